"""A store of voiceprints in versions: readers keep a snapshot, writers add versions and never lose one another's names.

path/data/<id> holds a version's rows as Parquet, path/versions/<number> is its manifest, a line of JSON that names the data. A version exists from the moment its manifest is renamed into place, which
fails if another writer has taken the number; that writer's version is then read and the change made again on it. What is left of a write that never got so far is not seen by anyone and goes with vacuum.
Any store that Spark reads will do if its rename doesn't replace files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, v array<double>, pitch_hz double, energy_rms double, total_speech_sec double"


class Conflict(Exception):
    """Another writer has added a version meanwhile."""


class Voiceprints:
    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA):
        self.spark, self.top, self.schema = spark, path.rstrip("/"), schema
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.top, *parts]))

    def _store(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        if not self._store().exists(self._path("versions")):
            return []
        return sorted(int(n) for f in self._store().listStatus(self._path("versions")) if (n := f.getPath().getName()).isdigit())

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.top}/versions/{version:012d}").first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """OP-08: the rows of a version, of the last one if none is given; none if there is no version. Later writes don't change what has been read."""
        have = self.versions()
        if version is None and not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.top}/data/{self.manifest(have[-1] if version is None else version)['data']}")

    def write(self, df: DataFrame, parent: int) -> int:
        """df as the version after parent (0: the first). Raises Conflict, and leaves no version, if there is one already."""
        data = uuid.uuid4().hex
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.top}/data/{data}")
        return self._swap(data, parent)

    def _swap(self, data: str, parent: int) -> int:
        store, at = self._store(), self._path("versions", f"{parent + 1:012d}")
        temp = self._path("versions", f"_{data}")
        out = store.create(temp, True)
        out.write(bytearray(json.dumps({"data": data, "parent": parent}).encode() + b"\n"))
        out.close()
        try:
            if store.exists(at):
                raise Conflict(f"version {parent + 1} is there")
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._fs.FileContext.getFileContext(temp.toUri(), self._conf).rename(temp, at, none)
        except Exception as e:
            store.delete(temp, False)
            if isinstance(e, Conflict) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {parent + 1} is there") from e
            raise
        return parent + 1

    def change(self, how: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """A version of how(the last version's rows); made again on what another writer has added meanwhile."""
        for k in range(tries):
            parent = max(self.versions(), default=0)
            try:
                return self.write(how(self.read()), parent)
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError

    def upsert(self, samples: DataFrame, skip_existing: bool = False) -> int:
        """OP-08, 61: samples (name, v, pitch_hz, energy_rms, duration) blended into the stored voiceprints."""
        from tessera.operators.vectors import refined

        return self.change(lambda stored: refined(samples, stored, skip_existing))

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last keep versions, and data of no version; for when nobody reads older ones or writes. Returns how many data folders went."""
        store, have = self._store(), self.versions()
        for v in have[:-keep]:
            store.delete(self._path("versions", f"{v:012d}"), False)
        used = {self.manifest(v)["data"] for v in have[-keep:]}
        gone = [f.getPath() for f in store.listStatus(self._path("data")) if f.getPath().getName() not in used] if store.exists(self._path("data")) else []
        for p in gone:
            store.delete(p, True)
        return len(gone)
