"""A Spark data source for sound files: spark.read.format("sound") reads files of any length as chunks, df.write.format("sound") writes segments as files.

Reading. Options: path (a folder with all below it, or a file), rate (16000), seconds (30, of a chunk), split (32 MB). A file is dealt to tasks by its size, without being opened by the driver; a task reads the
header, then only the bytes of its own chunks and what the resampling filter reaches to. Options from and to (seconds) take the chunks that
overlap that time only, speaker one folder only: files are not opened, and chunks not read, that they rule out. With option pushdown, comparisons of file_id, speaker, chunk, first, start and end with constants do the
same; Spark 4.1 keeps what has been pushed for all uses of a loaded frame, so such a frame is for one query that reads it once, and the session must allow it (spark.sql.python.filterPushdown.enabled). Rows are chunks as in operators.signals, with the sub-folder as speaker and the times of a chunk.
What can't be read is a row with an error and null samples; chunks before a place that can't be read stay.

Writing. Rows (speaker, file_name, samples, ...) become path/speaker/file_name.wav or .flac (option encoding), of rate hertz. Tasks write below path/_staging; the commit moves the files of the attempts that counted, and
a failed or repeated attempt leaves nothing that a reader sees; a task that is still at work while its job is aborted may leave files below path/_staging. Characters that no name may have become "_"; of rows of one name one is kept. Null samples give an empty file. Mode overwrite removes what was there when the new files are complete.

Paths are what pyarrow's file systems take: local, hdfs, s3 and gs, or a path without a scheme.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessera.sources import flac
from tessera.sources.resample import Resampler

SCHEMA = "file_id string, speaker string, chunk int, first long, n int, start double, end double, rate int, samples array<float>, error string"
EXTENSIONS = (".wav", ".flac")
_ARROW = pa.schema([("file_id", pa.string()), ("speaker", pa.string()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
#: Codes of sample formats in a WAV header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Wav:
    """Where the samples of an open WAV file lie, and how to read any of them."""

    file: object
    rate: int
    channels: int
    width: int
    kind: int
    at: int
    frames: int

    @classmethod
    def opened(cls, file, size: int) -> Wav:
        head = file.read(12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError("not a WAV file")
        at, form = 12, None
        while True:
            file.seek(at)
            head = file.read(8)
            if len(head) < 8:
                raise ValueError("no samples in the WAV file")
            name, n = head[:4], struct.unpack("<I", head[4:])[0]
            if name == b"fmt ":
                form = file.read(min(n, 40))
            if name == b"data":
                break
            at += 8 + n + n % 2
        if form is None or len(form) < 16:
            raise ValueError("no format in the WAV file")
        kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", form[:16])
        if kind == EXTENSIBLE and len(form) >= 26:
            kind = struct.unpack("<H", form[24:26])[0]
        if (kind, bits) not in ((PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)) or not channels or not rate or align != channels * bits // 8:
            raise ValueError(f"WAV of format {kind} with {bits} bits and {channels} channels")
        return cls(file, rate, channels, bits // 8, kind, at + 8, min(n, size - at - 8) // align)

    def read(self, a: int, b: int) -> np.ndarray:
        """Frames a to b as one channel from -1 to 1, their mean."""
        step = self.channels * self.width
        self.file.seek(self.at + a * step)
        raw = self.file.read((b - a) * step)
        if len(raw) < (b - a) * step:
            raise ValueError("the WAV file ends early")
        return mono(raw, self.kind, self.width, self.channels)


def mono(raw: bytes, kind: int, width: int, channels: int) -> np.ndarray:
    if kind == FLOAT:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608).astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << 8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1)


def opened(file, size: int):
    """The reader of an open file, by its first bytes."""
    head = file.read(4)
    file.seek(0)
    return (flac.Flac if head == b"fLaC" else Wav).opened(file, size)


@dataclass
class Times:
    """Comparisons of a chunk's columns with constants."""

    tests: list[tuple[str, type, object]]

    def hold(self, **values) -> bool:
        how = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        return all(how[op](values[c], x) for c, op, x in self.tests if c in values)


def chunks(sound, rate: int, seconds: float, part: int = 0, parts: int = 1, times: Times = Times([])) -> Iterator[tuple[int, int, np.ndarray]]:
    """(chunk, first, samples) of the part-th of parts equal parts of an opened file, at rate. Only what these chunks need is read."""
    filter_ = Resampler(sound.rate, rate)
    total, each = filter_.length(sound.frames), max(1, int(seconds * rate))
    count = max(1, -(-total // each))
    for k in range(count * part // parts, count * (part + 1) // parts):
        a, b = k * each, min(total, (k + 1) * each)
        if times.hold(chunk=k, first=a, start=a / rate, end=b / rate):
            low = max(0, a * filter_.down // filter_.up - filter_.reach)
            high = min(sound.frames, -(-b * filter_.down // filter_.up) + filter_.reach)
            yield k, a, filter_.part(sound.read(low, max(low, high)), low, a, b) if b > a else np.zeros(0, np.float32)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


@dataclass
class Part(InputPartition):
    file: str
    size: int
    part: int
    parts: int


class SoundReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rate, self.seconds = options["path"], int(options.get("rate", 16_000)), float(options.get("seconds", 30))
        self.split, self.tests = int(options.get("split", 32 << 20)), []
        for name, column, op, kind in (("from", "end", GreaterThan, float), ("to", "start", LessThan, float), ("speaker", "speaker", EqualTo, str)):
            if name in options:
                self.tests.append((column, op, kind(options[name])))

    def partitions(self) -> list[Part]:
        store, top = located(self.path)
        info = store.get_file_info(top)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(top, recursive=True))
        out, times = [], Times(self.tests)
        for f in sorted(files, key=lambda f: f.path):
            hidden = any(p[:1] in "._" for p in f.path[len(top) :].strip("/").split("/") if p) and not info.is_file
            if f.is_file and not hidden and f.path.lower().endswith(EXTENSIONS) and times.hold(file_id=f.path, speaker=_folder(f.path)):
                n = max(1, -(-f.size // self.split))
                out += [Part(f.path, f.size, k, n) for k in range(n)]
        return out

    def read(self, p: Part | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # there are no files
            return
        store, _ = located(self.path)
        who, head = _folder(p.file), True
        try:
            with store.open_input_file(p.file) as file:
                sound = opened(file, p.size)
                head = False
                for k, a, x in chunks(sound, self.rate, self.seconds, p.part, p.parts, Times(self.tests)):
                    samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([*_ones(p.file, who, k, a, len(x), a / self.rate, (a + len(x)) / self.rate, self.rate), samples, pa.array([None], pa.string())], schema=_ARROW)
        except Exception as e:  # noqa: BLE001 - goes to the error column; what is wrong with a file's header is told once
            if p.part == 0 or not head:
                yield pa.RecordBatch.from_arrays(_ones(p.file, who, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"), schema=_ARROW)


class PushedReader(SoundReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            columns = ("file_id", "speaker", "chunk", "first", "start", "end")
            if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and len(f.attribute) == 1 and f.attribute[0] in columns and f.value is not None:
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f  # rows of files that can't be read have no times, so Spark looks again


def _ones(*values) -> list[pa.Array]:
    return [pa.array([v], _ARROW.field(k).type) for k, v in enumerate(values)]


def _folder(path: str) -> str | None:
    return path.rstrip("/").split("/")[-2] if path.count("/") > 1 else None


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class SoundWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rate, self.encoding, self.overwrite = options["path"], int(options.get("rate", 16_000)), options.get("encoding", "wav"), overwrite
        if self.encoding not in ("wav", "flac"):
            raise ValueError(f"encoding {self.encoding}")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, top = located(self.path)
        folder, made, n = f"{top}/_staging/{self.job}/{TaskContext.get().taskAttemptId() if TaskContext.get() else uuid.uuid4().hex}", set(), 0
        try:
            for row in rows:
                to = f"{folder}/{safe(row['speaker'])}"
                if to not in made:
                    store.create_dir(to, recursive=True)
                    made.add(to)
                x = np.asarray([] if row["samples"] is None else row["samples"], np.float32)
                with store.open_output_stream(f"{to}/{safe(row['file_name'])}.{self.encoding}") as out:
                    out.write(wav(x, self.rate) if self.encoding == "wav" else flac.encoded(whole(x)[:, None], self.rate))
                n += 1
        except BaseException:
            if made:
                store.delete_dir(folder)
            raise
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = located(self.path)
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(top)):
                if f.base_name != "_staging":
                    store.delete_dir(f.path) if f.type == pafs.FileType.Directory else store.delete_file(f.path)
        for m in messages:
            if m is not None and m.files:
                for f in store.get_file_info(pafs.FileSelector(m.folder, recursive=True)):
                    if f.is_file:
                        to = f"{top}/{f.path[len(m.folder) + 1 :]}"
                        store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                        store.move(f.path, to)
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, store: pafs.FileSystem, top: str) -> None:
        for folder in (f"{top}/_staging/{self.job}", f"{top}/_staging"):
            if store.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(pafs.FileSelector(folder))):
                store.delete_dir(folder)


def safe(name: object) -> str:
    """A name that stays in its folder."""
    name = re.sub(r"[/\\\x00-\x1f]", "_", "" if name is None else str(name))
    return f"_{name}" if name in ("", ".", "..") or name.startswith(("_", ".")) else name


def whole(x: np.ndarray) -> np.ndarray:
    """Samples from -1 to 1 as 16-bit numbers."""
    return (np.clip(np.nan_to_num(x), -1, 1) * 32767).astype(np.int32)


def wav(x: np.ndarray, rate: int) -> bytes:
    data = whole(x).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


class Sound(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SoundReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown", "false").lower() == "true" else SoundReader)(options)

    def writer(self, schema, overwrite: bool) -> SoundWriter:
        if missing := {"speaker", "file_name", "samples"} - set(schema.names):
            raise ValueError(f"no column {sorted(missing)}")
        return SoundWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session; its workers need the package (see session.shipped)."""
    spark.dataSource.register(Sound)
    return spark


def decoded_bytes(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a whole file in memory."""
    sound = opened(io.BytesIO(content), len(content))
    return sound.read(0, sound.frames), sound.rate
