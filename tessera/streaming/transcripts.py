"""Live transcripts: chunks that arrive in any order, with state for each file that survives a restart. Streams need the RocksDB state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Ordered(StatefulProcessor):
    """Hands a file's rows on in the order of ord, from 0: what comes early waits, what comes twice is dropped; a row that is missing is given up once the watermark has passed the waiting rows by patience milliseconds."""

    def __init__(self, step: Callable, empty: tuple, state: str, columns: list[str], names: list[str], patience: int):
        self.step, self.empty, self.schema, self.columns, self.names, self.patience = step, empty, state, columns, names, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", f"due long, {self.schema}")
        self.early = handle.getMapState("early", "ord long", ", ".join(self.columns))

    def _run(self, key: tuple, skip: bool) -> pd.DataFrame:
        due, *held = self.at.get() if self.at.exists() else (0, *self.empty)
        out = []
        while True:
            if not self.early.containsKey((due,)):
                waiting = [k[0] for k in self.early.keys()] if skip else []
                if not waiting:
                    break
                due = min(waiting)
            row = self.early.getValue((due,))
            self.early.removeKey((due,))
            got, held = self.step(row, tuple(held))
            out += [(key[0], due, *g) for g in got]
            due += 1
        self.at.update((due, *held))
        return pd.DataFrame(out, columns=["file_id", "ord", *self.names])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, now = self.at.get()[0] if self.at.exists() else 0, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            now = max(now, int(pdf["ms"].max()))
            for r in pdf[["ord", *[c.split()[0] for c in self.columns]]].itertuples(index=False):
                if r[0] >= due and not self.early.containsKey((int(r[0]),)):
                    self.early.updateValue((int(r[0]),), tuple(r[1:]))
        yield self._run(key, False)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(True for _ in self.early.keys()):
            self.handle.registerTimer(now + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key, True)

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, step: Callable, empty: tuple, state: str, columns: list[str], names: list[str], out: str, delay: str, patience: float) -> DataFrame:
    processor = _Ordered(step, empty, state, columns, names, int(patience * 1000))
    kind = dict(rows.dtypes)["file_id"]
    marked = rows.withWatermark("ts", delay).select("file_id", "ts", F.unix_millis("ts").alias("ms"), F.col("ord").cast("long").alias("ord"), *[c.split()[0] for c in columns])
    return marked.groupBy("file_id").transformWithStateInPandas(processor, f"file_id {kind}, ord long, {out}", "append", "eventTime")


def carried_stream(chunks: DataFrame, model, prefix, delay: str = "1 minute", patience: float = 600.0) -> DataFrame:
    """OP-88 on a stream (file_id, ts, ord, text): (file_id, ord, text) of what model(text, carried) gives of each chunk in order; prefix(text) is carried to the next. Empty results give no row.
    A chunk that is missing is waited for until the watermark is patience seconds on; one that comes later still is dropped, as are repeated ones."""

    def step(row: tuple, held: tuple) -> tuple[list, tuple]:
        got = model(row[0], held[0])
        return ([(got,)] if got else []), (prefix(got),)

    return _ordered(chunks, step, ("",), "carried string", ["text string"], ["text"], "text string", delay, patience)


def packed_stream(segments: DataFrame, most: float = 30.0, delay: str = "1 minute", patience: float = 600.0) -> DataFrame:
    """OP-47 on a stream (file_id, ts, ord, start, end): (file_id, ord, start, end, group), each segment as soon as those before it are there."""

    def step(row: tuple, held: tuple) -> tuple[list, tuple]:
        (start, end), (group, size, some) = row, held
        if some and size + end - start > most:
            group, size = group + 1, 0.0
        return [(start, end, group)], (group, size + end - start, True)

    return _ordered(segments, step, (0, 0.0, False), "grp long, size double, some boolean", ["start double", "end double"], ["start", "end", "group"], "start double, end double, `group` long", delay, patience)
