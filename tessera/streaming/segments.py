"""Streams: merging segments as they arrive, and replaying progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.audio import parse_progress

_STATE = "speaker string, start double, end double, n long"


def collapse_stream(segments: DataFrame, gap: float = 0.0, delay: str = "10 minutes") -> DataFrame:
    """Same-speaker merging of a stream (file_id, ts, start, end, speaker), in order within a file: a merged segment comes out when the next one of its file starts, the last when the watermark has passed it. State is one open segment a file."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], *state.get))
            state.remove()
        else:
            open_ = list(state.get) if state.exists else None
            rows = pd.concat(list(frames)).sort_values("start", kind="stable")
            for s, e, who in rows[["start", "end", "speaker"]].itertuples(index=False):
                if open_ and open_[0] == who and s - open_[2] <= gap:
                    open_[2], open_[3] = max(open_[2], e), open_[3] + 1
                else:
                    if open_:
                        out.append((key[0], *open_))
                    open_ = [who, s, e, 1]
            state.update(tuple(open_))
            late = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1
            state.setTimeoutTimestamp(late)
        yield pd.DataFrame(out, columns=["file_id", "speaker", "start", "end", "n"])

    marked = segments.withWatermark("ts", delay).select("file_id", "ts", "start", "end", "speaker")
    return marked.groupBy("file_id").applyInPandasWithState(step, f"file_id {dict(segments.dtypes)['file_id']}, {_STATE}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress_stream(lines: DataFrame) -> DataFrame:
    """Latest state of each job from a stream of (job, value) JSON lines: completed, total and whether its result has come."""
    e = parse_progress(lines, "job")
    return e.groupBy("job").agg(F.max("completed").alias("completed"), F.max("total").alias("total"), F.max((F.col("type") == "result").cast("int")).alias("done"))
