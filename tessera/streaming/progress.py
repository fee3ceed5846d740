"""Live progress of a job as lines of JSON: one event when a stage has been written, with the rows that an Observation counted on the way, and one result or error at the end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.storage import saved


class Progress:
    """OP-20, the producer. emit takes a line without its end; after a result or an error nothing more is emitted."""

    def __init__(self, emit: Callable[[str], None], total: int):
        self.emit, self.total, self.completed, self.ended = emit, total, 0, False

    def _say(self, **event: object) -> None:
        if not self.ended:
            self.emit(json.dumps(event))

    def stage(self, df: DataFrame, step: str, where: str | None = None) -> DataFrame:
        """df written and read back (see storage.saved); its rows, and those that have an error, are counted as they are written, without another pass."""
        seen = Observation()
        failed = F.count_if(F.col("error").isNotNull()) if "error" in df.columns else F.count_if(F.lit(False))
        back = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed")), where)
        self.completed += 1
        self._say(type="progress", step=step, completed=self.completed, total=self.total, rows=seen.get["rows"], failed=seen.get.get("failed") or 0)
        return back

    def run(self, job: Callable[[Progress], DataFrame]) -> DataFrame | None:
        """The result of job(self); as events its stages, then one result with its rows, or one error, after which None is returned."""
        try:
            out = job(self)
            seen = Observation()
            out = saved(out.observe(seen, F.count(F.lit(1)).alias("rows")))
            self._say(type="result", step="done", completed=self.total, total=self.total, rows=seen.get["rows"])
        except Exception as e:  # noqa: BLE001 - goes to the listener
            self._say(type="error", error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", completed=self.completed, total=self.total)
            out = None
        self.ended = True
        return out
