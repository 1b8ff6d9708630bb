"""Rows and columns before and after each step, observed while the plan runs anyhow."""

from __future__ import annotations

import threading
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class StepLog:
    """``watch`` marks a frame; ``entries`` tells what has passed each mark once an action has run.

    A mark keeps filters from being pushed below it, so logging is for runs that ask for it.
    """

    def __init__(self):
        self.marks: list[tuple[str, DataFrame, Observation]] = []
        self.began = time.monotonic()

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation(f"step-{uuid.uuid4().hex}")
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        self.marks.append((step, out, seen))
        return out

    def entries(self, wait: float = 5.0) -> list[dict[str, Any]]:
        """step, columns, rowsIn, rowsOut, in order; rows are None where no action has reached a mark."""
        found: dict[int, int] = {}

        def ask(k: int, seen: Observation) -> None:
            found[k] = int(seen.get["rows"])

        asked = [threading.Thread(target=ask, args=(k, seen), daemon=True) for k, (_, _, seen) in enumerate(self.marks)]
        for t in asked:
            t.start()
        until = time.monotonic() + wait
        for t in asked:
            t.join(max(0.0, until - time.monotonic()))
        return [{"step": step, "columns": df.columns, "rowsIn": found.get(k - 1), "rowsOut": found.get(k)} for k, (step, df, _) in enumerate(self.marks)]
