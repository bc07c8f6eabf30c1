"""Conjunctive filters of listings; None leaves a dimension open."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprism.functions.timestamps import within


@dataclass(frozen=True)
class Filter:
    sources: tuple[str, ...] | None = None
    session: str | None = None
    subagent: str | None = None
    output: str | None = None
    task: str | None = None
    authored: str | None = None
    kinds: tuple[str, ...] | None = None
    window: Any = None

    def apply(self, rows: DataFrame, time: str = "timestamp") -> DataFrame:
        for value, column in ((self.session, "session_reference"), (self.subagent, "subagent_reference"), (self.output, "output_reference"), (self.task, "task_identifier"), (self.authored, "authored_status")):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        for values, column in ((self.sources, "source"), (self.kinds, "kind")):
            if values is not None:
                rows = rows.where(F.col(column).isin(list(values)))
        return rows if self.window is None else rows.where(within(F.col(time), self.window))
