"""Evidence under budgets: volumes, segment caps, byte budgets, projections; limits hold per source."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprism.errors import InvalidRequest, LimitExceeded
from talkprism.functions.text import byte_length, utf8_prefix
from talkprism.functions.timestamps import Clock, instant, within

SCAN_ORDER = ("path", "line_number")


@dataclass(frozen=True)
class Budget:
    segments: int
    bytes: int
    bound: int | None = None  # of one text; None projects no text
    metadata_only: bool = False

    def __post_init__(self):
        if self.segments <= 0 or self.bytes <= 0 or self.bound is not None and self.bound <= 0:
            raise LimitExceeded("limits must be positive")


def volumes(records: DataFrame) -> DataFrame:
    """Per source: records, bytes, first and last timestamp by instant, in their own text. Counts all records of the window, past any cap."""
    at = instant(F.col("timestamp"))
    return records.groupBy("source", "source_identifier").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(byte_length("text")).alias("bytes"),
        F.min_by("timestamp", at).alias("first_timestamp"),
        F.max_by("timestamp", at).alias("last_timestamp"),
    )


def capped(records: DataFrame, segments: int) -> DataFrame:
    """The first records of each source in scan order, with their place from 1. The rank filter is pushed into the window, so tasks keep only the first rows of a source before the shuffle."""
    order = Window.partitionBy("source", "source_identifier").orderBy(*SCAN_ORDER)
    return records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= segments)


def bounded_texts(records: DataFrame, budget: Budget) -> DataFrame:
    """Excerpts of the capped records: each at most ``bound`` bytes and at most what is left of its source's bytes.

    Up to the row at which a running sum of the bounded lengths passes the budget, what is left
    is the budget less the sum before. That row is cut at a character, which leaves at most three
    bytes; each later row that can use some of them leaves fewer, so three more steps settle all
    rows. All of it is windows over the order that the cap has sorted: no further shuffle.
    """
    source = Window.partitionBy("source", "source_identifier")
    before = source.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = capped(records, budget.segments).select("source", "source_identifier", "place", "path", "line_number", "timestamp", "text", byte_length("text").alias("bytes"))
    rows = rows.withColumn("own", F.coalesce(byte_length(utf8_prefix("text", budget.bound)), F.lit(0)))
    rows = rows.withColumn("left", F.lit(budget.bytes).cast("long") - F.coalesce(F.sum("own").over(before), F.lit(0)))
    length = lambda limit: F.coalesce(byte_length(utf8_prefix("text", limit)), F.lit(0))
    rows = rows.withColumn("cut_at", F.min(F.when(F.col("own") > F.col("left"), F.col("place"))).over(source))
    here, later = F.col("place") == F.col("cut_at"), F.col("place") > F.col("cut_at")
    rows = rows.withColumn("rest", F.max(F.when(here, F.col("left") - length(F.col("left")))).over(source))
    rows = rows.withColumn("left", F.when(later, F.col("rest")).otherwise(F.col("left")))
    for _ in range(3):
        uses = F.when(later, length(F.col("rest")))
        rows = rows.withColumn("used", uses).withColumn("cut_at", F.min(F.when(F.col("used") > 0, F.col("place"))).over(source))
        rows = rows.withColumn("rest", F.col("rest") - F.coalesce(F.max(F.when(here, F.col("used"))).over(source), F.lit(0)))
        rows = rows.withColumn("left", F.when(later, F.col("rest")).otherwise(F.col("left")))
    rows = rows.withColumn("excerpt", utf8_prefix("text", F.least(F.lit(budget.bound).cast("long"), F.col("left"))))
    reason = F.when(byte_length("excerpt") < F.col("bytes"), F.when(F.col("left") < budget.bound, "RequestLimit").otherwise("ProjectionLimit"))
    return rows.select("source", "source_identifier", "place", "path", "line_number", "timestamp", "excerpt", "bytes", reason.alias("truncation"))


@dataclass(frozen=True)
class Evidence:
    request_id: str
    window: Any
    volumes: DataFrame
    segments: DataFrame
    truncations: DataFrame
    failures: DataFrame


def collect(records: DataFrame, failures: DataFrame, request_id: str, window, budget: Budget, clock: Clock, sources: tuple[str, ...] | None = None) -> Evidence:
    """The evidence package of a request, as lazy DataFrames. Sources are pruned before anything is read."""
    if not request_id:
        raise InvalidRequest("a request needs an id")
    window = clock.lower(window)
    if sources is not None:
        records, failures = records.where(F.col("source").isin(list(sources))), failures.where(F.col("source").isin(list(sources)))
    inside = records.where(within(F.col("timestamp"), window)) if window is not None else records
    seen = volumes(inside)
    if budget.bound is not None:
        found = bounded_texts(inside, budget)
    else:
        names = ["path", "line_number"] if not budget.metadata_only else ["line_number"]
        found = capped(inside, budget.segments).select("source", "source_identifier", "place", *names, "timestamp", byte_length("text").alias("bytes"))
    cut = seen.where(F.col("record_count") > budget.segments).select("source", "source_identifier", F.lit("RequestLimit").alias("reason"))
    return Evidence(request_id, window, seen, found, cut, failures)
