"""Places inside groups by a distributed sort, so that a group may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkprism.llm.common import free_name, materialize


def placed(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """``rows`` in a table sorted by ``keys``, with ``at``: the partition in its upper 31 bits, the place in it below.

    Rows that agree in all keys are told apart by where they were read, so they don't fill one
    range. ``rows`` should come from a table that is written, as it is read twice (once to sample
    the ranges).
    """
    tie = free_name(rows, "tie")
    dealt = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    return materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "placed")


def ranked(rows: DataFrame, group: str, order: list[Column], attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order``) in their group and ``n``, the rows of it.

    No group is gathered: a place is that in a sorted partition plus the counts of the partitions
    before, of which a group has one for each partition. ``attach`` may add columns to (group, n),
    one row a group; rows get them by group and partition, so a large group is no hot key. The
    group's column must not be null.
    """
    table = placed(rows, [group, *order])
    part = F.shiftrightunsigned("at", 33)
    runs = table.groupBy(part.alias("part"), group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("run"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("run").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("part", group, (before - F.col("first")).alias("shift"), F.sum("run").over(own).alias("n")), "runs")
    if attach:
        runs = runs.drop("n").join(attach(runs.groupBy(group).agg(F.max("n").alias("n"))), group)
    return table.withColumn("part", part).join(runs, ["part", group]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")
