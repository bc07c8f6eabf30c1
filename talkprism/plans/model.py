"""The derived tables: sessions, subagents, outputs, segments and blocks of transcript records.

All come from one pass over the records; parent rows are aggregates, so a session's first record
is found by ``min_by`` with map-side combine and no session is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprism.functions.text import byte_length, line_count, reference

PREVIEW_BYTES = 65_536


def keyed(records: DataFrame) -> DataFrame:
    """Records with the references of their session, subagent and output. A record without a producer's session id has one session a file state."""
    known = reference("session", F.lit("producer-session"), "source", "source_identifier", "session_identifier")
    other = reference("session", "source", "source_identifier", "path", "fingerprint")
    rows = records.withColumn("session_reference", F.when(F.col("session_identifier").isNotNull(), known).otherwise(other))
    rows = rows.withColumn("subagent_reference", F.when(F.col("subagent_name").isNotNull(), reference("subagent", "session_reference", "subagent_name")))
    own = reference("output", "source", "source_identifier", "path", "line_number", "fingerprint", F.md5(F.col("text").cast("binary")))
    return rows.withColumn("output_reference", own)


def unique(rows: DataFrame) -> DataFrame:
    """Keyed records without repeats: a reference names a line of a file state, so equal references are equal rows.

    The tables below take unique rows; this is the only step that shuffles whole records, and a
    publication does it once.
    """
    return rows.dropDuplicates(["output_reference"])


def outputs(rows: DataFrame) -> DataFrame:
    """One row a record."""
    return rows.select(
        "output_reference",
        "session_reference",
        "subagent_reference",
        "source",
        "source_identifier",
        "path",
        "line_number",
        "fingerprint",
        F.col("timestamp").alias("produced_at"),
        "title",
        "authored_status",
        F.col("task.task_identifier").alias("task_identifier"),
        byte_length("text").alias("bytes"),
        line_count("text").alias("lines"),
        F.md5(F.col("text").cast("binary")).alias("text_hash"),
        "text",
    )


def segments(outs: DataFrame) -> DataFrame:
    """Each output's one segment: the whole of it."""
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return outs.select(
        reference("segment", "output_reference", F.lit("0")).alias("segment_reference"),
        "output_reference",
        F.lit(0).cast("long").alias("segment_index"),
        span(F.lit(0), F.col("bytes")).alias("byte_range"),
        span(F.lit(1), F.col("lines") + 1).alias("line_range"),
        "text",
    )


def blocks(rows: DataFrame) -> DataFrame:
    """One row a block, numbered from 0 in its record."""
    flat = rows.select("*", F.posexplode("blocks").alias("at", "block"))
    own = reference("block", "source", "source_identifier", "path", "line_number", "fingerprint", F.md5(F.coalesce("block.text", F.lit("")).cast("binary")), "at", "block.kind")
    text = F.col("block.text")
    return flat.select(
        own.alias("block_reference"),
        "session_reference",
        "subagent_reference",
        "output_reference",
        "source",
        "source_identifier",
        "path",
        "line_number",
        F.col("at").cast("long").alias("block_index"),
        F.col("block.kind").alias("kind"),
        "timestamp",
        "authored_status",
        F.col("block.task_identifier").alias("task_identifier"),
        F.when(text.isNull(), "Unavailable").otherwise("ReadableText").alias("availability"),
        F.coalesce(byte_length(text), F.lit(0)).alias("bytes"),
        F.coalesce(line_count(text), F.lit(0)).alias("lines"),
        "fingerprint",
        F.md5(text.cast("binary")).alias("text_hash"),
        text.alias("text"),
    )


def _first(column: str):
    return F.min_by(F.struct(column), F.struct("path", "line_number"))[column].alias(column)


def sessions(rows: DataFrame) -> DataFrame:
    """One row a session: its first record's values, counts, and the last time seen (latest text of a time)."""
    return rows.groupBy("session_reference").agg(
        _first("source"),
        _first("source_identifier"),
        _first("path"),
        _first("session_identifier"),
        _first("authored_status"),
        _first("title"),
        F.min_by("timestamp", F.struct("path", "line_number")).alias("started_at"),
        F.max("timestamp").alias("last_observed_at"),
        F.max("modified").alias("modified"),
        F.count(F.lit(1)).alias("output_count"),
        F.count_distinct("subagent_reference").alias("subagent_count"),
        F.min_by(byte_length("text"), F.struct("path", "line_number")).alias("first_bytes"),
        F.sum(byte_length("text")).alias("total_bytes"),
    ).withColumn("role", F.when(F.col("source") == "Claude", "MainSession").when(F.col("source").endswith("SubagentOutput"), "SubagentOutputSession").otherwise("Unknown"))


def subagents(rows: DataFrame) -> DataFrame:
    """One row a named subagent of a session."""
    return (
        rows.where("subagent_reference is not null")
        .groupBy("subagent_reference")
        .agg(
            _first("session_reference"),
            _first("subagent_name"),
            _first("authored_status"),
            F.min_by("task.task_identifier", F.struct("path", "line_number")).alias("task_identifier"),
            F.min_by("timestamp", F.struct("path", "line_number")).alias("first_observed_at"),
            F.max("timestamp").alias("last_observed_at"),
            F.count(F.lit(1)).alias("output_count"),
        )
    )


def parent_child_counts(children: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct children of each parent."""
    return children.groupBy(parent).agg(F.count_distinct(child).alias("child_count"))


def authorship(rows: DataFrame, by: str) -> DataFrame:
    """Authorship of a group: none is unknown, several are mixed."""
    known = F.collect_set("authored_status")
    folded = F.when(F.size(known) == 0, "UnknownAuthorship").when(F.size(known) > 1, "MixedAuthorship").otherwise(F.get(known, F.lit(0)))
    return rows.groupBy(by).agg(folded.alias("authored_status"))


def digest(rows: DataFrame, reference_column: str) -> DataFrame:
    """(n, digest) of a table, whatever its order: row hashes are added, in two halves that can't overflow."""
    half = lambda k: F.conv(F.substring(F.md5(F.col(reference_column).cast("binary")), k, 8), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *[F.coalesce(F.sum(half(k)), F.lit(0)).cast("string") for k in (1, 9)]).alias("digest"))
