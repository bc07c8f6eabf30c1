"""State of sources and the inventory of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Worst last.
COMPLETENESS = ("Complete", "Resumable", "Truncated", "Failed")


def source_health(roots: DataFrame, records: DataFrame, failures: DataFrame, truncations: DataFrame) -> DataFrame:
    """Per configured source: records and files with some, malformed lines, other failures, and one status, the gravest that applies. ``roots``: source, source_identifier."""
    key = ["source", "source_identifier"]
    good = records.groupBy(*key).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("path").alias("files"))
    bad = failures.groupBy(*key).agg(F.sum((F.col("reason") == "Malformed").cast("long")).alias("malformed"), F.sum((F.col("reason") != "Malformed").cast("long")).alias("unreadable"))
    cut = truncations.groupBy(*key).agg(F.count(F.lit(1)).alias("truncations"))
    rows = roots.join(good, key, "left").join(bad, key, "left").join(cut, key, "left").na.fill(0, ["records", "files", "malformed", "unreadable", "truncations"])
    return graded(rows)


def graded(rows: DataFrame) -> DataFrame:
    """Status and completeness by the counts of a source: records, malformed, unreadable, truncations."""
    status = F.when(F.col("unreadable") > 0, "Unreadable").when(F.col("truncations") > 0, "DiscoveryTruncated").when(F.col("malformed") > 0, "Malformed").when(F.col("records") == 0, "Empty").otherwise("Indexed")
    rows = rows.withColumn("status", status)
    grade = F.when(F.col("status") == "Unreadable", 3).when(F.col("status").isin("DiscoveryTruncated", "Malformed"), 2).otherwise(0)
    return rows.withColumn("completeness", F.element_at(F.array(*[F.lit(c) for c in COMPLETENESS]), grade + 1))


def completeness(health: DataFrame) -> DataFrame:
    """The gravest completeness of all sources, one row."""
    names = F.array(*[F.lit(c) for c in COMPLETENESS])
    return health.agg(F.element_at(names, F.coalesce(F.max(F.array_position(names, F.col("completeness"))), F.lit(1)).cast("int")).alias("completeness"))


def source_report(sessions: DataFrame) -> DataFrame:
    """Per source: sessions, bytes, oldest and newest change."""
    return sessions.groupBy("source", "source_identifier").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("total_bytes").alias("bytes"), F.min("modified").alias("oldest_modified"), F.max("modified").alias("newest_modified")
    )


def with_source_state(sessions: DataFrame, configured: DataFrame) -> DataFrame:
    """Sessions with their source's status, completeness and scan report. ``configured``: one row a source, so it is small beside the sessions."""
    report = configured.select("source", "source_identifier", F.col("status").alias("source_status"), F.col("completeness").alias("source_completeness"), F.struct("records", "files", "malformed", "unreadable", "truncations").alias("scan_report"))
    return sessions.join(report, ["source", "source_identifier"], "left").withColumn("source_status", F.coalesce("source_status", F.lit("Unconfigured")))


def archive_status(sessions: DataFrame, archived: DataFrame | None) -> DataFrame:
    """Sessions with ArchiveUnknown where no archive can be read or it is empty, else Archived or NotArchived."""
    if archived is None:
        return sessions.withColumn("archive_status", F.lit("ArchiveUnknown"))
    refs = archived.select("session_reference").distinct().withColumn("in_archive", F.lit(True))
    some = archived.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    status = F.when(F.col("in_archive"), "Archived").when(some == 0, "ArchiveUnknown").otherwise("NotArchived")
    return sessions.join(refs, "session_reference", "left").withColumn("archive_status", status).drop("in_archive")
