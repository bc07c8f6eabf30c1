"""Changes of configured repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE = "repository string, path string, commit_identifier string, commit_timestamp string, changed_paths array<string>, worktree_state string"


def configured_changes(changes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows of ``changes`` whose repository is configured (column repository)."""
    return changes.join(repositories.select("repository").distinct(), "repository", "left_semi")


def uncollected(repositories: DataFrame, reason: str = "UnsupportedFormat") -> DataFrame:
    """A failure for each repository that no collector serves."""
    return repositories.select(F.lit("Repository").alias("source"), F.col("repository").alias("source_identifier"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line_number"), F.lit(reason).alias("reason"))
