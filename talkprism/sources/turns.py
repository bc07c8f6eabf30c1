"""A table of conversation turns as transcript records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprism import schema
from talkprism.sources.rules import ROLE_KIND

SOURCES = schema.SOURCES[:5]


def records_of_turns(turns: DataFrame, start: str = "2025-01-01 00:00:00") -> DataFrame:
    """Records of (conv_id, turn, role, text): a conversation is a file and a session, a turn a line with one block, one minute after the one before; conversations start an hour apart and take the sources in turn."""
    kind = F.lit("Unclassified")
    for role, name in ROLE_KIND.items():
        kind = F.when(F.lower("role") == role, name).otherwise(kind)
    number = F.pmod("conv_id", F.lit(5)).cast("int")
    at = F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    agent = F.col("role") == "assistant"
    task = F.when(agent, F.concat(F.lit("task-"), F.pmod("turn", F.lit(2)).cast("string")))
    empty = [F.lit(None).cast("string").alias(n) for n in ("title", "tool_use_identifier", "output_path", "result", "usage")]
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), number + 1).alias("source"),
        F.concat(F.lit("root-"), number.cast("string")).alias("source_identifier"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"),
        (F.col("turn") + 1).cast("long").alias("line_number"),
        F.lit("table").alias("fingerprint"),
        at.alias("modified"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        text.alias("text"),
        F.lit(None).cast("string").alias("title"),
        F.when(agent, F.concat(F.lit("worker-"), F.pmod("turn", F.lit(3)).cast("string"))).alias("subagent_name"),
        F.when(F.col("role") == "user", "HumanAuthored").otherwise("AgentAuthored").alias("authored_status"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_identifier"),
        F.when(agent, F.struct(task.alias("task_identifier"), *empty)).alias("task"),
        F.array(F.struct(kind.alias("kind"), text.alias("text"), F.when(agent, task).alias("task_identifier"))).alias("blocks"),
    )
