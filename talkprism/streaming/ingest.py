"""New transcript lines as they arrive: the same parsing as the batch scan, appended to a table.

The file source's checkpoint replaces a scan cursor: only new files are read, and a restarted
query goes on where it stopped. Each micro-batch is written under its own number, so a batch that
runs twice leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkprism.sources.jsonl import parsed


def line_stream(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(source, path, p): parsed lines of new files below ``folder``."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    return lines.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("path"), parsed(F.lit(source), F.col("value")).alias("p"))


def block_stream(lines: DataFrame) -> DataFrame:
    """One row a block of the stream's readable lines."""
    flat = lines.where("not p.malformed").select("source", "path", F.col("p.timestamp").alias("timestamp"), F.posexplode("p.blocks").alias("block_index", "block"))
    return flat.select("source", "path", "timestamp", "block_index", "block.kind", "block.text")


def kinds_by_window(lines: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Blocks by kind and hour of their timestamps, closed by a watermark."""
    rows = block_stream(lines).withColumn("at", F.try_to_timestamp("timestamp")).where("at is not null")
    return rows.withWatermark("at", late).groupBy(F.window("at", every), "kind").agg(F.count(F.lit(1)).alias("n"))


def append_blocks(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the blocks of all available lines below ``table``, one folder a batch, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return block_stream(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
