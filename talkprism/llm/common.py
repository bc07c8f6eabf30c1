"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8. ``bytes.split()`` splits at exactly the characters that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset, a folder of our own in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="talkprism-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    files = table.inputFiles()
    if files:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def heavy_keys(rows: DataFrame, on: list[str], spread: int = 8) -> tuple[DataFrame, int]:
    """The keys with more rows than a ``spread``-th of a shuffle partition's fair share (and over 64), with their counts, and that bound. At most ``spread`` keys a partition can be heavy, so the result may be broadcast."""
    bound = max(64, rows.count() // (spread * shuffle_partitions(rows.sparkSession)))
    counts = rows.where(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("heavy_rows")).where(F.col("heavy_rows") > bound)
    return materialize(counts, "heavy-keys"), bound


def spread_join(left: DataFrame, right: DataFrame, on: list[str], lot: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where few keys may hold much of ``left``: their rows are dealt over salts by ``lot``, a bigint, and the rows of ``right`` are repeated for each salt."""
    heavy, bound = heavy_keys(left.select(*on), on)
    salt, salts = free_name(left, "salt"), free_name(left, "salts")
    heavy = F.broadcast(heavy.select(*on, F.ceil(F.col("heavy_rows") / bound).cast("int").alias(salts)))
    many = F.coalesce(F.col(salts), F.lit(1))
    left = left.join(heavy, on, "left").withColumn(salt, F.pmod(lot, many).cast("int")).drop(salts)
    right = right.join(heavy, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(salts)
    return left.join(right, [*on, salt], how).drop(salt)


def lookup(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The inner join of ``left`` with ``right``, whose keys are unique, where few keys may hold much of ``left``: rows of heavy keys find their partner in a broadcast of those keys' rows, at most a few for each shuffle partition."""
    heavy, _ = heavy_keys(left.select(on), [on])
    few = right.join(F.broadcast(heavy.select(on)), on, "left_semi")
    light = left.join(F.broadcast(heavy.select(on)), on, "left_anti").join(right, on)
    return light.unionByName(left.join(F.broadcast(few), on))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle parallelism, which a cluster sizes to its data; bucket counts follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
