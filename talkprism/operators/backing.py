"""What stands behind many references now: their files and lines, compared with the index.

A batch of references is a table. Their rows in the index name the backing files; a listing of the
roots (no contents) says which of these are gone or have another length or time. Only files that
look unchanged are opened, by the range of their times (a filter of the reader), and of each only
the lines that the batch names are parsed; their texts and kinds are compared with the index. So a
reference is Fresh, Stale (the file, the text or the kind is another), Broken (the file is gone or
the line is) or Missing (the index has no such reference).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprism.functions.text import utf8_prefix
from talkprism.sources.jsonl import Root, discover, exists, file_contents, fingerprint, long_lines, pieces, takes_long, with_parsed


def listed(spark: SparkSession, roots: list[Root]) -> DataFrame:
    """(source, source_identifier, path, now): the state of every transcript file of the roots; a root that is gone has none."""
    parts = [discover(spark, r).select(F.lit(r.source).alias("source"), F.lit(r.identifier).alias("source_identifier"), "path", "length", "modified") for r in roots if exists(spark, r.path)]
    if not parts:
        return spark.createDataFrame([], "source string, source_identifier string, path string, length long, modified timestamp, now string")
    return reduce(DataFrame.unionByName, parts).withColumn("now", fingerprint(F.col("length"), F.col("modified")))


def with_lifecycle(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Session cards with ``lifecycle`` (Current, or SourceMissing where the file is gone), and the number, bytes and time of its files as ``listed`` now. Repeated paths count once."""
    now = files.groupBy("source", "source_identifier", "path").agg(F.max("length").alias("file_bytes"), F.max("modified").alias("file_modified"))
    rows = sessions.join(now, ["source", "source_identifier", "path"], "left")
    there = F.col("file_bytes").isNotNull()
    return rows.withColumns({"lifecycle": F.when(there, "Current").otherwise("SourceMissing"), "file_count": there.cast("long")})


def _lines(spark: SparkSession, root: Root, wanted: DataFrame) -> DataFrame:
    """(path, line_number, p) of the wanted lines (path, line_number, time) of a root, parsed; no row for a line that is gone or over the cap."""
    span = wanted.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    if span["first"] is None:
        return spark.createDataFrame([], "path string, line_number long, p struct<text:string,blocks:array<struct<kind:string,text:string>>>")
    contents = file_contents(spark, root).where(F.col("modified").between(F.lit(span["first"]), F.lit(span["last"])))
    contents = contents.join(wanted.select("path").distinct(), "path", "left_semi")
    # One row a line, joined with the lines asked for: a row that carries all lines of its file would be repeated for each of them.
    rows = contents.select("path", F.posexplode(pieces(F.col("content"))).alias("at", "raw"))
    rows = rows.select("path", (F.col("at") + 1).cast("long").alias("line_number"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    if takes_long(root):
        more = long_lines(spark, root, (span["first"], span["last"])).where("line_number <= last")
        rows = rows.unionByName(more.select("path", "line_number", F.regexp_replace("raw", "\r$", "").alias("raw")))
    rows = rows.join(wanted.select("path", "line_number").distinct(), ["path", "line_number"], "left_semi")
    rows = with_parsed(rows.where(F.octet_length("raw") <= root.limits.line_bytes), root.source)
    return rows.where("not p.malformed").select("path", "line_number", F.struct("p.text", "p.blocks").alias("p"))


def _differs(collection: str) -> Column:
    """Whether the line parsed now gives another text or kind than the index has."""
    if collection == "outputs":
        return F.md5(F.col("p.text").cast("binary")) != F.col("text_hash")
    block = F.get("p.blocks", F.col("block_index").cast("int"))
    return ~(F.md5(block["text"].cast("binary")).eqNullSafe(F.col("text_hash")) & block["kind"].eqNullSafe(F.col("kind")))


def read_many(tables: dict[str, DataFrame], references: DataFrame, roots: list[Root], maximum: int, collection: str = "blocks") -> DataFrame:
    """(reference, state, text, text_state) for a batch (column ``reference``) of blocks or outputs; text only where it is Fresh, at most ``maximum`` bytes of the line as it is now.

    Repeated references give one row; a null one is Missing. The batch is joined, not collected.
    """
    spark, name = references.sparkSession, f"{collection[:-1]}_reference"
    own = ["block_index", "kind"] if collection == "blocks" else []
    rows = tables[collection].select(F.col(name).alias("reference"), "source", "source_identifier", "path", "line_number", "fingerprint", "text_hash", *own)
    files = listed(spark, roots).select("source", "source_identifier", "path", "now", F.col("modified").alias("time"))
    batch = references.select("reference").distinct().join(rows, "reference", "left").join(files, ["source", "source_identifier", "path"], "left")
    same = batch.where("fingerprint = now")
    parts = []
    for root in roots:
        if exists(spark, root.path):
            mine = same.where((F.col("source") == root.source) & (F.col("source_identifier") == root.identifier))
            lines = _lines(spark, root, mine.select("path", "line_number", "time").distinct())
            lines = lines.select(F.lit(root.source).alias("source"), F.lit(root.identifier).alias("source_identifier"), "path", "line_number", F.struct("p.text", F.transform("p.blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"))).alias("blocks")).alias("p"))
            parts.append(lines)
    if parts:
        batch = batch.join(reduce(DataFrame.unionByName, parts), ["source", "source_identifier", "path", "line_number"], "left")
    else:
        batch = batch.withColumn("p", F.lit(None).cast("struct<text:string,blocks:array<struct<kind:string,text:string>>>"))
    state = (
        F.when(F.col("path").isNull(), "Missing")
        .when(F.col("now").isNull(), "Broken")
        .when(F.col("now") != F.col("fingerprint"), "Stale")
        .when(F.col("p").isNull(), "Broken")
        .when(_differs(collection), "Stale")
        .otherwise("Fresh")
    )
    whole = F.col("p.text") if collection == "outputs" else F.get("p.blocks", F.col("block_index").cast("int"))["text"]
    batch = batch.withColumns({"state": state, "whole": whole})
    fresh = F.col("state") == "Fresh"
    cut = F.when(F.octet_length("whole") > maximum, "Truncated").when(F.col("whole").isNotNull(), "Complete")
    return batch.select("reference", "state", F.when(fresh, utf8_prefix("whole", maximum)).alias("text"), F.when(fresh, cut).alias("text_state"))
