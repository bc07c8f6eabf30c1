"""Transcript files as DataFrames: bounded discovery, exact line numbers, records and failures."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism import schema
from talkprism.functions.timestamps import instant
from talkprism.sources import rules, variant


#: Files up to this length are read as one value; the lines of longer ones come from the splits of Spark's text reader.
WHOLE_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Limits:
    """Caps of one scan of one root; the defaults are fixed values, and the most a configuration may ask for. ``file_bytes`` None: files of any length, for roots that a program names."""

    entries: int = 131_072
    files: int = 32_768
    file_bytes: int | None = WHOLE_BYTES
    line_bytes: int = 256 * 1024
    failures: int = 1024


@dataclass(frozen=True)
class Root:
    """A configured directory of transcripts."""

    path: str
    source: str
    identifier: str
    limits: Limits = Limits()

    @property
    def extension(self) -> str:
        return "output" if self.source.endswith("SubagentOutput") else "jsonl"


@dataclass(frozen=True)
class Scan:
    """What a root gave: records, failures of files and lines, and caps that cut the scan; ``lines`` are the parsed lines that all three come from."""

    records: DataFrame
    failures: DataFrame
    truncations: DataFrame
    lines: DataFrame


_PARSED: list[T.DataType] = []


def parsed(source: Column, line: Column) -> Column:
    """The struct of ``schema.PARSED`` for a line; an Arrow batch function, as content nests to any depth."""
    if not _PARSED:
        _PARSED.append(T._parse_datatype_string(schema.PARSED))

    @F.pandas_udf(_PARSED[0])
    def read(sources: pd.Series, lines: pd.Series) -> pd.DataFrame:
        names = [f.name for f in _PARSED[0].fields]
        rows = [dict.fromkeys(names) if x is None else rules.read_line(s, x) for s, x in zip(sources, lines, strict=True)]
        return pd.DataFrame(rows, columns=names)

    return read(source, line)


def with_parsed(rows: DataFrame, source: str, raw: str = "raw", native: bool = False) -> DataFrame:
    """``rows`` with ``p``, the struct of ``schema.PARSED`` for each line: in Python, or with ``native`` by built-in expressions for the lines that these are sure of."""
    if not native or source not in variant.SOURCES:
        return rows.withColumn("p", parsed(F.lit(source), F.col(raw)))
    rows = variant.with_native(rows, raw)
    rest = parsed(F.lit(source), F.when(~F.col("sure"), F.col(raw)))
    return rows.withColumn("p", F.when(F.col("sure"), F.col("native").cast(schema.PARSED)).otherwise(rest)).drop("native", "sure")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def session_of(source: Column, path: Column) -> Column:
    """The producer's session id: file stem or, for outputs of subagents, the folder's name, without its prefix; null for producers that have none."""
    folder = F.element_at(F.split(path, "/"), -2)
    own = F.when(source == "Claude", stem(path)).when(source.endswith("SubagentOutput"), folder)
    return F.regexp_replace(own, "^claude-", "")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder of this path, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and files.getFileStatus(folder).isDirectory()


def entries(spark: SparkSession, root: Root) -> DataFrame:
    """(path, length, modified) of every file below the root, of any kind; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def discover(spark: SparkSession, root: Root) -> DataFrame:
    """(path, length, modified) of the root's transcript files; contents are not read."""
    files = entries(spark, root).where(F.col("path").endswith(f".{root.extension}"))
    if root.source == "Codex":
        files = _indexed(spark, root, files)
    return files


def _indexed(spark: SparkSession, root: Root, files: DataFrame) -> DataFrame:
    """Only files named by index.jsonl at the root, where there is one; names that leave the root name nothing."""
    index = files.where(F.substring_index("path", "/", -1) == "index.jsonl")
    rest = files.where(F.substring_index("path", "/", -1) != "index.jsonl")
    own = [r["path"] for r in index.orderBy(F.length("path"), "path").limit(1).collect()]
    if not own or own[0].rsplit("/", 1)[0].split(":", 1)[-1].rstrip("/").lstrip("/") != root.path.split(":", 1)[-1].rstrip("/").lstrip("/"):
        return rest
    lines = spark.read.text(own[0])
    name = F.coalesce(F.get_json_object("value", "$.path"), F.get_json_object("value", "$.session_path"))
    named = lines.select(name.alias("name")).where(F.col("name").isNotNull() & ~F.col("name").rlike(r"(^|/)\.\.(/|$)"))
    folder = own[0].rsplit("/", 1)[0]
    full = F.when(F.col("name").startswith("/"), F.concat(F.lit(folder.split("/", 1)[0] if ":" in folder else ""), F.col("name"))).otherwise(F.concat(F.lit(folder + "/"), "name"))
    return rest.join(named.select(full.alias("path")).distinct(), "path", "left_semi")


def _report(rows: DataFrame, root: Root, reason: str, line: Column | None = None) -> DataFrame:
    return rows.select(F.lit(root.source).alias("source"), F.lit(root.identifier).alias("source_identifier"), "path", (F.lit(None) if line is None else line).cast("long").alias("line_number"), F.lit(reason).alias("reason"))


def listing(spark: SparkSession, root: Root) -> tuple[DataFrame, DataFrame]:
    """(path, length, modified) of the files that a scan reads, and reports of the caps that cut the listing or skip a file."""
    found, limits = discover(spark, root), root.limits
    last = entries(spark, root).select("path").orderBy("path").limit(limits.entries + 1)
    last = last.groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path")).where(F.col("n") > limits.entries)
    crowded = _report(last, root, "EntryLimit")
    past = F.broadcast(last.select(F.col("path").alias("past")))
    found = found.join(past, F.col("path") >= F.col("past"), "left_anti")
    # The first files in order of their paths: at most one more than the cap is ranked.
    ranked = found.orderBy("path").limit(limits.files + 1).withColumn("place", F.row_number().over(Window.partitionBy().orderBy("path")))
    many = _report(ranked.where(F.col("place") == limits.files + 1), root, "FileLimit")
    within = ranked.where(F.col("place") <= limits.files)
    large = _report(within.where(F.lit(False) if limits.file_bytes is None else F.col("length") > limits.file_bytes), root, "FileBytes")
    return within.drop("place"), crowded.unionByName(many).unionByName(large)


def file_contents(spark: SparkSession, root: Root) -> DataFrame:
    """(path, content, length, modified, same) of the root's files under the cap that are read as one value; ``same``: length and time are still those of the listing."""
    most = WHOLE_BYTES if root.limits.file_bytes is None else min(root.limits.file_bytes, WHOLE_BYTES)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{root.extension}").load(root.path).where(F.col("length") <= most)
    same = (F.octet_length("content") == F.col("_metadata.file_size")) & (F.col("modificationTime") == F.col("_metadata.file_modification_time"))
    return contents.select("path", "content", "length", F.col("modificationTime").alias("modified"), same.alias("same"))


def takes_long(root: Root) -> bool:
    """Whether a scan of the root reads files that are longer than one value."""
    return root.limits.file_bytes is None or root.limits.file_bytes > WHOLE_BYTES


def long_lines(spark: SparkSession, root: Root, span: tuple | None = None) -> DataFrame:
    """(path, length, modified, same, whole, n, tail, last, line_number, raw) of every line of the root's files that are too long for one value.

    ``span``: first and last time of the files to open. ``n`` counts a file's lines, ``tail`` has the bytes after its last line
    break, ``last`` the number of the last line that counts (all, or those before the first with U+FFFD if the file isn't ``whole``,
    valid UTF-8). The splits' lines are checkpointed, so that the same splits that are counted are numbered: a line's number is its
    place in its split after the lines of the file's earlier splits. No file is gathered in one task.
    """
    cap, meta = root.limits.file_bytes, F.col("_metadata")
    wanted = lambda size, time: (size > WHOLE_BYTES) & (F.lit(True) if cap is None else size <= cap) & (F.lit(True) if span is None else time.between(F.lit(span[0]), F.lit(span[1])))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{root.extension}").load(root.path)
    files = files.where(wanted(F.col("length"), F.col("modificationTime"))).select("path", "length", F.col("modificationTime").alias("modified"), meta["file_path"].alias("uri"))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{root.extension}").option("lineSep", "\n").text(root.path)
    text = text.where(wanted(meta["file_size"], meta["file_modification_time"]))
    rows = text.select(meta["file_path"].alias("uri"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("time"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw")).checkpoint()
    bad = ~F.is_valid_utf8("raw")
    odd = bad | F.contains("raw", F.lit("\ufffd"))
    splits = rows.groupBy("uri", "size", "time", "split").agg(
        F.min("id").alias("first"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("raw") + 1).alias("bytes"),
        F.bool_or(bad).alias("bad"),
        F.min(F.when(odd, F.col("id"))).alias("odd"),
        F.max_by(F.octet_length("raw"), "id").alias("end"),
    )
    own = Window.partitionBy("uri")
    splits = splits.withColumn("before", F.sum("rows").over(own.orderBy("split")) - F.col("rows"))
    splits = splits.withColumns({
        "n": F.sum("rows").over(own),
        "bytes": F.sum("bytes").over(own),
        "whole": ~F.bool_or("bad").over(own),
        "odd": F.min(F.col("before") + F.col("odd") - F.col("first")).over(own),
        "end": F.max_by("end", "split").over(own),
    })
    # Every line counts with its line break: one byte more than there is if the last has none, three less if the reader took a byte order mark away.
    spare = F.col("bytes") - F.col("size")
    splits = splits.withColumns({"marked": spare.isin(-3, -2), "open": spare.isin(1, -2), "exact": spare.isin(0, 1, -3, -2)})
    splits = splits.withColumn("tail", F.when(~F.col("open"), 0).otherwise(F.col("end") + F.when(F.col("marked") & (F.col("n") == 1), 3).otherwise(0)).cast("long"))
    splits = splits.withColumn("last", F.when(F.col("whole"), F.col("n")).otherwise(F.col("odd")))
    rows = rows.join(F.broadcast(splits.select("uri", "split", "first", "before", "n", "tail", "whole", "last", "marked", "exact")), ["uri", "split"]).join(F.broadcast(files), "uri")
    number = F.col("before") + F.col("id") - F.col("first") + 1
    same = F.col("exact") & (F.col("size") == F.col("length")) & (F.col("time") == F.col("modified"))
    raw = F.when(F.col("marked") & (number == 1), F.concat(F.lit("\ufeff"), "raw")).otherwise(F.col("raw"))
    return rows.select("path", "length", "modified", same.alias("same"), "whole", "n", "tail", "last", number.alias("line_number"), raw.alias("raw"))


def pieces(content: Column) -> Column:
    """The lines of a file's bytes, without what follows the last line break if that is nothing. Splitting puts U+FFFD for invalid bytes; in a file that has some, the first line with that character ends it."""
    text = content.cast("string")
    found = F.split(text, "\n", -1)
    found = F.when(F.endswith(text, F.lit("\n")), F.slice(found, 1, F.size(found) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(found)
    first_bad = F.array_position(F.transform(found, lambda x: F.contains(x, F.lit("\ufffd"))), True)
    return F.when(~F.is_valid_utf8(text) & (first_bad > 0), F.slice(found, F.lit(1), (first_bad - 1).cast("int"))).otherwise(found)


def records_of(rows: DataFrame, root: Root) -> DataFrame:
    """Records of the parsed lines (path, length, modified, line_number, p) that aren't malformed."""
    session = session_of(F.lit(root.source), F.col("path"))
    task = F.col("p.task")
    if root.source in ("Codex", "Pi"):
        task = F.lit(None).cast(schema.TASK)
    else:
        bare = F.struct(stem(F.col("path")).alias("task_identifier"), *[F.lit(None).cast("string").alias(n) for n in ("title", "tool_use_identifier", "output_path", "result", "usage")])
        task = F.coalesce(task, bare)
    return rows.where("not p.malformed").select(
        F.lit(root.source).alias("source"),
        F.lit(root.identifier).alias("source_identifier"),
        "path",
        "line_number",
        fingerprint(F.col("length"), F.col("modified")).alias("fingerprint"),
        "modified",
        *[F.col(f"p.{c}").alias(c) for c in ("timestamp", "text", "title", "subagent_name", "authored_status")],
        session.alias("session_identifier"),
        task.alias("task"),
        F.transform("p.blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), F.col("p.task.task_identifier").alias("task_identifier"))).alias("blocks"),
    )


def fingerprint(length: Column, modified: Column) -> Column:
    """The state of a file, part of the references to its lines."""
    return F.concat_ws(":", length, F.unix_micros(modified))


def scan(spark: SparkSession, root: Root) -> Scan:
    """Read a root. Where it has more entries than the cap, those after it in order of their paths aren't looked at. Files over the cap are skipped by their length alone; a file whose length or time is no longer that of the listing, a line over the cap, a blank or malformed one is a failure; invalid UTF-8 ends its file."""
    limits = root.limits
    within, cut = listing(spark, root)
    contents = file_contents(spark, root).join(within.select("path"), "path", "left_semi")
    changed = _report(contents.where("not same"), root, "ChangedDuringScan")
    contents = contents.where("same").drop("same")
    broken = _report(contents.where(~F.is_valid_utf8(F.col("content").cast("string"))), root, "InvalidUtf8")
    lines = contents.select("path", "length", "modified", F.posexplode(pieces(F.col("content"))).alias("at", "raw"))
    lines = lines.select("path", "length", "modified", (F.col("at") + 1).cast("long").alias("line_number"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    if takes_long(root):
        more = long_lines(spark, root).join(within.select("path"), "path", "left_semi")
        heads = more.where("line_number = 1")
        changed = changed.unionByName(_report(heads.where("not same"), root, "ChangedDuringScan"))
        broken = broken.unionByName(_report(heads.where("same and not whole"), root, "InvalidUtf8"))
        more = more.where("same and line_number <= last")
        lines = lines.unionByName(more.select("path", "length", "modified", "line_number", F.regexp_replace("raw", "\r$", "").alias("raw")))
    long = _report(lines.where(F.octet_length("raw") > limits.line_bytes), root, "LineBytes", F.col("line_number"))

    rows = lines.where(F.octet_length("raw") <= limits.line_bytes)
    rows = with_parsed(rows, root.source)
    bad = _report(rows.where("p.malformed"), root, "Malformed", F.col("line_number"))
    failures = bad.unionByName(broken).unionByName(changed)
    over = _report(failures.limit(limits.failures + 1).groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where(F.col("n") > limits.failures), root, "ReadFailures")
    kept = failures.orderBy("path", F.col("line_number").asc_nulls_last()).limit(limits.failures)
    return Scan(records_of(rows, root), kept, cut.unionByName(long).unionByName(over), rows)


def with_instant(records: DataFrame) -> DataFrame:
    return records.withColumn("instant", instant(F.col("timestamp")))
