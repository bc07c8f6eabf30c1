"""A scan that goes on where an earlier one stopped.

The states of a root's files (length, time, bytes up to the last line break, their digest and
number of lines) are joined with the listing. A file of the same length and time isn't opened. Of
one that has grown, what follows the known bytes is parsed if these are as they were; else it is
read from its start. Files are opened by the range of times of those that differ, a filter of the
reader. The result is one pass over the contents of these files: their new lines, parsed, with
the new state of the file on each.

Files of more than ``WHOLE_BYTES`` are read by splits (``long_lines``); their digest is a sum over
lines, which no task takes alone. A file that grew beyond that length is still known by the digest
of its bytes, of which there are no more than that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkprism.sources.jsonl import WHOLE_BYTES, Root, file_contents, fingerprint, listing, long_lines, pieces, records_of, takes_long, with_parsed

#: What is known of a file: ``whole`` says that it is valid UTF-8, ``covered`` and ``lines`` count its complete lines.
STATE = ("path", "length", "modified", "covered", "lines", "digest", "whole")
STATE_SCHEMA = "path string, length long, modified timestamp, covered long, lines long, digest string, whole boolean"
#: Caps of the listing; the first two leave files unseen.
UNSEEN, CAPS = ("EntryLimit", "FileLimit"), ("EntryLimit", "FileLimit", "FileBytes")
REPORT = ("source", "source_identifier", "path", "line_number", "reason")


@dataclass(frozen=True)
class Resumed:
    """``lines``: STATE, ``skip`` (lines known before), line_number, p and reason; at least one row a file read, not computed yet. ``within``: the files of the listing; ``cut``: reports of caps; ``read``: files to read; ``gone``: known files that aren't listed; ``caps``: reasons in ``cut``."""

    lines: DataFrame
    within: DataFrame
    cut: DataFrame
    read: int
    gone: int
    caps: frozenset[str]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _sum_of_lines(wanted: Column) -> Column:
    """A digest of a file's wanted lines with their numbers: their SHA-256 in four parts, added."""
    own = F.sha2(F.concat_ws(":", "line_number", "raw"), 256)
    part = lambda k: F.conv(F.substring(own, k, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws("-", *[F.coalesce(F.sum(F.when(wanted, part(k))), F.lit(0)).cast("string") for k in (1, 16, 31, 46)])


def _long(spark: SparkSession, root: Root, differ: DataFrame, span: tuple) -> DataFrame:
    """STATE, ``same``, ``skip``, ``at`` and ``raw`` of the new lines of long files, and a row without a line for each of these files."""
    lines = long_lines(spark, root, span).join(F.broadcast(differ.where(F.col("listed_length") > WHOLE_BYTES)), "path")
    lines = lines.withColumns({
        "same": F.col("same") & _same("length", "listed_length") & _same("modified", "listed_time"),
        "covered": F.when(F.col("whole"), F.col("length") - F.col("tail")).otherwise(0).cast("long"),
        "lines": F.when(F.col("whole"), F.col("n") - (F.col("tail") > 0).cast("long")).otherwise(0).cast("long"),
    })
    # The known lines are given whole only where they are known by the digest of their bytes, those of a file of one value.
    known = F.col("line_number") <= F.col("known_lines")
    few = F.when(known & ~F.contains("known_digest", F.lit("-")), F.struct("line_number", "raw"))
    texts = F.transform(F.array_sort(F.collect_list(few)), lambda x: F.concat(x["raw"], F.lit("\n")))
    facts = ("length", "modified", "same", "whole", "covered", "lines", "last", "known_whole", "known_covered", "known_lines", "known_digest")
    files = lines.groupBy("path").agg(*[F.first(c).alias(c) for c in facts], _sum_of_lines(F.col("line_number") <= F.col("lines")).alias("digest"), _sum_of_lines(known).alias("before"), F.sha2(F.array_join(texts, "").cast("binary"), 256).alias("bytes"))
    digest = F.when(F.contains("known_digest", F.lit("-")), F.col("before")).otherwise(F.col("bytes"))
    grown = F.coalesce(F.col("known_whole") & (F.col("length") >= F.col("known_covered")) & (digest == F.col("known_digest")), F.lit(False))
    files = files.withColumn("skip", F.when(grown, F.col("known_lines")).otherwise(0).cast("long"))
    none = files.select(*STATE, "same", "skip", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("raw"))
    new = lines.select("path", "line_number", "raw").join(F.broadcast(files), "path").where(F.col("same") & (F.col("line_number") > F.col("skip")) & (F.col("line_number") <= F.col("last")))
    return none.unionByName(new.select(*STATE, "same", "skip", (F.col("line_number") - F.col("skip") - 1).cast("int").alias("at"), "raw"))


def resume(spark: SparkSession, root: Root, states: DataFrame) -> Resumed:
    """The lines of a root that are new since ``states``; without states, all."""
    within, cut = listing(spark, root)
    known = states.select("path", *[F.col(c).alias(f"known_{c}") for c in STATE[1:]])
    differ = within.join(known, "path", "left").where(~(_same("length", "known_length") & _same("modified", "known_modified")))
    differ = differ.withColumnsRenamed({"length": "listed_length", "modified": "listed_time"})
    # One job says what there is to do: files to read and their times, files that are gone, caps.
    nothing = F.lit(None).cast("timestamp")
    asked = differ.select(F.lit("read").alias("what"), F.col("listed_time").alias("time"))
    asked = asked.unionByName(known.join(within, "path", "left_anti").select(F.lit("gone").alias("what"), nothing.alias("time")))
    asked = asked.unionByName(cut.select(F.col("reason").alias("what"), nothing.alias("time")))
    if takes_long(root):
        asked = asked.unionByName(differ.where(F.col("listed_length") > WHOLE_BYTES).select(F.lit("long").alias("what"), F.col("listed_time").alias("time")))
    told = {r["what"]: r for r in asked.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last")).collect()}
    contents = file_contents(spark, root)
    if "read" in told:
        contents = contents.where(F.col("modified").between(F.lit(told["read"]["first"]), F.lit(told["read"]["last"])))
    files = contents.join(differ, "path").withColumn("same", F.col("same") & _same("length", "listed_length") & _same("modified", "listed_time"))
    part = lambda start, size: F.substring("content", start.cast("int"), size.cast("int"))
    grown = F.coalesce(F.col("known_whole") & (F.col("length") >= F.col("known_covered")) & (F.sha2(part(F.lit(1), F.col("known_covered")), 256) == F.col("known_digest")), F.lit(False))
    files = files.withColumn("whole", F.is_valid_utf8(F.col("content").cast("string"))).withColumn("grown", grown)
    files = files.withColumns({"start": F.when(F.col("grown"), F.col("known_covered")).otherwise(0), "skip": F.when(F.col("grown"), F.col("known_lines")).otherwise(0)})
    rest = part(F.col("start") + 1, F.col("length"))
    tail = F.octet_length(F.substring_index(rest.cast("string"), "\n", -1))
    files = files.withColumn("covered", F.when(F.col("whole"), F.col("length") - tail).otherwise(0).cast("long"))
    breaks = F.octet_length(rest) - F.octet_length(F.replace(rest.cast("string"), F.lit("\n"), F.lit("")))
    files = files.withColumns({
        "lines": F.when(F.col("whole"), F.col("skip") + breaks).otherwise(0).cast("long"),
        "digest": F.sha2(part(F.lit(1), F.col("covered")), 256),
        "new": F.when(F.col("same"), pieces(rest)),
    })
    rows = files.select(*STATE, "same", F.col("skip").cast("long").alias("skip"), F.posexplode_outer("new").alias("at", "raw"))
    if takes_long(root) and "long" in told:
        rows = rows.unionByName(_long(spark, root, differ, (told["long"]["first"], told["long"]["last"])))
    rows = rows.withColumn("line_number", (F.col("skip") + F.col("at") + 1).cast("long")).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    long = F.octet_length("raw") > root.limits.line_bytes
    rows = with_parsed(rows.withColumn("line", F.when(F.col("raw").isNull() | long, F.lit("")).otherwise(F.col("raw"))), root.source, "line")
    reason = F.when(~F.col("same"), "ChangedDuringScan").when(F.col("at").isNull(), None).when(long, "LineBytes").when(F.col("p.malformed"), "Malformed")
    return Resumed(rows.select(*STATE, "skip", "line_number", "p", reason.alias("reason")), within, cut, told["read"]["n"] if "read" in told else 0, told["gone"]["n"] if "gone" in told else 0, frozenset(told) & frozenset(CAPS))


@dataclass(frozen=True)
class Whole:
    """What a full scan would give: records, reports and states of all files of a root."""

    records: DataFrame
    reports: DataFrame
    states: DataFrame


def _report(rows: DataFrame, root: Root, line: Column, reason: Column) -> DataFrame:
    return rows.select(F.lit(root.source).alias("source"), F.lit(root.identifier).alias("source_identifier"), "path", line.cast("long").alias("line_number"), reason.alias("reason"))


def merged(root: Root, before: Whole, step: Resumed, lines: DataFrame, seen: bool) -> Whole:
    """The earlier scan and the lines read now (``step.lines``, written), as one scan.

    Earlier rows of a file stay up to the lines that it had when it was read now, with the file's
    new state; those of a file that wasn't read stay, unless it is gone and the listing saw all
    files (``seen``): a scan that a cap has cut removes nothing that it hasn't looked at.
    """
    fresh = lines.where(~F.col("reason").eqNullSafe("ChangedDuringScan")).select(*STATE, "skip").dropDuplicates(["path"])
    kept = before.states.join(fresh.select("path"), "path", "left_anti")
    if seen:
        kept = kept.join(step.within.select("path"), "path", "left_semi")
    stay = kept.select("path", "length", "modified", F.lit((1 << 63) - 1).alias("upto")).unionByName(fresh.select("path", "length", "modified", F.col("skip").alias("upto")))
    stay = stay.withColumnRenamed("modified", "time")
    old = before.records.join(stay, "path").where("line_number <= upto")
    old = old.withColumns({"fingerprint": fingerprint(F.col("length"), F.col("time")), "modified": F.col("time")}).select(*before.records.columns)
    ok = records_of(lines.where("line_number is not null and reason is null"), root)
    reports = before.reports.where(~F.col("reason").isin("ChangedDuringScan", *CAPS)).join(stay.select("path", "upto"), "path").where("coalesce(line_number, 0) <= upto")
    # A file that is read now tells anew whether it is valid.
    reports = reports.join(fresh.select("path", F.lit(True).alias("again")), "path", "left").where("line_number is not null or again is null").select(*REPORT)
    now = _report(lines.where("reason is not null"), root, F.col("line_number"), F.col("reason"))
    broken = _report(fresh.where("not whole"), root, F.lit(None), F.lit("InvalidUtf8"))
    return Whole(old.unionByName(ok.select(*before.records.columns)), reports.unionByName(now).unionByName(broken).unionByName(step.cut.select(*REPORT)), kept.unionByName(fresh.drop("skip")))
