"""Queries of the library over the driver's tables, each with DuckDB SQL for the same rows.

Conversations stand for transcripts (see ``sources.turns``), documents for long texts, events for
time windows and JSON fields.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkprism import errors
from talkprism.functions import text as tx
from talkprism.functions import textquery as tq
from talkprism.functions.timestamps import Between, Clock, Recent, Since, instant, rfc3339, within
from talkprism.operators.backing import listed, read_many, with_lifecycle
from talkprism.operators.archive import Archive, record_identifier
from talkprism.operators.config import Configuration, InterfaceLimits, issues
from talkprism.operators.guards import ASPECTS, admitted, rejections, with_errors
from talkprism.operators.requests import Index, PageRequest
from talkprism.operators.slots import SlotStore, slot_name
from talkprism.operators.store import Store, changed_groups
from talkprism.plans import collect, health, model, paging, postings
from talkprism.plans.filters import Filter
from talkprism.sources import variant
from talkprism.sources.jsonl import Limits, Root, parsed
from talkprism.sources.repository import configured_changes
from talkprism.sources.turns import records_of_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CLOCK = Clock(dt.datetime(2025, 1, 4, tzinfo=dt.timezone.utc))
WINDOW = Between("2025-01-01T06:00:00Z", "2025-01-03T18:00:00Z")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of_turns(_table(spark, sf_dir, "conversations"))


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """Lazy tables: a request computes only what it selects."""
    rows = model.keyed(_records(spark, sf_dir))
    outs = model.outputs(rows)
    return Index({"sessions": model.sessions(rows), "subagents": model.subagents(rows), "outputs": outs, "segments": model.segments(outs), "blocks": model.blocks(rows)}, clock=CLOCK)


#: The same mapping of turns to records, with references.
_REC = """rec0 AS (
  SELECT conv_id, turn, role, coalesce("text", '') AS txt,
    CASE conv_id % 5 WHEN 0 THEN 'Claude' WHEN 1 THEN 'Codex' WHEN 2 THEN 'Pi' WHEN 3 THEN 'ClaudeSubagentOutput' ELSE 'PiSubagentOutput' END AS source,
    'root-' || (conv_id % 5) AS source_identifier, 'conv-' || conv_id || '.jsonl' AS path, turn + 1 AS line_number,
    TIMESTAMP '2025-01-01' + to_hours(conv_id::int) + to_minutes(turn::int) AS moment, 'conv-' || conv_id AS session_identifier,
    CASE WHEN role = 'assistant' THEN 'worker-' || (turn % 3) END AS subagent_name, CASE WHEN role = 'assistant' THEN 'task-' || (turn % 2) END AS task_identifier,
    CASE WHEN role = 'user' THEN 'HumanAuthored' ELSE 'AgentAuthored' END AS authored_status,
    CASE lower(role) WHEN 'user' THEN 'UserPrompt' WHEN 'system' THEN 'SystemInstruction' WHEN 'assistant' THEN 'AgentResponse' WHEN 'tool' THEN 'ToolResult' ELSE 'Unclassified' END AS kind
  FROM conversations),
rec1 AS (SELECT *, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'session:v1:' || md5(concat_ws('|', 'producer-session', source, source_identifier, session_identifier)) AS session_reference FROM rec0),
rec AS (SELECT *, CASE WHEN subagent_name IS NOT NULL THEN 'subagent:v1:' || md5(session_reference || '|' || subagent_name) END AS subagent_reference,
  'output:v1:' || md5(concat_ws('|', source, source_identifier, path, line_number::varchar, 'table', md5(txt))) AS output_reference,
  'block:v1:' || md5(concat_ws('|', source, source_identifier, path, line_number::varchar, 'table', md5(txt), '0', kind)) AS block_reference,
  strlen(txt)::bigint AS bytes, (CASE WHEN txt = '' THEN 0 ELSE length(txt) - length(replace(txt, chr(10), '')) + CASE WHEN txt LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::bigint AS lines
  FROM rec1)"""
_SESS = """sess AS (SELECT session_reference, first(source) AS source, first(source_identifier) AS source_identifier, min(ts) AS started_at, max(ts) AS last_observed_at, max(moment) AS modified,
  count(DISTINCT output_reference) AS output_count, count(DISTINCT subagent_reference) AS subagent_count, sum(bytes)::bigint AS total_bytes, arg_min(bytes, line_number) AS first_bytes,
  arg_min(authored_status, line_number) AS authored_status FROM rec GROUP BY session_reference)"""
_PREFIX = "left({t}, list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({t}, k)) <= {n}))::int)"


def _prefix(t: str, n) -> str:
    return _PREFIX.format(t=t, n=n)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_BLOCK = ("block_reference", "session_reference", "kind", "timestamp", "source", "path", "line_number", "bytes")
_BLOCK_SQL = "block_reference, session_reference, kind, ts AS timestamp, source, path, line_number, bytes"


@query(_with(_REC) + f"SELECT {_BLOCK_SQL} FROM rec ORDER BY ts, source, source_identifier, path, line_number, block_reference LIMIT 50")
def blocks_ordered_page(spark, sf_dir):
    rows = _index(spark, sf_dir).blocks(Filter())
    return paging.ordered(rows, paging.keys("OldestFirst", "block_reference", "timestamp", None, paging.BLOCK_TIES), 50).select(*_BLOCK)


@query(_with(_REC) + f"SELECT {_BLOCK_SQL} FROM rec WHERE kind IN ('UserPrompt', 'SystemInstruction') AND ts BETWEEN '{WINDOW.start}' AND '{WINDOW.end}' AND source IN ('Claude', 'Pi')")
def blocks_by_kind(spark, sf_dir):
    return _index(spark, sf_dir).blocks(Filter(kinds=("UserPrompt", "SystemInstruction"), window=WINDOW, sources=("Claude", "Pi"))).select(*_BLOCK)


@query(_with(_REC) + f"SELECT {_BLOCK_SQL} FROM rec WHERE (ts, source, path, line_number) > ('2025-01-02T00:01:00Z', 'ClaudeSubagentOutput', 'conv-23.jsonl', 2) ORDER BY ts, source, source_identifier, path, line_number LIMIT 64")
def keyset_page_two(spark, sf_dir):
    sort = paging.keys("OldestFirst", "block_reference", "timestamp", None, ("source", "path", "line_number"))
    rows = _index(spark, sf_dir).blocks(Filter()).where(paging.after(sort, ["2025-01-02T00:01:00Z", "ClaudeSubagentOutput", "conv-23.jsonl", 2, "block:w"]))
    return paging.ordered(rows, sort, 64).select(*_BLOCK)


def _search(name: str, q: tq.Query, sql: str) -> None:
    def run(spark, sf_dir):
        return _index(spark, sf_dir).search(q).select("block_reference", "kind", "bytes")

    run.__name__ = name
    query(_with(_REC, "tok AS (SELECT *, regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+') AS t FROM rec)") + f"SELECT block_reference, kind, bytes FROM tok WHERE {sql}")(run)


def _positions(word: str) -> str:
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] = '{word}')"


_PHRASE = "len(list_filter(range(1, len(t)), lambda i: t[i] = 'in' AND t[i + 1] = 'the')) > 0"
_NEAR = f"len(list_filter({_positions('the')}, lambda i: len(list_filter({_positions('and')}, lambda j: i <> j AND abs(j - i) - 1 <= 3)) > 0)) > 0"
_search("search_word", tq.Word("the"), "list_contains(t, 'the')")
_search("search_phrase", tq.Phrase("In the"), _PHRASE)
_search("search_near", tq.Near("the", "and", 3), _NEAR)
_search("search_all_of", tq.AllOf((tq.Word("the"), tq.Word("is"))), "list_contains(t, 'the') AND list_contains(t, 'is')")
_search("search_any_of", tq.AnyOf((tq.Word("der"), tq.Word("la"))), "list_contains(t, 'der') OR list_contains(t, 'la')")
_search("search_not", tq.AllOf((tq.Word("the"), tq.Not(tq.Word("is")))), "list_contains(t, 'the') AND NOT list_contains(t, 'is')")


@query(
    _with(_REC, "tok AS (SELECT *, regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+') AS t FROM rec)", f"pos AS (SELECT block_reference, unnest({_positions('the')}) - 1 AS p FROM tok)")
    + "SELECT block_reference, 'Word' AS term, p::int AS span_start, p::int AS span_end FROM pos"
)
def search_evidence_spans(spark, sf_dir):
    rows = _index(spark, sf_dir).search(tq.Word("the")).select("block_reference", F.explode("evidence").alias("e"))
    return rows.select("block_reference", F.lit("Word").alias("term"), F.explode("e.spans").alias("s")).select("block_reference", "term", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


_INDEXED = {
    "word": (tq.Word("the"), "list_contains(t, 'the')"),
    "phrase": (tq.Phrase("In the"), _PHRASE),
    "near": (tq.Near("the", "and", 3), _NEAR),
    "all": (tq.AllOf((tq.Word("the"), tq.Word("is"))), "list_contains(t, 'the') AND list_contains(t, 'is')"),
    "any": (tq.AnyOf((tq.Word("der"), tq.Phrase("in the"))), f"list_contains(t, 'der') OR {_PHRASE}"),
    "all, not": (tq.AllOf((tq.Word("the"), tq.Not(tq.Word("is")))), "list_contains(t, 'the') AND NOT list_contains(t, 'is')"),
    "not": (tq.Not(tq.Word("the")), "NOT list_contains(t, 'the')"),
}
_TOKENS = "tok AS (SELECT *, regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+') AS t FROM rec)"


@query(_with(_REC, _TOKENS) + " UNION ALL ".join(f"SELECT '{name}' AS question, block_reference, kind, bytes FROM tok WHERE {sql}" for name, (_, sql) in _INDEXED.items()))
def search_by_index(spark, sf_dir):
    """Seven queries over the search index, which is written first."""
    index = _index(spark, sf_dir)
    folder = f"{_scratch(spark, f'postings-{uuid.uuid4().hex}')}/table"
    postings.postings(index.tables["blocks"]).write.parquet(folder)
    index = Index({**index.tables, "postings": spark.read.parquet(folder)}, clock=CLOCK)
    found = [index.search(q).select(F.lit(name).alias("question"), "block_reference", "kind", "bytes") for name, (q, _) in _INDEXED.items()]
    return reduce(DataFrame.unionByName, found)


@query(
    _with(_REC, _TOKENS, f"pair AS (SELECT block_reference, i, unnest(list_filter({_positions('and')}, lambda j: i <> j AND abs(j - i) - 1 <= 3)) AS j FROM (SELECT block_reference, t, unnest({_positions('the')}) AS i FROM tok))")
    + "SELECT block_reference, (least(i, j) - 1)::int AS span_start, (greatest(i, j) - 1)::int AS span_end FROM pair"
)
def search_near_spans(spark, sf_dir):
    rows = _index(spark, sf_dir).search(tq.Near("the", "and", 3)).select("block_reference", F.explode("evidence").alias("e"))
    return rows.select("block_reference", F.explode("e.spans").alias("s")).select("block_reference", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


_SESSION = ("session_reference", "source", "started_at", "last_observed_at", "output_count", "subagent_count", "total_bytes", "first_bytes", "authored_status")


@query(_with(_REC, _SESS) + f"SELECT {', '.join(_SESSION)} FROM sess ORDER BY last_observed_at DESC, session_reference LIMIT 40")
def list_sessions_newest(spark, sf_dir):
    return paging.ordered(_index(spark, sf_dir).sessions(), paging.keys("NewestFirst", "session_reference", "observed", "modified"), 40).select(*_SESSION)


@query(_with(_REC, _SESS) + f"SELECT {', '.join(_SESSION)} FROM sess WHERE last_observed_at BETWEEN '{WINDOW.start}' AND '{WINDOW.end}'")
def list_sessions_window(spark, sf_dir):
    return _index(spark, sf_dir).sessions(Filter(window=WINDOW)).select(*_SESSION)


@query(
    _with(_REC)
    + """SELECT subagent_reference, first(session_reference) AS session_reference, first(subagent_name) AS subagent_name, min(ts) AS first_observed_at, max(ts) AS last_observed_at,
 count(DISTINCT output_reference) AS output_count, arg_min(task_identifier, line_number) AS task_identifier FROM rec WHERE subagent_reference IS NOT NULL GROUP BY subagent_reference"""
)
def list_subagents(spark, sf_dir):
    return _index(spark, sf_dir).subagents().select("subagent_reference", "session_reference", "subagent_name", "first_observed_at", "last_observed_at", "output_count", "task_identifier")


_OUTPUT = ("output_reference", "session_reference", "produced_at", "task_identifier", "bytes", "lines")


@query(_with(_REC) + f"SELECT output_reference, session_reference, ts AS produced_at, task_identifier, bytes, lines FROM rec WHERE task_identifier = 'task-1' AND authored_status = 'AgentAuthored' AND source IN ('Claude', 'Codex', 'Pi') AND ts >= '{WINDOW.start}'")
def list_outputs_filtered(spark, sf_dir):
    return _index(spark, sf_dir).outputs(Filter(task="task-1", authored="AgentAuthored", sources=("Claude", "Codex", "Pi"), window=Since(WINDOW.start))).select(*_OUTPUT)


@query(_with(_REC) + f"SELECT output_reference, bytes, {_prefix('txt', 100)} AS preview, CASE WHEN bytes > 100 THEN 'Truncated' ELSE 'Complete' END AS preview_state FROM rec")
def list_output_preview(spark, sf_dir):
    return _index(spark, sf_dir).outputs(Filter(), 100).select("output_reference", "bytes", "preview", "preview_state")


@query(_with(_REC) + "SELECT 'segment:v1:' || md5(output_reference || '|0') AS segment_reference, output_reference, 0::bigint AS segment_index, bytes AS byte_end, lines + 1 AS line_end FROM rec")
def list_segments(spark, sf_dir):
    rows = _index(spark, sf_dir).tables["segments"]
    return rows.select("segment_reference", "output_reference", "segment_index", F.col("byte_range.end").alias("byte_end"), F.col("line_range.end").alias("line_end"))


@query(
    _with(_REC)
    + f"SELECT source, source_identifier, count(*) AS record_count, sum(bytes)::bigint AS bytes, min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM rec WHERE ts BETWEEN '{WINDOW.start}' AND '{WINDOW.end}' GROUP BY ALL"
)
def collect_volume(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return collect.volumes(rows.where(within(F.col("timestamp"), WINDOW)))


_PLACE = "row_number() OVER (PARTITION BY source ORDER BY path, line_number)::int AS place"


@query(_with(_REC, f"p AS (SELECT *, {_PLACE} FROM rec)") + "SELECT source, place, path, line_number, ts AS timestamp, bytes FROM p WHERE place <= 20")
def collect_segment_cap(spark, sf_dir):
    return collect.capped(_records(spark, sf_dir), 20).select("source", "place", "path", "line_number", "timestamp", tx.byte_length("text").alias("bytes"))


def _fold(bound: int, budget: int, n: int) -> str:
    cut = _prefix("p.txt", f"least({bound}, {{left}})")
    return (
        "WITH RECURSIVE "
        + ",\n".join([_REC, f"p AS (SELECT *, {_PLACE} FROM rec)"])
        + f""",
f AS (SELECT source, place, path, line_number, bytes, {cut.format(left=budget)} AS excerpt, ({budget} - strlen({cut.format(left=budget)}))::bigint AS remaining, {budget}::bigint AS had FROM p WHERE place = 1
 UNION ALL
 SELECT p.source, p.place, p.path, p.line_number, p.bytes, {cut.format(left="f.remaining")}, f.remaining - strlen({cut.format(left="f.remaining")}), f.remaining FROM p JOIN f ON p.source = f.source AND p.place = f.place + 1 WHERE p.place <= {n})
SELECT source, place, path, line_number, bytes, excerpt, CASE WHEN strlen(excerpt) < bytes THEN CASE WHEN had < {bound} THEN 'RequestLimit' ELSE 'ProjectionLimit' END END AS truncation FROM f"""
    )


_EXCERPT = ("source", "place", "path", "line_number", "bytes", "excerpt", "truncation")


@query(_fold(200, 1000, 12))
def collect_byte_budget(spark, sf_dir):
    return collect.bounded_texts(_records(spark, sf_dir), collect.Budget(12, 1000, 200)).select(*_EXCERPT)


@query(_fold(64, 100000, 10))
def collect_bounded_text(spark, sf_dir):
    return collect.bounded_texts(_records(spark, sf_dir), collect.Budget(10, 100000, 64)).select(*_EXCERPT)


@query("""SELECT doc_id, strlen("text")::bigint AS bytes, (CASE WHEN "text" = '' THEN 0 ELSE length("text") - length(replace("text", chr(10), '')) + CASE WHEN "text" LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::bigint AS lines FROM documents""")
def size_metadata(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.byte_length("text").alias("bytes"), tx.line_count("text").alias("lines"))


@query("""SELECT doc_id, CASE WHEN strlen("text") >= 120 THEN 100::bigint END AS bytes FROM documents""")
def estimate_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.byte_estimate(tx.byte_length("text"), 20, 120).alias("bytes"))


@query(
    """WITH l AS (SELECT doc_id, strlen("text")::bigint AS b, (CASE WHEN "text" = '' THEN 0 ELSE length("text") - length(replace("text", chr(10), '')) + CASE WHEN "text" LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::bigint AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 2 THEN b * 2 // n END AS bytes FROM l"""
)
def estimate_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.line_estimate(tx.byte_length("text"), tx.line_count("text"), 1, 3).alias("bytes"))


def _bytes_sql(a: int, b: int) -> str:
    """Text of bytes a to b where both ends lie between characters."""
    at = lambda n: f"""list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left("text", k)) <= {n}))::int"""
    return f"""CASE WHEN strlen("text") >= {b} AND strlen(left("text", {at(a)})) = {a} AND strlen(left("text", {at(b)})) = {b} THEN substr("text", {at(a)} + 1, {at(b)} - {at(a)}) END"""


@query(f"SELECT doc_id, {_bytes_sql(5, 40)} AS part FROM documents")
def read_byte_range(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.byte_range("text", 5, 40).alias("part"))


@query("""WITH l AS (SELECT doc_id, string_split(CASE WHEN "text" LIKE '%' || chr(10) THEN left("text", length("text") - 1) ELSE "text" END, chr(10)) AS x, "text" AS t FROM documents)
SELECT doc_id, CASE WHEN (CASE WHEN t = '' THEN 0 ELSE len(x) END) >= 3 THEN array_to_string(x[2:3], chr(10)) END AS part FROM l""")
def read_line_range(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", tx.line_range("text", 2, 4).alias("part"))


@query(_with(_REC, _SESS) + "SELECT session_reference, source, output_count, total_bytes, CASE source WHEN 'Claude' THEN 'MainSession' WHEN 'Codex' THEN 'Unknown' WHEN 'Pi' THEN 'Unknown' ELSE 'SubagentOutputSession' END AS role FROM sess")
def session_inventory(spark, sf_dir):
    return _index(spark, sf_dir).sessions().select("session_reference", "source", "output_count", "total_bytes", "role")


@query(_with(_REC, _SESS) + "SELECT session_reference, CASE WHEN output_count >= 6 THEN 'Archived' ELSE 'NotArchived' END AS archive_status FROM sess")
def archive_membership(spark, sf_dir):
    sessions = _index(spark, sf_dir).sessions()
    return health.archive_status(sessions, sessions.where("output_count >= 6").select("session_reference")).select("session_reference", "archive_status")


@query(_with(_REC, _SESS) + "SELECT source, source_identifier, count(*) AS session_count, sum(total_bytes)::bigint AS bytes, min(modified) AS oldest_modified, max(modified) AS newest_modified FROM sess GROUP BY ALL")
def source_report(spark, sf_dir):
    return health.source_report(_index(spark, sf_dir).sessions())


@query(
    _with(_REC)
    + """, bad AS (SELECT source, source_identifier, count(*) FILTER (turn % 2 = 0) AS malformed, count(*) FILTER (turn % 2 = 1 AND conv_id % 5 = 1) AS unreadable FROM rec WHERE turn >= 6 AND conv_id % 5 IN (1, 2) AND (turn % 2 = 0 OR conv_id % 5 = 1) GROUP BY ALL),
good AS (SELECT source, source_identifier, count(*) AS records FROM rec WHERE NOT (turn >= 6 AND conv_id % 5 IN (1, 2) AND (turn % 2 = 0 OR conv_id % 5 = 1)) GROUP BY ALL)
SELECT source, source_identifier, records, coalesce(malformed, 0) AS malformed, coalesce(unreadable, 0) AS unreadable,
 CASE WHEN coalesce(unreadable, 0) > 0 THEN 'Unreadable' WHEN coalesce(malformed, 0) > 0 THEN 'Malformed' ELSE 'Indexed' END AS status,
 CASE WHEN coalesce(unreadable, 0) > 0 THEN 'Failed' WHEN coalesce(malformed, 0) > 0 THEN 'Truncated' ELSE 'Complete' END AS completeness
FROM good LEFT JOIN bad USING (source, source_identifier)"""
)
def health_rollup(spark, sf_dir):
    rows = _records(spark, sf_dir)
    number, turn = F.substring("source_identifier", -1, 1), F.col("line_number") - 1
    bad = (turn >= 6) & number.isin("1", "2") & ((turn % 2 == 0) | (number == "1"))
    failures = rows.where(bad).select("source", "source_identifier", "path", "line_number", F.when(turn % 2 == 0, "Malformed").otherwise("LineBytes").alias("reason"))
    roots = rows.select("source", "source_identifier").distinct()
    return health.source_health(roots, rows.where(~bad), failures, failures.limit(0)).select("source", "source_identifier", "records", "malformed", "unreadable", "status", "completeness")


@query(_with(_REC) + "SELECT session_reference, arg_min(txt, line_number) AS first_text, arg_min(authored_status, line_number) AS authored_status, count(DISTINCT output_reference) AS outputs FROM rec GROUP BY session_reference")
def dedupe_first_wins(spark, sf_dir):
    """Every record twice, and those of one role three times."""
    once = _records(spark, sf_dir)
    rows = model.unique(model.keyed(once.union(once).union(once.where("authored_status = 'HumanAuthored'"))))
    first = F.min_by(F.struct("text", "authored_status"), F.struct("path", "line_number"))
    found = rows.groupBy("session_reference").agg(first.alias("f"), F.count(F.lit(1)).alias("outputs"))
    return found.select("session_reference", F.col("f.text").alias("first_text"), F.col("f.authored_status").alias("authored_status"), "outputs")


@query(_with(_REC) + "SELECT output_reference, ts AS produced_at FROM rec WHERE ts BETWEEN '2025-01-03T12:00:00Z' AND '2025-01-04T00:00:00Z'")
def relative_window(spark, sf_dir):
    return _index(spark, sf_dir).outputs(Filter(window=Recent(12, "hours"))).select("output_reference", "produced_at")


@query(_with(_REC) + "SELECT session_reference, CASE WHEN count(DISTINCT authored_status) > 1 THEN 'MixedAuthorship' ELSE min(authored_status) END AS authored_status FROM rec GROUP BY session_reference")
def authorship_fold(spark, sf_dir):
    return model.authorship(model.keyed(_records(spark, sf_dir)), "session_reference")


@query(
    _with(_REC, "h AS (SELECT DISTINCT output_reference, md5(output_reference) AS m FROM rec)")
    + "SELECT count(*) AS n, sum(('0x' || m[1:8])::bigint)::varchar || '-' || sum(('0x' || m[9:16])::bigint)::varchar AS digest FROM h"
)
def snapshot_digest(spark, sf_dir):
    return model.digest(_index(spark, sf_dir).tables["outputs"], "output_reference")


@query(_with(_REC) + "SELECT session_reference, count(DISTINCT subagent_reference) AS child_count FROM rec WHERE subagent_reference IS NOT NULL GROUP BY session_reference")
def child_count_compaction(spark, sf_dir):
    return model.parent_child_counts(model.keyed(_records(spark, sf_dir)).where("subagent_reference is not null"), "session_reference", "subagent_reference")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id LIMIT 100")
def events_newest_page(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-02").cast("timestamp"))
    return paging.ordered(rows, [paging.Key("ts", True), paging.Key("event_id")], 100).select("event_id", "ts", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE user_id % 7 = 0 AND value > 90)")
def repository_semi_join(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    changes = events.select(F.col("event_type").alias("repository"), "user_id").distinct()
    named = events.where("user_id % 7 = 0 and value > 90").select(F.col("event_type").alias("repository"))
    return configured_changes(changes, named).select("user_id", F.col("repository").alias("event_type"))


@query("SELECT 'archive-record-' || lpad(vec_id::varchar, 16, '0') AS record_identifier, vec_id FROM embeddings")
def archive_identifiers(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(record_identifier(F.col("vec_id")).alias("record_identifier"), "vec_id")


# --- requests by reference, pages and their cursors -------------------------------------------------

_SESSION_ZERO = "'session:v1:' || md5('producer-session|Claude|root-0|conv-0')"
_WORKER_ONE = f"'subagent:v1:' || md5({_SESSION_ZERO} || '|worker-1')"


def _session_zero(spark, sf_dir) -> str:
    return _index(spark, sf_dir).lookup_session(producer=("Claude", "conv-0")).first()["session_reference"]


@query(_with(_REC, _SESS) + f"SELECT session_reference, source, output_count, 'ArchiveUnknown' AS archive_status FROM sess WHERE session_reference = {_SESSION_ZERO}")
def lookup_session_by_producer(spark, sf_dir):
    return _index(spark, sf_dir).lookup_session(producer=("Claude", "conv-0")).select("session_reference", "source", "output_count", "archive_status")


@query(_with(_REC, _SESS) + "SELECT s.session_reference, s.source, s.output_count FROM sess s WHERE s.session_reference IN (SELECT session_reference FROM rec WHERE path = 'conv-2.jsonl' AND source = 'Pi')")
def lookup_session_by_file(spark, sf_dir):
    return _index(spark, sf_dir).lookup_session(locator=("Pi", "conv-2.jsonl")).select("session_reference", "source", "output_count")


@query(_with(_REC) + f"SELECT output_reference, session_reference, ts AS produced_at, task_identifier, bytes, lines FROM rec WHERE session_reference = {_SESSION_ZERO}")
def outputs_of_session(spark, sf_dir):
    return _index(spark, sf_dir).outputs(Filter(session=_session_zero(spark, sf_dir))).select(*_OUTPUT)


@query(_with(_REC) + f"SELECT {_BLOCK_SQL} FROM rec WHERE subagent_reference = {_WORKER_ONE}")
def blocks_of_subagent(spark, sf_dir):
    index = _index(spark, sf_dir)
    own = index.subagents(Filter(session=_session_zero(spark, sf_dir))).where("subagent_name = 'worker-1'").first()
    return index.blocks(Filter(subagent=own["subagent_reference"])).select(*_BLOCK)


@query(_with(_REC) + f"SELECT {_BLOCK_SQL} FROM rec WHERE session_reference = {_SESSION_ZERO} AND line_number = 1")
def blocks_of_output(spark, sf_dir):
    index = _index(spark, sf_dir)
    first = index.list_outputs(Filter(session=_session_zero(spark, sf_dir)), PageRequest(1)).rows[0]
    return index.blocks(Filter(output=first["output_reference"])).select(*_BLOCK)


_FIRST = f"first_line AS (SELECT * FROM rec WHERE session_reference = {_SESSION_ZERO} AND line_number = 1)"


@query(
    _with(_REC, _FIRST)
    + """SELECT 'whole' AS part, bytes, 'Exact' AS certainty FROM first_line UNION ALL SELECT 'bytes 2 to 9', 7, 'Exact' FROM first_line
UNION ALL SELECT 'line 1', bytes // lines, 'Estimated' FROM first_line UNION ALL SELECT 'block', bytes, 'Exact' FROM first_line"""
)
def estimate_requests(spark, sf_dir):
    index = _index(spark, sf_dir)
    wanted = Filter(session=_session_zero(spark, sf_dir))
    output, block = index.list_outputs(wanted, PageRequest(1)).rows[0]["output_reference"], index.list_blocks(wanted, PageRequest(1)).rows[0]["block_reference"]
    found = [("whole", index.estimate_output(output)), ("bytes 2 to 9", index.estimate_output(output, byte_range=(2, 9))), ("line 1", index.estimate_output(output, line_range=(1, 2))), ("block", index.estimate_block(block))]
    return spark.createDataFrame([(k, x["bytes"], x["certainty"]) for k, x in found], "part string, bytes long, certainty string")


@query(_with(_REC, _FIRST) + f"SELECT 'output' AS part, {_prefix('txt', 40)} AS content, CASE WHEN bytes > 40 THEN 'Truncated' ELSE 'Complete' END AS state FROM first_line UNION ALL SELECT 'block', {_prefix('txt', 64)}, CASE WHEN bytes > 64 THEN 'Truncated' ELSE 'Complete' END FROM first_line")
def read_requests(spark, sf_dir):
    index = _index(spark, sf_dir)
    wanted = Filter(session=_session_zero(spark, sf_dir))
    output, block = index.list_outputs(wanted, PageRequest(1)).rows[0]["output_reference"], index.list_blocks(wanted, PageRequest(1)).rows[0]["block_reference"]
    found = [("output", index.read_output(output, 40, current=_records(spark, sf_dir))), ("block", index.read_block(block, 64, current=_records(spark, sf_dir)))]
    return spark.createDataFrame([(k, x["text"], x["state"]) for k, x in found], "part string, content string, state string")


def _walk(listing: Callable, order: str, limit: int, pages: int) -> list[tuple[int, int, object]]:
    """(page, place in all, row) of the first pages of a listing, each by the cursor of the one before."""
    out, cursor = [], None
    for k in range(pages):
        page = listing(PageRequest(limit, order, cursor))
        out += [(k, len(out) + i, r) for i, r in enumerate(page.rows)]
        cursor = page.next_cursor
        if cursor is None:
            break
    return out


def _paged(order: str, limit: int, pages: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place FROM {{table}} QUALIFY row_number() OVER (ORDER BY {order}) <= {limit * pages}"


@query(_with(_REC, _SESS, f"p AS ({_paged('modified DESC, session_reference', 12, 3).format(table='sess')})") + "SELECT place // 12 AS page, place, session_reference, output_count FROM p")
def session_pages_by_modified(spark, sf_dir):
    index = _index(spark, sf_dir)
    rows = _walk(lambda p: index.list_sessions(Filter(), p), "NewestModifiedFirst", 12, 3)
    return spark.createDataFrame([(k, i, r["session_reference"], r["output_count"]) for k, i, r in rows], "page long, place long, session_reference string, output_count long")


_SUBS = "subs AS (SELECT subagent_reference, count(*) AS output_count, max(ts) AS last_seen FROM rec WHERE subagent_reference IS NOT NULL GROUP BY ALL)"


@query(_with(_REC, _SUBS, f"p AS ({_paged('last_seen DESC, subagent_reference', 10, 2).format(table='subs')})") + "SELECT place // 10 AS page, place, subagent_reference, output_count FROM p")
def subagent_pages(spark, sf_dir):
    index = _index(spark, sf_dir)
    rows = _walk(lambda p: index.list_subagents(Filter(), p), "NewestFirst", 10, 2)
    return spark.createDataFrame([(k, i, r["subagent_reference"], r["output_count"]) for k, i, r in rows], "page long, place long, subagent_reference string, output_count long")


@query(_with(_REC, f"p AS ({_paged('ts, output_reference', 15, 2).format(table='rec')})") + f"SELECT place // 15 AS page, place, output_reference, {_prefix('txt', 20)} AS preview FROM p")
def output_pages(spark, sf_dir):
    index = _index(spark, sf_dir)
    rows = _walk(lambda p: index.list_outputs(Filter(), p, 20), "OldestFirst", 15, 2)
    return spark.createDataFrame([(k, i, r["output_reference"], r["preview"]) for k, i, r in rows], "page long, place long, output_reference string, preview string")


@query(_with(_REC, f"p AS ({_paged('block_reference', 15, 2).format(table='rec')})") + "SELECT place // 15 AS page, place, block_reference, kind FROM p")
def block_pages_by_reference(spark, sf_dir):
    index = _index(spark, sf_dir)
    rows = _walk(lambda p: index.list_blocks(Filter(), p), "ReferenceAscending", 15, 2)
    return spark.createDataFrame([(k, i, r["block_reference"], r["kind"]) for k, i, r in rows], "page long, place long, block_reference string, kind string")


@query(_with(_REC, "tok AS (SELECT *, regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+') AS t FROM rec)", "hit AS (SELECT * FROM tok WHERE list_contains(t, 'the'))", f"p AS ({_paged('ts DESC, source, source_identifier, path, line_number, block_reference', 20, 3).format(table='hit')})") + "SELECT place // 20 AS page, place, block_reference FROM p")
def search_pages(spark, sf_dir):
    index = _index(spark, sf_dir)
    rows = _walk(lambda p: index.search_blocks(tq.Word("the"), Filter(), p), "NewestFirst", 20, 3)
    return spark.createDataFrame([(k, i, r["block_reference"]) for k, i, r in rows], "page long, place long, block_reference string")


@query(_with(_REC, _FIRST) + "SELECT 'segment:v1:' || md5(output_reference || '|0') AS segment_reference, 0::bigint AS segment_index, bytes AS byte_end FROM first_line")
def segment_page(spark, sf_dir):
    index = _index(spark, sf_dir)
    output = index.list_outputs(Filter(session=_session_zero(spark, sf_dir)), PageRequest(1)).rows[0]["output_reference"]
    rows = index.list_segments(output, PageRequest(5)).rows
    return spark.createDataFrame([(r["segment_reference"], r["segment_index"], r["byte_range"]["end"]) for r in rows], "segment_reference string, segment_index long, byte_end long")


@query(_with(_REC, "n AS (SELECT * REPLACE (CASE WHEN turn % 2 = 0 THEN ts END AS ts) FROM rec WHERE conv_id < 12)") + "SELECT output_reference, ts AS produced_at FROM n ORDER BY ts DESC NULLS LAST, output_reference LIMIT 40")
def outputs_without_times_last(spark, sf_dir):
    records = _records(spark, sf_dir).where("cast(substring(path, 6, length(path) - 11) as int) < 12")
    rows = model.outputs(model.keyed(records)).withColumn("produced_at", F.when(F.col("line_number") % 2 == 1, F.col("produced_at")))
    return paging.ordered(rows, paging.keys("NewestFirst", "output_reference", "produced_at"), 40).select("output_reference", "produced_at")


@query(
    _with(_REC, "tok AS (SELECT *, regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+') AS t FROM rec)", "starts AS (SELECT block_reference, unnest(list_filter(range(1, len(t)), lambda i: t[i] = 'in' AND t[i + 1] = 'the')) - 1 AS p FROM tok)")
    + "SELECT block_reference, p::int AS span_start, (p + 1)::int AS span_end FROM starts"
)
def search_phrase_spans(spark, sf_dir):
    rows = _index(spark, sf_dir).search(tq.Phrase("In the")).select("block_reference", F.explode("evidence").alias("e"))
    return rows.select("block_reference", F.explode("e.spans").alias("s")).select("block_reference", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(_with(_REC, _SESS) + "SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(DISTINCT subagent_reference) FROM rec) AS subagents, count(*) AS outputs, count(*) AS blocks, 'Complete' AS completeness FROM rec")
def observe_health_counts(spark, sf_dir):
    rows = _records(spark, sf_dir)
    report = health.source_health(rows.select("source", "source_identifier").distinct(), rows, _no_failures(rows), _no_failures(rows))
    state = _index(spark, sf_dir).observe_health(report)
    return spark.createDataFrame([(*[state["counts"][t] for t in ("sessions", "subagents", "outputs", "blocks")], state["completeness"])], "sessions long, subagents long, outputs long, blocks long, completeness string")


def _no_failures(rows: DataFrame) -> DataFrame:
    return rows.select("source", "source_identifier", "path", "line_number", F.lit("").alias("reason")).limit(0)


@query(_with(_REC) + "SELECT source, source_identifier, count(*) AS records, count(DISTINCT path) AS files, 'Indexed' AS status FROM rec GROUP BY ALL UNION ALL SELECT 'Pi', 'root-none', 0, 0, 'Empty'")
def source_files(spark, sf_dir):
    rows = _records(spark, sf_dir)
    roots = rows.select("source", "source_identifier").distinct().union(spark.createDataFrame([("Pi", "root-none")], "source string, source_identifier string"))
    return health.source_health(roots, rows, _no_failures(rows), _no_failures(rows)).select("source", "source_identifier", "records", "files", "status")


@query(
    _with(_REC, _SESS, "state AS (SELECT source, count(*) AS records, count(DISTINCT path) AS files FROM rec WHERE source <> 'Codex' GROUP BY source)")
    + "SELECT session_reference, CASE WHEN records IS NULL THEN 'Unconfigured' ELSE 'Indexed' END AS source_status, records, files FROM sess LEFT JOIN state USING (source)"
)
def inventory_with_source_state(spark, sf_dir):
    index, rows = _index(spark, sf_dir), _records(spark, sf_dir)
    report = health.source_health(rows.select("source", "source_identifier").distinct(), rows, _no_failures(rows), _no_failures(rows)).where("source <> 'Codex'")
    all_cards = Index(index.tables, InterfaceLimits(page_items=1_000_000))
    return all_cards.inventory(configured=report).select("session_reference", "source_status", F.col("scan_report.records").alias("records"), F.col("scan_report.files").alias("files"))


# --- transcript lines ------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, path, line_number, raw): every turn as a JSON line of its producer; of a fourth source most lines are no JSON."""
    rows = _records(spark, sf_dir).join(_table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), (F.col("turn") + 1).cast("long").alias("line_number"), "role"), ["path", "line_number"])
    turn = F.col("line_number") - 1
    piece = lambda **f: F.to_json(F.struct(*[x.alias(k) for k, x in f.items()]))
    text, role, lit = F.to_json(F.struct("text")), F.col("role"), F.lit
    quoted = F.substring(text, 9, F.length(text) - 9)  # the text as a JSON string
    role_json = F.concat(lit('"'), role, lit('"'))
    number = turn.cast("string")
    claude = F.when(
        turn % 2 == 0,
        F.concat(
            lit('{"timestamp":"'), "timestamp", lit('","type":'), role_json, lit(',"title":"T'), number, lit('","agent_name":"w'), number, lit('","task_id":"k'), number,
            lit('","message":{"role":'), role_json, lit(',"content":[{"type":"thinking","thinking":"t'), number, lit('"},{"type":"text","text":'), quoted,
            lit('},{"type":"tool_use","name":"Bash","id":"u1","input":{"b":1,"a":"x"}},{"type":"tool_result","content":[{"text":"ok"},{"text":"fine"}]},{"type":"image"}]}}'),
        ),
    ).otherwise(piece(timestamp=F.col("timestamp"), role=role, text=F.col("text")))
    codex = (
        F.when(turn % 4 == 0, F.concat(lit('{"payload":{"type":"message","role":'), role_json, lit(',"content":[{"text":'), quoted, lit('},{"content":[{"text":"deep"}]}]}}')))
        .when(turn % 4 == 1, lit('{"payload":{"type":"function_call","name":"f","arguments":"{}"}}'))
        .when(turn % 4 == 2, F.concat(lit('{"payload":{"type":"function_call_output","output":'), quoted, lit("}}")))
        .otherwise(F.concat(lit('{"payload":{"type":"reasoning","summary":[{"text":"why"},{"text":'), quoted, lit("}]}}")))
    )
    pi = (
        F.when(turn % 3 == 0, F.concat(lit('{"type":"message","message":{"role":'), role_json, lit(',"content":[{"type":"thinking","text":"p"},{"type":"toolCall","name":"g","input":1},{"type":"text","text":'), quoted, lit("}]}}")))
        .when(turn % 3 == 1, piece(role=role, output=F.col("text")))
        .otherwise(lit('{"type":"custom_message","content":"note"}'))
    )
    broken = F.element_at(F.array(*[lit(x) for x in ("not-json", '{"text":"a\\ud800b"}', '{"text":"x","n":NaN}', '{"text":"x","n":' + "[" * 200 + "]" * 200 + "}", '{"text":"ok"}', "")]), (turn % 6 + 1).cast("int"))
    raw = F.when(F.col("source") == "Claude", claude).when(F.col("source") == "Codex", codex).when(F.col("source") == "Pi", pi).otherwise(broken)
    return rows.select("source", "path", "line_number", raw.alias("raw"))


def _parsed(spark, sf_dir, source: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where(F.col("source") == source)
    return rows.select("path", "line_number", parsed(F.lit(source), F.col("raw")).alias("p"))


def _natively_parsed(spark, sf_dir, source: str) -> DataFrame:
    """As ``_parsed`` without a Python worker; a line that needs one is an error."""
    rows = variant.with_native(_lines(spark, sf_dir).where(F.col("source") == source))
    return rows.select("path", "line_number", F.when(F.col("sure"), F.col("native")).otherwise(F.raise_error(F.concat(F.lit("not sure of "), "raw"))).alias("p"))


def _parsed_blocks(name: str, source: str, pieces: list[tuple[str, str, str]]) -> None:
    """A query of the blocks of a source's lines. ``pieces``: condition, kind and text in SQL, in order; blank texts count for nothing."""

    def run(spark, sf_dir):
        return (_natively_parsed if source in variant.SOURCES else _parsed)(spark, sf_dir, source).select("path", "line_number", F.posexplode("p.blocks").alias("block_index", "b")).select("path", "line_number", "block_index", F.col("b.kind").alias("kind"), F.col("b.text").alias("content"))

    run.__name__ = name
    parts = [f"SELECT path, line_number, {i} AS pos, {kind} AS kind, {text} AS content FROM rec WHERE source = '{source}' AND {condition}" for i, (condition, kind, text) in enumerate(pieces)]
    sql = f"b AS ({' UNION ALL '.join(parts)})"
    query(_with(_REC, sql) + "SELECT path, line_number, (row_number() OVER (PARTITION BY path, line_number ORDER BY pos) - 1)::int AS block_index, kind, content FROM b WHERE kind = 'Attachment' OR trim(content) <> ''")(run)


_parsed_blocks("parse_claude_blocks", "Claude", [
    ("turn % 2 = 0", "'Inference'", "'t' || turn"),
    ("TRUE", "kind", "txt"),
    ("turn % 2 = 0", "'ToolCall'", """'{"id":"u1","input":{"a":"x","b":1},"name":"Bash","type":"tool_use"}'"""),
    ("turn % 2 = 0", "'ToolResult'", "'ok' || chr(10) || 'fine'"),
    ("turn % 2 = 0", "'Attachment'", "NULL"),
])
_parsed_blocks("parse_codex_blocks", "Codex", [
    ("turn % 4 = 0", "kind", "txt || chr(10) || 'deep'"),
    ("turn % 4 = 1", "'ToolCall'", """'{"arguments":"{}","name":"f","type":"function_call"}'"""),
    ("turn % 4 = 2", "'ToolResult'", "txt"),
    ("turn % 4 = 3", "'Inference'", "'why' || chr(10) || txt"),
])
_parsed_blocks("parse_pi_blocks", "Pi", [
    ("turn % 3 = 0", "'Inference'", "'p'"),
    ("turn % 3 = 0", "'ToolCall'", """'{"input":1,"name":"g","type":"toolCall"}'"""),
    ("turn % 3 IN (0, 1)", "kind", "txt"),
    ("turn % 3 = 2", "'SessionEvent'", "'note'"),
])


@query(_with(_REC) + "SELECT path, line_number, turn % 6 <> 4 AS malformed, CASE WHEN turn % 6 = 4 THEN 'ok' END AS content FROM rec WHERE source = 'ClaudeSubagentOutput'")
def parse_malformed_lines(spark, sf_dir):
    return _parsed(spark, sf_dir, "ClaudeSubagentOutput").select("path", "line_number", F.col("p.malformed").alias("malformed"), F.col("p.text").alias("content"))


@query(
    _with(_REC)
    + """SELECT path, line_number, ts AS timestamp, CASE WHEN turn % 2 = 0 THEN 't' || turn || chr(10) || txt ELSE txt END AS content, CASE WHEN turn % 2 = 0 THEN 'T' || turn END AS title,
 CASE WHEN turn % 2 = 0 THEN 'w' || turn END AS subagent_name, authored_status, CASE WHEN turn % 2 = 0 THEN 'k' || turn END AS task_identifier FROM rec WHERE source = 'Claude'"""
)
def parse_metadata(spark, sf_dir):
    p = F.col("p")
    return _parsed(spark, sf_dir, "Claude").select("path", "line_number", p["timestamp"].alias("timestamp"), p["text"].alias("content"), p["title"].alias("title"), p["subagent_name"].alias("subagent_name"), p["authored_status"].alias("authored_status"), p["task"]["task_identifier"].alias("task_identifier"))


# --- times, guards, archive, publication -------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((microsecond(ts) % 1000000)::varchar, 6, '0'), '0') END || 'Z' AS canonical, TRUE AS same FROM events")
def canonical_times(spark, sf_dir):
    """Timestamps to their canonical text and back."""
    at = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return _table(spark, sf_dir, "events").select("event_id", rfc3339(at).alias("canonical"), (instant(rfc3339(at)) == at).alias("same"))


@query("SELECT event_id, event_id % 5 = 0 AS canonical FROM events")
def noncanonical_times(spark, sf_dir):
    """Only the first of five writings of a time is canonical."""
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = [F.concat(day, F.lit("Z")), F.concat(day, F.lit("+00:00")), F.concat(day, F.lit(".500Z")), F.concat(F.translate(day, "T", " "), F.lit("Z")), day]
    return _table(spark, sf_dir, "events").select("event_id", instant(F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))).isNotNull().alias("canonical"))


_GUARDS = {
    "page of none": ("InvalidRequest", lambda i: i.list_outputs(Filter(), PageRequest(0))),
    "page above the limit": ("Oversized", lambda i: i.list_outputs(Filter(), PageRequest(65))),
    "unknown order": ("InvalidRequest", lambda i: i.list_outputs(Filter(), PageRequest(5, "Sideways"))),
    "preview of none": ("InvalidRequest", lambda i: i.list_outputs(Filter(), PageRequest(5), 0)),
    "preview above the limit": ("Oversized", lambda i: i.list_blocks(Filter(), PageRequest(5), 4097)),
    "read above the limit": ("Oversized", lambda i: i.read_output("output:v1:x", 65_537)),
    "word without letters": ("InvalidQuery", lambda i: i.search(tq.Word("!"))),
    "empty phrase": ("InvalidQuery", lambda i: i.search(tq.Phrase(" "))),
    "near by too many words": ("InvalidQuery", lambda i: i.search(tq.Near("a", "b", 10_001))),
    "all of nothing": ("InvalidQuery", lambda i: i.search(tq.AllOf(()))),
    "unknown session": ("Missing", lambda i: i.list_outputs(Filter(session="session:v1:x"), PageRequest(5))),
    "cursor that can't be read": ("FragileReferenceStale", lambda i: i.list_outputs(Filter(), PageRequest(5, "OldestFirst", "junk"))),
    "reversed window": ("InvalidTimeWindow", lambda i: i.outputs(Filter(window=Between("2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z")))),
    "budget of none": ("LimitExceeded", lambda i: collect.Budget(0, 1)),
    "request without an id": ("InvalidRequest", lambda i: collect.collect(None, None, "", None, collect.Budget(1, 1), CLOCK)),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{error}')" for k, (error, _) in _GUARDS.items()) + ") AS t(request, error)")
def request_guards(spark, sf_dir):
    index, found = _index(spark, sf_dir), []
    for name, (_, call) in _GUARDS.items():
        try:
            call(index)
            found.append((name, None))
        except errors.Rejected as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "request string, error string")


_ERRORS = [f"{a}_error" for a in ASPECTS]


def _requests(spark, sf_dir):
    """A request for every turn: limits by its place and length, a query by its words, a window to its session's end or, at every fourth turn, back to its start."""
    index = _index(spark, sf_dir)
    place, size = F.col("line_number") - 1, F.col("bytes")
    word, often = F.substring_index("text", " ", 1), lambda n, k: place % n == k
    rows = index.tables["blocks"].join(index.sessions().select("session_reference", "started_at", "last_observed_at"), "session_reference")
    return rows.select(
        "block_reference",
        (place * 16 - 16).alias("page_items"),
        F.when(often(3, 0), "NewestFirst").when(often(6, 1), F.col("kind")).alias("sort"),
        F.when(~often(5, 4), size * 4 - 400).alias("preview_bytes"),
        (size * 60).alias("read_bytes"),
        F.when(often(2, 0), word).alias("word"),
        F.when(often(6, 2), F.col("text")).alias("phrase"),
        F.when(often(2, 1), word).alias("near_left"),
        F.when(often(2, 1), F.col("kind")).alias("near_right"),
        F.when(often(2, 1) & ~often(7, 5), size * 10).alias("distance"),
        F.when(~often(6, 5), F.col("timestamp")).alias("window_start"),
        F.when(often(4, 3), F.col("started_at")).when(often(8, 6), F.substring("last_observed_at", 1, 16)).otherwise(F.col("last_observed_at")).alias("window_end"),
        (place - 1).alias("budget_segments"),
        size.alias("budget_bytes"),
    )


_REQUESTS_SQL = (
    _REC,
    _SESS,
    """req AS (SELECT block_reference, turn * 16 - 16 AS page_items, CASE WHEN turn % 3 = 0 THEN 'NewestFirst' WHEN turn % 6 = 1 THEN kind END AS sort, CASE WHEN turn % 5 <> 4 THEN bytes * 4 - 400 END AS preview_bytes, bytes * 60 AS read_bytes,
  split_part(txt, ' ', 1) AS w, turn, kind, txt, bytes, CASE WHEN turn % 2 = 1 AND turn % 7 <> 5 THEN bytes * 10 END AS distance, CASE WHEN turn % 6 <> 5 THEN ts END AS window_start,
  CASE WHEN turn % 4 = 3 THEN started_at WHEN turn % 8 = 6 THEN left(last_observed_at, 16) ELSE last_observed_at END AS window_end FROM rec JOIN (SELECT session_reference, started_at, last_observed_at FROM sess) USING (session_reference))""",
    """bad AS (SELECT *, strlen(w) > 256 OR len(regexp_extract_all(lower(w), '[\\p{L}\\p{N}]+')) <> 1 AS odd, len(regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+')) AS n FROM req)""",
    """err AS (SELECT block_reference, CASE WHEN window_start IS NULL OR strlen(window_end) = 16 OR window_start > window_end THEN 'InvalidTimeWindow' END AS window_error,
  CASE WHEN turn <= 1 OR bytes <= 0 THEN 'LimitExceeded' END AS budget_error,
  CASE WHEN odd OR (turn % 6 = 2 AND (n NOT BETWEEN 1 AND 32 OR bytes > 2048)) OR (turn % 2 = 1 AND (distance IS NULL OR distance > 10000)) THEN 'InvalidQuery' END AS query_error,
  CASE WHEN preview_bytes <= 0 THEN 'InvalidRequest' WHEN preview_bytes > 4096 THEN 'Oversized' END AS preview_error,
  CASE WHEN page_items <= 0 THEN 'InvalidRequest' WHEN page_items > 64 THEN 'Oversized' END AS page_error,
  CASE WHEN sort <> 'NewestFirst' THEN 'InvalidRequest' END AS sort_error,
  CASE WHEN read_bytes <= 0 THEN 'InvalidRequest' WHEN read_bytes > 65536 THEN 'Oversized' END AS read_error FROM bad)""",
)


@query(_with(*_REQUESTS_SQL) + f"SELECT *, coalesce({', '.join(_ERRORS)}) AS error FROM err")
def guarded_requests(spark, sf_dir):
    """Every request of a batch with what each check says of it."""
    return with_errors(_requests(spark, sf_dir)).select("block_reference", *_ERRORS, "error")


@query(_with(*_REQUESTS_SQL) + " UNION ALL ".join(f"SELECT '{a}' AS aspect, {a}_error AS error, count(*) AS requests FROM err WHERE {a}_error IS NOT NULL GROUP BY 2" for a in ASPECTS))
def request_rejections(spark, sf_dir):
    return rejections(_requests(spark, sf_dir))


@query(_with(*_REQUESTS_SQL) + f"SELECT block_reference, page_items, preview_bytes, read_bytes, distance FROM req JOIN err USING (block_reference) WHERE coalesce({', '.join(_ERRORS)}) IS NULL")
def admitted_requests(spark, sf_dir):
    return admitted(_requests(spark, sf_dir)).select("block_reference", "page_items", "preview_bytes", "read_bytes", "distance")


_BAD = Configuration((Root("", "Word", ""), Root("/x", "Pi", "p"), Root("/y", "Pi", "p", Limits(files=0))), ("",), "../x", InterfaceLimits(read_bytes=0))


@query("SELECT * FROM (VALUES ('UnknownSource:Word'), ('EmptyPath'), ('EmptyIdentifier'), ('RepeatedSource:Pi:p'), ('ZeroLimit:files'), ('ZeroLimit:read_bytes'), ('EmptyRepository'), ('ArchivePathLeavesRoot'), ('MissingTranscriptSource')) AS t(issue)")
def configuration_issues(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in [*issues(_BAD), *issues(Configuration())]], "issue string")


@query("SELECT 'talkprism 0.5.0' AS version")
def version(spark, sf_dir):
    return spark.createDataFrame([(_index(spark, sf_dir).version(),)], "version string")


@query(_with(_REC, _SESS, "a AS (SELECT session_reference, row_number() OVER (ORDER BY started_at, session_reference) - 1 AS n, output_count FROM sess QUALIFY n < 3)") + "SELECT 'archive-record-' || lpad(n::varchar, 16, '0') AS record_identifier, session_reference, output_count, left('summary of ' || n, 10) AS summary, 'Truncated' AS summary_state FROM a")
def archive_records(spark, sf_dir):
    """Three sessions written to a new archive, queried, and each read with a cut summary."""
    name = f"archive-{uuid.uuid4().hex}"
    _scratch(spark, name)
    archive = Archive(spark, spark.conf.get("spark.sql.warehouse.dir"), name)
    for n, row in enumerate(_index(spark, sf_dir).list_sessions(Filter(), PageRequest(3)).rows):
        archive.write({**row.asDict(), "started_at": row["started_at"]}, f"summary of {n}", "query", "2025-01-04T00:00:00Z")
    out = []
    for row in archive.query().collect():
        read = archive.read(row["record_identifier"], 10, 100)
        out.append((row["record_identifier"], row["session_reference"], row["output_count"], read["summary"], read["summary_state"]))
    return spark.createDataFrame(out, "record_identifier string, session_reference string, output_count long, summary string, summary_state string")


@query(_with(_REC, _SESS) + "SELECT session_reference, source, output_count, subagent_count, total_bytes FROM sess")
def published_sessions(spark, sf_dir):
    """Two sources published, then all five: what a reader of the second generation sees."""
    store, rows = Store(spark, _database(spark, "published")), _records(spark, sf_dir)
    store.publish(rows.where("source in ('Claude', 'Pi')"))
    return store.publish(rows.where("source in ('Claude', 'Pi')").union(rows.where("source not in ('Claude', 'Pi')"))).tables["sessions"].select("session_reference", "source", "output_count", "subagent_count", "total_bytes")


@query(_with(_REC) + "SELECT output_reference, 'Removed' AS state FROM rec WHERE turn % 3 = 1")
def removed_outputs(spark, sf_dir):
    rows = model.outputs(model.keyed(_records(spark, sf_dir)))
    return changed_groups(rows, rows.where("(line_number - 1) % 3 <> 1"), "output_reference")


@query(_with(_REC) + "SELECT output_reference, source, produced_at FROM (SELECT output_reference, source, ts AS produced_at FROM rec WHERE source <> 'Pi' OR turn % 2 = 0) WHERE source IN ('Pi', 'Codex')")
def replaced_source(spark, sf_dir):
    """Two sources in slots, then one of them replaced by half of its records."""
    store, rows = SlotStore(spark, _database(spark, "replaced")), _records(spark, sf_dir)
    for source, identifier in (("Pi", "root-2"), ("Codex", "root-1")):
        store.replace(rows, source, identifier)
    store.replace(rows.where("(line_number - 1) % 2 = 0"), "Pi", "root-2")
    return Index.of(store.snapshot(), InterfaceLimits(), CLOCK).outputs().select("output_reference", "source", "produced_at")


# --- transcript files --------------------------------------------------------------------------------


#: Of the roots below: their few files hold all turns, and grow with them.
_ANY_LENGTH = Limits(file_bytes=None)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the warehouse, which goes when the driver ends."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def _database(spark: SparkSession, name: str) -> str:
    """The name of a new database whose folder goes when the driver ends."""
    name = f"{name}_{uuid.uuid4().hex[:8]}"
    _scratch(spark, f"{name}.db")
    return name


def _write_transcripts(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """(file, line_number, raw) as files below ``folder``, each written by one task in order of its lines; files that are there are replaced.

    Dealt out by a hash of the file, which no input is dealt by: Spark leaves out a shuffle by ``file`` where a union's sides
    have one each, and then merges small partitions of either side on its own, so that two tasks write one file.
    """
    staged = f"{folder}/staged-{uuid.uuid4().hex}"
    rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", "line_number").select("file", "raw").write.partitionBy("file").text(staged)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [found.getPath() for found in fs.globStatus(paths(f"{staged}/file=*/part-*"))]
    names = [part.getParent().getName().removeprefix("file=") for part in parts]
    if len(set(names)) < len(names):
        raise ValueError("several tasks wrote lines of one file")
    for name, part in zip(names, parts, strict=True):
        target = paths(f"{folder}/{name}")
        fs.delete(target, False)
        fs.rename(part, target)
    fs.delete(paths(staged), True)


def _transcript_lines(spark: SparkSession, sf_dir: str, files: int, prefix: str = "claude-") -> DataFrame:
    """(conv_id, turn, file, line_number, n, raw): conversations dealt over files as JSON lines of one producer; n lines in a file."""
    rows = _table(spark, sf_dir, "conversations").withColumn("file", F.concat(F.lit(prefix), (F.col("conv_id") % files).cast("string"), F.lit(".jsonl")))
    own = Window.partitionBy("file")
    raw = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("text")))
    return rows.select("conv_id", "turn", "file", F.row_number().over(own.orderBy("conv_id", "turn")).cast("long").alias("line_number"), F.count(F.lit(1)).over(own).alias("n"), raw.alias("raw"))


_DEALT = """c AS (SELECT conv_id, turn, role, conv_id % 16 AS f, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS line_number, count(*) OVER (PARTITION BY conv_id % 16) AS n, "text" AS content FROM conversations)"""


@query(
    f"""WITH {_DEALT} SELECT 'claude-' || f || '.jsonl' AS file, line_number, CASE role WHEN 'user' THEN 'UserPrompt' WHEN 'assistant' THEN 'AgentResponse' WHEN 'system' THEN 'SystemInstruction' ELSE 'Unclassified' END AS kind, content,
 (SELECT count(*) FROM c WHERE f % 2 = 0 AND line_number > (n + 1) // 2) AS lines_parsed FROM c WHERE f % 2 = 0 OR line_number <= (n + 1) // 2"""
)
def resumed_scan(spark, sf_dir):
    """Files with half of their lines are scanned; half of the files grow, and the scan goes on. All rows, and how many lines the second scan parsed."""
    folder, lines = _scratch(spark, f"transcripts-{uuid.uuid4().hex}"), _transcript_lines(spark, sf_dir, 16)
    store, root = SlotStore(spark, _database(spark, "resumed")), Root(folder, "Claude", "main", _ANY_LENGTH)
    half = F.col("line_number") <= F.expr("(n + 1) div 2")
    _write_transcripts(spark, lines.where(half), folder)
    store.refresh([root])
    _write_transcripts(spark, lines.where("conv_id % 2 = 0"), folder)
    (slot,) = store.refresh([root])
    blocks = store.snapshot().tables["blocks"]
    return blocks.select(F.substring_index("path", "/", -1).alias("file"), "line_number", "kind", F.col("text").alias("content"), F.lit(slot.parsed).cast("long").alias("lines_parsed"))


@query(
    """WITH c AS (SELECT ['grown', 'broken', 'gone'][conv_id % 3 + 1] AS source_identifier, turn < 4 AS early FROM conversations)
SELECT source_identifier, CASE source_identifier WHEN 'grown' THEN 'Complete' WHEN 'broken' THEN 'Incomplete' ELSE 'Failed' END AS coverage, count(*) FILTER (early OR source_identifier = 'grown') AS complete_records,
 count(*) FILTER (early OR source_identifier <> 'gone') AS newest_records, source_identifier <> 'grown' AS same_files FROM c GROUP BY source_identifier"""
)
def slots_of_sources(spark, sf_dir):
    """Three sources; one grows, one grows with a broken line, one can't be listed: what readers of the complete and of the newest generations see, and whether a source's files are those of before."""
    folder, names = _scratch(spark, f"sources-{uuid.uuid4().hex}"), ("grown", "broken", "gone")
    store, roots = SlotStore(spark, _database(spark, "slots")), [Root(f"{folder}/{n}", "Claude", n, _ANY_LENGTH) for n in names]
    lines = _transcript_lines(spark, sf_dir, 24)
    for k, root in enumerate(roots):
        _write_transcripts(spark, lines.where((F.col("conv_id") % 3 == k) & (F.col("turn") < 4)), root.path)
    store.refresh(roots)
    files = lambda: {n: {f for f in store.snapshot().tables["records"].inputFiles() if f"slot={slot_name('Claude', n)}" in f} for n in names}
    before = files()
    _write_transcripts(spark, lines.where("conv_id % 3 = 0"), roots[0].path)
    broken = lines.where("conv_id % 3 = 1")
    _write_transcripts(spark, broken.unionByName(broken.where("line_number = n").withColumns({"line_number": F.col("n") + 1, "raw": F.lit("no json")})), roots[1].path)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    paths(folder).getFileSystem(spark._jsc.hadoopConfiguration()).rename(paths(roots[2].path), paths(f"{folder}/elsewhere"))
    coverage, after = {s.source_identifier: s.coverage for s in store.refresh(roots)}, files()
    count = lambda partial, name: store.snapshot(partial).tables["records"].groupBy("source_identifier").agg(F.count(F.lit(1)).alias(name))
    state = spark.createDataFrame([(n, coverage[n], before[n] == after[n]) for n in names], "source_identifier string, coverage string, same_files boolean")
    return state.join(count(False, "complete_records"), "source_identifier").join(count(True, "newest_records"), "source_identifier")


@query(
    f"""WITH {_DEALT} SELECT 'claude-' || f || '.jsonl' AS file, line_number, CASE WHEN f % 4 = 0 THEN 'Fresh' WHEN f % 4 = 3 THEN 'Broken' ELSE 'Stale' END AS state,
 CASE WHEN f % 4 = 0 THEN {_prefix('content', 20)} END AS content, CASE WHEN f % 4 = 0 THEN CASE WHEN strlen(content) > 20 THEN 'Truncated' ELSE 'Complete' END END AS content_state FROM c"""
)
def read_changed_lines(spark, sf_dir):
    """Every block of the index read from its file's line, after a quarter of the files was written anew with other texts, one grew, and one went."""
    folder, lines = _scratch(spark, f"backing-{uuid.uuid4().hex}"), _transcript_lines(spark, sf_dir, 16)
    store, root = SlotStore(spark, _database(spark, "backing")), Root(folder, "Claude", "main", _ANY_LENGTH)
    _write_transcripts(spark, lines, folder)
    store.refresh([root])
    other = F.when(F.col("conv_id") % 4 == 1, F.replace("raw", F.lit("e"), F.lit("E"))).otherwise(F.col("raw"))
    more = lines.where("conv_id % 4 = 2 and line_number = n").withColumn("line_number", F.col("n") + 1)
    _write_transcripts(spark, lines.where("conv_id % 4 in (1, 2)").withColumn("raw", other).unionByName(more), folder)
    _remove(spark, folder, [f"claude-{f}.jsonl" for f in range(3, 16, 4)])
    tables = store.snapshot().tables
    found = read_many(tables, tables["blocks"].select(F.col("block_reference").alias("reference")), [root], 20)
    names = tables["blocks"].select(F.col("block_reference").alias("reference"), F.substring_index("path", "/", -1).alias("file"), "line_number")
    return found.join(names, "reference").select("file", "line_number", "state", F.col("text").alias("content"), F.col("text_state").alias("content_state"))


def _remove(spark: SparkSession, folder: str, names: list[str]) -> None:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(paths(f"{folder}/{name}"), False)


@query(f"""WITH {_DEALT} SELECT f::varchar AS producer, count(*) AS outputs, CASE WHEN f % 3 = 0 THEN 'SourceMissing' ELSE 'Current' END AS lifecycle, (f % 3 <> 0)::bigint AS file_count FROM c GROUP BY f""")
def session_lifecycle(spark, sf_dir):
    """Cards of one session a file, after a third of the files went."""
    folder, lines = _scratch(spark, f"lifecycle-{uuid.uuid4().hex}"), _transcript_lines(spark, sf_dir, 16)
    store, root = SlotStore(spark, _database(spark, "lifecycle")), Root(folder, "Claude", "main", _ANY_LENGTH)
    _write_transcripts(spark, lines, folder)
    store.refresh([root])
    _remove(spark, folder, [f"claude-{f}.jsonl" for f in range(0, 16, 3)])
    cards = with_lifecycle(store.snapshot().tables["sessions"], listed(spark, [root]))
    return cards.select(F.col("session_identifier").alias("producer"), F.col("output_count").alias("outputs"), "lifecycle", "file_count")
