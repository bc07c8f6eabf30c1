"""Requests over a published index: listings, pages, searches, reads, rejections, publication."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from talkprism import errors
from talkprism.functions import text as tx
from talkprism.functions import textquery as tq
from talkprism.functions.timestamps import Between, Clock, Recent, Since
from talkprism.operators import guards
from talkprism.operators.archive import Archive
from talkprism.operators.config import Configuration, ConfigurationStore, InterfaceLimits, default_roots, issues, place_issues
from talkprism.operators.requests import Index, PageRequest
from talkprism.operators.store import Store, changed_groups
from talkprism.plans import collect, health, model, paging
from talkprism.plans.filters import Filter
from talkprism.sources.jsonl import Limits, Root, scan

CLOCK = Clock(dt.datetime(2025, 1, 1, 12, tzinfo=dt.timezone.utc))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("root")
    lines = [
        {"timestamp": "2025-01-01T10:00:00Z", "type": "user", "text": "find Alpha, then beta omega"},
        {"timestamp": "2025-01-01T10:00:00.5Z", "type": "assistant", "agent_name": "writer", "task_id": "t1", "message": {"content": [{"type": "thinking", "thinking": "alpha?"}, {"type": "text", "text": "an exact phrase\nof two lines"}, {"type": "image"}]}},
        {"timestamp": "2025-01-01T11:30:00Z", "type": "assistant", "agent_name": "writer", "text": "héllo wörld"},
        {"type": "assistant", "text": "no time"},
    ]
    (folder / "claude-s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (folder / "claude-s2.jsonl").write_text(json.dumps({"timestamp": "2025-01-01T09:00:00Z", "type": "user", "text": "other"}))
    return str(folder)


@pytest.fixture(scope="module")
def index(spark, root):
    store = Store(spark, "index_of_requests")
    snapshot, _ = store.refresh([Root(root, "Claude", "main")])
    return Index.of(snapshot, InterfaceLimits(page_items=4, preview_bytes=20, read_bytes=100), CLOCK)


def all_pages(call, limit, order="OldestFirst"):
    rows, cursor = [], None
    while True:
        page = call(PageRequest(limit, order, cursor))
        rows += page.rows
        cursor = page.next_cursor
        if cursor is None:
            return rows
        assert len(page.rows) == limit


@pytest.mark.parametrize("order", paging.ORDERS)
@pytest.mark.parametrize("limit", [1, 2, 4])
def test_pages_give_the_whole_order(index, order, limit):
    rows = all_pages(lambda p: index.list_outputs(Filter(), p), limit, order)
    whole = paging.ordered(index.outputs(), paging.keys(order, "output_reference", "produced_at")).collect()
    assert [r["output_reference"] for r in rows] == [r["output_reference"] for r in whole] and len(rows) == 5
    if order != "ReferenceAscending":
        assert rows[-1]["produced_at"] is None  # without a time last, either way


def test_fraction_sorts_as_text(index):
    times = [r["produced_at"] for r in all_pages(lambda p: index.list_outputs(Filter(), p), 3)]
    assert times[1:3] == ["2025-01-01T10:00:00.5Z", "2025-01-01T10:00:00Z"]


def test_blocks_in_order_with_previews(index):
    rows = all_pages(lambda p: index.list_blocks(Filter(), p, 7), 3)
    assert [(r["kind"], r["preview"]) for r in rows if r["timestamp"] == "2025-01-01T10:00:00.5Z"] == [("Inference", "alpha?"), ("AgentResponse", "an exac"), ("Attachment", None)]
    assert {r["preview_state"] for r in rows} == {"Complete", "Truncated", None}
    only = index.list_blocks(Filter(kinds=("Inference",), task="t1"), PageRequest(4)).rows
    assert len(only) == 1 and "text" not in only[0] and "preview" not in only[0]


def test_sessions_and_subagents(index):
    rows = index.list_sessions(Filter(), PageRequest(4, "NewestFirst")).rows
    assert [(r["session_identifier"], r["output_count"], r["subagent_count"], r["role"]) for r in rows] == [("s1", 4, 1, "MainSession"), ("s2", 1, 0, "MainSession")]
    assert rows[0]["started_at"] == "2025-01-01T10:00:00Z" and rows[0]["last_observed_at"] == "2025-01-01T11:30:00Z" and rows[0]["first_bytes"] == 27
    sub = index.list_subagents(Filter(session=rows[0]["session_reference"]), PageRequest(4)).rows
    assert [(r["subagent_name"], r["output_count"], r["task_identifier"]) for r in sub] == [("writer", 2, "t1")]
    assert len(index.list_outputs(Filter(subagent=sub[0]["subagent_reference"]), PageRequest(4)).rows) == 2


def test_windows(index):
    count = lambda w: index.outputs(Filter(window=w)).count()
    assert count(Since("2025-01-01T10:00:00Z")) == 3 and count(Between("2025-01-01T09:00:00Z", "2025-01-01T10:00:00Z")) == 2 and count(Recent(1, "hours")) == 1
    for bad in (Recent(0, "days"), Recent(1, "weeks"), Between("2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z"), Since("yesterday")):
        with pytest.raises(errors.InvalidTimeWindow):
            count(bad)


def test_searches(index):
    found = lambda q: sorted(r["bytes"] for r in index.search(q).collect())
    assert found(tq.Word("ALPHA")) == [6, 27] and found(tq.Phrase("exact phrase")) == [28]
    assert found(tq.Near("omega", "then", 1)) == [27] and found(tq.Near("alpha", "omega", 1)) == []
    assert found(tq.AnyOf((tq.Word("wörld"), tq.Phrase("two lines")))) == [13, 28]
    assert found(tq.AllOf((tq.Word("alpha"), tq.Not(tq.Word("find"))))) == [6]
    rows = all_pages(lambda p: index.search_blocks(tq.Word("alpha"), Filter(), p), 1)
    assert [[(s["start"], s["end"]) for e in r["evidence"] for s in e["spans"]] for r in rows] == [[(0, 0)], [(1, 1)]]


@pytest.mark.parametrize(
    "query",
    [tq.Word("!!!"), tq.Word("two words"), tq.Word("x" * 300), tq.Phrase(" "), tq.Phrase("w " * 33), tq.Near("a", "b", 10_001), tq.AllOf(()), tq.AnyOf((tq.AllOf(()),)), tq.AnyOf(tuple(tq.Word("a") for _ in range(64)))],
)
def test_bad_queries(index, query):
    with pytest.raises(errors.InvalidQuery):
        index.search_blocks(query, Filter(), PageRequest(1))


def test_deep_query(index):
    q = tq.Word("a")
    for _ in range(16):
        q = tq.Not(q)
    with pytest.raises(errors.InvalidQuery):
        index.search(q)


@pytest.mark.parametrize("order", ["OldestModifiedFirst", "NewestModifiedFirst"])
def test_cursors_on_times_in_two_zones(spark, order):
    """The session's zone and the driver's differ; pages still give every row once, at a clock change too."""
    times = [dt.datetime(2025, 11, 2, 4, 30, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=30 * i, microseconds=i) for i in range(9)]
    rows = spark.createDataFrame([(f"r{i}", "Claude", None, None, int(t.timestamp()) * 1_000_000 + t.microsecond) for i, t in enumerate(times)] + [("none", "Claude", None, None, None)], "session_reference string, source string, last_observed_at string, started_at string, us long")
    own = Index({"sessions": rows.withColumn("modified", F.timestamp_micros("us"))}, InterfaceLimits(page_items=4))
    before, zone = spark.conf.get("spark.sql.session.timeZone"), os.environ.get("TZ")
    try:
        for session, driver in (("UTC", "America/New_York"), ("America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", session)
            os.environ["TZ"] = driver
            time.tzset()
            got = [r["session_reference"] for r in all_pages(lambda p: own.list_sessions(Filter(), p), 3, order)]
            want = [f"r{i}" for i in range(9)]
            assert got == [*(want if order.startswith("Oldest") else want[::-1]), "none"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        os.environ.pop("TZ") if zone is None else os.environ.update(TZ=zone)
        time.tzset()


def test_limits_references_and_cursors(index):
    page = index.list_outputs(Filter(), PageRequest(2))
    for request, error in ((PageRequest(0), errors.InvalidRequest), (PageRequest(5), errors.Oversized), (PageRequest(2, "Sideways"), errors.InvalidRequest)):
        with pytest.raises(error):
            index.list_outputs(Filter(), request)
    for cursor, order in (("junk", "OldestFirst"), (page.next_cursor, "NewestFirst"), ("x" * 5000, "OldestFirst")):
        with pytest.raises(errors.FragileReferenceStale):
            index.list_outputs(Filter(), PageRequest(2, order, cursor))
    with pytest.raises(errors.FragileReferenceStale):
        index.list_outputs(Filter(task="t1"), PageRequest(2, "OldestFirst", page.next_cursor))
    for preview, error in ((0, errors.InvalidRequest), (21, errors.Oversized)):
        with pytest.raises(error):
            index.list_outputs(Filter(), PageRequest(2), preview)
    with pytest.raises(errors.Missing):
        index.list_outputs(Filter(session="session:v1:none"), PageRequest(2))


def test_reads_and_estimates(index, spark, root):
    row = index.outputs(Filter(window=Since("2025-01-01T11:00:00Z"))).first()
    ref = row["output_reference"]
    assert index.read_output(ref, 100) == {"text": "héllo wörld", "state": "Complete"}
    assert index.read_output(ref, 2) == {"text": "h", "state": "Truncated"}
    assert index.read_output(ref, 100, byte_range=(0, 3))["text"] == "hé" and index.estimate_output(ref)["bytes"] == 13
    for bad in ((0, 2), (2, 5), (0, 14), (5, 4)):
        with pytest.raises(errors.InvalidRange):
            index.read_output(ref, 100, byte_range=bad)
    assert index.estimate_output(ref, byte_range=(1, 4)) == {"bytes": 3, "certainty": "Exact"}
    assert index.estimate_output(ref, line_range=(1, 2))["certainty"] == "Estimated"
    with pytest.raises(errors.InvalidRange):
        index.estimate_output(ref, line_range=(0, 2))
    block = index.blocks(Filter(kinds=("AgentResponse",), task="t1")).first()["block_reference"]
    assert index.read_block(block, 8) == {"text": "an exact", "state": "Truncated"} and index.estimate_block(block)["lines"] == 2
    with pytest.raises(errors.Missing):
        index.read_block(index.blocks(Filter(kinds=("Attachment",))).first()["block_reference"], 8)
    segment = index.list_segments(ref, PageRequest(1), 5).rows[0]
    assert segment["preview"] == "héll" and segment["byte_range"]["end"] == 13
    current = scan(spark, Root(root, "Claude", "main")).records.select("path", "fingerprint").distinct()
    assert index.read_output(ref, 100, current=current)["state"] == "Complete"
    with pytest.raises(errors.FragileReferenceStale):
        index.read_output(ref, 100, current=current.withColumn("fingerprint", F.lit("changed")))
    with pytest.raises(errors.FragileReferenceBroken):
        index.read_output(ref, 100, current=current.limit(0))
    records = scan(spark, Root(root, "Claude", "main")).records
    assert index.read_output(ref, 100, current=records)["state"] == "Complete" and index.read_block(block, 8, current=records)["state"] == "Truncated"
    other = records.withColumn("text", F.lit("rewritten")).withColumn("blocks", F.transform("blocks", lambda b: b.withField("kind", F.lit("UserPrompt"))))
    for read in (index.read_output, index.read_block):
        with pytest.raises(errors.FragileReferenceStale):
            read(ref if read == index.read_output else block, 8, current=other)
        with pytest.raises(errors.FragileReferenceBroken):
            read(ref if read == index.read_output else block, 8, current=records.where("line_number = 99"))


def test_texts(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a\nb\n",), ("é😀x",)], "t string")
    got = rows.select(tx.line_count("t"), tx.byte_length("t"), tx.utf8_prefix("t", 3), tx.line_range("t", 1, 2), tx.byte_range("t", 0, 2), tx.tokens("t")).collect()
    assert [tuple(r)[:2] for r in got] == [(0, 0), (1, 1), (2, 4), (1, 7)]
    assert [r[2] for r in got] == ["", "a", "a\nb", "é"] and [r[3] for r in got] == [None, "a", "a", "é😀x"] and [r[4] for r in got] == [None, None, "a\n", "é"]


def test_inventory_lookup_and_health(index, spark, tmp_path):
    archive = Archive(spark, str(tmp_path), "summaries")
    assert {r["archive_status"] for r in index.inventory(archived=archive.rows()).collect()} == {"ArchiveUnknown"}
    first = index.lookup_session(producer=("Claude", "s1")).first()
    assert archive.write(first.asDict(), "summary möre", "by hand", "2025-01-02T00:00:00Z") == "archive-record-0000000000000000"
    assert archive.write(first.asDict(), "again", "by hand", "2025-01-02T00:00:00Z").endswith("1")
    status = {r["session_identifier"]: r["archive_status"] for r in index.inventory(archived=archive.rows()).collect()}
    assert status == {"s1": "Archived", "s2": "NotArchived"}
    read = archive.read("archive-record-0000000000000000", 10, 100)
    assert read["summary"] == "summary m" and read["summary_state"] == "Truncated" and read["provenance_state"] == "Complete"
    assert archive.query(first["session_reference"]).count() == 2 and archive.query("none").count() == 0
    with pytest.raises(errors.Missing):
        archive.read("archive-record-9", 1, 1)
    for path in ("/etc/x", "../x", "a/../../x", "s3://b/x", ""):
        with pytest.raises(errors.Unauthorized):
            Archive(spark, str(tmp_path), path)
    with pytest.raises(errors.Oversized):
        Index(index.tables, InterfaceLimits(page_items=1)).inventory()
    assert index.lookup_session(reference=first["session_reference"]).count() == 1 and index.lookup_session(locator=("Claude", "nowhere")).count() == 0


def test_publication_keeps_the_last_complete_generation(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, "index_of_publication")
    folder.mkdir()
    root = Root(str(folder), "Claude", "main")
    with pytest.raises(errors.CollectionUnavailable):
        store.snapshot()
    (folder / "a.jsonl").write_text('{"text":"one"}')
    one, _ = store.refresh([root])
    assert store.refresh([root])[0].generation == one.generation  # nothing changed
    (folder / "b.jsonl").write_text("not-json")
    assert store.refresh([root])[0].generation == one.generation  # incomplete
    assert store.refresh([root], partial=True)[0].digest == one.digest
    (folder / "b.jsonl").write_text('{"text":"two"}')
    two, _ = store.refresh([root])
    assert two.generation != one.generation and two.tables["outputs"].count() == 2
    os.remove(folder / "a.jsonl")
    three, scans = store.refresh([root])
    assert {t.name.split("_")[0] for t in spark.catalog.listTables("index_of_publication")} == {"current", two.generation, three.generation}
    spark.range(1).write.saveAsTable("index_of_publication.gen0_records")
    young = f"gen{int(time.time() * 1000)}x0"  # of a writer that may be at work
    spark.range(1).write.saveAsTable(f"index_of_publication.{young}_records")
    assert store.clean() == ["gen0"] and store.clean(-1) == [young] and store.snapshot().tables["outputs"].count() == 1
    gone = changed_groups(two.tables["outputs"], three.tables["outputs"], "output_reference").collect()
    assert len(gone) == 1 and gone[0]["state"] == "Removed"
    with pytest.raises(errors.FragileReferenceStale):
        store.point(store.pointer(), None)
    roots = spark.createDataFrame([("Claude", "main"), ("Pi", "none")], "source string, source_identifier string")
    report = health.source_health(roots, scans[0].records, scans[0].failures, scans[0].truncations)
    assert {(r["source"], r["status"], r["files"]) for r in report.collect()} == {("Claude", "Indexed", 1), ("Pi", "Empty", 0)}
    states = lambda found: {(r["source_status"], r["scan_report"] and r["scan_report"]["records"]) for r in Index(three.tables).inventory(configured=found).collect()}
    assert states(report) == {("Indexed", 1)} and states(report.where("source = 'Pi'")) == {("Unconfigured", None)}
    state = Index(three.tables).observe_health(report)
    assert state["counts"]["outputs"] == 1 and state["completeness"] == "Complete"


def test_collect(spark, root):
    found = scan(spark, Root(root, "Claude", "main"))
    package = collect.collect(found.records, found.failures, "r1", Recent(3, "hours"), collect.Budget(2, 30, 20), CLOCK, ("Claude",))
    assert package.volumes.first()["record_count"] == 4 and package.volumes.first()["first_timestamp"] == "2025-01-01T09:00:00Z"
    rows = package.segments.orderBy("place").collect()
    assert [(r["excerpt"], r["truncation"]) for r in rows] == [("find Alpha, then bet", "ProjectionLimit"), ("alpha?\nan ", "RequestLimit")]
    assert sum(len(r["excerpt"].encode()) for r in rows) == 30 and package.truncations.count() == 1
    plain = collect.collect(found.records, found.failures, "r2", None, collect.Budget(10, 10), CLOCK)
    assert plain.segments.count() == 5 and "excerpt" not in plain.segments.columns
    with pytest.raises(errors.LimitExceeded):
        collect.Budget(0, 1)
    with pytest.raises(errors.InvalidRequest):
        collect.collect(found.records, found.failures, "", None, collect.Budget(1, 1), CLOCK)


def test_byte_budget_never_cuts_a_character(spark):
    texts = ["ééé", "abc", "é", "x", ""]
    rows = spark.createDataFrame([("Claude", "m", "p", i, "2025-01-01T00:00:00Z", t) for i, t in enumerate(texts)], "source string, source_identifier string, path string, line_number long, timestamp string, text string")
    got = [r["excerpt"] for r in collect.bounded_texts(rows, collect.Budget(5, 8, 5)).orderBy("place").collect()]
    assert got == ["éé", "abc", "", "x", ""]


def test_dedupe_authorship_and_digest(spark):
    rows = spark.createDataFrame([("s", "HumanAuthored", "r1"), ("s", "AgentAuthored", "r2"), ("t", "AgentAuthored", "r3"), ("u", None, "r4")], "k string, authored_status string, ref string")
    assert {r["k"]: r["authored_status"] for r in model.authorship(rows, "k").collect()} == {"s": "MixedAuthorship", "t": "AgentAuthored", "u": "UnknownAuthorship"}
    a, b = (model.digest(x, "ref").first() for x in (rows, rows.orderBy(F.desc("ref"))))
    assert a == b and a["n"] == 4 and model.digest(rows.limit(0), "ref").first()["n"] == 0
    assert {r["k"]: r["child_count"] for r in model.parent_child_counts(rows, "k", "ref").collect()} == {"s": 2, "t": 1, "u": 1}


def test_configuration(tmp_path):
    store = ConfigurationStore(str(tmp_path / "c.json"))
    with pytest.raises(errors.ConfigurationUnavailable):
        store.observe()
    good = Configuration((Root("/x", "Claude", "main"),), ("repo",), "archive/a")
    assert store.configure(good) == good == store.observe()
    bad = Configuration((Root("", "Word", ""), Root("/x", "Pi", "p"), Root("/y", "Pi", "p")), ("",), "/abs", InterfaceLimits(page_items=0))
    assert issues(bad) == ["UnknownSource:Word", "EmptyPath", "EmptyIdentifier", "RepeatedSource:Pi:p", "ZeroLimit:page_items", "EmptyRepository", "ArchivePathLeavesRoot"]
    assert issues(Configuration()) == ["MissingTranscriptSource"]
    assert issues(Configuration((Root("/x", "Pi", "p", Limits(files=10**9)),), limits=InterfaceLimits(page_items=65))) == ["LimitAboveCeiling:files", "LimitAboveCeiling:page_items"]
    with pytest.raises(errors.InvalidRequest):
        store.configure(bad)
    assert store.observe() == good
    old = json.loads((tmp_path / "c.json").read_text())
    del old["limits"]["read_bytes"], old["archive"], old["roots"][0]["limits"]
    (tmp_path / "c.json").write_text(json.dumps(old))  # of a version that lacked these
    assert store.observe() == Configuration((Root("/x", "Claude", "main"),), ("repo",))
    for text in ("{", '{"roots": [{"path": "/x"}]}', '{"roots": [], "limits": {"speed": 1}}', "[]"):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(errors.ConfigurationUnavailable):
            store.observe()
    assert default_roots("/home/u", "/w/my.app")[0].path == "/home/u/.claude/projects/-w-my-app"


def test_batches_of_requests_are_refused_as_single_ones(spark):
    """Each check of a batch says what the single request raises."""
    index, long = Index({}), "x" * 257
    page = lambda **o: lambda: (paging.check_limit(o.get("page_items", 1), index.limits.page_items, ""), paging.keys(o.get("sort", "OldestFirst"), "r", "t"))
    ask = lambda q: lambda: tq.check(q)
    cases = [({"page_items": n}, page(page_items=n)) for n in (-1, 0, 1, 64, 65)] + [({"sort": o}, page(sort=o)) for o in (*paging.ORDERS, "Sideways", "")]
    cases += [({"preview_bytes": n}, lambda n=n: index._check_preview(n)) for n in (0, 1, 4096, 4097)]
    cases += [({"word": w}, ask(tq.Word(w))) for w in ("a", "A!", "", "a b", "é\u00a0", "a_b", "١", long[1:], long, "é" * 129)]
    cases += [({"phrase": p}, ask(tq.Phrase(p))) for p in ("", "!", "a b", "a " * 32, "a " * 33, "x" * 2048, "x" * 2049)]
    cases += [({"near_left": a, "near_right": b, "distance": d}, ask(tq.Near(a, b, d))) for a, b, d in (("a", "b", 0), ("a", "b", -1), ("a", "b", 10_000), ("a", "b", 10_001), ("", "b", 1), ("a", "b c", 1))]
    times = ("2025-01-01T00:00:00Z", "2025-01-01T00:00:00.5Z", "2025-01-02T00:00:00Z", "soon")
    cases += [({"window_start": a, "window_end": b}, lambda a=a, b=b: CLOCK.lower(Between(a, b))) for a in times for b in times]
    cases += [({"budget_segments": a, "budget_bytes": b}, lambda a=a, b=b: collect.Budget(a, b)) for a in (0, 1) for b in (-1, 1)]
    want = []
    for _, call in cases:
        try:
            call()
            want.append(None)
        except errors.Rejected as e:
            want.append(e.reason)
    fields = ", ".join(f"{k} {t}" for k, t in guards.REQUEST.items())
    batch = spark.createDataFrame([(n, *[c.get(k) for k in guards.REQUEST]) for n, (c, _) in enumerate(cases)], "n int, " + fields)
    rows = guards.with_errors(batch).orderBy("n").collect()
    assert [(c, r["error"]) for (c, _), r in zip(cases, rows, strict=True)] == [(c, w) for (c, _), w in zip(cases, want, strict=True)]
    assert len(set(want)) == 6 and guards.admitted(batch).columns == batch.columns
    assert {r["n"] for r in guards.admitted(batch).collect()} == {n for n, w in enumerate(want) if w is None}
    assert sum(r["requests"] for r in guards.rejections(batch).collect()) == sum(w is not None for w in want)  # one aspect each
    # Columns that a batch lacks and values that are null ask for nothing; a near query lacks no part, a window no start.
    bare = spark.createDataFrame([(1, None), (2, "2025-01-01T00:00:00Z")], "n int, window_end string")
    assert [r["error"] for r in guards.with_errors(bare).orderBy("n").collect()] == [None, "InvalidTimeWindow"]
    half = spark.createDataFrame([("a", None)], "near_left string, near_right string")
    assert guards.with_errors(half).first()["query_error"] == "InvalidQuery" and guards.with_errors(batch.limit(0)).count() == 0


def test_configuration_issues_of_places(spark, tmp_path):
    """Folders are looked up where Spark reads them; an index never lies in what it reads."""
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "file").write_text("x")
    here = str(tmp_path)
    found = lambda paths, index=f"{here}/index": place_issues(spark, Configuration(tuple(Root(p, "Pi", str(n)) for n, p in enumerate(paths))), index)
    assert found([f"{here}/in"]) == []
    assert found([f"{here}/in", f"{here}/gone", f"{here}/file"]) == [f"UnreadablePath:{here}/gone", f"UnreadablePath:{here}/file"]
    assert found([f"{here}/in"], f"{here}/in/deep/index") == [f"IndexInsideSource:{here}/in"]
    assert found([f"file:{here}/in/"], f"{here}/x/../in") == [f"IndexInsideSource:file:{here}/in/"]
    assert found([f"{here}/in"], f"{here}/inner") == []
    assert found([f"{here}/in"], f"{here}/file/index") == [f"StorageNotAFolder:{here}/file"]
