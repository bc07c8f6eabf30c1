"""Resumed scans and slots of sources: only new lines are parsed, only changed sources are written."""

import json
import os

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkprism import errors, queries
from talkprism.operators.backing import read_many
from talkprism.operators.slots import SlotStore, slot_name
from talkprism.sources import jsonl, resume
from talkprism.sources.jsonl import Limits, Root, scan

RECORD = ("path", "line_number", "fingerprint", "modified", "text", "blocks", "session_identifier", "title")


def line(text):
    return json.dumps({"type": "user", "text": text}) + "\n"


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


def rows(df, *columns):
    return sorted([tuple(map(str, r)) for r in df.select(*columns).collect()])


def same_as_a_full_scan(spark, store, root):
    full, now = scan(spark, root), store.snapshot(partial=True).tables
    own = lambda df: df.where(F.col("source_identifier") == root.identifier)
    assert rows(own(now["records"]), *RECORD) == rows(full.records, *RECORD)
    reports = full.failures.union(full.truncations)
    assert rows(own(now["reports"]), "path", "line_number", "reason") == rows(reports, "path", "line_number", "reason")
    assert own(now["outputs"]).count() == full.records.count()


def test_resumed_scans_equal_full_ones(spark, tmp_path):
    """Files that grow, stay, go, come, change, end in a broken line, or turn invalid, step by step."""
    folder, store = tmp_path / "in", SlotStore(spark, "resumed_scans")
    root = Root(str(folder), "Claude", "main", Limits(line_bytes=200))
    put(folder / "a.jsonl", line("a1") + line("a2"))
    put(folder / "b.jsonl", line("b1") + '{"type":"user","te')  # an unfinished line
    put(folder / "sub/c.jsonl", line("c1") + "no json\n" + line("x" * 300) + line("c4"))
    put(folder / "d.jsonl", "")
    (first,) = store.refresh([root])
    assert (first.parsed, first.coverage, first.complete, first.malformed, first.truncations) == (8, "Incomplete", None, 2, 1)
    same_as_a_full_scan(spark, store, root)
    assert store.refresh([root])[0] == store.slots()[first.slot] and store.slots()[first.slot].provisional == first.provisional  # nothing to read

    put(folder / "a.jsonl", line("a3"), "a")
    put(folder / "b.jsonl", 'xt":"b2"}\n' + line("b3"), "a")
    put(folder / "d.jsonl", line("d1"))
    put(folder / "e.jsonl", line("e1"))
    (second,) = store.refresh([root])
    assert second.parsed == 1 + 2 + 1 + 1 and second.malformed == 1
    same_as_a_full_scan(spark, store, root)

    os.remove(folder / "e.jsonl")
    put(folder / "a.jsonl", line("A1") + line("a2") + line("a3") + line("a4"))  # its beginning differs
    put(folder / "sub/c.jsonl", line("c1") + line("c2"))  # shorter
    (third,) = store.refresh([root])
    assert (third.parsed, third.coverage, third.provisional) == (4 + 2, "Complete", None)
    same_as_a_full_scan(spark, store, root)

    os.utime(folder / "a.jsonl", (1_700_000_000, 1_700_000_000))  # touched: no line is parsed, references change
    (fourth,) = store.refresh([root])
    assert fourth.parsed == 0 and fourth.complete != third.complete
    same_as_a_full_scan(spark, store, root)

    with open(folder / "d.jsonl", "ab") as f:
        f.write(b'{"text":"\xff"}\n' + line("lost").encode())
    (fifth,) = store.refresh([root])
    assert (fifth.coverage, fifth.unreadable, fifth.complete) == ("Incomplete", 1, fourth.complete)
    same_as_a_full_scan(spark, store, root)
    put(folder / "d.jsonl", line("d1") + line("d2"))
    (sixth,) = store.refresh([root])
    assert (sixth.coverage, sixth.parsed) == ("Complete", 2)
    same_as_a_full_scan(spark, store, root)


def test_a_cut_listing_removes_nothing_unseen(spark, tmp_path):
    folder, store = tmp_path / "in", SlotStore(spark, "cut_listings")
    for name in "abc":
        put(folder / f"{name}.jsonl", line(name))
    store.refresh([Root(str(folder), "Claude", "main")])
    os.remove(folder / "b.jsonl")
    put(folder / "aa.jsonl", line("aa"))
    (slot,) = store.refresh([Root(str(folder), "Claude", "main", Limits(files=2))])
    assert (slot.coverage, slot.truncations) == ("Incomplete", 1)
    texts = lambda partial: sorted(r["text"] for r in store.snapshot(partial).tables["outputs"].collect())
    assert texts(True) == ["a", "aa", "b", "c"] and texts(False) == ["a", "b", "c"]
    assert store.refresh([Root(str(folder), "Claude", "main")])[0].coverage == "Complete"
    assert texts(False) == texts(True) == ["a", "aa", "c"]


def test_sources_are_refreshed_alone(spark, tmp_path):
    store = SlotStore(spark, "own_slots")
    with pytest.raises(errors.CollectionUnavailable):
        store.snapshot()
    roots = [Root(str(tmp_path / n), "Claude", n) for n in ("one", "two", "it's")]
    for r in roots:
        put(tmp_path / r.identifier / "s.jsonl", line(r.identifier))
    store.refresh(roots)
    files = lambda n: {f for f in store.snapshot(True).tables["blocks"].inputFiles() if f"slot={slot_name('Claude', n)}" in f}
    before = {n: files(n) for n in ("one", "two", "it's")}
    assert all(before.values())
    put(tmp_path / "one/s.jsonl", line("more"), "a")
    put(tmp_path / "two/s.jsonl", "broken\n", "a")
    os.rename(tmp_path / "it's", tmp_path / "away")
    found = {s.source_identifier: s for s in store.refresh(roots)}
    assert {k: (s.coverage, s.parsed) for k, s in found.items()} == {"one": ("Complete", 1), "two": ("Incomplete", 1), "it's": ("Failed", 0)}
    assert files("it's") == before["it's"] and files("one") != before["one"]
    texts = lambda partial: sorted(r["text"] for r in store.snapshot(partial).tables["outputs"].collect())
    assert texts(False) == texts(True) == ["it's", "more", "one", "two"]
    health = {r["source_identifier"]: (r["status"], r["completeness"], r["records"]) for r in store.health().collect()}
    assert health == {"one": ("Indexed", "Complete", 2), "two": ("Malformed", "Truncated", 1), "it's": ("Unreadable", "Failed", 1)}
    os.rename(tmp_path / "away", tmp_path / "it's")
    assert store.refresh(roots)[2].coverage == "Complete" and files("it's") == before["it's"]
    store.refresh(roots[:1])  # the others are no longer configured
    assert set(store.slots()) == {slot_name("Claude", "one")} and texts(False) == ["more", "one"]
    with pytest.raises(errors.FragileReferenceStale):
        store._point(None, found["two"])


def test_one_refresh_reads_contents_once(spark, tmp_path):
    """The files with new lines are opened by one job, and old ones not at all."""
    folder, store = tmp_path / "in", SlotStore(spark, "read_once")
    root = Root(str(folder), "Claude", "main")
    for i in range(6):
        put(folder / f"s{i}.jsonl", line(f"t{i}"))
        os.utime(folder / f"s{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    store.refresh([root])
    before = store.slots()[slot_name("Claude", "main")]
    put(folder / "s5.jsonl", line("new"), "a")
    os.remove(folder / "s0.jsonl")
    from talkprism.sources.resume import resume

    states = store.snapshot().tables["files"]
    step = resume(spark, root, states)
    assert step.read == 1
    scans = [x for x in step.lines._jdf.queryExecution().executedPlan().toString().split("\n") if "content#" in x and "FileScan binaryFile" in x]
    assert len(scans) == 1
    (slot,) = store.refresh([root])
    assert (slot.parsed, slot.records, slot.files, slot.earlier) == (1, 6, 5, before.complete)
    assert sorted(r["text"] for r in store.snapshot().tables["outputs"].collect()) == ["new", "t1", "t2", "t3", "t4", "t5"]


def test_clean_leaves_named_and_young_generations(spark, tmp_path):
    store, root = SlotStore(spark, "clean_slots"), Root(str(tmp_path / "in"), "Claude", "main")
    put(tmp_path / "in/a.jsonl", line("a"))
    (slot,) = store.refresh([root])
    records = spark.table("clean_slots.records").drop("slot", "generation")
    store._write("records", records, slot.slot, "0000000000001-left")  # of a writer that failed long ago
    store._write("records", records, slot.slot, "2000000000000-now")  # of one at work
    assert store.clean() == ["0000000000001-left"] and store.clean(-1e5) == ["2000000000000-now"]
    assert store.snapshot().tables["records"].count() == 1


def test_an_empty_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store, root = SlotStore(spark, "empty_slots"), Root(str(tmp_path / "in"), "Claude", "main")
    (slot,) = store.refresh([root])
    assert (slot.coverage, slot.records, slot.parsed) == ("Complete", 0, 0)
    assert store.snapshot().tables["sessions"].count() == 0 and store.health().first()["status"] == "Empty"


def test_children_lie_with_their_parents(spark, tmp_path):
    """Outputs, segments and blocks join without a shuffle, over all sources; a reference is answered by one bucket."""
    store = SlotStore(spark, "bucketed_slots", buckets=8)
    roots = [Root(str(tmp_path / n), "Claude", n) for n in ("one", "two")]
    for r in roots:
        for k in range(3):
            put(tmp_path / r.identifier / f"s{k}.jsonl", "".join(line(f"{r.identifier} {k} {i}") for i in range(40)))
    store.refresh(roots)
    tables = store.snapshot().tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables["outputs"].select("output_reference").join(tables["blocks"].select("output_reference", "block_reference", "kind"), "output_reference")
        joined = joined.join(tables["segments"].select("output_reference", "segment_reference"), "output_reference")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 240
        subagents = tables["sessions"].select("session_reference").join(tables["subagents"].select("session_reference"), "session_reference")
        assert "Exchange" not in subagents._jdf.queryExecution().executedPlan().toString()
        reference = tables["blocks"].select("output_reference").first()[0]
        one = tables["blocks"].where(F.col("output_reference") == reference)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell its buckets
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_a_file_of_a_union_is_written_by_one_task(spark, tmp_path):
    """Both sides of the union are dealt by file already, and their partitions of unlike sizes."""
    own = Window.partitionBy("file")
    rows = spark.range(60_000).select(F.concat(F.lit("f"), F.col("id") % 8, F.lit(".jsonl")).alias("file"), "id", F.concat(F.sha2(F.col("id").cast("string"), 256), F.col("id")).alias("raw"))
    rows = rows.withColumn("line_number", F.row_number().over(own.orderBy("id")).cast("long")).withColumn("n", F.count(F.lit(1)).over(own))
    more = rows.where("line_number = n").withColumns({"line_number": F.col("n") + 1, "raw": F.lit("last")})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        queries._write_transcripts(spark, rows.unionByName(more), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for k in range(8):
        lines = (tmp_path / f"out/f{k}.jsonl").read_text().split("\n")
        assert len(lines) == 7502 and lines[-2:] == ["last", ""] and [x[64:] for x in lines[:-2]] == [str(i) for i in range(k, 60_000, 8)]


def test_long_files_by_splits_equal_files_of_one_value(spark, tmp_path, monkeypatch):
    """Long files grow, cross the length of one value, change, turn invalid, have a byte order mark and an unfinished line; all in splits of 9,000 bytes."""
    folder = tmp_path / "in"
    whole, long = SlotStore(spark, "whole_files"), SlotStore(spark, "long_files")
    root, anything = Root(str(folder), "Claude", "main"), Root(str(folder), "Claude", "main", Limits(file_bytes=None))
    many = lambda name, n: "".join(line(f"{name} \u00e9{i} " + "x" * (i * 70 % 900)) for i in range(n))
    put(folder / "small.jsonl", many("small", 3))
    put(folder / "crosses.jsonl", many("crosses", 12))
    put(folder / "grows.jsonl", many("grows", 60) + '{"type":"user","te')
    put(folder / "changes.jsonl", many("changes", 40))
    put(folder / "marked.jsonl", "\ufeff" + many("marked", 30) + "\r\n\n")
    put(folder / "ends.jsonl", many("ends", 50) + "no json\n" + many("more", 3))
    steps = [
        lambda: None,
        lambda: (put(folder / "crosses.jsonl", many("later", 30), "a"), put(folder / "grows.jsonl", 'xt":"b2"}\n' + many("g", 5), "a"), put(folder / "changes.jsonl", many("Changed", 41))),
        lambda: (put(folder / "crosses.jsonl", many("last", 2), "a"), put(folder / "marked.jsonl", many("m", 2), "a"), os.remove(folder / "small.jsonl"), (folder / "ends.jsonl").open("ab").write(b'{"text":"\xff"}\n' + line("lost").encode())),
    ]
    table = lambda store, name, *c: rows(store.snapshot(True).tables[name], *c)
    report, split = ("path", "line_number", "reason"), "spark.sql.files.maxPartitionBytes"
    for at, step in enumerate(steps):
        step()
        (first,) = whole.refresh([root])
        with monkeypatch.context() as m:
            for place in (jsonl, resume):
                m.setattr(place, "WHOLE_BYTES", 10_000)
            spark.conf.set(split, "9000")
            try:
                (second,) = long.refresh([anything])
                if at == len(steps) - 1:
                    full, tables = scan(spark, anything), long.snapshot(True).tables
                    assert rows(full.records, *RECORD) == table(whole, "records", *RECORD)
                    assert rows(full.failures, *report) == table(whole, "reports", *report)
                    states = read_many(tables, tables["blocks"].select(F.col("block_reference").alias("reference")), [anything], 9).groupBy("state").count().collect()
                    assert [(r["state"], r["count"]) for r in states] == [("Fresh", second.records)]
            finally:
                spark.conf.unset(split)
        for c in ("coverage", "records", "files", "malformed", "unreadable", "truncations", "parsed"):
            assert getattr(first, c) == getattr(second, c), (at, c)
        for name, columns in (("records", RECORD), ("reports", report), ("files", ("path", "length", "covered", "lines", "whole"))):
            assert table(long, name, *columns) == table(whole, name, *columns), (at, name)


@pytest.mark.parametrize("name", ["session_lifecycle", "resumed_scan"])
def test_queries_over_a_file_longer_than_the_cap(spark, tmp_path, name):
    """All turns fall into one file of more than 8 MiB: each of its lines counts."""
    text = F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(1600)), F.col("id"))
    table = spark.range(90).select((F.col("id").cast("long") / 3).cast("long") * 16 % 480, F.col("id") % 3, F.lit("user"), text).toDF("conv_id", "turn", "role", "text")
    table.coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(queries.SQL[name])
    assert rows(df, *sorted(sql.columns)) == sorted(tuple(map(str, (r[sql.columns.index(c)] for c in sorted(sql.columns)))) for r in sql.fetchall())
