"""Batches of references against their backing files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from talkprism import errors
from talkprism.functions.timestamps import Clock
from talkprism.operators.backing import listed, read_many, with_lifecycle
from talkprism.operators.config import InterfaceLimits
from talkprism.operators.requests import Index, PageRequest
from talkprism.operators.slots import SlotStore
from talkprism.plans.filters import Filter
from talkprism.sources.jsonl import Root


def line(text, role="user"):
    return json.dumps({"message": {"role": role, "content": [{"type": "text", "text": text}, {"type": "image"}]}}) + "\n"


def test_states_of_a_batch(spark, tmp_path):
    root = Root(str(tmp_path / "in"), "Claude", "main")
    os.makedirs(root.path)
    names = "same changed kind touched gone shorter".split()
    for n in names:
        with open(f"{root.path}/{n}.jsonl", "w") as f:
            f.write(line(f"{n} é one") + line(f"{n} é two"))
    store = SlotStore(spark, "batches")
    store.refresh([root])
    tables = store.snapshot().tables
    times = {n: os.stat(f"{root.path}/{n}.jsonl") for n in names}

    def rewrite(name, *lines, keep=True):
        with open(f"{root.path}/{name}.jsonl", "w") as f:
            f.writelines(lines)
        if keep:  # as if nothing had happened
            os.utime(f"{root.path}/{name}.jsonl", ns=(times[name].st_atime_ns, times[name].st_mtime_ns))

    rewrite("changed", line("changed é one"), line("changed é TWO"))
    rewrite("kind", line("kind é one", "tool"), line("kind é two", "user") + " ")
    rewrite("touched", line("touched é one"), line("touched é two"))
    os.utime(f"{root.path}/touched.jsonl", (1_700_000_000, 1_700_000_000))
    rewrite("shorter", " " * (len(line("shorter é one")) + len(line("shorter é two")) - 2) + "\n ")
    os.remove(f"{root.path}/gone.jsonl")
    blocks = tables["blocks"].where("kind <> 'Attachment'")
    batch = blocks.select(F.col("block_reference").alias("reference"))
    batch = batch.union(batch).union(spark.createDataFrame([("block:v1:none",), (None,)], "reference string"))
    found = read_many(tables, batch, [root], 9)
    assert found.count() == 12 + 2
    names_of = blocks.select(F.col("block_reference").alias("reference"), F.regexp_extract("path", r"(\w+)\.jsonl", 1).alias("file"), "line_number")
    got = {(r["file"], r["line_number"]): (r["state"], r["text"], r["text_state"]) for r in found.join(names_of, "reference", "left").collect()}
    assert got["same", 1] == ("Fresh", "same é o", "Truncated") and got["same", 2][0] == "Fresh"
    assert got["changed", 1][0] == "Fresh" and got["changed", 2] == ("Stale", None, None)
    assert got["kind", 1][0] == "Stale"
    assert got["touched", 1][0] == got["touched", 2][0] == "Stale" and got["gone", 1][0] == "Broken"
    assert got["shorter", 1][0] == got["shorter", 2][0] == "Broken"  # the lines hold nothing
    assert got[None, None] == ("Missing", None, None)
    outputs = tables["outputs"].select(F.col("output_reference").alias("reference"))
    states = read_many(tables, outputs, [root], 100, "outputs").groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in states}["Fresh"] >= 3
    os.rename(root.path, f"{root.path}-away")
    assert [r["state"] for r in read_many(tables, batch.limit(3), [root], 9).select("state").distinct().collect()] == ["Broken"]


def test_cards_of_files_that_went(spark, tmp_path):
    root = Root(str(tmp_path / "in"), "Claude", "main")
    os.makedirs(root.path)
    for n in "ab":
        with open(f"{root.path}/claude-{n}.jsonl", "w") as f:
            f.write(line(n))
    store = SlotStore(spark, "cards")
    store.refresh([root])
    os.remove(f"{root.path}/claude-b.jsonl")
    sessions = store.snapshot().tables["sessions"]
    cards = {r["session_identifier"]: (r["lifecycle"], r["file_count"], r["file_bytes"]) for r in with_lifecycle(sessions, listed(spark, [root])).collect()}
    assert cards == {"a": ("Current", 1, len(line("a"))), "b": ("SourceMissing", 0, None)}
    gone = Root(str(tmp_path / "nowhere"), "Claude", "main")
    assert {r["lifecycle"] for r in with_lifecycle(sessions, listed(spark, [gone])).collect()} == {"SourceMissing"}


def test_an_index_with_roots_checks_its_reads(spark, tmp_path):
    root = Root(str(tmp_path / "in"), "Claude", "main")
    os.makedirs(root.path)
    for n in "abc":
        with open(f"{root.path}/claude-{n}.jsonl", "w") as f:
            f.write(line(n))
    store = SlotStore(spark, "checked_reads")
    store.refresh([root])
    index = Index.of(store.snapshot(), InterfaceLimits(), Clock(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)), (root,))
    with open(f"{root.path}/claude-b.jsonl", "a") as f:
        f.write(line("more"))
    os.remove(f"{root.path}/claude-c.jsonl")
    outputs = {r["path"][-7]: r["output_reference"] for r in index.outputs().collect()}
    blocks = {r["path"][-7]: r["block_reference"] for r in index.blocks().where("kind <> 'Attachment'").collect()}
    assert index.read_output(outputs["a"], 9)["text"] == "a" and index.read_block(blocks["a"], 9)["text"] == "a"
    for name, error in (("b", errors.FragileReferenceStale), ("c", errors.FragileReferenceBroken)):
        with pytest.raises(error):
            index.read_output(outputs[name], 9)
        with pytest.raises(error):
            index.read_block(blocks[name], 9)
    cards = index.list_sessions(Filter(), PageRequest(5)).rows
    assert {r["session_identifier"]: r["lifecycle"] for r in cards} == {"a": "Current", "b": "Current", "c": "SourceMissing"}


def test_lines_of_a_file_are_not_carried_with_each_other(spark, tmp_path):
    """What a batch asks of one file grows with its lines, not with their square."""
    root = Root(str(tmp_path / "in"), "Claude", "main")
    os.makedirs(root.path)
    with open(f"{root.path}/a.jsonl", "w") as f:
        f.writelines(line(f"text {i}") for i in range(3000))
    store = SlotStore(spark, "many_lines")
    store.refresh([root])
    tables = store.snapshot().tables
    found = read_many(tables, tables["blocks"].where("kind <> 'Attachment'").select(F.col("block_reference").alias("reference")), [root], 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    carried = [x for x in plan.split("\n") if "Generate explode(" in x or "Generate posexplode(" in x]
    assert len(carried) == 1 and "posexplode(" in carried[0], carried
    rows = found.join(tables["blocks"].select(F.col("block_reference").alias("reference"), "line_number"), "reference").select("state", "text", "line_number").collect()
    assert len(rows) == 3000 and all((r["state"], r["text"]) == ("Fresh", f"text {r['line_number'] - 1}") for r in rows)
