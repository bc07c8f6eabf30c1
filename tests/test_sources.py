"""Transcript files of each producer: blocks, metadata, failures and caps."""

import json
import os
import random

import pytest

from talkprism.sources import rules, variant
from talkprism.sources.jsonl import Limits, Root, discover, scan, with_parsed
from talkprism.sources.repository import CHANGE, configured_changes, uncollected
from talkprism.streaming import ingest


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def kinds(source, line):
    row = rules.read_line(source, json.dumps(line))
    return [(b["kind"], b["text"]) for b in row["blocks"]]


def test_claude_blocks():
    content = [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"b": 1, "a": 2}}, {"type": "tool_result", "content": [{"text": "ok"}]}, {"type": "image"}]
    found = kinds("Claude", {"message": {"role": "assistant", "content": content}})
    assert [k for k, _ in found] == ["Inference", "AgentResponse", "ToolCall", "ToolResult", "Attachment"]
    assert found[2][1] == '{"input":{"a":2,"b":1},"name":"Bash","type":"tool_use"}' and found[3][1] == "ok" and found[4][1] is None
    assert kinds("Claude", {"type": "queue-operation", "content": "q"}) == [("SessionEvent", "q")]
    assert kinds("Claude", {"type": "attachment"}) == [("Attachment", None)]
    assert kinds("Claude", {"text": "t"}) == [("Unclassified", "t")]
    assert kinds("Claude", {"role": "system", "content": "s"}) == [("SystemInstruction", "s")]
    assert kinds("Claude", {"role": "user", "text": "  "}) == []


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"type": "message", "role": "user", "content": [{"text": "a"}, {"text": "b"}]}, [("UserPrompt", "a\nb")]),
        ({"type": "user_message", "message": "m", "images": ["x"]}, [("UserPrompt", "m"), ("Attachment", None)]),
        ({"type": "user_message", "text_elements": [{"text": "e"}]}, [("UserPrompt", "e")]),
        ({"type": "agent_message", "message": "m"}, [("AgentResponse", "m")]),
        ({"type": "function_call", "name": "f"}, [("ToolCall", '{"name":"f","type":"function_call"}')]),
        ({"type": "custom_tool_call_output", "output": {"content": [{"content": "deep"}]}}, [("ToolResult", "deep")]),
        ({"type": "function_call_output", "x": 1}, [("ToolResult", '{"type":"function_call_output","x":1}')]),
        ({"type": "reasoning", "summary": [{"text": "r"}]}, [("Inference", "r")]),
        ({"type": "token_count", "n": 1}, [("SessionEvent", '{"n":1,"type":"token_count"}')]),
        ({"content": "plain"}, [("Unclassified", "plain")]),
    ],
)
def test_codex_payloads(payload, want):
    assert kinds("Codex", {"payload": payload}) == want


def test_pi_blocks():
    content = [{"type": "text", "text": "t"}, {"kind": "thinking", "text": "h"}, {"type": "toolCall", "n": 1}, {"type": "toolResult", "output": "o"}, {"type": "file"}]
    assert [k for k, _ in kinds("Pi", {"message": {"role": "assistant", "content": content}})] == ["AgentResponse", "Inference", "ToolCall", "ToolResult", "Attachment"]
    assert kinds("Pi", {"type": "custom_message", "content": "c"}) == [("SessionEvent", "c")]
    assert kinds("Pi", {"role": "user", "text": "a", "output": "b"}) == [("UserPrompt", "a"), ("UserPrompt", "b")]


def test_metadata():
    task = {"type": "tool_use", "name": "Task", "id": "tool-1", "input": {"subagent_type": "writer", "description": "d", "output_path": "/o"}}
    row = rules.read_line("Claude", json.dumps({"type": "assistant", "content": [task], "usage": {"n": 1}, "title": " ", "summary": "not reached"}))
    assert row["subagent_name"] == "writer" and row["title"] is None and row["authored_status"] == "AgentAuthored"
    assert row["task"] == {"task_identifier": "tool-1", "title": "d", "tool_use_identifier": "tool-1", "output_path": "/o", "result": None, "usage": '{"n":1}'}
    assert rules.read_line("Claude", '{"type":"user","text":"x"}')["authored_status"] == "HumanAuthored"
    assert rules.read_line("Claude", '{"authorship":"mixed","type":"user","text":"x"}')["authored_status"] == "MixedAuthorship"


def test_malformed_lines():
    for line in ("not-json", "", "[1] x", "5", "{}", '{"timestamp":"2025-01-01T00:00:00.500Z","text":"x"}', '{"timestamp":"2025-01-01 00:00:00","text":"x"}', '{"timestamp":"2025-01-01T00:00:00+01:00","text":"x"}'):
        assert rules.read_line("Claude", line)["malformed"], line
    assert not rules.read_line("Claude", '{"timestamp":"2025-01-01T00:00:00.5Z","text":"x"}')["malformed"]


def test_scan_reports_files_and_lines(spark, tmp_path):
    root = str(tmp_path / "c")
    write(f"{root}/a/claude-one.jsonl", {"text": "first"}, "not-json", "", {"text": "lasté"})
    write(f"{root}/b.jsonl", {"text": "x" * 300})
    write(f"{root}/c.txt", {"text": "not a transcript"})
    with open(f"{root}/d.jsonl", "wb") as f:
        f.write(b'{"text":"good"}\r\n{"text":"\xff"}\n{"text":"lost"}\n')
    found = scan(spark, Root(root, "Claude", "main", Limits(line_bytes=200, file_bytes=10_000)))
    rows = {(r["path"].rsplit("/", 1)[1], r["line_number"]): r for r in found.records.collect()}
    assert set(rows) == {("claude-one.jsonl", 1), ("claude-one.jsonl", 4), ("d.jsonl", 1)}
    assert rows["claude-one.jsonl", 1]["session_identifier"] == "one" and rows["claude-one.jsonl", 1]["task"]["task_identifier"] == "claude-one"
    assert rows["d.jsonl", 1]["text"] == "good"
    assert {(r["reason"], r["line_number"]) for r in found.failures.collect()} == {("InvalidUtf8", None), ("Malformed", 2), ("Malformed", 3)}
    assert [(r["reason"], r["line_number"]) for r in found.truncations.collect()] == [("LineBytes", 1)]
    tight = scan(spark, Root(root, "Claude", "main", Limits(file_bytes=100, files=2, failures=1)))
    assert {r["reason"] for r in tight.truncations.collect()} >= {"FileLimit", "FileBytes"}
    assert tight.failures.count() <= 1


def test_subagent_outputs_take_their_folder(spark, tmp_path):
    write(str(tmp_path / "claude-s9/task-1.output"), {"type": "assistant", "text": "quota"})
    row = scan(spark, Root(str(tmp_path), "ClaudeSubagentOutput", "sub")).records.first()
    assert row["session_identifier"] == "s9" and row["task"]["task_identifier"] == "task-1"


def test_codex_index_names_the_files(spark, tmp_path):
    root = str(tmp_path)
    for name in ("one", "two"):
        write(f"{root}/day/{name}.jsonl", {"payload": {"type": "agent_message", "message": name}})
    assert discover(spark, Root(root, "Codex", "x")).count() == 2
    write(f"{root}/index.jsonl", {"path": "day/two.jsonl"}, {"session_path": "../outside.jsonl"})
    rows = scan(spark, Root(root, "Codex", "x")).records.collect()
    assert [(r["text"], r["session_identifier"], r["task"]) for r in rows] == [("two", None, None)]


def test_repositories(spark):
    changes = spark.createDataFrame([("a", "p", None, None, ["x"], "clean"), ("b", "p", None, None, [], "clean")], CHANGE)
    names = spark.createDataFrame([("a",), ("a",)], "repository string")
    assert [r["repository"] for r in configured_changes(changes, names).collect()] == ["a"]
    assert uncollected(names.distinct()).first()["reason"] == "UnsupportedFormat"


def test_stream_appends_new_files_once(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "check"))
    write(f"{folder}/a.jsonl", {"text": "one"}, "bad")
    for more in ("b", None):
        ingest.append_blocks(ingest.line_stream(spark, folder, "Claude"), table, checkpoint).awaitTermination()
        if more:
            write(f"{folder}/{more}.jsonl", {"text": "two"})
    assert sorted(r["text"] for r in spark.read.parquet(table).collect()) == ["one", "two"]


def test_stream_counts_by_window(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(f"{folder}/a.jsonl", *[{"timestamp": f"2025-01-01T0{h}:00:00Z", "role": "user", "text": "x"} for h in (1, 1, 2, 9)])
    counts = ingest.kinds_by_window(ingest.line_stream(spark, folder, "Claude"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("kinds").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("kinds").collect()) == [1, 1, 2]


def test_a_scan_survives_any_line(spark, tmp_path):
    """Lone surrogates, constants and numbers that JSON lacks, and deep content are malformed lines; a pair of surrogates and 127 levels are read."""
    nested = lambda n: '{"payload":{"type":"message","content":' + "[" * (n - 2) + '"x"' + "]" * (n - 2) + "}}"
    bad = ['{"text":"a\\ud800b"}', '{"text":"b\\uDC00"}', '{"text":"x","n":NaN}', '{"text":"x","n":-Infinity}', '{"text":"x","n":1e999}', nested(128), nested(5000), nested(60_000), "[" * 100_000, '{"text":"x"']
    good = ['{"content":"\\ud83d\\ude00"}', nested(127), '{"content":{"content":{"content":["a",{"text":"b"}]}}}']
    write(tmp_path / "s.jsonl", *bad, *good)
    found = scan(spark, Root(str(tmp_path), "Codex", "main"))
    assert sorted(r["line_number"] for r in found.failures.collect()) == list(range(1, len(bad) + 1))
    assert {r["reason"] for r in found.failures.collect()} == {"Malformed"}
    texts = [r["text"] for r in found.records.orderBy("line_number").collect()]
    assert texts == ["😀", "x", "a\nb"]


def test_entry_cap_and_files_that_change(spark, tmp_path):
    for i in range(4):
        write(tmp_path / f"s{i}.jsonl", {"text": f"t{i}"})
    (tmp_path / "r.txt").write_text("not a transcript, but an entry")
    found = scan(spark, Root(str(tmp_path), "Claude", "main", Limits(entries=3)))
    assert sorted(r["text"] for r in found.records.collect()) == ["t0", "t1"]
    assert [r["reason"] for r in found.truncations.collect()] == ["EntryLimit"]
    found = scan(spark, Root(str(tmp_path), "Claude", "main", Limits(entries=5)))
    write(tmp_path / "s2.jsonl", {"text": "longer than it was"})
    assert sorted(r["text"] for r in found.records.collect()) == ["t0", "t1", "t3"]
    assert [r["reason"] for r in found.failures.collect()] == ["ChangedDuringScan"] and found.truncations.isEmpty()


def test_native_parsing_is_that_of_the_rules(spark):
    """Made lines of every shape: where the built-in expressions are sure, they give the row of the rules; the lines of this file's other tests are such."""
    rng = random.Random(11)
    words = ["a", "  ", "", "Task", "tool_use", "user", "assistant", "System", "text", "thinking", "é\n\"q\"", "😀", "2025-01-01T00:00:00Z", "2025-01-01T00:00:00.50Z", "queue-operation", "attachment", "human", "MIXED", " ", "x\u0001"]
    keys = "type role text thinking content message name id input title summary usage usage_summary task_id tool_use_id timestamp created_at subagent agent_name subagent_type description output_path result authored_status authorship author".split()

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.55:
            return rng.choice(words)
        if kind < 0.62:
            return rng.choice([None, True, 5, -7, 1.5, 10**20])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind < 0.8 else thing(depth + 1)

    def thing(depth):
        return {rng.choice(keys): value(depth) for _ in range(rng.randrange(1, 6))}

    def item():
        given = {"description": "d", "subagent_type": rng.choice(["w", " ", 1]), "b": 1, "a": [1, "é"]}
        return {"type": rng.choice(["text", "thinking", "tool_use", "TOOL_RESULT", "image", "other"]), "text": rng.choice(["t", None, 5, ""]), "content": rng.choice(["c", [{"text": "x"}, {"thinking": "y"}, "z"], {"text": "o"}, None, []]), "name": rng.choice(["Task", "Bash"]), "id": f"u{rng.randrange(9)}", "input": given}

    lines = []
    for _ in range(1500):
        line = thing(0)
        if rng.random() < 0.5:
            line["content"] = [item() for _ in range(rng.randrange(4))]
        if rng.random() < 0.4:
            line["message"] = {"role": rng.choice(words), "content": [item() for _ in range(rng.randrange(3))]}
        text = json.dumps(line, ensure_ascii=rng.random() < 0.3)
        lines.append(text + (rng.choice(["]", "}", " x", ",1", ' ,"|end of line|"]']) if rng.random() < 0.05 else ""))
    plain = [{"message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"b": 1}}, {"type": "image"}]}}, {"type": "queue-operation", "content": "q"}, {"text": "t"}, {"role": "system", "content": "s"}]
    lines += [json.dumps(x) for x in plain] + ['{"text":"a\\ud800b"}', '{"text":"x","n":NaN}', '{"text":"x","n":1e999}', '{"text":"a","text":"b"}', "", "5"]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    rows = variant.with_native(df).collect()
    sure = [r for r in rows if r["sure"]]
    assert all(r["native"].asDict(recursive=True) == rules.read_line("Claude", r["raw"]) for r in sure)
    assert len(sure) > 100 and {json.dumps(x) for x in plain} <= {r["raw"] for r in sure}
    both = {r["raw"]: r["p"].asDict(recursive=True) for r in with_parsed(df, "Claude", native=True).collect()}
    assert all(p == rules.read_line("Claude", raw) for raw, p in both.items())
