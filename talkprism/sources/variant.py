"""Lines of the message format in built-in expressions over VARIANT, without a Python worker.

``with_native`` gives each line the row that ``rules.read_line`` gives, and says where it is
``sure`` to be the same. It isn't sure of what the two JSON readers may tell apart: no or repeated
keys, lone surrogates, long or exponential numbers, deep content, and, where a value is written
back as JSON, fractions and escaped control characters. Such lines (and malformed ones) are left to
``rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.functions.timestamps import CANONICAL
from talkprism.sources import rules

#: Sources whose lines have this format.
SOURCES = ("Claude", "ClaudeSubagentOutput", "PiSubagentOutput")
#: A second element of the array that a line is put in: what follows the line's value would come before it.
_END = "|end of line|"
#: A character that isn't white space.
_INK = r"[^\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLOCK = "struct<kind:string,text:string>"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _string(value: Column, *paths: str) -> Column:
    """The first of these fields that is a string."""
    return F.coalesce(*[F.when(F.schema_of_variant(_at(value, p)) == "STRING", _at(value, p, "string")) for p in paths])


def _inked(text: Column) -> Column:
    return F.when(text.rlike(_INK), text)


def _filled(value: Column, *paths: str) -> Column:
    return _inked(_string(value, *paths))


def _kind_of(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rules.ROLE_KIND.items() for x in pair])
    return F.coalesce(known[F.lower(F.coalesce(role, F.lit("")))], F.lit("Unclassified"))


def _author(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in rules.AUTHOR.items() for x in pair])[F.lower(F.coalesce(name, F.lit("")))]


def _items(value: Column, path: str) -> Column:
    """The elements of a list, the one of an object, or none."""
    single = F.when(F.schema_of_variant(_at(value, path)).startswith("OBJECT"), F.array(_at(value, path)))
    return F.coalesce(_at(value, path, "array<variant>"), single, F.array().cast("array<variant>"))


def _content(value: Column, path: str) -> Column:
    """Text of a string, or of the items of a list that have some, or of an object."""
    texts = F.filter(F.transform(_at(value, path, "array<variant>"), lambda x: _string(x, "$.text", "$.thinking")), lambda t: t.isNotNull())
    listed = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    return F.coalesce(_string(value, path, f"{path}.text"), listed)


def _block(kind: Column | str, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"))


_TOOLS, _RESULTS, _ATTACHED = ("tool_use", "tooluse"), ("tool_result", "toolresult"), ("image", "document", "attachment")


def _item(x: Column, role: Column) -> Column:
    kind, text = F.lower(F.coalesce(_string(x, "$.type"), F.lit(""))), _string(x, "$.text")
    return (
        F.when(kind == "text", _block(_kind_of(role), text))
        .when(kind == "thinking", _block("Inference", _string(x, "$.thinking", "$.text")))
        .when(kind.isin(*_TOOLS), _block("ToolCall", F.to_json(x)))
        .when(kind.isin(*_RESULTS), _block("ToolResult", F.coalesce(_content(x, "$.content"), text, F.to_json(x))))
        .when(kind.isin(*_ATTACHED), _block("Attachment", F.lit(None).cast("string")))
        .when(text.isNotNull(), _block(_kind_of(role), text))
        .otherwise(_block("Unclassified", _content(x, "$.content")))
    )


def with_native(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``native``, a struct of schema.PARSED, and ``sure``."""
    line = F.col("in_array")
    at = lambda *names: tuple(f"$[0].{n}" for n in names)
    rows = rows.withColumn("in_array", F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit(f',"{_END}"]'))))

    kind = F.lower(F.coalesce(_string(line, *at("type")), F.lit("")))
    spoken = F.when(_string(line, *at("type")).isin("user", "assistant", "system"), _string(line, *at("type")))
    rows = rows.withColumns({"role_": F.coalesce(_string(line, *at("role", "message.role")), spoken), "own_": F.coalesce(_string(line, *at("text")), _content(line, "$[0].message.content"), _content(line, "$[0].content"))})
    role = F.col("role_")
    said = F.array(_block("Inference", _string(line, *at("thinking"))), _block(_kind_of(role), _string(line, *at("text"))))
    parts = [F.concat(F.array(_block(_kind_of(role), _string(line, p))), F.transform(_items(line, p), lambda x: _item(x, role))) for p in at("message.content", "content")]
    blocks = (
        F.when(kind == "queue-operation", F.array(_block("SessionEvent", _string(line, *at("content")))))
        .when(kind == "attachment", F.array(_block("Attachment", F.lit(None).cast("string"))))
        .otherwise(F.concat(said, *parts))
    )
    rows = rows.withColumn("blocks_", F.filter(blocks, lambda b: (b["kind"] == "Attachment") | F.coalesce(b["text"].rlike(_INK), F.lit(False))))

    tasks = F.filter(F.coalesce(_at(line, "$[0].content", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(_string(x, "$.name") == "Task", F.lit(False)))
    rows = rows.withColumn("tasks_", tasks)
    given = lambda *names: _inked(F.get(F.filter(F.transform("tasks_", lambda x: _string(x, *[f"$.input.{n}" for n in names])), lambda t: t.isNotNull()), F.lit(0)))
    used = F.get(F.transform(F.filter("tasks_", lambda x: F.coalesce(_string(x, "$.type") == "tool_use", F.lit(False))), lambda x: _string(x, "$.id")), F.lit(0))
    use = F.coalesce(_filled(line, *at("tool_use_id", "tool_use_identifier")), used)
    usage_object = F.schema_of_variant(_at(line, "$[0].usage")).startswith("OBJECT")
    task_id = F.coalesce(_filled(line, *at("task_identifier", "task_id", "id")), use)
    task = F.struct(
        task_id.alias("task_identifier"),
        F.coalesce(_filled(line, *at("task_title", "title", "description")), given("description", "title")).alias("title"),
        use.alias("tool_use_identifier"),
        F.coalesce(_filled(line, *at("output_path", "output_file", "file_path")), given("output_path", "output_file", "file_path")).alias("output_path"),
        _filled(line, *at("result", "status")).alias("result"),
        F.coalesce(_filled(line, *at("usage", "usage_summary")), F.when(usage_object, F.to_json(_at(line, "$[0].usage")))).alias("usage"),
    )
    when = _string(line, *at("timestamp", "created_at"))
    joined = F.array_join(F.transform("blocks_", lambda b: b["text"]), "\n")
    native = F.struct(
        F.lit(False).alias("malformed"),
        when.alias("timestamp"),
        F.coalesce("own_", joined).alias("text"),
        _filled(line, *at("title", "summary", "name")).alias("title"),
        F.coalesce(_filled(line, *at("subagent", "subagent_name", "agent_name")), given("subagent_type", "agent_type")).alias("subagent_name"),
        F.coalesce(_author(_filled(line, *at("authored_status", "authorship"))), _author(_filled(line, *at("role", "type", "author"))), F.lit("AgentAuthored")).alias("authored_status"),
        F.when(task_id.isNotNull(), task).alias("task"),
        F.col("blocks_").alias("blocks"),
    )
    text = F.col(raw)
    one = (_at(line, "$[1]", "string") == _END) & _at(line, "$[2]").isNull() & ~F.contains(text, F.lit(_END)) & F.schema_of_variant(_at(line, "$[0]")).startswith("OBJECT")
    alike = ~text.rlike(r"\\u[dD][89a-fA-F]|[:,\[]\s*-?(\d{19}|\d[\d.]*[eE])")
    shallow = F.length(text) - F.length(F.translate(text, "[{", "")) < rules.MAX_DEPTH
    # Values are written back as JSON for calls, results without text, and a usage object.
    written = usage_object | F.exists("blocks_", lambda b: b["kind"].isin("ToolCall", "ToolResult"))
    fair = ~written | ~text.rlike(r"[:,\[]\s*-?\d+\.|\\u00|[\x{10000}-\x{10FFFF}]")
    readable = (when.isNull() | when.rlike(CANONICAL) & ~when.rlike(r"[^\x20-\x7e]")) & (F.col("own_").isNotNull() | (F.size("blocks_") > 0))
    sure = F.coalesce(one & alike & shallow & fair & readable, F.lit(False))
    return rows.withColumns({"native": native, "sure": sure}).drop("in_array", "role_", "own_", "blocks_", "tasks_")
