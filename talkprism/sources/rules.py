"""What a JSON line of each producer says: one row of fields and a list of blocks.

A small per-line helper for the Arrow function in ``jsonl``; everything that relates rows to each
other is a Spark plan.
"""

from __future__ import annotations

import json
import re
from typing import Any

from talkprism.functions.timestamps import CANONICAL

#: Block kinds of roles, authorship of names, payload types of calls and their outputs.
ROLE_KIND = {"user": "UserPrompt", "system": "SystemInstruction", "tool": "ToolResult", "tool_result": "ToolResult", "toolresult": "ToolResult", "assistant": "AgentResponse"}
AUTHOR = {
    **dict.fromkeys(("agent", "agent-authored", "agentauthored", "assistant", "tool", "subagent"), "AgentAuthored"),
    **dict.fromkeys(("human", "human-authored", "humanauthored", "user"), "HumanAuthored"),
    **dict.fromkeys(("mixed", "mixed-authorship", "mixedauthorship"), "MixedAuthorship"),
    **dict.fromkeys(("unknown", "unknown-authorship", "unknownauthorship"), "UnknownAuthorship"),
}
_CALLS = {"function_call", "functioncall", "custom_tool_call", "customtoolcall", "tool_search_call", "toolsearchcall"}
_OUTPUTS = {"function_call_output", "functioncalloutput", "custom_tool_call_output", "customtoolcalloutput", "tool_search_output", "toolsearchoutput"}
_CANONICAL = re.compile(CANONICAL)


def get(value: Any, *path: str) -> Any:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def string(value: Any, *names: str) -> str | None:
    """The first named field that is a string, of any content."""
    return next((v for n in names if isinstance(v := get(value, n), str)), None)


def filled(value: Any, *names: str) -> str | None:
    """As ``string``, but a blank first hit gives nothing."""
    found = string(value, *names)
    return found if found and found.strip() else None


def kind_of(role: str | None) -> str:
    return ROLE_KIND.get((role or "").lower(), "Unclassified")


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def first(*options: Any) -> Any:
    return next((o for o in options if o is not None), None)


def deep_text(value: Any, fields: tuple[str, ...]) -> str | None:
    """Text of nested content: a string, the texts of a list, or the first string field, else its content."""
    found, left = [], [value]
    while left:
        value = left.pop()
        if isinstance(value, str):
            found.append(value)
        elif isinstance(value, list):
            left += reversed(value)
        elif (own := string(value, *fields)) is not None:
            found.append(own)
        elif (inner := get(value, "content")) is not None:
            left.append(inner)
    return "\n".join(found) if found else None


TEXT, TEXT_OUTPUT = ("text",), ("text", "output")


def tasks(line: dict) -> list[dict]:
    content = get(line, "content")
    return [x for x in content if isinstance(x, dict) and x.get("name") == "Task"] if isinstance(content, list) else []


def task_input(line: dict, *names: str) -> str | None:
    found = next((v for x in tasks(line) if (v := string(x.get("input"), *names)) is not None), None)
    return found if found and found.strip() else None


def metadata(line: dict) -> dict:
    """Title, subagent, authorship and task of a line."""
    use = first(filled(line, "tool_use_id", "tool_use_identifier"), next((string(x, "id") for x in tasks(line) if x.get("type") == "tool_use"), None))
    task_id = first(filled(line, "task_identifier", "task_id", "id"), use)
    usage = first(filled(line, "usage", "usage_summary"), compact(line["usage"]) if isinstance(get(line, "usage"), dict) else None)
    authored = first(*(AUTHOR.get((filled(line, *names) or "").lower()) for names in (("authored_status", "authorship"), ("role", "type", "author"))), "AgentAuthored")
    return {
        "title": filled(line, "title", "summary", "name"),
        "subagent_name": first(filled(line, "subagent", "subagent_name", "agent_name"), task_input(line, "subagent_type", "agent_type")),
        "authored_status": authored,
        "task": None
        if task_id is None
        else {
            "task_identifier": task_id,
            "title": first(filled(line, "task_title", "title", "description"), task_input(line, "description", "title")),
            "tool_use_identifier": use,
            "output_path": first(filled(line, "output_path", "output_file", "file_path"), task_input(line, "output_path", "output_file", "file_path")),
            "result": filled(line, "result", "status"),
            "usage": usage,
        },
    }


def _claude_item(item: Any, role: str | None) -> tuple[str, str | None] | None:
    kind = (string(item, "type") or "").lower()
    if kind == "text":
        return kind_of(role), string(item, "text")
    if kind == "thinking":
        return "Inference", string(item, "thinking", "text")
    if kind in ("tool_use", "tooluse"):
        return "ToolCall", compact(item)
    if kind in ("tool_result", "toolresult"):
        return "ToolResult", first(_claude_content(get(item, "content")), string(item, "text"), compact(item))
    if kind in ("image", "document", "attachment"):
        return "Attachment", None
    text = string(item, "text")
    return (kind_of(role), text) if text is not None else ("Unclassified", _claude_content(get(item, "content")))


def _claude_content(value: Any) -> str | None:
    """Text of a string, or of the items of a list that have some."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        found = [t for v in value if (t := string(v, "text", "thinking")) is not None]
        return "\n".join(found) if found else None
    return string(value, "text")


def claude(line: dict) -> tuple[list, str | None]:
    kind = (string(line, "type") or "").lower()
    spoken = string(line, "type") if string(line, "type") in ("user", "assistant", "system") else None
    role = first(string(line, "role"), string(get(line, "message"), "role"), spoken)
    blocks: list = []
    if kind == "queue-operation":
        blocks.append(("SessionEvent", string(line, "content")))
    elif kind == "attachment":
        blocks.append(("Attachment", None))
    else:
        blocks += [("Inference", string(line, "thinking")), (kind_of(role), string(line, "text"))]
        for content in (get(line, "message", "content"), get(line, "content")):
            if isinstance(content, str):
                blocks.append((kind_of(role), content))
            else:
                blocks += [_claude_item(x, role) for x in (content if isinstance(content, list) else [content] if isinstance(content, dict) else [])]
    return blocks, first(string(line, "text"), _claude_content(get(line, "message", "content")), _claude_content(get(line, "content")))


def _codex_payload(payload: Any, role: str | None) -> tuple[list, str | None]:
    kind = (string(payload, "type") or "").lower()
    of = lambda *names: first(*(deep_text(v, TEXT) for n in names if (v := get(payload, n)) is not None))
    content = first(get(payload, "content"), get(payload, "message", "content"))
    message = deep_text(content, TEXT) if content is not None else None
    if kind == "message":
        return [(kind_of(first(string(payload, "role"), role, string(get(payload, "message"), "role"))), message)], message
    if kind in ("user_message", "usermessage"):
        text = first(string(payload, "message"), string(payload, "text"), of("text_elements"), message)
        pictures = any(isinstance(v := get(payload, n), list) and v for n in ("images", "local_images"))
        return [("UserPrompt", text), *([("Attachment", None)] if pictures else [])], text
    if kind in ("agent_message", "agentmessage"):
        text = first(string(payload, "message"), message)
        return [("AgentResponse", text)], text
    if kind in _CALLS:
        return [("ToolCall", compact(payload))], of("content")
    if kind in _OUTPUTS:
        text = of("output", "content")
        return [("ToolResult", first(text, compact(payload)))], text
    if kind == "reasoning":
        text = first(of("summary", "content"), string(payload, "text"))
        return [("Inference", text)], text
    text = of("content")
    return [(kind_of(role), text) if text is not None else ("SessionEvent", compact(payload) if kind else None)], text


def codex(line: dict) -> tuple[list, str | None]:
    role = first(string(line, "role"), string(get(line, "payload"), "role"), string(get(line, "payload", "message"), "role"))
    blocks, payload_text = [], None
    for name in ("payload", "item"):
        if (payload := get(line, name)) is not None:
            found, text = _codex_payload(payload, role)
            blocks += found
            payload_text = text if name == "payload" else payload_text
    content, message = (deep_text(v, TEXT) if (v := get(line, n)) is not None else None for n in ("content", "message"))
    blocks += [(kind_of(role), content), (kind_of(role), message)]
    item = get(line, "item", "content")
    return blocks, first(content, message, deep_text(item, TEXT) if item is not None else None, payload_text)


def _pi_item(item: Any, role: str | None) -> tuple[str, str | None]:
    kind, text = (string(item, "type", "kind") or "").lower(), deep_text(item, TEXT_OUTPUT)
    if kind == "thinking":
        return "Inference", text
    if kind in ("toolcall", "tool_call"):
        return "ToolCall", compact(item)
    if kind in ("toolresult", "tool_result"):
        return "ToolResult", first(text, compact(item))
    if kind in ("attachment", "image", "file"):
        return "Attachment", None
    return kind_of(role), text


def _pi_content(content: Any, role: str | None) -> list:
    if isinstance(content, str):
        return [(kind_of(role), content)]
    return [_pi_item(x, role) for x in (content if isinstance(content, list) else [content] if isinstance(content, dict) else [])]


def pi(line: dict) -> tuple[list, str | None]:
    message, content = get(line, "message"), get(line, "content")
    role, inner = first(string(line, "role"), string(message, "role")), get(message, "content")
    deep = lambda v: deep_text(v, TEXT_OUTPUT) if v is not None else None
    if (string(line, "type") or "").lower() == "custom_message":
        blocks = [("SessionEvent", string(line, "content"))]
    else:
        own = first(string(message, "role"), role)
        blocks = _pi_content(inner, own) if inner is not None else [(kind_of(own), string(message, "text"))]
        blocks += [*_pi_content(content, role), (kind_of(role), string(line, "text")), (kind_of(role), string(line, "output"))]
    return blocks, first(string(line, "text", "output"), deep(content), deep(inner), string(message, "text"))


PRODUCERS = {"Claude": claude, "ClaudeSubagentOutput": claude, "PiSubagentOutput": claude, "Codex": codex, "Pi": pi}
TIMES = {"Pi": ("timestamp", "started_at")}


#: Fixed value: arrays and objects may nest one level less.
MAX_DEPTH = 128
_ESCAPED_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _finite(text: str) -> float:
    value = float(text)
    if value - value != 0:
        raise ValueError(f"{text} is out of range")
    return value


def _too_deep(value: Any) -> bool:
    level = [value]
    for _ in range(MAX_DEPTH - 1):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return False
    return any(isinstance(v, (dict, list)) for v in level)


def load(text: str) -> Any:
    """The JSON value of a line; raises ValueError for what is none, lone surrogates, numbers out of range and MAX_DEPTH levels among it."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("too deep") from e
    if text.count("[") + text.count("{") >= MAX_DEPTH and _too_deep(value):
        raise ValueError("too deep")
    if _ESCAPED_SURROGATE.search(text):
        json.dumps(value, ensure_ascii=False).encode()  # UnicodeEncodeError is a ValueError
    return value


def read_line(source: str, text: str) -> dict:
    """The row of PARSED for one line, whatever it holds."""
    bad = {"malformed": True, "timestamp": None, "text": None, "title": None, "subagent_name": None, "authored_status": None, "task": None, "blocks": []}
    try:
        line = load(text)
    except ValueError:
        return bad
    when = string(line, *TIMES.get(source, ("timestamp", "created_at")))
    if when is not None and not _CANONICAL.match(when):
        return bad
    found, own = PRODUCERS[source](line)
    # An attachment has no text; other blocks count only with text that isn't blank.
    blocks = [{"kind": k, "text": t} for k, t in (b for b in found if b) if k == "Attachment" or t is not None and t.strip()]
    if own is None and not blocks:
        return bad
    if own is None:
        own = "\n".join(b["text"] for b in blocks if b["text"] is not None)
    return {"malformed": False, "timestamp": when, "text": own, **metadata(line), "blocks": blocks}
