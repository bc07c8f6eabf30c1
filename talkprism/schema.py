"""Row types: what one transcript line becomes, and reports about files."""

from __future__ import annotations

SOURCES = ("Claude", "Codex", "Pi", "ClaudeSubagentOutput", "PiSubagentOutput", "Repository")
BLOCK_KINDS = ("UserPrompt", "AgentResponse", "SystemInstruction", "ToolCall", "ToolResult", "Inference", "SessionEvent", "Attachment", "Unclassified")
AUTHORSHIP = ("AgentAuthored", "HumanAuthored", "MixedAuthorship", "UnknownAuthorship")

TASK = "struct<task_identifier:string,title:string,tool_use_identifier:string,output_path:string,result:string,usage:string>"
BLOCK = "struct<kind:string,text:string>"
PARSED = f"struct<malformed:boolean,timestamp:string,text:string,title:string,subagent_name:string,authored_status:string,task:{TASK},blocks:array<{BLOCK}>>"
#: One row a transcript line that parsed.
RECORD_COLUMNS = ("source", "source_identifier", "path", "line_number", "fingerprint", "modified", "timestamp", "text", "title", "subagent_name", "authored_status", "session_identifier", "task", "blocks")
#: One row a file or line that didn't.
FAILURE = "source string, source_identifier string, path string, line_number long, reason string"
#: The same as a schema.
RECORD = f"source string, source_identifier string, path string, line_number long, fingerprint string, modified timestamp, timestamp string, text string, title string, subagent_name string, authored_status string, session_identifier string, task {TASK}, blocks array<struct<kind:string,text:string,task_identifier:string>>"
