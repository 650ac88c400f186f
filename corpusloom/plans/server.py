"""The search tools over JSON-RPC 2.0, one message a line, as the Model Context Protocol has it on standard streams."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import IO, Any

from .search import Corpus, tool_document, tool_info, tool_search

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 1, "maximum": 20}
TOOLS = {
    "search": ("Passages that answer a question, from all packages.", {"query": _TEXT, "limit": _NUMBER, "direction": _TEXT}, ["query"]),
    "info": ("Documents, passages and languages of the packages.", {}, []),
    "document": ("The whole text of a document by name or pseudopath.", {"name": _TEXT}, ["name"]),
}
INVALID, UNKNOWN, BAD_ARGUMENTS, UNREADABLE = -32600, -32601, -32602, -32700


class Refused(Exception):
    """A request that gets an error with a code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def call(packages: Mapping[str, Corpus], tool: str, given: Mapping[str, Any]) -> dict:
    """A tool's answer; arguments of a wrong kind are refused before anything runs."""
    if tool not in TOOLS:
        raise Refused(BAD_ARGUMENTS, f"there is no tool {tool}")
    _, known, needed = TOOLS[tool]
    for name in needed:
        if name not in given:
            raise Refused(BAD_ARGUMENTS, f"{tool} needs {name}")
    for name, value in given.items():
        kind = {"string": str, "integer": int}.get(known.get(name, {}).get("type"))
        if kind is None or not isinstance(value, kind) or isinstance(value, bool):
            raise Refused(BAD_ARGUMENTS, f"{tool} takes no such {name}")
    if tool == "search":
        return tool_search(packages, given["query"], given.get("limit", 5), given.get("direction"))
    return tool_info(packages) if tool == "info" else tool_document(packages, given["name"])


def _result(packages: Mapping[str, Corpus], method: str, params: Mapping[str, Any]) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusloom", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    if method == "tools/call":
        try:
            answer, failed = call(packages, params.get("name", ""), params.get("arguments") or {}), False
        except Refused:
            raise
        except Exception as e:  # a question that fails doesn't end the service
            answer, failed = {"error": f"{type(e).__name__}: {e}"}, True
        return {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False)}], "isError": failed}
    raise Refused(UNKNOWN, f"there is no method {method}")


def respond(packages: Mapping[str, Corpus], line: str) -> dict | None:
    """The response to one message; None to a notification."""
    number = None
    try:
        try:
            message = json.loads(line)
        except ValueError as e:
            raise Refused(UNREADABLE, "this is no JSON") from e
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            raise Refused(INVALID, "this is no request")
        number = message.get("id")
        if "id" not in message:
            return None
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise Refused(BAD_ARGUMENTS, "parameters go by name")
        return {"jsonrpc": "2.0", "id": number, "result": _result(packages, message["method"], params)}
    except Refused as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}


def serve(packages: Mapping[str, Corpus], requests: IO[str], responses: IO[str]) -> None:
    """Answers messages until the stream ends."""
    for line in requests:
        if line.strip() and (answer := respond(packages, line)) is not None:
            responses.write(json.dumps(answer, ensure_ascii=False) + "\n")
            responses.flush()
