import io
import json

import pytest

from corpusloom.plans import server
from corpusloom.plans.search import Corpus

DOCS = "doc_id long, name string, pseudopath string, source string, text string"


@pytest.fixture(scope="module")
def packages(spark):
    texts = [(1, "pump", "@/Sent/pump.md", "SENT", "The pump moves water through the pipe."), (2, "leaf", "@/Received/leaf.md", "RECEIVED", "Sugar is made from light in the leaf.")]
    return {"p": Corpus(spark.createDataFrame(texts, DOCS), language="en")}


def _ask(packages, *messages):
    out = io.StringIO()
    server.serve(packages, io.StringIO("\n".join(m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages) + "\n"), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def _tool(packages, tool, /, **arguments):
    (answer,) = _ask(packages, {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    return json.loads(answer["result"]["content"][0]["text"]) if "result" in answer else answer["error"]["code"]


def test_protocol(packages):
    first, tools = _ask(packages, {"id": 0, "method": "initialize"}, {"method": "notifications/initialized"}, "", {"id": "a", "method": "tools/list"})
    assert first["result"]["capabilities"] == {"tools": {}} and tools["id"] == "a" and [t["name"] for t in tools["result"]["tools"]] == ["search", "info", "document"]
    codes = [a["error"]["code"] for a in _ask(packages, "{", "[]", {"id": 1, "method": "none"}, {"id": 1, "method": "ping", "params": [1]})]
    assert codes == [server.UNREADABLE, server.INVALID, server.UNKNOWN, server.BAD_ARGUMENTS]


def test_tools(packages):
    found = _tool(packages, "search", query="sugar leaf", limit=20)
    assert found["passages"][0]["document"] == "leaf"
    assert _tool(packages, "search", query="sugar leaf", direction="sent")["found"] == 0
    assert _tool(packages, "document", name="@/Sent/pump.md")["text"].startswith("The pump") and "error" in _tool(packages, "document", name="x")
    info = _tool(packages, "info")
    assert info["documents"] == 2 and info["cross_language"] == {"languages": ["en"], "questions_in_any_language": False}
    for name, arguments in (("search", {}), ("search", {"query": 3}), ("search", {"query": "a", "limit": True}), ("none", {}), ("info", {"x": "y"})):
        assert _tool(packages, name, **arguments) == server.BAD_ARGUMENTS
