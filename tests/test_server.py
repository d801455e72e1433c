import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from quillmere.server import http_server, tools
from quillmere.sources.snapshot import Snapshot


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("served")
    (folder / "in.jsonl").write_text('{"_id":"a","title":"cat é"}\n{"_id":"b","title":"dog"}\n', encoding="utf-8")
    return Snapshot.build(spark, f"file://{folder}/in.jsonl", str(folder / "s"))


def test_http(table):
    server = http_server(table)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert get("/health") == (200, '{"status":"ok"}')
    assert json.loads(get("/api/stats")[1])["rows"] == 2
    assert [h["_id"] for h in json.loads(get("/api/search?q=title:cat")[1])["hits"]] == ["a"]
    assert json.loads(get("/api/doc?row=1")[1])["_id"] == "b"
    assert get("/api/doc?row=9")[0] == 404 and get("/nothing")[0] == 404
    status, body = get("/api/search?q=title:")
    assert status == 400 and json.loads(body)["error"]["code"] == "PARSE"
    assert get("/api/stream?q=*")[1].count("event: hit") == 2
    assert "Leaf" in json.loads(get("/api/explain?q=title:cat")[1])["plan"]
    server.shutdown()


def test_tools(table):
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "title:dog"}}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "nope:1"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "get_document", "arguments": {"row": 0}}}, {"id": 6, "method": "tools/call", "params": {"name": "get_document"}}, {"id": 7, "method": "what"},
    ]
    sink = io.StringIO()
    tools(table, io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x["id"] for x in out] == [1, 2, 3, 4, 5, 6, 7, None]
    assert len(out[1]["result"]["tools"]) == 4
    assert json.loads(out[2]["result"]["content"][0]["text"])["hits"][0]["_id"] == "b"
    assert out[3]["result"]["isError"] and "error" in out[5] and out[6]["error"]["code"] == -32601
    assert json.loads(out[4]["result"]["content"][0]["text"])["title"] == "cat é"
