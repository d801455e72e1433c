"""A snapshot over HTTP, and as tools over standard input and output.

HTTP, on the loopback address: /health, /api/stats, /api/search?q=, /api/explain?q=, /api/doc?row= and /api/stream?q=, which
sends a finished result as server-sent events. Tools: JSON-RPC lines with initialize, tools/list and tools/call.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import IO
from urllib.parse import parse_qs, urlsplit

from quillmere.errors import NotFound, QuillmereError
from quillmere.sources.snapshot import Snapshot


def _failure(e: QuillmereError) -> dict:
    return {"error": {"code": e.code, "message": e.message, "pos": e.pos, "len": e.length}}


def _document(table: Snapshot, row: int) -> str:
    found = table.document(row)
    if found is None:
        raise NotFound(f"there is no row {row}")
    return found


def http_server(table: Snapshot, port: int = 0) -> HTTPServer:
    """A server that handles one client at a time; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            query = args.get("q", "")
            try:
                match url.path:
                    case "/health":
                        self.answer(200, '{"status":"ok"}')
                    case "/api/stats":
                        self.answer(200, json.dumps(table.stats()))
                    case "/api/search":
                        self.answer(200, table.search(query).to_json())
                    case "/api/explain":
                        self.answer(200, json.dumps({"plan": table.explain(query)}))
                    case "/api/doc" if args.get("row", "").isdigit():
                        self.answer(200, _document(table, int(args["row"])))
                    case "/api/stream":
                        done = json.loads(table.search(query).to_json())
                        events = "".join(f"event: hit\ndata: {json.dumps(h, ensure_ascii=False)}\n\n" for h in done["hits"])
                        self.answer(200, f"{events}event: done\ndata: {json.dumps(done['execution'])}\n\n", "text/event-stream")
                    case _:
                        self.answer(404, '{"error":{"code":"NOT_FOUND","message":"no such path"}}')
            except QuillmereError as e:
                self.answer(404 if isinstance(e, NotFound) else 400, json.dumps(_failure(e)))

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def tools(table: Snapshot, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers JSON-RPC lines until the input ends."""
    text = {"type": "string"}
    offered: dict[str, tuple[str, dict, Callable[[dict], str]]] = {
        "search": ("Search the snapshot", {"query": text}, lambda a: table.search(a["query"]).to_json()),
        "explain": ("Explain a query", {"query": text}, lambda a: table.explain(a["query"])),
        "stats": ("Schema and row count", {}, lambda a: json.dumps(table.stats())),
        "get_document": ("A document by its row", {"row": {"type": "integer"}}, lambda a: _document(table, int(a["row"]))),
    }

    def reply(request: dict) -> dict | None:
        params = request.get("params") or {}
        match request.get("method"):
            case "initialize":
                return {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillmere", "version": "0.1.0"}}}
            case "ping":
                return {"result": {}}
            case "tools/list":
                return {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(p)}} for n, (d, p, _) in offered.items()]}}
            case "tools/call":
                _, properties, run = offered.get(params.get("name"), (None, None, None))
                arguments = params.get("arguments") or {}
                if run is None or set(properties) - set(arguments):
                    return {"error": {"code": -32602, "message": "unknown tool or missing arguments"}}
                try:
                    return {"result": {"content": [{"type": "text", "text": run(arguments)}], "isError": False}}
                except QuillmereError as e:
                    return {"result": {"content": [{"type": "text", "text": json.dumps(_failure(e))}], "isError": True}}
        return {"error": {"code": -32601, "message": "method not found"}}

    for line in source:
        try:
            request = json.loads(line)
        except ValueError:
            answer: dict | None = {"id": None, "error": {"code": -32700, "message": "parse error"}}
        else:
            if not isinstance(request, dict) or "id" not in request:
                continue  # a notification
            answer = {"id": request["id"]} | (reply(request) or {})
        print(json.dumps({"jsonrpc": "2.0"} | answer), file=sink, flush=True)
