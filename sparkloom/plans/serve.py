"""The questions and the jobs for other programs: over HTTP on this machine, and as tools over standard input and output.

``python -m sparkloom.plans.serve http [PORT]`` or ``... tools``.  Both call the functions of ``api`` and ``jobs``; a
request is answered by ``Service.answer``, which needs no socket.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from ..operators import graph
from ..session import session
from . import api, settings
from . import pack as packs
from .jobs import Jobs, PathLocks

HOST, PORT = "127.0.0.1", 8765
PROTOCOL = "2024-11-05"


class Service:
    """Routes to functions; ``answer`` gives (status, body)."""

    def __init__(self, spark: SparkSession, settings_path: str = ".sparkloom-settings.json", config: dict | None = None):
        """config: the project and pack that a client starts with, if any."""
        self.config = {"project": None, "pack": None} | (config or {})
        self.spark, self.jobs, self.settings, self.writing = spark, Jobs(spark), settings_path, PathLocks()
        question = lambda f, **names: lambda a: f(**{to: a[name] for name, to in names.items() if a.get(name) not in (None, "")})
        own = {"pack": "pack_path", "project": "project_path"}
        self.get: dict[str, Callable[[dict], object]] = {
            "/api/overview": question(api.get_overview, **own), "/api/files": question(api.list_files, **own), "/api/relationships": question(api.get_relationships, pack="pack_path"),
            "/api/dependents": question(api.get_dependents, pack="pack_path", file="file"), "/api/blast_radius": question(api.get_blast_radius, pack="pack_path", file="file"),
            "/api/detail": lambda a: {"text": api.get_detail(a["pack"], a["file"], _int(a.get("start")), _int(a.get("end")))}, "/api/freshness": question(api.check_freshness, **own),
            "/api/search": lambda a: api.search_project(a["project"], a["pattern"], _int(a.get("context")) or 0, str(a.get("ignore_case", "")).lower() in ("1", "true")),
            "/api/select_files": lambda a: self.jobs.selectable(a["project"]) | {"output": settings.output_path(self.settings, a["project"])},
            "/api/pack/status": lambda a: self.jobs.status(a["job"], _int(a.get("since")) or 0), "/api/pack/review": lambda a: self.jobs.review(a["job"]), "/api/settings": lambda a: settings.load(self.settings),
            "/api/config": lambda a: dict(self.config), "/api/overview/text": lambda a: {"text": packs.overview_text(packs.load(self.spark, a["pack"]))}, "/api/files/text": lambda a: {"text": packs.file_text(packs.load(self.spark, a["pack"]), a["file"])},
        }
        self.post: dict[str, Callable[[dict], object]] = {
            "/api/pack": self._start, "/api/pack/link": lambda a: self.jobs.link(a["job"], a["file"], a["target"]), "/api/pack/unlink": lambda a: self.jobs.unlink(a["job"], a["file"], a["target"]),
            "/api/pack/finalize": lambda a: {"pack": self.jobs.finish(a["job"], name=a.get("name"), prompt=a.get("prompt"), rules=a.get("rules"), summaries=a.get("summaries"))},
            "/api/pack/stop": lambda a: self.jobs.stop(a["job"], a.get("save", True) not in (False, "false", "0")), "/api/pack/cancel": lambda a: self.jobs.discard(a["job"]), "/api/settings": lambda a: settings.save(self.settings, settings.load(self.settings) | a),
            "/api/relationships/link": lambda a: self._edit(graph.link, a), "/api/relationships/unlink": lambda a: self._edit(graph.unlink, a),
        }

    def _start(self, a: dict) -> dict:
        output = a.get("output") or settings.output_path(self.settings, a["project"]).removesuffix(".json") or f"result/{a['project'].rstrip('/').rpartition('/')[2]}"
        if a.get("output"):
            settings.pin(self.settings, a["project"], str(a["output"]).rpartition("/")[0] or ".")
        return {"job": self.jobs.start(a["project"], output, selected=a.get("files"), use_cache=not a.get("no_cache"), use_llm=not a.get("no_llm"))}

    def _edit(self, change: Callable, a: dict) -> dict:
        with self.writing.of(a["pack"]):
            packs.edit_saved_edges(self.spark, a["pack"], change, a["file"], a["target"])
        return api.get_relationships(a["pack"])

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        """400: malformed, 404: unknown route, job, file or pack, 409: the edge would close a cycle."""
        url = urlsplit(target)
        route = {"GET": self.get, "POST": self.post}.get(method, {}).get(url.path)
        if route is None:
            return 404, {"error": f"no {method} {url.path}"}
        try:
            asked = dict(parse_qsl(url.query)) | (json.loads(body) if body else {})
        except (ValueError, TypeError):
            return 400, {"error": "the body isn't a JSON object"}
        try:
            return 200, route(asked)
        except KeyError as e:
            return 400, {"error": f"missing: {e.args[0]}"}
        except graph.CycleError as e:
            return 409, {"error": str(e)}
        except ValueError as e:
            return 400 if "regex" in str(e) else 404, {"error": str(e)}
        except Exception as e:  # noqa: BLE001 - a pack or folder that can't be read; the server goes on
            return 404, {"error": f"{type(e).__name__}: {str(e)[:300]}"}


def _int(value: object) -> int | None:
    return None if value in (None, "") else int(value)  # type: ignore[call-overload]


def http(service: Service, port: int = PORT) -> ThreadingHTTPServer:
    """A server for this machine only; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = service.answer(self.command, self.path, self.rfile.read(size))
            data = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((HOST, port), Handler)


# ---- tools: JSON-RPC, a message a line

_KINDS = {"int": "integer", "bool": "boolean"}


def tools() -> list[dict]:
    """The eight questions with their parameters."""
    found = []
    for name, f in api.QUESTIONS.items():
        own = inspect.signature(f).parameters.values()
        kinds = {p.name: {"type": next((k for t, k in _KINDS.items() if str(p.annotation).startswith(t)), "string")} for p in own}
        found.append({"name": name, "description": (f.__doc__ or name.replace("_", " ")).strip(), "inputSchema": {"type": "object", "properties": kinds, "required": [p.name for p in own if p.default is p.empty]}})
    return found


def respond(message: dict) -> dict | None:
    """The reply to a message; None to a notification."""
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, asked = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools()}}
    if method != "tools/call" or asked.get("name") not in api.QUESTIONS:
        return reply | {"error": {"code": -32601, "message": f"unknown: {asked.get('name') or method}"}}
    try:
        text, failed = json.dumps(api.QUESTIONS[asked["name"]](**(asked.get("arguments") or {})), ensure_ascii=False), False
    except Exception as e:  # noqa: BLE001 - the caller is told
        text, failed = f"{type(e).__name__}: {str(e)[:300]}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve_tools(source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = respond(json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()


def main(argv: list[str]) -> None:
    spark = session("local[*]")
    if argv[:1] == ["tools"]:
        serve_tools(sys.stdin, sys.stdout)
    else:
        http(Service(spark), int(argv[1]) if argv[1:] else PORT).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
