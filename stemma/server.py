"""The named tools as a server: JSON-RPC 2.0, one message a line on stdin and stdout.

Answers ``initialize``, ``ping``, ``tools/list``, ``tools/call``, ``resources/list``
and ``resources/read``; what has no id is a notification and gets no answer.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import TextIO

from stemma import tools

PROTOCOL = "2024-11-05"
STRING, NUMBER = {"type": "string"}, {"type": "integer"}
#: Of each tool what it does, the arguments it must have, and those it may have.
OFFERED = {
    "analyze": ("Nodes, edges and statistics of a file or folder", {"path": STRING}, {"pattern": STRING}),
    "health": ("Score, status and notes of every entity of a file or folder", {"path": STRING}, {"pattern": STRING}),
    "index": ("Stores the graph of a folder with its communities and call paths", {"path": STRING}, {"db": STRING, "pattern": STRING}),
    "query": ("Runs a graph query on a stored graph", {"db": STRING, "cypher": STRING}, {"parameters": {"type": "object"}}),
    "impact": ("What depends on an entity of a stored graph, or what it depends on", {"db": STRING, "name": STRING}, {"direction": {"type": "string", "enum": ["upstream", "downstream"]}, "depth": NUMBER}),
    "communities": ("Groups of entities that belong together", {"path": STRING}, {"pattern": STRING}),
    "hotspots": ("Functions and methods of a stored graph by complexity", {"db": STRING}, {"limit": NUMBER}),
    "unhealthy": ("Functions and methods of a stored graph with a score below a bound", {"db": STRING}, {"below": {"type": "number"}}),
}
RESOURCES = {"status": "What a stored graph holds", "schema": "Labels of a stored graph and their columns"}


def _listed() -> list[dict]:
    return [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": {**must, **may}, "required": list(must)}} for n, (text, must, may) in OFFERED.items()]


class Fault(Exception):
    """An error of the protocol: a code and a message."""


def _result(method: str, params: dict, db: str | None, spark) -> dict:
    match method:
        case "initialize":
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "stemma", "version": "1"}}
        case "ping":
            return {}
        case "tools/list":
            return {"tools": _listed()}
        case "tools/call":
            if params.get("name") not in OFFERED:
                raise Fault(-32602, f"no tool is called {params.get('name')}")
            text = tools.call(params["name"], {**({"db": db} if db else {}), **(params.get("arguments") or {})}, spark)
            failed = isinstance(out := json.loads(text), dict) and set(out) == {"error", "traceback"}
            return {"content": [{"type": "text", "text": text}], "isError": failed}
        case "resources/list":
            return {"resources": [{"uri": f"stemma://{n}", "name": n, "description": d, "mimeType": "application/json"} for n, d in RESOURCES.items()]}
        case "resources/read":
            uri = str(params.get("uri"))
            name = uri.removeprefix("stemma://")
            if name not in RESOURCES or (name == "status" and not db):
                raise Fault(-32002, f"nothing to read at {uri}")
            return {"contents": [{"uri": uri, "mimeType": "application/json", "text": tools.resource(name, db, spark)}]}
    raise Fault(-32601, f"no method is called {method}")


def answer(message: object, db: str | None = None, spark=None) -> dict | None:
    """The answer to one message, or None for a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    own = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        return {**own, "result": _result(message["method"], message.get("params") or {}, db, spark)}
    except Fault as e:
        return {**own, "error": dict(zip(("code", "message"), e.args, strict=True))}
    except Exception as e:  # a client gets any failure as an answer
        return {**own, "error": {"code": -32603, "message": f"{type(e).__name__}: {e}"}}


def serve(lines: Iterable[str], out: TextIO, db: str | None = None, spark=None) -> None:
    """Answers messages until there are no more; ``db``: the stored graph that tools use unless told another."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            given = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            given = answer(message, db, spark)
        if given is not None:
            out.write(json.dumps(given, default=str) + "\n")
            out.flush()


if __name__ == "__main__":
    serve(sys.stdin, sys.stdout, sys.argv[1] if len(sys.argv) > 1 else None)
