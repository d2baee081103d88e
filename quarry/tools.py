"""The search tool and a JSON-RPC server for it, over standard input and output."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterable
from typing import Any

PROTOCOL = "2024-11-05"
TOOL = {
    "name": "memory_search",
    "description": "Search the memory files for past decisions, facts, preferences, people and dates. Gives ranked snippets with file and lines.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "description": "What to look for"},
            "maxResults": {"type": "number", "description": "At most so many results (default 10)"},
            "minScore": {"type": "number", "description": "Least score from 0 to 1 (default 0.3)"},
            "directories": {"type": "array", "items": {"type": "string"}, "description": "Only directories of these names or paths"},
        },
        "required": ["query"],
    },
}
#: JSON-RPC error codes.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603

Search = Callable[[str, int, float | None], list[dict[str, Any]]]


def _text(text: str, error: bool = False) -> dict[str, Any]:
    return {"content": [{"type": "text", "text": text}]} | ({"isError": True} if error else {})


class ToolExecutor:
    """Runs the tool over directories: name to a search function."""

    def __init__(self, directories: dict[str, Search]):
        self.directories = directories

    def chosen(self, asked: Iterable[str] | None) -> dict[str, Search]:
        """The directories whose name holds one of those asked for, whatever the case; all if none is asked for."""
        asked = [a.lower() for a in asked or ()]
        return {d: s for d, s in self.directories.items() if not asked or any(a in d.lower() for a in asked)}

    def execute(self, name: str, params: dict[str, Any]) -> dict[str, Any]:
        if name != TOOL["name"]:
            return _text(f"Unknown tool: {name}", error=True)
        try:
            return self._search(params)
        except Exception as e:  # a tool's failure is its answer
            return _text(f"Error: {e}", error=True)

    def _search(self, params: dict[str, Any]) -> dict[str, Any]:
        most = int(params.get("maxResults") or 10)
        places = self.chosen(params.get("directories"))
        if not places:
            return _text(f"No matching directories found. Available: {', '.join(self.directories)}", error=True)
        found = [r | {"directory": d} for d, search in places.items() for r in search(params["query"], math.ceil(most * 1.5), params.get("minScore"))]
        found = sorted(found, key=lambda r: -r["score"])[:most]
        if not found:
            return _text("No results found.")
        shown = []
        for i, r in enumerate(found, 1):
            where = f" [{r['directory']}]" if len(places) > 1 else ""
            shown.append(f"[{i}] {r['path']}:{r['start_line']}-{r['end_line']}{where} ({r['score'] * 100:.1f}% match)\n{r['snippet']}")
        note = f"\n\n(Searched {len(places)} directories)" if len(places) > 1 else ""
        return _text("\n\n".join(shown) + note)


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Answers JSON-RPC requests; notifications have no answer."""

    def __init__(self, executor: ToolExecutor, name: str = "quarry", version: str = "0.1.0"):
        self.executor, self.info = executor, {"name": name, "version": version}

    def _result(self, method: str, params: dict[str, Any]) -> dict[str, Any]:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": self.info}
        if method in ("initialized", "ping"):
            return {}
        if method == "tools/list":
            return {"tools": [TOOL]}
        if method == "tools/call":
            if not isinstance(params.get("name"), str) or not params["name"]:
                raise RpcError(INVALID_PARAMS, "Missing tool name")
            return self.executor.execute(params["name"], params.get("arguments") or {})
        raise RpcError(METHOD_NOT_FOUND, f"Method not found: {method}")

    def handle(self, request: dict[str, Any]) -> dict[str, Any]:
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
        try:
            return answer | {"result": self._result(request.get("method", ""), request.get("params") or {})}
        except RpcError as e:
            return answer | {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return answer | {"error": {"code": INTERNAL_ERROR, "message": str(e)}}

    def handle_line(self, line: str) -> dict[str, Any] | None:
        """The answer to a line; None for a blank one and for a notification."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "Parse error"}}
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
            return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": INVALID_REQUEST, "message": "Invalid JSON-RPC version"}}
        answer = self.handle(request)
        return answer if "id" in request else None

    def run(self, lines: Iterable[str] = sys.stdin, write: Callable[[str], Any] = sys.stdout.write) -> None:
        for line in lines:
            if (answer := self.handle_line(line)) is not None:
                write(json.dumps(answer) + "\n")
