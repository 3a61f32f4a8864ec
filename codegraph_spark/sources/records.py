"""What a frontend finds in one file: nodes, calls and imports."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..functions import types


def stable_id(*parts: object) -> int:
    """A positive 63-bit id that depends on the parts alone, so that unchanged files keep their ids."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "big") >> 1


@dataclass
class FileGraph:
    """Nodes, edges and imports of one file. Names are looked up by their last definition in the file."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    error: str | None = None
    _named: dict[str, int] = field(default_factory=dict)
    _calls: list[tuple] = field(default_factory=list)

    def type_of(self, text: str | None) -> tuple:
        return types.read(text, self.language)

    def add(self, kind: str, segments: list[str], line: int, end_line: int, **facts) -> int:
        name, same = "::".join(segments), sum(n["name"] == "::".join(segments) for n in self.nodes)
        node = stable_id(self.path, kind, name, same)
        self.nodes.append({"node_id": node, "node_kind": kind, "name": name, "short_name": segments[-1], "file": self.path, "start_line": line, "end_line": end_line, **facts})
        self._named[segments[-1]] = node
        return node

    def function(self, segments: list[str], line: int, end_line: int, *, visibility: str, complexity: int, params: list[tuple[str, str | None, bool]], returns: str | None, is_async: bool = False, is_unsafe: bool = False) -> int:
        """params: (name, text of the type or None, whether it has a default)."""
        told = [(n, self.type_of(t), d) for n, t, d in params]
        result = None if returns is None else self.type_of(returns)
        return self.add(
            "function", segments, line, end_line, visibility=visibility, complexity=complexity, is_async=is_async, is_unsafe=is_unsafe,
            params=[{"name": n, "type_debug": types.debug(t), "type_display": types.display(t), "has_default": d} for n, t, d in told],
            return_type_debug=None if result is None else types.debug(result), return_type_display=None if result is None else types.display(result),
        )

    def data(self, segments: list[str], line: int, end_line: int, *, kind: str, visibility: str, fields: list[tuple[str, str | None, str]] = (), implements: list[str] = ()) -> int:
        """fields: (name, text of the type, visibility)."""
        told = [{"name": n, "type_debug": types.debug(self.type_of(t)), "visibility": v} for n, t, v in fields]
        return self.add("type", segments, line, end_line, visibility=visibility, data_kind=kind, fields=told, implements=[types.debug(self.type_of(x)) for x in implements])

    def call(self, caller: int, text: str, line: int, condition: str | None = None, dynamic: bool = False) -> None:
        self._calls.append((caller, text, line, condition, dynamic))

    def finish(self, by_last_part: bool) -> FileGraph:
        """Turns calls into edges, once all names of the file are known; unknown callees become placeholders, one for
        each text. by_last_part: whether the part after the last '.' is looked up before the whole text."""
        empty: dict[str, int] = {}
        known = dict(self._named)
        for caller, text, line, condition, dynamic in self._calls:
            keys = [text.rsplit(".", 1)[-1], text] if by_last_part else [text]
            callee = next((known[k] for k in keys if k in known), None)
            if callee is None and text not in empty:
                empty[text] = stable_id(self.path, "placeholder", text)
                self.nodes.append({"node_id": empty[text], "node_kind": "function", "name": text, "short_name": text, "file": self.path, "start_line": line, "end_line": line, "visibility": "private", "is_async": False, "is_unsafe": False, "params": [], "complexity": None})
            self.edges.append({"src": caller, "dst": empty[text] if callee is None else callee, "edge_kind": "calls", "condition": condition, "is_dynamic": dynamic, "line": line})
        return self
