"""Python files, by the standard library's syntax tree.

A file that does not parse is read block by block: each statement that starts in the first column is parsed by itself,
and only those that are broken are lost. Functions inside functions are part of the outer one.
"""

from __future__ import annotations

import ast

from .records import FileGraph

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _statements(text: str) -> tuple[list[tuple[ast.stmt, str]], str | None]:
    """Top-level statements with the source that they were parsed from, and what is wrong with the file."""
    try:
        return [(s, text) for s in ast.parse(text).body], None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = f"line {getattr(e, 'lineno', None) or 0}: {getattr(e, 'msg', None) or e}"
    lines, found, begin = text.split("\n"), [], 0
    starts = [k for k, x in enumerate(lines) if x[:1].strip() and x[0] not in ")]}#" and not (k and lines[k - 1].startswith("@"))]
    for begin, end in zip(starts, [*starts[1:], len(lines)], strict=True):
        own = "\n" * begin + "\n".join(lines[begin:end])
        try:
            found += [(s, own) for s in ast.parse(own).body]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return found, error


def _visibility(name: str) -> str:
    special = name.startswith("__") and name.endswith("__")
    return "private" if name.startswith("_") and not special else "public"


def complexity(node: ast.AST) -> int:
    count = 1
    for n in ast.walk(node):
        if isinstance(n, ast.BoolOp):
            count += len(n.values) - 1
        count += isinstance(n, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.Match))
    return count


def _calls(graph: FileGraph, owner: int, node: ast.AST, text: str, within: str | None = None) -> None:
    """Calls below node, each with the nearest construct that decides whether it runs."""
    if isinstance(node, ast.Call):
        callee = ast.get_source_segment(text, node.func) or ast.unparse(node.func)
        graph.call(owner, callee, node.lineno, within, "." in callee)
    for child in ast.iter_child_nodes(node):
        inside = within
        if isinstance(node, (ast.If, ast.IfExp, ast.Match)):
            inside = "conditional"
        elif isinstance(node, LOOPS):
            inside = "in_loop"
        elif isinstance(node, ast.ExceptHandler):
            inside = "error_path"
        elif isinstance(node, ast.Try):
            inside = "fallible"
        _calls(graph, owner, child, text, inside)


def _params(a: ast.arguments, text: str) -> list[tuple[str, str | None, bool]]:
    plain = [*a.posonlyargs, *a.args]
    rows = [(p, k >= len(plain) - len(a.defaults)) for k, p in enumerate(plain)]
    rows += [(p, False) for p in [a.vararg] if p] + [(p, d is not None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)] + [(p, False) for p in [a.kwarg] if p]
    return [(p.arg, p.annotation and ast.get_source_segment(text, p.annotation), d) for p, d in rows if p.arg not in ("self", "cls")]


def _visit(graph: FileGraph, node: ast.stmt, text: str, scope: list[str]) -> None:
    if isinstance(node, FUNCTIONS):
        made = graph.function([*scope, node.name], node.lineno, node.end_lineno or node.lineno, visibility=_visibility(node.name), complexity=complexity(node), params=_params(node.args, text), returns=node.returns and ast.get_source_segment(text, node.returns), is_async=isinstance(node, ast.AsyncFunctionDef))
        for statement in node.body:
            _calls(graph, made, statement, text)
    elif isinstance(node, ast.ClassDef):
        graph.data([*scope, node.name], node.lineno, node.end_lineno or node.lineno, kind="Class", visibility=_visibility(node.name), implements=[ast.get_source_segment(text, b) or "" for b in node.bases])
        for statement in node.body:
            _visit(graph, statement, text, [*scope, node.name])
    elif isinstance(node, (ast.If, ast.Try, ast.With)):  # definitions under a condition
        for statement in ast.iter_child_nodes(node):
            if isinstance(statement, ast.stmt):
                _visit(graph, statement, text, scope)


def parse(path: str, text: str) -> FileGraph:
    graph = FileGraph(path, "python")
    statements, graph.error = _statements(text)
    for node, own in statements:
        if isinstance(node, ast.ImportFrom):
            names = [a.name for a in node.names]
            graph.imports.append({"module": "." * node.level + (node.module or ""), "symbols": [n for n in names if n != "*"], "wildcard": "*" in names})
        elif isinstance(node, ast.Import):
            graph.imports += [{"module": a.name, "symbols": [], "wildcard": False} for a in node.names]
        else:
            _visit(graph, node, own, [])
    return graph.finish(by_last_part=True)
