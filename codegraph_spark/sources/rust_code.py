"""Rust files, from their tokens. Functions inside functions are part of the outer one; macros are not looked into."""

from __future__ import annotations

from .records import FileGraph
from .tokens import RUST, Tokens

#: Words in front of '(' that are no calls. Fixed values.
NO_CALL = frozenset("if while for match return fn in let move loop else as break impl dyn where unsafe async await ref mut".split())


def _visibility(t: Tokens, at: int) -> tuple[str, int]:
    """The visibility that stands at a token, and the token after it."""
    if t.word(at) != "pub":
        return "private", at
    if t.word(at + 1) != "(":
        return "public", at + 1
    inside = t.source(at + 2, t.past(at + 1) - 1)
    return {"crate": "internal", "super": "protected"}.get(inside, "private"), t.past(at + 1)


def _params(t: Tokens, lo: int, hi: int) -> list[tuple[str, str | None, bool]]:
    found = []
    for a, b in t.split(lo, hi):
        while t.word(a) == "#":
            a = t.past(a + 1)
        colon = t.until(a, b, (":",))
        if colon == b and "self" in t.words[a:b]:
            found.append(("self", None, False))
        else:
            name = t.source(a + (t.word(a) == "mut"), colon)
            found.append((name, t.source(colon + 1, b) if colon < b else None, False))
    return found


def _skipped(t: Tokens, lo: int, hi: int) -> set[int]:
    """Tokens inside macro calls."""
    out: set[int] = set()
    at = lo
    while at < hi:
        if t.word(at) == "!" and t.is_name(at - 1) and t.word(at + 1) in ("(", "[", "{"):
            out.update(range(at + 1, t.past(at + 1)))
            at = t.past(at + 1)
        else:
            at += 1
    return out


def _regions(t: Tokens, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """(from, to, condition) of the constructs in a body."""
    out = []
    for at in range(lo, hi):
        word = t.words[at]
        if t.kinds[at] != "word" or word not in ("if", "match", "for", "while", "loop"):
            continue
        block = t.until(at + 1, hi, ("{",))
        end = t.past(block)
        while word == "if" and t.word(end) == "else":
            end = t.past(t.until(end + 1, hi, ("{",)))
        out.append((at, end, "conditional" if word in ("if", "match") else "in_loop"))
    return out


def complexity(t: Tokens, lo: int, hi: int) -> int:
    """1, and 1 for each branch, loop with a condition, arm, and lazy operator."""
    count, skipped = 1, _skipped(t, lo, hi)
    for at in range(lo, hi):
        if at in skipped:
            continue
        word, before = t.words[at], t.word(at - 1)
        if word == "||" and t.kinds[at] == "op":  # not a closure without parameters
            count += at > lo and (t.kinds[at - 1] in ("number", "string") or before in (")", "]", "}", "?") or (t.is_name(at - 1) and before not in NO_CALL))
        elif t.kinds[at] in ("op", "word"):
            count += word in ("if", "else", "while", "for", "=>", "&&")
    return count


def _calls(graph: FileGraph, t: Tokens, owner: int, lo: int, hi: int) -> None:
    skipped, regions = _skipped(t, lo, hi), _regions(t, lo, hi)
    for at in range(lo, hi):
        if at in skipped or not t.is_name(at) or t.words[at] in NO_CALL or t.word(at - 1) == "fn":
            continue
        follow = at + 1
        if t.word(follow) == "::" and t.word(follow + 1) == "<":
            follow = t.past_angles(follow + 1)
        if t.word(follow) != "(":
            continue
        begin = t.callee_start(at)
        inside = [r for r in regions if r[0] < at < r[1]]
        condition = "fallible" if t.word(t.past(follow)) == "?" else max(inside)[2] if inside else None
        graph.call(owner, t.source(begin, follow), t.line(at), condition, t.word(at - 1) == ".")


def _function(graph: FileGraph, t: Tokens, at: int, hi: int, scope: list[str], visibility: str, before: set[str]) -> int:
    """The function whose word fn is at ``at``; returns the token after it."""
    params = t.past_angles(at + 2)
    after = t.past(params)
    returns = None
    stop = t.until(after, hi, ("{", ";", "where"))
    if t.word(after) == "->":
        returns = t.source(after + 1, stop)
    body = t.until(stop, hi, ("{", ";"))
    end = t.past(body) if t.word(body) == "{" else min(body + 1, hi)
    lo, last = (body + 1, end - 1) if t.word(body) == "{" else (end, end)
    made = graph.function([*scope, t.word(at + 1)], t.line(at), t.line(end - 1), visibility=visibility, complexity=complexity(t, lo, last), params=_params(t, params + 1, after - 1), returns=returns, is_async="async" in before, is_unsafe="unsafe" in before)
    _calls(graph, t, made, lo, last)
    return end


def _fields(t: Tokens, at: int) -> list[tuple[str, str, str]]:
    found = []
    for a, b in t.split(at + 1, t.past(at) - 1):
        while t.word(a) == "#":
            a = t.past(a + 1)
        visibility, a = _visibility(t, a)
        if t.word(a + 1) == ":":
            found.append((t.word(a), t.source(a + 2, b), visibility))
    return found


def _imports(t: Tokens, lo: int, hi: int, prefix: list[str]) -> list[dict]:
    """The modules that a use tree names: one for each list of names, path or wildcard."""
    end = t.until(lo, hi, ("{",))
    path = [w for w in t.words[lo:end] if w != "::"]
    if end < hi:
        return [{"module": "::".join([*prefix, *path]), "symbols": [t.words[a] for a, _ in t.split(end + 1, t.past(end) - 1)], "wildcard": False}]
    if "as" in path:
        path = path[: path.index("as")]
    star = path[-1:] == ["*"]
    return [{"module": "::".join([*prefix, *path[:-1]]), "symbols": [] if star else path[-1:], "wildcard": star}]


def _items(graph: FileGraph, t: Tokens, at: int, hi: int, scope: list[str], top: bool = False, public: bool = False) -> None:
    while at < hi:
        if t.word(at) == "#":
            at = t.past(at + 1 + (t.word(at + 1) == "!"))
            continue
        first = at
        visibility, at = _visibility(t, at)
        before = set()
        while t.word(at) in ("async", "unsafe", "default", "extern") or (t.word(at) == "const" and t.word(at + 1) in ("fn", "unsafe", "async", "extern")) or (before and at < hi and t.kinds[at] == "string"):
            before.add(t.word(at))
            at += 1
        if public and visibility == "private":
            visibility = "public"
        word, name = t.word(at), t.word(at + 1)
        if word == "fn" and t.is_name(at + 1):
            at = _function(graph, t, at, hi, scope, visibility, before)
        elif word in ("struct", "enum", "trait", "union") and t.is_name(at + 1):
            body = t.until(t.past_angles(at + 2), hi, ("{", ";", "("))
            end = t.past(body) if t.word(body) in ("{", "(") else body + 1
            kind = word.title()
            graph.data([*scope, name], t.line(at), t.line(min(end, hi) - 1), kind=kind, visibility=visibility, fields=_fields(t, body) if kind in ("Struct", "Union") and t.word(body) == "{" else [])
            if word == "trait" and t.word(body) == "{":
                _items(graph, t, body + 1, end - 1, [*scope, name], public=visibility == "public")
            at = end
        elif word == "impl":
            head = t.past_angles(at + 1)
            body = t.until(head, hi, ("{", ";"))
            target = t.until(head, body, ("for",))
            begin = target + 1 if target < body else head
            owner = t.source(begin, t.until(begin, body, ("where", "<")))
            _items(graph, t, body + 1, t.past(body) - 1, [*scope, owner.rsplit("::", 1)[-1]])
            at = t.past(body)
        elif word == "mod" and t.is_name(at + 1):
            graph.add("module", [*scope, name], t.line(at), t.line(t.past(at + 2) - 1))
            if t.word(at + 2) == "{":
                _items(graph, t, at + 3, t.past(at + 2) - 1, [*scope, name])
            at = t.past(at + 2)
        elif word in ("const", "static"):
            at += 1 + (t.word(at + 1) == "mut")
            end = t.until(at, hi, (";",))
            if t.is_name(at):
                graph.add("binding", [*scope, t.word(at)], t.line(at), t.line(min(end, len(t) - 1)), visibility=visibility, is_constant=word == "const", is_mutable=t.word(at - 1) == "mut")
            at = end + 1
        elif word in ("use", "type"):
            end = t.until(at, hi, (";",))
            if top and word == "use":
                graph.imports += _imports(t, at + 1, end, [])
            at = end + 1
        else:
            at = max(t.past(at) if t.word(at) in ("(", "[", "{") else at + 1, first + 1)


def parse(path: str, text: str) -> FileGraph:
    graph, t = FileGraph(path, "rust"), Tokens(text, RUST)
    graph.error = None if t.balanced else "brackets do not match"
    _items(graph, t, 0, len(t), [], top=True)
    return graph.finish(by_last_part=False)
