"""TypeScript and JavaScript files, from their tokens."""

from __future__ import annotations

from .records import FileGraph
from .tokens import SCRIPT, Tokens

#: Words in front of '(' that are no calls, words that begin a statement, and words in front of members. Fixed values.
NO_CALL = frozenset("if while for switch return function catch typeof super await new in of do else throw void delete yield case import".split())
BEGINS = frozenset("const let var function class export import interface type enum if for while return async abstract throw try switch declare".split())
BEFORE_MEMBERS = frozenset("public private protected static readonly async get set abstract override declare".split())


def _params(t: Tokens, lo: int, hi: int) -> list[tuple[str, str | None, bool]]:
    """Parameters between lo and hi; a rest parameter has a name only."""
    found = []
    for a, b in t.split(lo, hi):
        while t.word(a) in BEFORE_MEMBERS and t.is_name(a + 1) or t.word(a).startswith("@"):
            a += 1
        if t.word(a) == "...":
            found.append((t.word(a + 1), None, False))
            continue
        equal = t.until(a, b, ("=",))
        colon = t.until(a, equal, (":",))
        name = t.source(a, colon).rstrip("?").strip()
        found.append((name, t.source(colon + 1, equal) if colon < equal else None, equal < b))
    return found


def _is_ternary(t: Tokens, at: int) -> bool:
    return t.words[at] == "?" and t.kinds[at] == "op" and t.word(at + 1) not in (":", ",", ")", "=", ";") and t.word(at + 1) != "?"


def complexity(t: Tokens, lo: int, hi: int) -> int:
    words = ("if", "else", "while", "for", "case", "catch", "&&", "||", "??")
    return 1 + sum((t.kinds[k] in ("op", "word") and t.words[k] in words and t.word(k - 1) != ".") or _is_ternary(t, k) for k in range(lo, hi))


def _regions(t: Tokens, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """(from, to, condition) of the constructs in a body."""
    kinds = {"if": "conditional", "switch": "conditional", "for": "in_loop", "while": "in_loop", "do": "in_loop", "try": "fallible", "catch": "error_path"}
    out = []
    for at in range(lo, hi):
        word = t.words[at]
        if _is_ternary(t, at):
            out.append((at, t.until(at + 1, hi, (";", ",", ")", "]", "}")), "conditional"))
        if t.kinds[at] != "word" or word not in kinds or t.word(at - 1) == ".":
            continue
        end = _statement_end(t, t.past(at + 1) if t.word(at + 1) == "(" else at + 1, hi)
        while word == "if" and t.word(end) == "else":
            end = _statement_end(t, end + 1, hi)
        out.append((at, end, kinds[word]))
    return out


def _statement_end(t: Tokens, at: int, hi: int) -> int:
    if t.word(at) == "{":
        return t.past(at)
    if t.word(at) == "if" and t.word(at + 1) == "(":
        end = _statement_end(t, t.past(at + 1), hi)
        return _statement_end(t, end + 1, hi) if t.word(end) == "else" else end
    return min(t.until(at, hi, (";",)) + 1, hi)


def _calls(graph: FileGraph, t: Tokens, owner: int, lo: int, hi: int) -> None:
    regions = _regions(t, lo, hi)
    for at in range(lo, hi):
        if not t.is_name(at) or t.words[at] in NO_CALL or t.word(at - 1) == "function":
            continue
        follow = at + 1
        if t.word(follow) == "<" and t.word(t.past_angles(follow)) == "(":
            follow = t.past_angles(follow)
        follow += t.word(follow) == "?." and t.word(follow + 1) == "("
        if t.word(follow) != "(" or t.word(t.past(follow)) == "{" and t.word(at - 1) in (",", "{", "}"):
            continue  # the second is a method of an object
        text = t.source(t.callee_start(at), at + 1)
        inside = [r for r in regions if r[0] < at < r[1]]
        graph.call(owner, text, t.line(at), max(inside)[2] if inside else None, "." in text)


def _body(t: Tokens, at: int, hi: int) -> tuple[int, int, int]:
    """(from, to, after) of a function's body, a block or an expression, that begins at ``at``."""
    if t.word(at) == "{":
        return at + 1, t.past(at) - 1, t.past(at)
    end, k = hi, at
    while k < hi:
        if t.words[k] in (";", ",") and t.kinds[k] == "op" or (k > at and t.words[k] in BEGINS and t.kinds[k] == "word" and t.line(k) > t.line(k - 1)):
            end = k
            break
        k = t.past(k) if t.words[k] in ("(", "[", "{") and t.kinds[k] == "op" else k + 1
    return at, end, end


def _callable(t: Tokens, at: int, hi: int) -> tuple | None:
    """(params, returns, body from, body to, after, async) of an arrow or function expression at ``at``."""
    is_async = t.word(at) == "async"
    at += is_async
    if t.word(at) == "function":
        at += 1 + (t.word(at + 1) == "*")
        at += t.is_name(at)
        at = t.past_angles(at)
        if t.word(at) != "(":
            return None
        arrow, lo = False, at
    elif t.is_name(at) and t.word(at + 1) == "=>":
        return [(t.word(at), None, False)], None, *_body(t, at + 2, hi), is_async
    else:
        lo, arrow = t.past_angles(at), True
        if t.word(lo) != "(":
            return None
    after = t.past(lo)
    stop = t.until(after, hi, ("=>",) if arrow else ("{",)) if t.word(after) == ":" else after
    if t.word(stop) != ("=>" if arrow else "{"):
        return None
    returns = t.source(after + 1, stop) if stop > after else None
    return _params(t, lo + 1, after - 1), returns, *_body(t, stop + arrow, hi), is_async


def _add(graph: FileGraph, t: Tokens, at: int, segments: list[str], visibility: str, found: tuple) -> int:
    params, returns, lo, hi, after, is_async = found
    made = graph.function(segments, t.line(at), t.line(max(after - 1, at)), visibility=visibility, complexity=complexity(t, lo, hi), params=params, returns=returns, is_async=is_async)
    _calls(graph, t, made, lo, hi)
    return after


def _type_end(t: Tokens, at: int, hi: int) -> int:
    """Where the type of a member, which begins at ``at``, ends."""
    k = at
    while k < hi and not (t.kinds[k] == "op" and t.words[k] in (";", ",", "=", "}")) and not (k > at and t.line(k) > t.line(k - 1) and t.words[k] not in ("|", "&", "=>") and t.word(k - 1) not in ("|", "&", "=>", ":")):
        k = t.past(k) if t.words[k] in ("(", "[", "{") else t.past_angles(k) if t.words[k] == "<" else k + 1
    return min(k, hi)


def _members(graph: FileGraph, t: Tokens, at: int, hi: int, scope: list[str]) -> None:
    """Methods and fields of a class; a field is a function node, too."""
    while at < hi:
        if t.word(at).startswith("@"):
            at += 1
            at = t.past(at) if t.word(at) == "(" else at
            continue
        before, first = set(), at
        while t.word(at) in BEFORE_MEMBERS and t.word(at + 1) not in ("(", "=", ":", ";", "?", "!", "<"):
            before.add(t.word(at))
            at += 1
        at += t.word(at) == "*"
        if t.word(at) == "{" and before == {"static"} or not (t.is_name(at) or (at < hi and t.kinds[at] in ("string", "number"))):
            at = t.past(at) if t.word(at) in ("(", "[", "{") else max(at + 1, first + 1)
            continue
        visibility = next((v for v in ("private", "protected") if v in before), "private" if t.word(at).startswith("#") else "public")
        name = [*scope, t.word(at).strip("\"'")]
        k = t.past_angles(at + 1 + (t.word(at + 1) in ("?", "!")))
        if t.word(k) == "(":
            after = t.past(k)
            stop = after
            if t.word(after) == ":":
                stop = after + 1
                if t.word(stop) == "{":
                    stop = t.past(stop)
                stop = t.until(stop, hi, ("{", ";"))
            returns = t.source(after + 1, stop) if stop > after + 1 else None
            lo, end, follow = _body(t, stop, hi) if t.word(stop) == "{" else (stop, stop, stop + 1)
            at = _add(graph, t, at, name, visibility, (_params(t, k + 1, after - 1), returns, lo, end, follow, "async" in before))
            continue
        kind = None
        if t.word(k) == ":":
            end = _type_end(t, k + 1, hi)
            kind, k = t.source(k + 1, end), end
        if t.word(k) == "=":
            found = _callable(t, k + 1, hi)
            if found:
                at = _add(graph, t, at, name, visibility, found)
                continue
            lo, end, after = _body(t, k + 1, hi)
            at = _add(graph, t, at, name, visibility, ([], kind, lo, end, max(after, k + 1), False))
        else:
            at = _add(graph, t, at, name, visibility, ([], kind, k, k, max(k, at + 1), False))


def _interface_fields(t: Tokens, at: int, hi: int) -> list[tuple[str, str | None, str]]:
    found = []
    while at < hi:
        at += t.word(at) == "readonly" and t.is_name(at + 1)
        k = at + 1 + (t.word(at + 1) == "?")
        if t.is_name(at) and t.word(k) == ":":
            end = _type_end(t, k + 1, hi)
            found.append((t.word(at), t.source(k + 1, end), "public"))
            at = end
        else:
            at = t.past(at) if t.word(at) in ("(", "[", "{") else at + 1
    return found


def _import(t: Tokens, at: int, hi: int) -> tuple[dict | None, int]:
    end = at + 1
    while end < hi and t.kinds[end] != "string":
        if t.word(end) == ";":
            return None, end
        end = t.past(end) if t.word(end) == "{" else end + 1
    if end >= hi or t.word(at + 1) in ("(", "."):
        return None, at + 1
    symbols, k = [], at + 1
    wildcard = "*" in t.words[k:end]
    while k < end:
        if t.word(k) == "{":
            symbols += [t.word(a + (t.word(a) == "type" and b > a + 1)) for a, b in t.split(k + 1, t.past(k) - 1)]
            k = t.past(k)
        else:
            if t.is_name(k) and t.word(k) not in ("type", "from", "as"):
                symbols.append(t.word(k))
            k += 1
    return {"module": t.word(end)[1:-1], "symbols": symbols, "wildcard": wildcard}, end + 1


def _top(graph: FileGraph, t: Tokens, at: int, hi: int) -> None:
    while at < hi:
        first, exported = at, False
        while t.word(at) in ("export", "default", "declare", "abstract"):
            exported |= t.word(at) == "export"
            at += 1
        visibility = "public" if exported else "private"
        word = t.word(at)
        if word == "const" and t.word(at + 1) == "enum":
            at, word = at + 1, "enum"
        name = t.word(at + 1)
        if word == "import":
            found, at = _import(t, at, hi)
            graph.imports += [found] if found else []
        elif word == "function" or (word == "async" and name == "function"):
            where = at + 1 + (word == "async")
            where += t.word(where) == "*"
            found = _callable(t, at, hi)
            at = _add(graph, t, where, [t.word(where) if t.is_name(where) else "default"], visibility, found) if found else where + 1
        elif word == "class":
            body = t.until(t.past_angles(at + 2 if t.is_name(at + 1) else at + 1), hi, ("{",))
            own = name if t.is_name(at + 1) and name != "extends" else "default"
            bases = t.until(at + 1, body, ("implements",))
            implements = [t.source(a, b) for a, b in t.split(bases + 1, body)] if bases < body else []
            extends = t.until(at + 1, bases, ("extends",))
            implements = ([t.source(extends + 1, bases)] if extends < bases else []) + implements
            graph.data([own], t.line(at), t.line(max(t.past(body) - 1, at)), kind="Class", visibility=visibility, implements=implements)
            _members(graph, t, body + 1, t.past(body) - 1, [own])
            at = t.past(body) if body < hi else hi
        elif word == "interface" and t.is_name(at + 1):
            body = t.until(t.past_angles(at + 2), hi, ("{",))
            graph.data([name], t.line(at), t.line(max(t.past(body) - 1, at)), kind="Interface", visibility="public", fields=_interface_fields(t, body + 1, t.past(body) - 1))
            at = t.past(body) if body < hi else hi
        elif word == "enum" and t.is_name(at + 1):
            graph.data([name], t.line(at), t.line(max(t.past(at + 2) - 1, at)), kind="Enum", visibility="public")
            at = t.past(at + 2)
        elif word == "type" and t.is_name(at + 1) and t.word(t.past_angles(at + 2)) == "=":
            end = _type_end(t, t.past_angles(at + 2) + 1, hi)
            graph.data([name], t.line(at), t.line(max(end - 1, at)), kind="TypeAlias", visibility="public")
            at = end
        elif word in ("const", "let", "var") and t.is_name(at + 1):
            equal = at + 2
            if t.word(equal) == ":":
                equal = _type_end(t, equal + 1, hi)
            if t.word(equal) == "=":
                found = _callable(t, equal + 1, hi)
                if found:
                    at = _add(graph, t, at + 1, [name], visibility, found)
                else:
                    end = _body(t, equal + 1, hi)[2]
                    graph.add("binding", [name], t.line(at), t.line(max(end - 1, at)), visibility=visibility, is_constant=word == "const", is_mutable=word != "const")
                    at = max(end, equal + 1)
            else:
                at = equal
        else:
            at = max(t.past(at) if t.word(at) in ("(", "[", "{") else at + 1, first + 1)


def parse(path: str, text: str) -> FileGraph:
    graph, t = FileGraph(path, "typescript"), Tokens(text, SCRIPT)
    graph.error = None if t.balanced else "brackets do not match"
    _top(graph, t, 0, len(t))
    return graph.finish(by_last_part=True)
