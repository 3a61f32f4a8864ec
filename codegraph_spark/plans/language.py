"""The FIND ... WHERE ... language: lexer, parser and a compiler to DataFrame operations.

Evaluation is two-valued: what does not apply to a node is false, so its negation is true. Scalar conditions become
one Column filter, which reaches the scan; conditions on neighbours become semi joins, negated ones anti joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target words of the language and the node kind they stand for. Fixed values.
TARGETS = {
    "function": ("functions", "function", "fn", "fns", "methods"),
    "type": ("types", "type", "structs", "classes", "interfaces"),
    "module": ("modules", "module", "mod"),
    "binding": ("bindings", "binding", "vars", "constants"),
    "all": ("all", "*"),
}
KEYWORDS = ("find", "where", "and", "or", "not", "true", "false")
OPERATORS = ("!=", ">=", "<=", "=", ">", "<", "~")
EPSILON = 2.220446049250313e-16


class QueryError(ValueError):
    """The query text cannot be read."""


@dataclass(frozen=True)
class Token:
    kind: str  # ident, string, number, op, punct, keyword, end
    value: object


@dataclass(frozen=True)
class Condition:
    """field op value, or name(args) if op is 'call'; negated if it stands under an odd number of NOTs."""

    field: str
    op: str
    value: Token | tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    target: str
    conditions: tuple[Condition, ...]
    text: str


_LEX = re.compile(r"""(?P<space>\s+)|(?P<op>!=|>=|<=|[=><~])|(?P<punct>[(),])|(?P<string>'[^']*'?|"[^"]*"?)|(?P<number>[0-9][0-9.]*)|(?P<ident>[^\W]|[_.:*])""")
_IDENT = re.compile(r"[\w.:*/]+")


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _LEX.match(text, at)
        if not found:
            raise QueryError(f"unexpected character {text[at]!r}")
        kind, value, at = found.lastgroup, found.group(), found.end()
        if kind == "string":
            out.append(Token("string", value[1:].removesuffix(value[0]) if len(value) > 1 else ""))
        elif kind == "number":
            try:
                out.append(Token("number", float(value)))
            except ValueError:
                raise QueryError(f"not a number: {value}") from None
        elif kind == "ident":
            value = _IDENT.match(text, found.start()).group()
            at = found.start() + len(value)
            out.append(Token("keyword", value.lower()) if value.lower() in KEYWORDS else Token("ident", value))
        elif kind != "space":
            out.append(Token(kind, value))
    return [*out, Token("end", None)]


def _shown(token: Token) -> str:
    if token.kind == "number":
        return str(int(token.value)) if token.value.is_integer() else repr(token.value)
    return str(token.value)


def parse(text: str, strict: bool = False) -> Query:
    """[FIND] target [WHERE condition {AND condition}]. What follows the last condition is ignored unless strict."""
    tokens, at = tokenize(text), 0

    def take(kind: str | None = None, value: object = None) -> Token | None:
        nonlocal at
        token = tokens[at]
        if (kind and token.kind != kind) or (value is not None and token.value != value):
            return None
        at = min(at + 1, len(tokens) - 1)
        return token

    take("keyword", "find")
    word = take("ident")
    target = next((k for k, words in TARGETS.items() if word and str(word.value).lower() in words), None)
    if target is None:
        raise QueryError("a target is missing or unknown")
    conditions = []
    if take("keyword", "where"):
        while True:
            negated = False
            while take("keyword", "not"):
                negated = not negated
            name = take("ident")
            if not name:
                raise QueryError("a field or predicate is missing")
            if take("punct", "("):
                args = []
                while (token := take("ident") or take("string") or take("number")) or take("punct", ","):
                    if token:
                        args.append(_shown(token))
                if tokens[at].kind == "keyword":
                    raise QueryError("a keyword cannot be an argument")
                take("punct", ")")
                conditions.append(Condition(name.value, "call", tuple(args), negated))
            else:
                op = take("op")
                value = take() if op else None
                if not op or value.kind not in ("ident", "string", "number", "keyword") or (value.kind == "keyword" and value.value not in ("true", "false")):
                    raise QueryError(f"a comparison of {name.value} is incomplete")
                conditions.append(Condition(name.value, op.value, value, negated))
            if not take("keyword", "and"):
                break
    if strict and tokens[at].kind != "end":
        raise QueryError(f"unexpected {tokens[at].value!r}")
    return Query(target, tuple(conditions), text)


def glob_pattern(pattern: str) -> str:
    """A Java regular expression for a glob: '*' matches anything, each part its leftmost place after the last one."""
    quote = lambda x: "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if not pattern:
        return r"^\z"
    if "*" not in pattern:
        return "(?s)" + quote(pattern)
    first, *rest = pattern.split("*")
    return "(?s)^" + (quote(first) if first else "") + "".join(f"(?>.*?{quote(part)})" for part in rest if part) + ("" if pattern.endswith("*") else r"\z")


def _number(column: Column, op: str, value: Token) -> Column:
    if value.kind not in ("number", "ident"):
        return F.lit(False)
    try:
        x = float(value.value)
    except ValueError:  # a word that is no number
        x = 0.0
    if math.isnan(x):
        return F.lit(False)
    column = column.cast("double")
    near = F.abs(column - x) < EPSILON
    return {"=": near, "!=": ~near, ">": column > x, "<": column < x, ">=": column >= x, "<=": column <= x}.get(op, F.lit(False))


def _text(token: Token) -> str | None:
    return str(token.value) if token.kind in ("ident", "string") else None


def _truth(token: Token) -> bool | None:
    return {"keyword": token.value == "true", "ident": token.value == "true"}.get(token.kind)


def kind_name() -> Column:
    """The kind that a node is shown as: that of its data for types."""
    return F.when(F.col("node_kind") == "type", F.lower("data_kind")).otherwise(F.col("node_kind"))


def scalar(field: str, op: str, value: Token) -> Column:
    """A comparison as a Column that is never null."""
    is_function, is_type, no = F.col("node_kind") == "function", F.col("node_kind") == "type", F.lit(False)
    equal = op in ("=", "!=")
    if op == "~":
        if _text(value) is None or field not in ("name", "file"):
            return no
        found = F.col(field).rlike(glob_pattern(_text(value)))
    elif field in ("complexity",):
        found = is_function & _number(F.coalesce("complexity", F.lit(0)), op, value)
    elif field in ("params", "param_count"):
        found = is_function & _number(F.size("params"), op, value)
    elif field in ("fields", "field_count"):
        found = is_type & _number(F.size("fields"), op, value)
    elif field in ("async", "unsafe") and equal and _truth(value) is not None:
        if field == "unsafe" and op == "!=" and value.kind == "ident":
            return no
        found = is_function & ((F.col(f"is_{field}") == _truth(value)) if op == "=" else (F.col(f"is_{field}") != _truth(value)))
    elif not equal or _text(value) is None:
        return no
    elif field == "name":
        same = (F.col("name") == _text(value)) | (F.col("short_name") == _text(value))
        found = same if op == "=" else ~same
    elif field in ("visibility", "vis"):
        same = F.coalesce("visibility", F.lit("private")) == _text(value).lower()
        found = same if op == "=" else ~same
    elif field == "file":
        same = F.endswith(F.replace("file", F.lit("\\"), F.lit("/")), F.lit(_text(value)))
        found = same if op == "=" else ~same
    elif field == "kind":
        same = kind_name() == _text(value).lower()
        found = same if op == "=" else ~same
    else:
        return no
    return F.coalesce(found, no)


#: Predicates on a node's own columns: (argument) -> Column. More can be registered.
PREDICATES: dict[str, Callable[[str], Column]] = {
    "returns": lambda x: (F.col("node_kind") == "function") & F.contains("return_type_debug", F.lit(x)),
    "implements": lambda x: F.exists("implements", lambda s: F.contains(s, F.lit(x))),
    "has_field": lambda x: F.array_contains("fields", F.lit(x)),
    "in_file": lambda x: F.contains(F.replace("file", F.lit("\\"), F.lit("/")), F.lit(x)),
}
PREDICATES |= {"hasfield": PREDICATES["has_field"], "infile": PREDICATES["in_file"]}


NEIGHBOURS = frozenset("handles catches calls called_by calledby".split())


def _neighbours(name: str, arg: str, nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Ids of the nodes for which a predicate on neighbours holds."""
    if name not in NEIGHBOURS:
        return None
    links = edges.where("src <> dst")
    ends = nodes.select(F.col("node_id").alias("n"), "name", "short_name")
    if name in ("handles", "catches"):
        return links.select(F.col("src").alias("node_id"))
    if name == "calls":
        hit = ends.where(F.contains("name", F.lit(arg)) | (F.col("short_name") == arg)).select("n")
        return links.join(hit, F.col("dst") == F.col("n"), "left_semi").select(F.col("src").alias("node_id"))
    if name in ("called_by", "calledby"):
        hit = ends.where(F.contains("name", F.lit(arg))).select("n")
        return links.join(hit, F.col("src") == F.col("n"), "left_semi").select(F.col("dst").alias("node_id"))
    return None


def candidates(query: Query, nodes: DataFrame) -> DataFrame:
    """Nodes of the query's target, without placeholders: what the query scans."""
    own = nodes if query.target == "all" else nodes.where(F.col("node_kind") == query.target)
    return own.where("NOT (node_kind = 'function' AND complexity IS NULL)")


def execute(text: str | Query, nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame], strict: bool = False) -> DataFrame:
    """The matching nodes. edges: resolved (src, dst), or what gives them, asked only if a condition looks at neighbours.
    Scalar conditions come first, then joins."""
    query = text if isinstance(text, Query) else parse(text, strict)
    out, joins = candidates(query, nodes), []
    for c in query.conditions:
        if c.op == "call":
            arg = c.value[0] if c.value else ""
            if c.field in NEIGHBOURS and callable(edges):
                edges = edges()
            if (ids := _neighbours(c.field, arg, nodes, edges)) is not None:
                joins.append((ids, "left_anti" if c.negated else "left_semi"))
                continue
            found = F.coalesce(PREDICATES[c.field](arg), F.lit(False)) if c.field in PREDICATES else F.lit(False)
        else:
            found = scalar(c.field, c.op, c.value)
        out = out.where(~found if c.negated else found)
    for ids, how in joins:
        out = out.join(ids, "node_id", how)
    return out


def described(matches: DataFrame) -> DataFrame:
    """node_id, file, start_line, name, kind, description: what a result shows."""
    vis = F.coalesce("visibility", F.lit("private"))
    function = F.concat(vis, F.lit(" fn("), F.size("params").cast("string"), F.lit(" params, complexity "), F.coalesce("complexity", F.lit(0)).cast("string"), F.lit(", "), F.when(F.col("is_async"), "async, ").otherwise(""), F.when(F.col("is_unsafe"), "unsafe").otherwise(""), F.lit(")"))
    data = F.concat("data_kind", F.lit(" with "), F.size("fields").cast("string"), F.lit(" fields, 0 methods"))
    binding = F.when(F.col("is_constant"), "const binding").otherwise("let binding (mut)")
    text = F.when(F.col("node_kind") == "function", function).when(F.col("node_kind") == "type", data).when(F.col("node_kind") == "binding", binding).otherwise(F.col("node_kind"))
    return matches.select("node_id", F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), "start_line", "name", kind_name().alias("kind"), text.alias("description"))
