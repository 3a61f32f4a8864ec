"""Every query of the engine against its SQL twin in DuckDB."""

import collections
import math

import pytest

from codegraph_spark.plans.queries import ORACLES, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v.item() if hasattr(v, "item") else v
    return list(frame.columns), collections.Counter(tuple(map(clean, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, duck, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_risk_of_every_node(spark, monkeypatch):
    from types import SimpleNamespace

    from codegraph_spark.plans import queries

    edges = [(1, 2), (1, 2), (2, 3), (3, 4), (4, 1), (5, 5), (6, 1), (6, 2), (250, 1), (7, 999)]
    nodes = [1, 2, 3, 4, 5, 6, 7, 8, 250]
    tables = SimpleNamespace(nodes=spark.createDataFrame([(n,) for n in nodes], "node_id long"), edges=spark.createDataFrame(edges, "src long, dst long"))
    monkeypatch.setattr(queries, "Lens", lambda *_: tables)
    want = {}
    for n in nodes:
        near = {b for a, b in edges if a == n}
        near = (near | {b for a, b in edges if a in near}) - {n}
        want[n] = (len(near), round(min(math.log(len(near)) / 10, 1.0), 6) if near else 0.0)
    got = QUERIES["impact_risk_all"](spark, "").collect()
    assert len(got) == len(nodes)
    assert {r["root"]: (r["affected"], r["risk"]) for r in got} == want


def test_entry_imports_and_names_all_queries(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_bracket_findings():
    """Against a walk character by character; the messages tell both places."""
    import random

    from codegraph_spark.operators.checks import PAIRS, bracket_findings

    def walked(text):
        stack, found, line, col, quote, comment, escaped = [], [], 1, 0, None, None, False
        k = 0
        while k < len(text):
            c, two, col = text[k], text[k : k + 2], col + 1
            if c == "\n":
                line, col, comment = line + 1, 0, None if comment == "line" else comment
            elif comment == "line":
                pass
            elif comment == "block":
                if two == "*/":
                    comment, k, col = None, k + 1, col + 1
            elif quote:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == quote:
                    quote = None
            elif two in ("//", "/*"):
                comment, k, col = "line" if two == "//" else "block", k + 1, col + 1
            elif c == "#":
                comment = "line"
            elif c in "'\"`":
                quote = c
            elif c in PAIRS.values():
                stack.append((c, line, col))
            elif c in PAIRS:
                top = stack.pop() if stack else None
                if top is None or top[0] != PAIRS[c]:
                    found.append((line, col))
            k += 1
        return found + [(a, b) for _, a, b in stack]

    assert list(bracket_findings("f(a[1]) // )\n{'}'}")) == []
    assert list(bracket_findings("(]")) == [(1, 2, "error", "Mismatched bracket: ']' at line 1 closes '(' from line 1:1")]
    assert [f[:2] for f in bracket_findings("x)\n(")] == [(1, 2), (2, 1)]
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("()[]{}'\"`/*#\\\nab") for _ in range(r.randint(0, 24)))
        assert [f[:2] for f in bracket_findings(text)] == walked(text), text


def test_indentation(spark):
    from codegraph_spark.operators.checks import indentation

    files = [("a.py", "if x:\n \ty\n  z\n\t \t\n"), ("b.py", "\ta\n  b"), ("c.py", "  a\n \t \n"), ("d.py", None)]
    got = {(r["path"], r["line"], r["col"], r["severity"]) for r in indentation(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {("a.py", 2, 1, "error"), ("a.py", 0, 0, "warning"), ("b.py", 0, 0, "warning")}


def test_readers_of_tools(spark):
    from codegraph_spark.operators import checks

    lines = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    found = checks.tsc(lines("src\\a.ts(4,5): error TS1: bad (x): y", "b.ts(x,2): info z", "no place"))
    assert [tuple(r) for r in found.collect()] == [("src/a.ts", 4, 5, "error", "error TS1: bad (x): y"), ("b.ts", 0, 2, "warning", "info z")]
    assert [tuple(r) for r in checks.pylint(lines("a\\b.py:4:2: E1: oh: no", "a:b")).collect()] == [("a/b.py", 4, 2, "warning", "E1: oh: no")]
    report = '[{"filePath": "a.js", "messages": [{"line": 1, "column": 3, "severity": 2, "message": "m", "ruleId": "r"}, {"severity": 0}, {"severity": 1}]}]'
    assert [tuple(r) for r in checks.eslint(spark.createDataFrame([(report,)], "json string")).collect()] == [("a.js", 1, 3, "error", "m (r)"), ("a.js", 0, 0, "warning", " ()")]
    compiled = spark.createDataFrame([("a.py", '  File "a.py", line 3'), ("a.py", "SyntaxError: bad on line 3 ")], "file string, text string")
    assert [tuple(r) for r in checks.py_compile(compiled).collect()] == [("a.py", 3, 0, "error", "SyntaxError: bad on line 3")]
    out = ["E   Lost: x", "FAILED t/a.py::T::test_a - boom", "E   ValueError: bad: worse", "t/a.py:42: in test_a", "FAILED t/b.py", "E   plain", "E   other"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(out)], "run int, no int, text string")
    got = {tuple(r) for r in checks.test_failures(rows).collect()}
    assert got == {(1, "T::test_a", "t/a.py", 42, "ValueError", "bad: worse"), (1, "", "t/b.py", None, "TestFailure", "plain")}


def test_tags_and_attributes(spark):
    from codegraph_spark.operators import checks

    found = lambda t: [f[0::3] for f in checks.tag_findings(t)]
    assert found("<div><p></div>") == [(1, "Unclosed <p>")]
    assert found("<template><br><a/></template>") == []
    assert found("<!DOCTYPE html><div>\n</p><ul><li>x</ul>\n<b>\n<ul><li></ul>") == [(2, "Unclosed <li>"), (4, "Unclosed <li>")]
    assert found('<div class="a">\n<span>\n</DIV>') == [(2, "Unclosed <span>")]
    files = spark.createDataFrame([("a.vue", '<b / x>\n // <a / b>\n<i ="x">\n="y"\na / b')], "path string, text string")
    assert {tuple(r)[:3] for r in checks.html_attributes(files).collect()} == {("a.vue", 1, 4), ("a.vue", 3, 0), ("a.vue", 4, 0)}


def test_words_that_are_numbers(spark):
    from codegraph_spark.plans.language import execute

    rows = [(1, "function", "m::inf", "inf", 5), (2, "function", "x", "x", 3)]
    nodes = spark.createDataFrame(rows, "node_id long, node_kind string, name string, short_name string, complexity int")
    ids = lambda text: [r["node_id"] for r in execute(text, nodes, None).collect()]
    assert ids("FIND functions WHERE name = inf") == [1]
    assert ids("FIND functions WHERE complexity < inf") == [1, 2]


def test_imports_of_scripts_and_rust(spark):
    from codegraph_spark.operators.index import imports

    files = [("a.ts", "typescript", "import { x } from \"./y\";\nconst z = require('q')\nlet a = 1"), ("b.rs", "rust", "use std::io;\nuse self::x;\nuse super::y;\n  use a::{b, c};"), ("c.txt", "other", "import a"), ("d.py", "python", None)]
    found = imports(spark.createDataFrame(files, "path string, language string, text string")).collect()
    assert sorted(map(tuple, found)) == [("a.ts", "./y"), ("a.ts", "q"), ("b.rs", "a::{b, c}"), ("b.rs", "std::io")]


def test_cargo_lines_without_span_or_json(spark):
    from codegraph_spark.operators.checks import cargo

    lines = ["no json", '{"reason": "build-finished"}', '{"reason": "compiler-message", "message": {"level": "error", "message": "m", "spans": []}}', '{"reason": "compiler-message", "message": {"level": "note", "message": "n"}}', None]
    assert [tuple(r) for r in cargo(spark.createDataFrame([(x,) for x in lines], "text string")).collect()] == [("", 0, 0, "error", "m")]
