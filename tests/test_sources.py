"""The frontends, the index driver, snapshots and documents on small hand-made projects."""

import json

import pytest

from codegraph_spark.functions import types
from codegraph_spark.sources.frontends import FRONTENDS, Frontend, parse_file


def parsed(path, text):
    graph = parse_file(path, text)
    names = {n["node_id"]: n["name"] for n in graph.nodes}
    real = {n["name"]: n for n in graph.nodes if n["node_kind"] != "function" or n["complexity"] is not None}
    return graph, real, [(names[e["src"]], names[e["dst"]], e["condition"], e["is_dynamic"]) for e in graph.edges]


@pytest.mark.parametrize(
    "language, text, debug, display",
    [
        ("rust", "i32", "Resolved(Primitive(Int32))", "i32"),
        ("rust", "()", "Resolved(Unit)", "void"),
        ("rust", "Option<&str>", "Resolved(Optional(Resolved(Primitive(String))))", "string | null"),
        ("rust", "Vec<Vec<u8>>", "Resolved(Array(Resolved(Array(Resolved(Primitive(Uint8))))))", "u8[][]"),
        ("rust", "Result<T>", 'Unresolved("Result<T>")', "Result<T>"),
        ("rust", "Result<(), E>", 'Resolved(Result { ok: Resolved(Unit), err: Unresolved("E") })', "Result<void, E>"),
        ("rust", "HashMap<u8, bool>", "Resolved(Map { key: Resolved(Primitive(Uint8)), value: Resolved(Primitive(Bool)) })", "Map<u8, bool>"),
        ("typescript", "number", "Resolved(Primitive(Float64))", "f64"),
        ("typescript", "boolean[]", "Resolved(Array(Resolved(Primitive(Bool))))", "bool[]"),
        ("typescript", "number | undefined", "Resolved(Optional(Resolved(Primitive(Float64))))", "f64 | null"),
        ("typescript", "Promise<Map<string, any>>", "Resolved(Map { key: Resolved(Primitive(String)), value: Unknown })", "Map<string, unknown>"),
        ("typescript", "'a' | 'b' | 1", "Resolved(Union([Unresolved(\"'a'\"), Unresolved(\"'b'\"), Unresolved(\"1\")]))", "'a' | 'b' | 1"),
        ("python", "bytes", "Resolved(Primitive(Bytes))", "bytes"),
        ("python", "List[int]", "Resolved(Array(Resolved(Primitive(Int64))))", "i64[]"),
        ("python", "float | None", "Resolved(Optional(Resolved(Primitive(Float64))))", "f64 | null"),
        ("python", "Dict[str, Any]", "Resolved(Map { key: Resolved(Primitive(String)), value: Unknown })", "Map<string, unknown>"),
        ("python", "tuple[int, bool]", "Resolved(Tuple([Resolved(Primitive(Int64)), Resolved(Primitive(Bool))]))", "(i64, bool)"),
        ("python", None, "Unknown", "unknown"),
    ],
)
def test_types(language, text, debug, display):
    found = types.read(text, language)
    assert (types.debug(found), types.display(found)) == (debug, display)


def test_rust():
    graph, nodes, calls = parsed("a.rs", """
use std::{io, fmt as f};
use crate::b::*;
// fn not_there() {}
pub(crate) unsafe fn sum<T: Into<i64>>(xs: &[T], mut n: u32) -> Result<i64, String> where T: Copy {
    let s = "fn no() {";
    if n > 0 && xs.len() > 1 { other::<T>(xs)?; } else { loop { step(n) } }
    match n { 0 => a(), 1 => b(), _ => c(|x| x + 1) }
    vec![hidden(1)];
}
impl<'a> Shape for Box<'a> { fn area(&self) -> f32 { self.w.scale(2) } }
mod inner { pub const LIMIT: u8 = 3; static mut COUNT: u8 = 0; pub struct Deep { pub x: i8, y: Vec<u8> } }
""")
    f = nodes["sum"]
    assert (f["visibility"], f["is_unsafe"], f["is_async"], f["complexity"], f["start_line"]) == ("internal", True, False, 7, 5)
    assert [(p["name"], p["type_debug"]) for p in f["params"]] == [("xs", 'Unresolved("&[T]")'), ("n", "Resolved(Primitive(Uint32))")]
    assert f["return_type_display"] == "Result<i64, string>"
    assert calls == [("sum", "xs.len", "conditional", True), ("sum", "other::<T>", "fallible", False), ("sum", "step", "in_loop", False), ("sum", "a", "conditional", False), ("sum", "b", "conditional", False), ("sum", "c", "conditional", False), ("Box::area", "self.w.scale", None, True)]
    assert nodes["inner::LIMIT"]["is_constant"] and not nodes["inner::COUNT"]["is_constant"]
    assert [(x["name"], x["visibility"]) for x in nodes["inner::Deep"]["fields"]] == [("x", "public"), ("y", "private")]
    assert nodes["inner"]["node_kind"] == "module"
    assert graph.imports == [{"module": "std", "symbols": ["io", "fmt"], "wildcard": False}, {"module": "crate::b", "symbols": [], "wildcard": True}]
    assert graph.error is None and parse_file("b.rs", "fn a( {").error


def test_scripts():
    graph, nodes, calls = parsed("a.ts", """
import base, { one, two as deux } from "./lib";
import * as all from 'all';
export async function load(url: string, n = 3, ...rest: any[]): Promise<string[]> {
  for (const x of rest) { try { await get(x); } catch (e) { report(e); } }
  return n ? all.pick(url) : [];
}
const twice = (x: number) => x * 2, kept = 4;
export const LIMIT = 10;
export class Store extends Base implements Api<string> {
  private items: Map<string, number> = new Map();
  constructor(readonly name: string) { super(name); }
  protected async find(id?: string): Promise<void> { if (id || this.name) { this.items.get(id!); } }
}
export interface Api<T> { id: T; tags?: string[]
  size: number }
type Either = string | number;
enum Color { Red }
""")
    f = nodes["load"]
    assert (f["visibility"], f["is_async"], f["complexity"], f["return_type_display"]) == ("public", True, 4, "string[]")
    assert [(p["name"], p["has_default"]) for p in f["params"]] == [("url", False), ("n", True), ("rest", False)]
    assert (nodes["twice"]["node_kind"], nodes["twice"]["visibility"], nodes["LIMIT"]["node_kind"]) == ("function", "private", "binding")
    assert nodes["Store"]["implements"] == ['Unresolved("Base")', 'Unresolved("Api<string>")']
    assert (nodes["Store::find"]["visibility"], nodes["Store::items"]["visibility"], nodes["Store::find"]["complexity"]) == ("protected", "private", 3)
    assert [x["name"] for x in nodes["Api"]["fields"]] == ["id", "tags", "size"]
    assert {nodes[n]["data_kind"] for n in ("Store", "Api", "Either", "Color")} == {"Class", "Interface", "TypeAlias", "Enum"}
    assert ("load", "get", "fallible", False) in calls and ("load", "report", "error_path", False) in calls and ("load", "all.pick", "conditional", True) in calls
    assert ("Store::items", "Map", None, False) in calls
    assert [(i["module"], i["symbols"], i["wildcard"]) for i in graph.imports] == [("./lib", ["base", "one", "two"], False), ("all", ["all"], True)]


def test_python():
    graph, nodes, calls = parsed("a.py", """
from ..pkg import a, b as c
import os.path
from x import *

class Shop(Base, abc.ABC):
    @property
    def _total(self) -> float:
        return sum(p.cost for p in self.items() if p and p.cost and p.new)

    async def buy(self, item: "Item", *, count: int = 1, **more) -> dict[str, int] | None:
        while count:
            try:
                pay(item)
            except Error:
                self._total()
        match item:
            case 1: undo()
""")
    assert nodes["Shop"]["implements"] == ['Unresolved("Base")', 'Unresolved("abc.ABC")']
    f = nodes["Shop::buy"]
    assert (f["is_async"], f["complexity"], [p["name"] for p in f["params"]]) == (True, 4, ["item", "count", "more"])
    assert (nodes["Shop::_total"]["visibility"], nodes["Shop::_total"]["complexity"]) == ("private", 3)
    assert ("Shop::buy", "pay", "fallible", False) in calls and ("Shop::buy", "Shop::_total", "error_path", True) in calls and ("Shop::_total", "self.items", "in_loop", True) in calls
    assert [i["module"] for i in graph.imports] == ["..pkg", "os.path", "x"]
    broken = parse_file("b.py", "def ok():\n    fine()\n\ndef broken(:\n  x\n\n@d\ndef last():\n    ok()\n")
    assert [n["name"] for n in broken.nodes if n["complexity"]] == ["ok", "last"] and "line 4" in broken.error
    assert parse_file("a.txt", "x") is None


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_", "."), bytearray(v.encode())) for k, v in texts.items()], "path string, content binary")


def test_engine(spark, tmp_path):
    from codegraph_spark.engine import Engine
    from codegraph_spark.operators import index, report, snapshot

    one = Engine(spark).index(files(spark, src__a_py="def alpha(x: int) -> str:\n    return beta(x)\n", src__b_py="def beta(x):\n    return gamma(x) or lost()\n\ndef gamma(y):\n    lost()\n", skip_txt="x"))
    stats = one.stats.first().asDict()
    assert {k: stats[k] for k in ("files_analyzed", "files_removed", "nodes", "edges", "resolved", "unresolved", "merged", "retargeted")} == {"files_analyzed": 2, "files_removed": 0, "nodes": 4, "edges": 4, "resolved": 1, "unresolved": 1, "merged": 0, "retargeted": 1}
    assert {r["name"] for r in one.query("FIND functions WHERE calls(beta)").collect()} == {"alpha"}
    names = {r["node_id"]: r["name"] for r in one.nodes.collect()}
    got = {names[r["node_id"]]: (r["distance"], [names[k] for k in r["path"]]) for r in one.impact("a.py", "alpha").collect()}
    assert got == {"beta": (1, ["alpha", "beta"]), "gamma": (2, ["alpha", "beta", "gamma"]), "lost": (2, ["alpha", "beta", "lost"])}
    two = one.index(files(spark, src__a_py="def alpha(x: str, y) -> str:\n    return beta(x)\n", src__c_py="async def new(a):\n    pass\n", src__b_py="def beta(x):\n    return gamma(x) or lost()\n\ndef gamma(y):\n    lost()\n"))
    assert two.stats.select("files_analyzed", "files_removed").first() == (2, 0)
    v = two.verify(one)
    assert {(r["kind"], r["risk"], r["description"]) for r in v.changes.collect()} == {("SignatureChange", "Breaking", "'alpha': parameter count changed (1 → 2)"), ("FunctionAdded", "NeedsReview", "New function 'new'")}
    row = report.summary(v).first()
    assert (row["status"], row["risk_score"], row["confidence"], row["breaking"], row["warnings"]) == ("pass", 0.34, 0.85, 1, 1)
    document = json.loads(report.json_document(v).first()[0])
    assert document["summary"]["total_changes"] == 2 and len(document["semantic_changes"]) == 2 and {t["priority"] for t in document["suggested_tests"]} == {"High"}
    sarif = json.loads(report.sarif_document(v).first()[0])
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and {r["id"]: r["defaultConfiguration"]["level"] for r in run["tool"]["driver"]["rules"]} == {"codegraph/signaturechange": "error", "codegraph/functionadded": "warning", "codegraph/invariant-violation": "warning"}
    assert {r["locations"][0]["physicalLocation"]["region"]["startColumn"] for r in run["results"]} == {1}
    assert report.build_outputs(row)["output"] == "status=pass\nrisk-score=34\nchanges=2\n"
    assert (report.fails(row), report.fails(row, "warning"), report.fails(row, "never")) == (False, True, False)
    assert "New function 'new'" in report.verify_text(row, v.changes.collect(), v.tests.collect())
    one.snapshot().write(str(tmp_path / "snap"))
    before = snapshot.Snapshot.read(spark, str(tmp_path / "snap"))
    moved = snapshot.compared(before, two.snapshot())
    assert {(r["name"], r["change"]) for r in moved.functions.collect()} == {("alpha", "signature"), ("new", "added")}
    assert [r["file"] for r in moved.files.collect()] == ["src/c.py"] and not moved.empty()
    assert snapshot.compared(before, before).empty()
    assert snapshot.Snapshot.read(spark, str(tmp_path / "none")) is None
    three = two.index(files(spark, src__a_py="def alpha(x: str, y) -> str:\n    return beta(x)\n"))
    assert three.stats.select("files_analyzed", "files_removed", "nodes").first() == (0, 2, 2)
    assert index.put_objects(files(spark, a="x", b="x", c="y"), str(tmp_path / "store")).count() == 2
    assert index.put_objects(files(spark, a="x", d="z"), str(tmp_path / "store")).count() == 1
    assert [bytes(r["content"]) for r in index.get_objects(spark, str(tmp_path / "store"), index.hashed(files(spark, q="z", r="no"))).collect()] == [b"z"]


def test_registry_asks_the_first_frontend(spark):
    from codegraph_spark.engine import Engine
    from codegraph_spark.sources.records import FileGraph

    def parse(path, text):
        graph = FileGraph(path, "python")
        graph.function(["only"], 1, 1, visibility="public", complexity=1, params=[], returns=None)
        return graph.finish(True)

    engine = Engine(spark).register(Frontend("mine", ("py", "x"), parse))
    engine = engine.index(files(spark, a_py="def a(): pass", b_x="?", c_rs="fn c() {}"))
    assert sorted(r["name"] for r in engine.nodes.collect()) == ["c", "only", "only"]
    assert [f.name for f in FRONTENDS] == ["rust", "typescript", "python"]


def test_discovery_honours_ignore_files(spark, tmp_path):
    from codegraph_spark.operators.index import discover

    for path, text in {"a.py": "", "b.txt": "", ".hidden/c.py": "", "out/d.py": "", "src/e.py": "", "src/gen/f.py": "", "src/gen/keep.py": "", "lib/x_pb.py": "", "lib/__init__.py": "", "lib/sub/y.rs": "", ".gitignore": "/out/\n# no\n*_pb.py\n", "src/.gitignore": "gen/*\n!gen/keep.py\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(r["path"] for r in discover(spark, str(tmp_path), ("py", "rs")).collect()) == ["a.py", "lib/__init__.py", "lib/sub/y.rs", "src/e.py", "src/gen/keep.py"]


def test_git(spark, tmp_path):
    import subprocess

    from codegraph_spark.sources import git

    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("two")
    root = str(tmp_path)
    assert git.blob(root, "HEAD", "a.py") == b"one" and git.blob(root, "HEAD", "none") is None
    assert git.changed_files(root, "HEAD") == ["a.py"] and git.changed_files(root, staged=True) == [] and git.changed_files(root, "nowhere") == []
    assert git.first_changes(root) == (["a.py"], "HEAD")
    assert {(r["version"], bytes(r["content"])) for r in git.versions(spark, root, ["a.py", "gone"], "HEAD").collect()} == {("old", b"one"), ("new", b"two")}
    assert git.diff_base({"GITHUB_ACTIONS": "1", "GITHUB_BASE_REF": "main"}, False) == "origin/main"
    assert git.diff_base({"GITLAB_CI": "1", "CI_MERGE_REQUEST_DIFF_BASE_SHA": git.NO_COMMIT, "CI_COMMIT_BEFORE_SHA": "abc"}, False) == "abc"
    assert (git.diff_base({}, True), git.diff_base({}, False), git.diff_base({"GITHUB_ACTIONS": "1"}, True)) == ("HEAD", "HEAD~1", "HEAD~1")


def test_tooling():
    from codegraph_spark.operators.snapshot import tooling

    assert tooling({"tsconfig.json", ".pylintrc"}, {"vue-tsc", "jest"}) == {"type_check": "npx vue-tsc --noEmit", "linter": "python -m pylint", "formatter": None, "test_runner": "npx jest"}
    assert tooling({"pyproject.toml", "ruff.toml", "Cargo.toml"}, {"prettier"}) == {"type_check": None, "linter": "ruff check", "formatter": "npx prettier --write", "test_runner": "cargo test"}
    assert tooling(set(), set()) == dict.fromkeys(("type_check", "linter", "formatter", "test_runner"))


def test_graph_edits_and_syntax(spark):
    from codegraph_spark.operators import checks, graph

    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "node_id long, name string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    left, kept = graph.without_node(nodes, edges, 2)
    assert (left.count(), [tuple(r) for r in kept.collect()]) == (2, [(1, 3)])
    assert {tuple(r) for r in graph.with_nodes(nodes, spark.createDataFrame([(3, "d"), (4, "e")], nodes.schema)).collect()} == {(1, "a"), (2, "b"), (3, "d"), (4, "e")}
    rows = [("a.py", "if x:\n \ty(", None), ("b.rs", "(", "broken"), ("c.vue", "<p><b></p>", None), ("d.txt", "(", None)]
    found = checks.syntax(spark.createDataFrame(rows, "path string, text string, error string"), ("py", "rs"))
    assert {(r["path"], r["line"], r["message"].split(" at ")[0]) for r in found.collect()} == {("a.py", 2, "Unclosed '('"), ("a.py", 2, "Mixed tabs and spaces in indentation"), ("b.rs", 0, "Parse error: broken"), ("c.vue", 1, "Unclosed <b>")}
