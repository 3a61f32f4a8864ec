"""The operators of the graph on hand-made input."""

from codegraph_spark.operators import graph


def test_removed_file_takes_shared_ids_and_keeps_nodes_without_file(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None), (5, "c")], "node_id long, file string")
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 2), (3, 4), (4, 5), (4, 5), (5, 9)], "src long, dst long")
    left, kept = graph.without_file(nodes, edges, "a")
    assert sorted(r["node_id"] for r in left.collect()) == [2, 3, 4, 5]
    assert sorted(map(tuple, kept.collect())) == [(3, 4), (4, 5), (4, 5)]


def _best(nodes):
    """(placeholder, candidate) by a walk over all pairs."""
    found = {}
    for a, kind, short, file, _, complexity in nodes:
        if kind != "function" or complexity is not None:
            continue
        key = short.rsplit("." if "." in short else "::", 1)[-1]
        directory = lambda f: None if f is None else f.rsplit("/", 1)[0]
        offers = []
        for b, k, s, f, visibility, c in nodes:
            if (k != "function" or c is not None) and key and key in (s, s.rsplit("::", 1)[-1], s.rsplit(".", 1)[-1]):
                score = {"public": 10, "internal": 5}.get(visibility, 0) * (k == "function") + 20 * (file is not None and directory(f) == directory(file)) - 5 * ("test" in (f or ""))
                offers.append((-score, b))
        if offers:
            found[a] = min(offers)[1]
    return found


SCHEMA = "node_id long, node_kind string, short_name string, file string, visibility string, complexity int"


def test_links_are_the_best_of_all_pairs(spark):
    import random

    r = random.Random(5)
    nodes = [(k, r.choice(["function", "function", "type"]), r.choice(["", "x.", "m::", "x.m::"]) + r.choice("abc"), r.choice([None, "a/b.rs", "a/test_b.rs", "a/c/d.rs", "e.rs"]), r.choice(["public", "internal", "private", None]), r.choice([None, 3])) for k in range(400)]
    got = graph.linked(spark.createDataFrame(nodes, SCHEMA)).collect()
    assert len(got) == len({x["old_id"] for x in got})
    assert {x["old_id"]: x["new_id"] for x in got} == _best(nodes)


def test_links_of_a_frequent_name_make_no_pairs(spark):
    """2,000 placeholders and 2,000 candidates of one name: no operator of the plan may make pairs of them."""
    ids = spark.range(4_000)
    nodes = ids.selectExpr("id as node_id", "'function' as node_kind", "concat('f', id div 100000) as short_name", "concat('d', id % 3, '/x.rs') as file", "'public' as visibility", "case when id % 2 = 0 then 1 end as complexity")
    links = graph.linked(nodes)
    assert {tuple(x) for x in links.selectExpr("old_id % 3", "new_id").distinct().collect()} == {(0, 0), (1, 4), (2, 2)}
    links.collect()
    made, todo = [], [links._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        while plan.nodeName().startswith("AdaptiveSparkPlan") or "QueryStage" in plan.nodeName():
            plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.plan()
        if "Join" in plan.nodeName():
            made.append(plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert made and max(made) <= 4_000


def test_retargeting_keeps_each_edge_once(spark):
    nodes = spark.createDataFrame([(1, "function", "f", "a/x.rs", None, None), (2, "function", "f", "a/y.rs", None, 1), (2, "type", "f", "b/y.rs", None, None), (3, "function", "f", "b/x.rs", None, None)], SCHEMA)
    edges = spark.createDataFrame([(1, 3, "calls"), (1, 3, "calls"), (2, 1, "calls"), (4, 1, "calls")], "src long, dst long, edge_kind string")
    got = graph.retargeted(edges, graph.linked(nodes)).select("src", "dst").collect()
    assert sorted(map(tuple, got)) == [(2, 2), (2, 2), (2, 2), (4, 2)]


def test_link_stats_of_a_frequent_name(spark):
    from codegraph_spark.engine import linked

    nodes = spark.range(20_000).selectExpr("id as node_id", "'function' as node_kind", "concat('f', id div 19000) as short_name", "concat('f', id div 19000) as name", "concat('d', id % 3, '/x.rs') as file", "'public' as visibility", "case when id % 2 = 0 and id < 19000 then 1 end as complexity")
    edges = spark.range(20_000).selectExpr("0L as src", "id as dst", "'calls' as edge_kind")
    assert tuple(linked(nodes, edges)[2].first()) == (9_500, 1_000, 999, 10_499)


def test_calls_are_parsed_once_and_in_many_tasks(spark, small):
    from codegraph_spark.plans.queries import QUERIES
    from codegraph_spark.sources import frontends

    plan = QUERIES["index_calls"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "RoundRobinPartitioning(8)" in plan
    files = [("a.py", "def f():\n    return g(h.f())\n\ndef g(): f()\n"), ("b.rs", "fn f() { if x { m::g()?; } }"), ("c.ts", "function f(): void {}"), ("d.txt", "f()"), ("e.py", None)]
    got = frontends.calls_in(spark.createDataFrame(files, "path string, content string")).collect()
    want = []
    for path, text in files[:3]:
        graph = frontends.parse_file(path, text)
        names = {n["node_id"]: n["name"] for n in graph.nodes}
        want += [(path, names[e["src"]], names[e["dst"]], e["condition"], e["is_dynamic"], e["line"]) for e in graph.edges]
    assert len(want) >= 4 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_linking_and_resolving_sort_nothing(spark):
    """Linking takes minima that need no sorted rows, offers are gathered once, and edges are not sorted for their ends."""
    nodes = spark.createDataFrame([(1, "function", "f", "a/x.rs", None, None), (2, "function", "f", None, "public", 1), (3, "function", "f", "a/y.rs", "public", 1)], SCHEMA)
    links = graph.linked(nodes)
    assert [tuple(x) for x in links.collect()] == [(1, 3)]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ReusedExchange" in plan
    edges = spark.createDataFrame([(1, 2), (2, 9)], "src long, dst long")
    got = graph.resolved(edges, nodes)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString() and [tuple(x) for x in got.collect()] == [(1, 2)]


def test_link_stats_resolves_only_edges_that_it_counts(spark, small):
    from codegraph_spark.plans import queries

    at = queries.Lens(spark, small)
    ends = at.nodes.where("node_kind = 'function' and complexity is null").selectExpr("node_id as dst")
    few = sorted(map(tuple, at.edges_into(ends).select("src", "dst", "edge_kind").collect()))
    assert few and "edges" not in vars(at)
    assert few == sorted(map(tuple, at.edges.join(ends, "dst", "left_semi").select("src", "dst", "edge_kind").collect()))
    queries._LENSES.clear()
    row = queries.QUERIES["link_stats"](spark, small).first()
    assert "edges" not in vars(queries._at(spark, small)) and row["retargeted"] <= len(few)
