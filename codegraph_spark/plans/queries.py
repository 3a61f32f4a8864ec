"""The engine's queries over the lens tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..engine import Engine, link_stats as counted, link_tables
from ..operators import changes, checks, conventions, graph, index, report, rollup, snapshot
from ..operators.storage import cut
from ..sources import frontends
from . import lens
from .language import QueryError, candidates, described, execute, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None, newer: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = "WITH RECURSIVE " + lens.LENS_SQL + (", " + lens.NEW_SQL if newer else "") + " " + sql
        return f

    return register


class Lens:
    """Frames of a scale factor, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def nodes(self) -> DataFrame:
        return lens.nodes(self.spark, self.dir)

    @cached_property
    def functions(self) -> DataFrame:
        return lens.functions(self.spark, self.dir)

    @cached_property
    def newer(self) -> DataFrame:
        return lens.new_functions(self.spark, self.dir)

    @cached_property
    def raw_edges(self) -> DataFrame:
        return lens.raw_edges(self.spark, self.dir)

    @cached_property
    def edges(self) -> DataFrame:
        """The graph's resolved edges: resolved once and kept, as an index is."""
        return cut(graph.resolved(self.raw_edges, self.nodes))

    def edges_into(self, ends: DataFrame) -> DataFrame:
        """The resolved edges that end in ends (dst); without the others, where these have not been resolved yet."""
        if "edges" in self.__dict__:
            return self.edges.join(ends, "dst", "left_semi")
        return graph.resolved(lens.raw_edges(self.spark, self.dir, ends), self.nodes)

    @cached_property
    def found(self) -> DataFrame:
        """The findings of the version diff."""
        return changes.semantic_diff(self.functions, self.newer)

    def table(self, name: str) -> DataFrame:
        return lens.table(self.spark, self.dir, name)


_LENSES: dict[tuple, Lens] = {}


def _at(spark: SparkSession, sf_dir: str) -> Lens:
    key = spark.sparkContext.applicationId, id(spark), sf_dir
    if key not in _LENSES:
        _LENSES[key] = Lens(spark, sf_dir)
    return _LENSES[key]


# --- the query language -------------------------------------------------------------------------------------------

_LIVE = "NOT (node_kind = 'function' AND complexity IS NULL)"
_VIS = "coalesce(visibility, 'private')"
_CALLS = "node_id IN (SELECT src FROM edges JOIN nodes d ON d.node_id = dst WHERE src <> dst AND (contains(d.name, '{0}') OR d.short_name = '{0}'))"
_CALLED = "node_id IN (SELECT dst FROM edges JOIN nodes s ON s.node_id = src WHERE src <> dst AND contains(s.name, '{0}'))"
_GLOB_PART = "(strpos(name, 'Brand#1') = 1 AND strpos(substr(name, 8), '_') > 0)"

#: Query texts by key, with the SQL condition of the same meaning.
FIND = {
    "find_functions": ("FIND functions", "node_kind = 'function'"),
    "find_types": ("FIND types", "node_kind = 'type'"),
    "find_modules": ("FIND modules", "node_kind = 'module'"),
    "find_bindings": ("FIND bindings", "node_kind = 'binding'"),
    "find_all": ("FIND all", "true"),
    "skip_placeholders": ("FIND fns WHERE complexity <= 3", "node_kind = 'function' AND complexity <= 3"),
    "and_conditions": ("FIND functions WHERE complexity > 10 AND visibility = public", "node_kind = 'function' AND complexity > 10 AND visibility = 'public'"),
    "not_condition": ("FIND all WHERE NOT complexity > 5", "NOT (node_kind = 'function' AND coalesce(complexity, 0) > 5)"),
    "not_not_condition": ("FIND all WHERE NOT NOT complexity > 45", "node_kind = 'function' AND complexity > 45"),
    "or_is_ignored": ("FIND functions WHERE complexity > 48 OR async = true", "node_kind = 'function' AND complexity > 48"),
    "name_eq": ("FIND all WHERE name = init_97", "name = 'init_97' OR short_name = 'init_97'"),
    "name_ne": ("FIND types WHERE name != 'Supplier#000000001'", "node_kind = 'type' AND NOT (name = 'Supplier#000000001' OR short_name = 'Supplier#000000001')"),
    "visibility_eq": ("FIND all WHERE vis = Private", f"{_VIS} = 'private'"),
    "complexity_cmp": ("FIND functions WHERE complexity >= 20 AND complexity < 30", "node_kind = 'function' AND complexity >= 20 AND complexity < 30"),
    "param_count_cmp": ("FIND functions WHERE param_count > 4", "node_kind = 'function' AND len(params) > 4"),
    "field_count_cmp": ("FIND types WHERE fields > 5", "node_kind = 'type' AND len(fields) > 5"),
    "async_eq": ("FIND functions WHERE async = true", "node_kind = 'function' AND is_async"),
    "async_word": ("FIND functions WHERE async = yes", "node_kind = 'function' AND NOT is_async"),
    "unsafe_eq": ("FIND functions WHERE unsafe = true", "node_kind = 'function' AND is_unsafe"),
    "unsafe_word_ne": ("FIND functions WHERE unsafe != yes", "false"),
    "file_suffix": ("FIND functions WHERE file = '_7.ts'", "node_kind = 'function' AND file LIKE '%\\_7.ts' ESCAPE '\\'"),
    "kind_eq": ("FIND types WHERE kind = INTERFACE", "node_kind = 'type' AND lower(data_kind) = 'interface'"),
    "num_eq_epsilon": ("FIND functions WHERE complexity = 7", "node_kind = 'function' AND complexity = 7"),
    "nan_is_false": ("FIND functions WHERE complexity > nan", "false"),
    "glob_name": ("FIND functions WHERE name ~ 'Brand#1*_*'", f"node_kind = 'function' AND {_GLOB_PART}"),
    "glob_file": ("FIND functions WHERE file ~ 'src/*.rs'", "node_kind = 'function' AND file LIKE 'src/%.rs'"),
    "glob_contains": ("FIND functions WHERE name ~ 'init_'", "node_kind = 'function' AND contains(name, 'init_')"),
    "pred_calls": ("FIND functions WHERE calls(init_97)", "node_kind = 'function' AND " + _CALLS.format("init_97")),
    "pred_not_calls": ("FIND functions WHERE NOT calls(Supplier)", "node_kind = 'function' AND NOT " + _CALLS.format("Supplier")),
    "pred_called_by": ("FIND all WHERE called_by(EUROPE)", _CALLED.format("EUROPE")),
    "pred_handles": ("FIND functions WHERE handles(Error)", "node_kind = 'function' AND node_id IN (SELECT src FROM edges WHERE src <> dst)"),
    "pred_returns": ("FIND functions WHERE returns(Result)", "node_kind = 'function' AND contains(return_type_debug, 'Result')"),
    "pred_implements": ("FIND types WHERE implements(AN)", "node_kind = 'type' AND contains(implements[1], 'AN')"),
    "pred_has_field": ("FIND types WHERE has_field(f6)", "node_kind = 'type' AND list_contains(fields, 'f6')"),
    "pred_in_file": ("FIND all WHERE in_file(consts/c_1)", "contains(file, 'consts/c_1')"),
    "pred_unknown": ("FIND modules WHERE NOT no_such(x)", "node_kind = 'module'"),
}


def _finder(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _at(spark, sf_dir)
        return execute(text, at.nodes, lambda: at.edges).select("node_id", "name", "file")

    return run


for _name, (_text, _where) in FIND.items():
    _query(_name, f"SELECT node_id, name, file FROM nodes WHERE {_LIVE} AND ({_where})")(_finder(_text))


@_query("match_projection", f"""SELECT node_id, file, start_line, name, CASE WHEN node_kind = 'type' THEN lower(data_kind) ELSE node_kind END AS kind,
  CASE node_kind WHEN 'function' THEN concat(visibility, ' fn(', len(params), ' params, complexity ', complexity, ', ', CASE WHEN is_async THEN 'async, ' ELSE '' END, CASE WHEN is_unsafe THEN 'unsafe' ELSE '' END, ')')
    WHEN 'type' THEN concat(data_kind, ' with ', len(fields), ' fields, 0 methods') WHEN 'binding' THEN CASE WHEN is_constant THEN 'const binding' ELSE 'let binding (mut)' END ELSE node_kind END AS description
  FROM nodes WHERE {_LIVE}""")
def match_projection(spark, sf_dir):
    at = _at(spark, sf_dir)
    return described(execute("FIND all", at.nodes, lambda: at.edges))


@_query("total_scanned", f"SELECT count(*) AS total_scanned, count(*) FILTER (WHERE complexity > 10) AS matches FROM nodes WHERE node_kind = 'function' AND {_LIVE}")
def total_scanned(spark, sf_dir):
    at, query = _at(spark, sf_dir), parse("FIND functions WHERE complexity > 10")
    scanned = candidates(query, at.nodes).agg(F.count("*").alias("total_scanned"))
    return scanned.crossJoin(execute(query, at.nodes, lambda: at.edges).agg(F.count("*").alias("matches")))  # one row each


# --- graph --------------------------------------------------------------------------------------------------------


@_query("graph_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, sf_dir):
    at = _at(spark, sf_dir)
    return at.nodes.agg(F.count("*").alias("nodes")).crossJoin(at.edges.agg(F.count("*").alias("edges")))  # one row each


@_query("edges_resolved", "SELECT src, dst, edge_kind FROM edges")
def edges_resolved(spark, sf_dir):
    return _at(spark, sf_dir).edges


@_query("nodes_in_file", "SELECT node_id, name FROM nodes WHERE file = 'src/types/t_3.ts'")
def nodes_in_file(spark, sf_dir):
    return _at(spark, sf_dir).nodes.where("file = 'src/types/t_3.ts'").select("node_id", "name")


@_query("find_by_short_name", "SELECT node_id, name FROM nodes WHERE short_name = 'FRANCE'")
def find_by_short_name(spark, sf_dir):
    return _at(spark, sf_dir).nodes.where("short_name = 'FRANCE'").select("node_id", "name")


@_query("qualified_name", "SELECT node_id, name, string_split(name, '::')[-1] AS last_segment FROM nodes")
def qualified_name(spark, sf_dir):
    return _at(spark, sf_dir).nodes.select("node_id", "name", F.element_at(F.split("name", "::"), -1).alias("last_segment"))


_KEY = "CASE WHEN contains(short_name, '.') AND string_split(short_name, '.')[-1] <> '' THEN string_split(short_name, '.')[-1] WHEN contains(short_name, '::') AND string_split(short_name, '::')[-1] <> '' THEN string_split(short_name, '::')[-1] ELSE short_name END"
_LINKS = f"""links AS (
  SELECT old_id, new_id FROM (
    SELECT a.node_id AS old_id, b.node_id AS new_id, row_number() OVER (PARTITION BY a.node_id ORDER BY
      CASE WHEN b.node_kind = 'function' AND b.visibility = 'public' THEN 10 WHEN b.node_kind = 'function' AND b.visibility = 'internal' THEN 5 ELSE 0 END
      + CASE WHEN regexp_replace(a.file, '/[^/]*$', '') = regexp_replace(b.file, '/[^/]*$', '') THEN 20 ELSE 0 END - CASE WHEN contains(b.file, 'test') THEN 5 ELSE 0 END DESC, b.node_id) AS r
    FROM (SELECT *, {_KEY} AS key FROM nodes WHERE node_kind = 'function' AND complexity IS NULL) a
    JOIN nodes b ON {_LIVE.replace("node_kind", "b.node_kind").replace("complexity", "b.complexity")} AND a.key <> '' AND a.key IN (b.short_name, string_split(b.short_name, '::')[-1], string_split(b.short_name, '.')[-1])
  ) WHERE r = 1),
loose AS (SELECT * FROM nodes WHERE node_kind = 'function' AND complexity IS NULL AND node_id NOT IN (SELECT old_id FROM links)),
merged AS (SELECT node_id AS old_id, least_id AS new_id FROM (SELECT *, min(node_id) OVER (PARTITION BY name) AS least_id FROM loose) WHERE node_id <> least_id)"""


@_query("linker_short_names", f"SELECT node_id, {_KEY} AS key FROM nodes")
def linker_short_names(spark, sf_dir):
    return _at(spark, sf_dir).nodes.select("node_id", graph.link_key().alias("key"))


@_query("linker_resolve", f", {_LINKS} SELECT old_id, new_id FROM links")
def linker_resolve(spark, sf_dir):
    return graph.linked(_at(spark, sf_dir).nodes)


@_query("linker_unresolved", f", {_LINKS} SELECT node_id, name FROM loose")
def linker_unresolved(spark, sf_dir):
    nodes = _at(spark, sf_dir).nodes
    return graph.unresolved(nodes, graph.linked(nodes)).select("node_id", "name")


@_query("linker_merge_duplicates", f", {_LINKS} SELECT old_id, new_id FROM merged")
def linker_merge_duplicates(spark, sf_dir):
    nodes = _at(spark, sf_dir).nodes
    return graph.merged_duplicates(graph.unresolved(nodes, graph.linked(nodes)))


@_query("link_stats", f", {_LINKS} SELECT (SELECT count(*) FROM links) AS resolved, (SELECT count(*) FROM loose) AS unresolved, (SELECT count(*) FROM merged) AS merged, (SELECT count(*) FROM edges WHERE dst IN (SELECT old_id FROM links UNION ALL SELECT old_id FROM merged)) AS retargeted")
def link_stats(spark, sf_dir):
    at = _at(spark, sf_dir)
    links, loose, merged = link_tables(at.nodes)
    ends = links.unionByName(merged).select(F.col("old_id").alias("dst"))
    return counted(links, loose, merged, at.edges_into(ends))


@_query("retarget_edges", f", {_LINKS} SELECT coalesce(s.new_id, src) AS src, coalesce(d.new_id, dst) AS dst, edge_kind FROM edges LEFT JOIN links s ON s.old_id = src LEFT JOIN links d ON d.old_id = dst")
def retarget_edges(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.retargeted(at.edges, graph.linked(at.nodes))


@_query("remove_file", "SELECT src, dst FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE file = 'src/types/t_3.ts') AND dst NOT IN (SELECT node_id FROM nodes WHERE file = 'src/types/t_3.ts')")
def remove_file(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.without_file(at.nodes, at.edges, "src/types/t_3.ts")[1].select("src", "dst")


@_query("find_file_suffix", "SELECT node_id, file FROM nodes WHERE file = (SELECT min(file) FROM nodes WHERE file LIKE '%mod_7.rs')")
def find_file_suffix(spark, sf_dir):
    return graph.file_by_suffix(_at(spark, sf_dir).nodes, "mod_7.rs").select("node_id", "file")


@_query("find_target", "SELECT node_id, name FROM nodes WHERE file = 'src/types/t_3.ts' ORDER BY start_line, node_id LIMIT 1")
def find_target(spark, sf_dir):
    return graph.find_target(_at(spark, sf_dir).nodes, "src/types/t_3.ts").select("node_id", "name")


def _bfs(start: str, a: str, b: str, depth: int) -> str:
    return f"""reached AS (
  SELECT node_id AS root, node_id, 0 AS distance FROM nodes WHERE {start}
  UNION SELECT root, {b}, distance + 1 FROM reached JOIN edges ON {a} = reached.node_id WHERE distance < {depth}),
near AS (SELECT root, node_id, min(distance) AS distance FROM reached GROUP BY root, node_id HAVING min(distance) > 0)"""


_ROOT = "node_id = 1000492"
_BACK = "node_id = 2000005"


def _root(at: Lens, root: int = 1_000_492) -> DataFrame:
    return at.nodes.where(F.col("node_id") == root).select(F.col("node_id").alias("root"))


@_query("impact_forward_d3", f", {_bfs(_ROOT, 'src', 'dst', 3)} SELECT node_id, distance, round(1.0::DOUBLE / distance, 6) AS confidence FROM near")
def impact_forward_d3(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.impact(at.edges, _root(at), 3).select("node_id", "distance", F.expr("round(1.0D / nullif(distance, 0), 6)").alias("confidence"))


@_query("impact_reverse_d3", f", {_bfs(_BACK, 'dst', 'src', 3)} SELECT node_id, distance FROM near")
def impact_reverse_d3(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.impact(at.edges, _root(at, 2_000_005), 3, reverse=True).select("node_id", "distance")


@_query("impact_risk", f", {_bfs('node_id % 250 = 0', 'src', 'dst', 2)} SELECT root, count(*) AS affected, round(least(ln(count(*)) / 10, 1.0), 6) AS risk FROM near GROUP BY root")
def impact_risk(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.impact_risk(graph.impact(at.edges, at.nodes.where("node_id % 250 = 0").select(F.col("node_id").alias("root")), 2))


@_query("impact_risk_all")
def impact_risk_all(spark, sf_dir):
    at = _at(spark, sf_dir)
    roots = at.nodes.select(F.col("node_id").alias("root"))
    found = graph.impact_risk(graph.impact(at.edges, roots, 2))
    return roots.distinct().join(found, "root", "left").fillna(0, ["affected", "risk"])


@_query("impact_top15", f", {_bfs(_ROOT, 'src', 'dst', 3)} SELECT node_id, distance FROM near ORDER BY distance, node_id LIMIT 15")
def impact_top15(spark, sf_dir):
    return impact_forward_d3(spark, sf_dir).select("node_id", "distance").orderBy("distance", "node_id").limit(15)


@_query("impact_blast_radius", f", {_bfs(_ROOT, 'src', 'dst', 5)}, {_bfs(_ROOT, 'dst', 'src', 5).replace('reached', 'behind').replace('near AS', 'back AS')} SELECT (SELECT count(*) FROM near) AS forward, (SELECT count(*) FROM back) AS backward, (SELECT count(*) FROM near) + (SELECT count(*) FROM back) AS total")
def impact_blast_radius(spark, sf_dir):
    at = _at(spark, sf_dir)
    one = lambda reverse, name: graph.impact(at.edges, _root(at), 5, reverse).agg(F.count("*").alias(name))
    return one(False, "forward").crossJoin(one(True, "backward")).withColumn("total", F.col("forward") + F.col("backward"))  # one row each


_TEST = "(lower(x) LIKE 'test%' OR contains(lower(x), '::test'))"
_CROSS = f"SELECT a.file AS from_file, b.file AS to_file, a.name AS caller, b.name AS callee FROM (SELECT DISTINCT src, dst FROM edges) JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE b.node_kind = 'function' AND b.complexity IS NOT NULL AND a.file <> b.file AND NOT {_TEST.replace('x', 'a.name')}"


@_query("cross_file_deps", _CROSS)
def cross_file_deps(spark, sf_dir):
    at = _at(spark, sf_dir)
    return graph.cross_file(at.nodes, at.edges)


# --- roll-ups -----------------------------------------------------------------------------------------------------

_EXT = "string_split(file, '.')[-1]"


def _language(table: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_EXT} = '{ext}' THEN '{name}'" for ext, name in table.items()) + f" ELSE '{other}' END"


@_query("project_overview", f"SELECT count(*) FILTER (WHERE node_kind = 'function') AS functions, count(*) FILTER (WHERE node_kind = 'type') AS types, count(DISTINCT file) AS files, count(DISTINCT {_language(names.LANGUAGES, 'other')}) AS languages FROM nodes WHERE {_LIVE}")
def project_overview(spark, sf_dir):
    return rollup.overview(_at(spark, sf_dir).nodes)


@_query("language_breakdown", f"SELECT {_language(names.STATUS_LANGUAGES, 'Other')} AS language, count(*) AS nodes FROM nodes WHERE {_LIVE} GROUP BY 1")
def language_breakdown(spark, sf_dir):
    return rollup.languages(_at(spark, sf_dir).nodes)


@_query("status_counts", f"SELECT count(*) FILTER (WHERE f) AS functions, count(*) FILTER (WHERE f AND visibility = 'public') AS public_functions, count(*) FILTER (WHERE f AND is_async) AS async_functions, count(*) FILTER (WHERE node_kind = 'type') AS types, count(*) FILTER (WHERE node_kind = 'module') AS modules FROM (SELECT *, node_kind = 'function' AND complexity IS NOT NULL AS f FROM nodes)")
def status_counts(spark, sf_dir):
    return rollup.status(_at(spark, sf_dir).nodes)


@_query("file_map", f"SELECT file, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE node_kind = 'function'), '') AS functions, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE node_kind = 'type'), '') AS types FROM nodes WHERE node_kind IN ('function', 'type') AND {_LIVE} GROUP BY file")
def file_map(spark, sf_dir):
    return rollup.file_map(_at(spark, sf_dir).nodes)


@_query("calls_list", f"SELECT src AS node_id, string_agg(DISTINCT name, ',' ORDER BY name) AS calls FROM edges JOIN nodes ON nodes.node_id = dst WHERE src <> dst AND {_LIVE} AND src IN (SELECT node_id FROM nodes WHERE node_kind = 'function' AND complexity IS NOT NULL) GROUP BY src")
def calls_list(spark, sf_dir):
    at = _at(spark, sf_dir)
    return rollup.callees(at.nodes, at.edges)


@_query("called_by_list", f"SELECT dst AS node_id, string_agg(DISTINCT name, ',' ORDER BY name) AS called_by FROM edges JOIN nodes ON nodes.node_id = src WHERE src <> dst AND {_LIVE} AND dst IN (SELECT node_id FROM nodes WHERE node_kind = 'function' AND complexity IS NOT NULL) AND NOT {_TEST.replace('x', 'name')} GROUP BY dst")
def called_by_list(spark, sf_dir):
    at = _at(spark, sf_dir)
    return rollup.callers(at.nodes, at.edges)


_HOT = """hot AS (SELECT node_id, 'complexity' AS reason, CAST(complexity AS BIGINT) AS value FROM nodes WHERE node_kind = 'function' AND complexity > 15
  UNION ALL SELECT n.node_id, 'callers', count(DISTINCT src) FROM nodes n JOIN edges ON dst = n.node_id AND src <> dst WHERE node_kind = 'function' AND complexity IS NOT NULL AND visibility = 'public' GROUP BY n.node_id HAVING count(DISTINCT src) > 5)"""


@_query("hotspots", f", {_HOT} SELECT * FROM hot")
def hotspots(spark, sf_dir):
    at = _at(spark, sf_dir)
    return rollup.hotspots(at.nodes, at.edges)


@_query("health_snapshot", f", {_HOT} SELECT 100 - least(count(*) * 3, 30) AS health FROM hot")
def health_snapshot(spark, sf_dir):
    at = _at(spark, sf_dir)
    return rollup.health(at.nodes, at.edges)


def _top_sql(by: str, above: int) -> str:
    return f"SELECT node_id, name, CAST({by} AS BIGINT) AS value FROM nodes WHERE node_kind = 'function' AND complexity IS NOT NULL AND {by} > {above} ORDER BY {by} DESC, file, start_line, node_id LIMIT 5"


_HEALTH = "SELECT 100 - least(count(*) FILTER (WHERE complexity > 15) * 3, 30){more} AS health FROM nodes WHERE node_kind = 'function' AND complexity IS NOT NULL"


@_query("health_manifest", _HEALTH.format(more=""))
def health_manifest(spark, sf_dir):
    return rollup.health_by_nodes(_at(spark, sf_dir).nodes)


@_query("health_status", _HEALTH.format(more=" - least(count(*) FILTER (WHERE len(params) > 4) * 2, 15)"))
def health_status(spark, sf_dir):
    return rollup.health_by_nodes(_at(spark, sf_dir).nodes, wide=True)


@_query("top_complexity", _top_sql("complexity", 15))
def top_complexity(spark, sf_dir):
    return rollup.top(_at(spark, sf_dir).nodes, F.col("complexity"), 15)


@_query("top_params", _top_sql("len(params)", 4))
def top_params(spark, sf_dir):
    return rollup.top(_at(spark, sf_dir).nodes, F.size("params"), 4)


@_query("is_test_name", f"SELECT node_id, {_TEST.replace('x', 'short_name')} AS is_test, file LIKE '%/test\\_%' ESCAPE '\\' AS is_test_file FROM nodes")
def is_test_name(spark, sf_dir):
    return _at(spark, sf_dir).nodes.select("node_id", names.is_test_name("short_name").alias("is_test"), names.is_test_file("file").alias("is_test_file"))


@_query("relative_path", "SELECT node_id, CASE WHEN file LIKE 'src/%' THEN substr(file, 5) ELSE file END AS path FROM nodes")
def relative_path(spark, sf_dir):
    return _at(spark, sf_dir).nodes.select("node_id", names.relative_path("file", "src").alias("path"))


# --- versions -----------------------------------------------------------------------------------------------------

_SAID = "concat(chr(39), nname, chr(39), ': ', {0})"
_PAIRS = f"""lastly AS (SELECT 'o' AS v, * FROM fns WHERE complexity IS NOT NULL UNION ALL SELECT 'n', * FROM newer WHERE complexity IS NOT NULL),
one AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY v, file, short_name ORDER BY start_line DESC, node_id DESC) AS r FROM lastly) WHERE r = 1),
sides AS (SELECT * FROM one UNION ALL SELECT 'o', * FROM fns WHERE complexity IS NULL AND file NOT IN (SELECT file FROM newer) UNION ALL SELECT 'n', * FROM newer WHERE complexity IS NULL AND file NOT IN (SELECT file FROM fns)),
pairs AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.short_name, n.short_name) AS short_name, coalesce(n.start_line, o.start_line) AS line, o.name AS oname, n.name AS nname, o.node_id AS oid, n.node_id AS nid, o.visibility AS ov, n.visibility AS nv, o.params AS op, n.params AS np,
  o.return_type_debug AS ort, n.return_type_debug AS nrt, o.complexity AS oc, n.complexity AS nc, o.is_async AS oa, n.is_async AS na
  FROM (SELECT * FROM sides WHERE v = 'o') o FULL JOIN (SELECT * FROM sides WHERE v = 'n') n ON o.file = n.file AND o.short_name = n.short_name),
found AS (
  SELECT file, short_name, line, 'FunctionAdded' AS kind, CASE WHEN nv = 'public' THEN 'NeedsReview' ELSE 'Safe' END AS risk, concat('New function ', chr(39), nname, chr(39)) AS description FROM pairs WHERE oid IS NULL
  UNION ALL SELECT file, short_name, line, 'FunctionRemoved', CASE WHEN ov = 'public' THEN 'Breaking' ELSE 'Safe' END, concat('Removed function ', chr(39), oname, chr(39)) FROM pairs WHERE nid IS NULL
  UNION ALL SELECT file, short_name, line, 'SignatureChange', CASE WHEN nv = 'public' THEN 'Breaking' ELSE 'NeedsReview' END, {_SAID.format("concat('parameter count changed (', len(op), ' → ', len(np), ')')")} FROM pairs WHERE len(op) <> len(np)
  UNION ALL SELECT file, short_name, line, 'TypeChange', CASE WHEN nv = 'public' THEN 'Breaking' ELSE 'NeedsReview' END, {_SAID.format("concat('param ', chr(39), 'p', i - 1, chr(39), ' type changed')")} FROM pairs, unnest(range(1, len(op) + 1)) AS u(i) WHERE len(op) = len(np) AND op[i] IS DISTINCT FROM np[i]
  UNION ALL SELECT file, short_name, line, 'SignatureChange', CASE WHEN nv = 'public' THEN 'Breaking' ELSE 'NeedsReview' END, {_SAID.format("concat('return type changed (', CASE WHEN ort IS NULL THEN 'None' ELSE concat('Some(', ort, ')') END, ' → ', CASE WHEN nrt IS NULL THEN 'None' ELSE concat('Some(', nrt, ')') END, ')')")} FROM pairs WHERE oid IS NOT NULL AND nid IS NOT NULL AND ort IS DISTINCT FROM nrt
  UNION ALL SELECT file, short_name, line, 'ApiSurfaceChange', CASE WHEN ov = 'public' THEN 'Breaking' WHEN nv = 'public' THEN 'NeedsReview' ELSE 'Safe' END, {_SAID.format("concat('visibility changed (', upper(ov[1]), ov[2:], ' → ', upper(nv[1]), nv[2:], ')')")} FROM pairs WHERE ov <> nv
  UNION ALL SELECT file, short_name, line, 'ComplexityChange', CASE WHEN nc > 20 THEN 'NeedsReview' ELSE 'Safe' END, {_SAID.format("concat('complexity changed (', oc, ' → ', nc, ', ', CASE WHEN nc > oc THEN '+' ELSE '' END, nc - oc, ')')")} FROM pairs WHERE abs(nc - oc) >= 3
  UNION ALL SELECT file, short_name, line, 'ControlFlowChange', CASE WHEN nv = 'public' THEN 'Breaking' ELSE 'NeedsReview' END, {_SAID.format("concat('async changed (', oa, ' → ', na, ')')")} FROM pairs WHERE oa <> na),
files AS (SELECT DISTINCT file FROM found)"""

_DIFFS = {
    "diff_functions": ((changes.added, changes.removed), "kind IN ('FunctionAdded', 'FunctionRemoved')"),
    "diff_param_count": ((changes.param_count,), "description LIKE '%parameter count%'"),
    "diff_param_types": ((changes.param_types,), "kind = 'TypeChange'"),
    "diff_return_type": ((changes.return_type,), "description LIKE '%return type changed%'"),
    "diff_visibility": ((changes.visibility,), "kind = 'ApiSurfaceChange'"),
    "diff_complexity": ((changes.complexity,), "kind = 'ComplexityChange'"),
    "diff_async": ((changes.asyncness,), "kind = 'ControlFlowChange'"),
}


def _differ(rules):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _at(spark, sf_dir)
        return changes.semantic_diff(at.functions, at.newer, rules)

    return run


for _name, (_rules, _where) in _DIFFS.items():
    _query(_name, f", {_PAIRS} SELECT * FROM found WHERE {_where}", newer=True)(_differ(_rules))


def _diff(at: Lens) -> tuple[DataFrame, DataFrame]:
    return at.found, at.found.select("file").distinct()


@_query("function_map", f", {_PAIRS} SELECT node_id, file, short_name FROM one WHERE v = 'o'", newer=True)
def function_map(spark, sf_dir):
    return changes.function_map(_at(spark, sf_dir).functions).select("node_id", "file", "short_name")


_STATIC = "SELECT file, short_name, start_line AS line, 'ControlFlowChange' AS kind, 'SecuritySensitive' AS risk, concat('Unsafe function ', chr(39), name, chr(39), ' — requires careful review') AS description FROM newer WHERE is_unsafe AND file IN (SELECT file FROM files)"


@_query("static_unsafe", f", {_PAIRS} {_STATIC}", newer=True)
def static_unsafe(spark, sf_dir):
    at = _at(spark, sf_dir)
    return changes.static_findings(at.newer, _diff(at)[1])


@_query("verify_changes", f", {_PAIRS} SELECT * FROM found UNION ALL {_STATIC}", newer=True)
def verify_changes(spark, sf_dir):
    at = _at(spark, sf_dir)
    found, files = _diff(at)
    return found.unionByName(changes.static_findings(at.newer, files))


@_query("verify_risk", f""", {_PAIRS}, every AS (SELECT * FROM found UNION ALL {_STATIC}) SELECT *, round(least(breaking * 0.25 + securitysensitive * 0.20 + needsreview * 0.05 + safe * 0.01 + changed_files * 0.02, 1.0), 6)::DOUBLE AS risk_score FROM (
  SELECT count(*) FILTER (WHERE risk = 'Breaking') AS breaking, count(*) FILTER (WHERE risk = 'SecuritySensitive') AS securitysensitive, count(*) FILTER (WHERE risk = 'NeedsReview') AS needsreview, count(*) FILTER (WHERE risk = 'Safe') AS safe, (SELECT count(*) FROM files) AS changed_files FROM every)""", newer=True)
def verify_risk(spark, sf_dir):
    at = _at(spark, sf_dir)
    found = cut(at.found)  # looked at three times
    files = found.select("file").distinct()
    return changes.risk_score(found.unionByName(changes.static_findings(at.newer, files)), files)


@_query("suggested_tests", f", {_PAIRS} SELECT file, short_name, 'High' AS priority, concat('Add tests for ', chr(39), name, chr(39)) AS description, concat('#[test]', chr(10), 'fn test_', short_name, '() {{', chr(10), '    todo!()', chr(10), '}}') AS skeleton FROM newer WHERE visibility = 'public' AND complexity IS NOT NULL AND file IN (SELECT file FROM files)", newer=True)
def suggested_tests(spark, sf_dir):
    at = _at(spark, sf_dir)
    return changes.suggested_tests(at.newer, _diff(at)[1])


_SARIF = "concat('codegraph/', lower(replace(kind, ' ', '-'))) AS rule_id"


@_query("sarif_rows", f", {_PAIRS} SELECT {_SARIF}, CASE WHEN risk IN ('Breaking', 'SecuritySensitive') THEN 'error' WHEN risk = 'NeedsReview' THEN 'warning' ELSE 'note' END AS level, description, file, short_name, line, 1 AS col FROM found", newer=True)
def sarif_rows(spark, sf_dir):
    return changes.sarif_rows(_diff(_at(spark, sf_dir))[0])


@_query("sarif_rules", f", {_PAIRS} SELECT DISTINCT {_SARIF} FROM found", newer=True)
def sarif_rules(spark, sf_dir):
    return sarif_rows(spark, sf_dir).select("rule_id").distinct()


# --- conventions --------------------------------------------------------------------------------------------------


@_query("inv_error_handling", "SELECT functions, nodes, round(least(functions / nodes, 1.0) * 0.8 + 0.1, 6)::DOUBLE AS confidence FROM (SELECT count(*) FILTER (WHERE return_type_debug LIKE 'Resolved(Result%' OR return_type_debug LIKE 'Unresolved(\"Result%') AS functions, count(*) AS nodes FROM nodes) WHERE functions >= 3")
def inv_error_handling(spark, sf_dir):
    return conventions.error_handling(_at(spark, sf_dir).nodes)


def _naming_sql(kind: str, least: int, pattern: str) -> str:
    return f"SELECT total, conforming, round(conforming / total, 6)::DOUBLE AS confidence FROM (SELECT count(*) AS total, count(*) FILTER (WHERE regexp_full_match(short_name, '{pattern}')) AS conforming FROM nodes WHERE node_kind = '{kind}' AND visibility = 'public') WHERE total >= {least} AND conforming / total > 0.9"


@_query("inv_snake_case", _naming_sql("function", 5, "[a-z_0-9]+"))
def inv_snake_case(spark, sf_dir):
    return conventions.naming(_at(spark, sf_dir).nodes, "function", 5)


@_query("inv_pascal_case", _naming_sql("type", 3, "[A-Z][^_]*"))
def inv_pascal_case(spark, sf_dir):
    return conventions.naming(_at(spark, sf_dir).nodes, "type", 3)


_INIT = "node_kind = 'function' AND (short_name IN ('init', 'new') OR short_name LIKE 'init%')"


@_query("inv_call_ordering", f", {_bfs(_INIT, 'src', 'dst', 3)} SELECT root, count(*) AS affected FROM near GROUP BY root HAVING count(*) >= 3")
def inv_call_ordering(spark, sf_dir):
    at = _at(spark, sf_dir)
    return conventions.call_ordering(at.nodes, at.edges)


@_query("inv_type_usage", "SELECT type_debug, count(*) AS users, min(file) AS file FROM (SELECT file, unnest(params) AS type_debug FROM fns) GROUP BY type_debug HAVING count(*) >= 3 AND min(file) = max(file)")
def inv_type_usage(spark, sf_dir):
    return conventions.type_usage(_at(spark, sf_dir).nodes)


# --- files --------------------------------------------------------------------------------------------------------

_FILES = "files AS (SELECT concat(source, '/', doc_id, '.', CASE doc_id % 3 WHEN 0 THEN 'rs' WHEN 1 THEN 'ts' ELSE 'py' END) AS path, text, doc_id FROM documents)"
_MANIFESTS = f"""{_FILES},
new_m AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS hash FROM files),
old_m AS (SELECT path, sha256(text) AS hash FROM files WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('gone/', i, '.rs'), 'x' FROM range(5) t(i)),
turned AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'Added' WHEN n.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS change FROM old_m o FULL JOIN new_m n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    ext = F.expr("CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' ELSE '.py' END")
    return lens.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), "text", "doc_id")


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    new = index.hashed(files.select("path", F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))
    gone = spark.range(5).select(F.concat(F.lit("gone/"), F.col("id").cast("string"), F.lit(".rs")).alias("path"), F.lit("x").alias("hash"))
    return index.hashed(files.where("doc_id % 10 <> 0").withColumn("content", F.col("text"))).unionByName(gone), new


@_query("scan_by_extension", f", {_FILES} SELECT path FROM files WHERE path LIKE '%.rs' OR path LIKE '%.py'")
def scan_by_extension(spark, sf_dir):
    return index.with_extension(_files(spark, sf_dir), ("rs", "py")).select("path")


@_query("content_hash", f", {_FILES} SELECT path, sha256(text) AS hash, sha256(text) = repeat('0', 64) AS is_zero FROM files")
def content_hash(spark, sf_dir):
    return index.hashed(_files(spark, sf_dir).withColumn("content", F.col("text"))).withColumn("is_zero", F.col("hash") == "0" * 64)


@_query("detect_changes", f", {_MANIFESTS} SELECT path, change FROM turned")
def detect_changes(spark, sf_dir):
    return index.detect_changes(*_manifests(spark, sf_dir))


@_query("commit_changes", f", {_MANIFESTS} SELECT path, hash FROM new_m")
def commit_changes(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return index.commit_changes(old, new, index.detect_changes(old, new))


@_query("object_store_dedup", f", {_FILES} SELECT sha256(text) AS hash, concat('objects/', substr(sha256(text), 1, 2), '/', substr(sha256(text), 3)) AS path, count(*) AS copies FROM files GROUP BY text")
def object_store_dedup(spark, sf_dir):
    return index.object_store(_files(spark, sf_dir).withColumn("content", F.col("text")))


@_query("bracket_balance")
def bracket_balance(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" the "), F.lit(" (the] ")))
    return checks.check_texts(files, checks.bracket_findings)


@_query("python_indent", f""", {_FILES}, l AS (SELECT path, i AS line, s[i] AS x FROM (SELECT path, string_split(replace(text, ' the ', chr(10) || chr(9) || ' the '), chr(10)) AS s FROM files), unnest(range(1, len(s) + 1)) AS u(i)),
  m AS (SELECT path, line, regexp_extract(x, '^(\\s*)', 1) AS lead FROM l WHERE regexp_matches(x, '\\S'))
  SELECT path, CAST(line AS INTEGER) AS line, 1 AS col, 'error' AS severity, 'Mixed tabs and spaces in indentation' AS message FROM m WHERE contains(lead, chr(9)) AND contains(lead, ' ')
  UNION ALL SELECT path, 0, 0, 'warning', 'File mixes tab and space indentation' FROM m GROUP BY path HAVING bool_or(contains(lead, chr(9))) AND bool_or(contains(lead, ' ') AND NOT contains(lead, chr(9)))""")
def python_indent(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" the "), F.lit("\n\t the ")))
    return checks.indentation(files)


_TSC = "concat('src', chr(92), 'f', event_id % 9, '.ts(', event_id, ',', event_id % 80, '): ', CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END, ' TS', user_id, ': (', event_type, '): x')"


@_query("tsc_parse", "SELECT concat('src/f', event_id % 9, '.ts') AS file, CAST(event_id AS INTEGER) AS line, CAST(event_id % 80 AS INTEGER) AS col, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, concat(CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END, ' TS', user_id, ': (', event_type, '): x') AS message FROM events WHERE event_id % 9 < 4")
def tsc_parse(spark, sf_dir):
    lines = lens.table(spark, sf_dir, "events").select(F.expr(_TSC).alias("text"))
    changed = spark.range(4).select(F.concat(F.lit("repo/src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("file"))
    return checks.in_files(checks.tsc(lines), changed)


@_query("pylint_parse", "SELECT concat('m/a', event_id % 5, '.py') AS file, CAST(event_id AS INTEGER) AS line, CAST(event_id % 7 AS INTEGER) AS col, 'warning' AS severity, concat('E1: ', event_type, ': x') AS message FROM events")
def pylint_parse(spark, sf_dir):
    return checks.pylint(lens.table(spark, sf_dir, "events").select(F.expr("concat('m', chr(92), 'a', event_id % 5, '.py:', event_id, ':', event_id % 7, ': E1: ', event_type, ': x')").alias("text")))


@_query("eslint_parse", "SELECT concat('a', event_id % 5, '.js') AS file, CAST(event_id AS INTEGER) AS line, CAST(event_id % 11 AS INTEGER) AS col, CASE WHEN event_id % 3 = 2 THEN 'error' ELSE 'warning' END AS severity, concat(event_type, ' (no-', event_type, ')') AS message FROM events WHERE event_id % 3 > 0")
def eslint_parse(spark, sf_dir):
    message = "named_struct('line', cast(event_id as int), 'column', cast(event_id % 11 as int), 'severity', cast(event_id % 3 as int), 'message', event_type, 'ruleId', concat('no-', event_type))"
    reports = lens.table(spark, sf_dir, "events").select(F.expr(f"to_json(array(named_struct('filePath', concat('a', event_id % 5, '.js'), 'messages', array({message}))))").alias("json"))
    return checks.eslint(reports)


@_query("extract_line_number", "SELECT event_id, CAST(event_id AS INTEGER) AS line FROM events")
def extract_line_number(spark, sf_dir):
    return lens.table(spark, sf_dir, "events").select("event_id", names.line_number(F.expr("concat('at line ', event_id, ': x')")).alias("line"))


@_query("cargo_parse", "SELECT concat('src/c', event_id % 7, '.rs') AS file, CAST(event_id AS INTEGER) AS line, CAST(event_id % 80 AS INTEGER) AS col, CASE WHEN event_id % 3 = 2 THEN 'error' ELSE 'warning' END AS severity, event_type AS message FROM events WHERE event_id % 3 > 0")
def cargo_parse(spark, sf_dir):
    span = "named_struct('file_name', concat('src', chr(92), 'c', event_id % 7, '.rs'), 'line_start', cast(event_id as int), 'column_start', cast(event_id % 80 as int))"
    message = f"named_struct('level', element_at(array('note', 'warning', 'error'), cast(event_id % 3 as int) + 1), 'message', event_type, 'spans', array({span}))"
    return checks.cargo(lens.table(spark, sf_dir, "events").select(F.expr(f"to_json(named_struct('reason', 'compiler-message', 'message', {message}))").alias("text")))


@_query("extract_imports", "SELECT DISTINCT concat('d', event_id % 50, '.py') AS path, m AS module FROM events, unnest([concat('pkg_', event_type), concat('mod_', event_id % 11), concat('mod_', event_id % 13)]) AS u(m)")
def extract_imports(spark, sf_dir):
    text = F.expr("concat('from pkg_', event_type, ' import x', chr(10), '  import mod_', event_id % 11, ' as y, mod_', event_id % 13)")
    return index.imports(lens.table(spark, sf_dir, "events").select(F.expr("concat('d', event_id % 50, '.py')").alias("path"), F.lit("python").alias("language"), text.alias("text")))


@_query("json_map_keys", "SELECT concat('p', event_id, '.json') AS path, n AS name FROM events, unnest(list_distinct([event_type, concat('lib', event_id % 9)])) AS u(n)")
def json_map_keys(spark, sf_dir):
    json = F.expr("to_json(named_struct('dependencies', map(event_type, '1'), 'devDependencies', map(concat('lib', event_id % 9), '2')))")
    return index.dependencies(lens.table(spark, sf_dir, "events").select(F.expr("concat('p', event_id, '.json')").alias("path"), json.alias("json")))


# --- snapshots, verification, agents ------------------------------------------------------------------------------

_OF = "coalesce((SELECT string_agg(DISTINCT o.name, ',' ORDER BY o.name) FROM edges JOIN nodes o ON o.node_id = {other} WHERE {own} = f.node_id AND src <> dst AND NOT (o.node_kind = 'function' AND o.complexity IS NULL){more}), '')"
_PARAMS = "array_to_string(list_transform(range(len(params)), lambda i: concat('p', i)), ', ')"
_INFO = f"""info AS (SELECT node_id, file, name, start_line AS line, visibility, {_PARAMS} AS params, return_type_debug AS return_type, complexity, is_async, {_OF.format(other='dst', own='src', more='')} AS calls,
  {_OF.format(other='src', own='dst', more=' AND NOT ' + _TEST.replace('x', 'o.name'))} AS called_by FROM nodes f WHERE node_kind = 'function' AND complexity IS NOT NULL),
kinds AS (SELECT node_id, file, name, data_kind AS kind, start_line AS line, array_to_string(fields, ', ') AS fields, visibility FROM nodes WHERE node_kind = 'type')"""


@_query("function_info", f", {_INFO} SELECT * FROM info")
def function_info(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.function_info(at.nodes, at.edges)


@_query("type_info", f", {_INFO} SELECT * FROM kinds")
def type_info(spark, sf_dir):
    return snapshot.type_info(_at(spark, sf_dir).nodes)


_SIGNED = "concat(name, '(', params, ') → ', coalesce(return_type, 'void'))"


@_query("signature_strings", f", {_INFO} SELECT node_id, {_SIGNED} AS signature, concat(CASE WHEN is_async THEN 'async ' ELSE '' END, name, '(', params, ') -> ', coalesce(return_type, 'void')) AS short FROM info UNION ALL SELECT node_id, NULL, CASE WHEN fields = '' THEN name ELSE concat(name, ' {{ ', fields, ' }}') END FROM kinds")
def signature_strings(spark, sf_dir):
    at = _at(spark, sf_dir)
    functions = snapshot.function_info(at.nodes, at.edges).select("node_id", snapshot.signature().alias("signature"), snapshot.short_signature().alias("short"))
    return functions.unionByName(snapshot.type_info(at.nodes).select("node_id", F.lit(None).cast("string").alias("signature"), snapshot.short_type().alias("short")))


@_query("summary_hotspots", f", {_HOT} SELECT concat(file, ':', start_line, ' ', name, ' (', reason, ')') AS text FROM (SELECT n.file, n.start_line, n.name, CASE reason WHEN 'complexity' THEN concat('complexity ', value) ELSE concat(value, ' callers') END AS reason FROM hot JOIN nodes n USING (node_id)) ORDER BY file, start_line, name, reason LIMIT 10")
def summary_hotspots(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.summary_hotspots(snapshot.taken(at.nodes, at.edges))


@_query("summary_dependencies", f", deps AS ({_CROSS}) SELECT text FROM (SELECT concat(caller, ' -> ', callee) AS text FROM deps ORDER BY caller, callee, from_file, to_file LIMIT 20)")
def summary_dependencies(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.summary_dependencies(snapshot.taken(at.nodes, at.edges))


_VERSIONS = f"""sides2 AS (SELECT 'o' AS v, * FROM fns WHERE complexity IS NOT NULL UNION ALL SELECT 'n', * FROM newer WHERE complexity IS NOT NULL),
signed AS (SELECT v, file, name, max(struct_pack(line := start_line, node_id := node_id, signature := concat(name, '(', array_to_string(list_transform(range(len(params)), lambda i: CASE WHEN v = 'n' AND i = len(params) - 1 AND (node_id - 1000000) % 13 = 0 AND node_id < 1900000 THEN 'extra' ELSE concat('p', i) END), ', '), ') → ', coalesce(return_type_debug, 'void')))) AS x FROM sides2 GROUP BY v, file, name),
moved AS (SELECT coalesce(n.file, o.file) AS file, coalesce(n.name, o.name) AS name, o.x AS o, n.x AS n FROM (SELECT * FROM signed WHERE v = 'o') o FULL JOIN (SELECT * FROM signed WHERE v = 'n') n ON o.file = n.file AND o.name = n.name)"""


@_query("snapshot_functions", f", {_VERSIONS} SELECT file, name, coalesce(n.line, o.line) AS line, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'signature' END AS change, CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN concat(o.signature, ' → ', n.signature) ELSE coalesce(n.signature, o.signature) END AS description FROM moved WHERE o IS NULL OR n IS NULL OR o.signature <> n.signature", newer=True)
def snapshot_functions(spark, sf_dir):
    at = _at(spark, sf_dir)
    info = lambda functions: functions.where("complexity IS NOT NULL").select("node_id", "file", "name", F.col("start_line").alias("line"), F.array_join(F.transform("params", lambda p: p["name"]), ", ").alias("params"), F.col("return_type_debug").alias("return_type"))
    return snapshot.function_changes(info(at.functions), info(at.newer))


@_query("snapshot_modified_files", "SELECT file FROM (SELECT file, count(*) AS n FROM newer WHERE complexity IS NOT NULL GROUP BY file) n LEFT JOIN (SELECT file, count(*) AS o FROM fns WHERE complexity IS NOT NULL GROUP BY file) o USING (file) WHERE o IS NULL OR o <> n", newer=True)
def snapshot_modified_files(spark, sf_dir):
    at = _at(spark, sf_dir)
    state = lambda functions: snapshot.Snapshot(functions.where("complexity IS NOT NULL"), at.nodes.limit(0), None, None, None)
    return snapshot.modified_files(state(at.functions), state(at.newer))


@_query("snapshot_dependencies", f", deps AS ({_CROSS}), a AS (SELECT DISTINCT concat(caller, '→', callee) AS d FROM deps WHERE length(caller) % 2 = 0), b AS (SELECT DISTINCT concat(caller, '→', callee) AS d FROM deps WHERE length(callee) % 3 > 0) SELECT d AS dependency, 'new' AS change FROM b WHERE d NOT IN (SELECT d FROM a) UNION ALL SELECT d, 'lost' FROM a WHERE d NOT IN (SELECT d FROM b)")
def snapshot_dependencies(spark, sf_dir):
    found = cross_file_deps(spark, sf_dir)
    return snapshot.dependency_changes(found.where("length(caller) % 2 = 0"), found.where("length(callee) % 3 > 0"))


@_query("manifest_project", f"SELECT string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT file) AS files, count(*) FILTER (WHERE node_kind = 'function') AS functions, count(*) FILTER (WHERE node_kind = 'type') AS types, count(*) FILTER (WHERE complexity > 15) AS high_complexity, 100 - least(count(*) FILTER (WHERE complexity > 15) * 3, 30) AS health FROM (SELECT *, nullif({_language(names.MANIFEST_LANGUAGES, '')}, '') AS language FROM nodes WHERE {_LIVE})")
def manifest_project(spark, sf_dir):
    return snapshot.manifest_project(_at(spark, sf_dir).nodes)


_SCOPES = f"""{_bfs(_INIT, 'src', 'dst', 3)},
res AS (SELECT node_id, file, start_line AS line FROM nodes WHERE node_kind = 'function' AND (return_type_debug LIKE 'Resolved(Result%' OR return_type_debug LIKE 'Unresolved("Result%')),
used AS (SELECT node_id, file, start_line AS line, unnest(params) AS t FROM fns),
only_in AS (SELECT t, count(*) AS users, min(file) AS file FROM used GROUP BY t HAVING count(*) >= 3 AND min(file) = max(file)),
scopes AS (
  SELECT 'ErrorsMustBeHandled' AS kind, concat('Found ', (SELECT count(*) FROM res), ' functions returning Result — errors should be handled, not silently ignored') AS description, round(least((SELECT count(*) FROM res) / (SELECT count(*) FROM nodes), 1.0) * 0.8 + 0.1, 6)::DOUBLE AS confidence, (SELECT count(*) FROM res) AS evidence, * FROM res WHERE (SELECT count(*) FROM res) >= 3
  UNION ALL SELECT 'MustPrecede', concat('Initialization function leads to ', affected, ' downstream operations'), 0.7, affected, node_id, file, start_line FROM (SELECT root, count(*) AS affected FROM near GROUP BY root HAVING count(*) >= 3) JOIN nodes ON nodes.node_id = root
  UNION ALL SELECT 'TypeUsageConstraint', concat('Type ', t, ' is only used in ', only_in.file, ' (', users, ' occurrences)'), 0.6, users, node_id, used.file, line FROM only_in JOIN used USING (t))"""
_NAMED = "SELECT 'ConventionConstraint' AS kind, concat('{what} (', conforming, '/', total, ' = ', printf('%.0f', conforming / total * 100), '%)') AS description, round(conforming / total, 6)::DOUBLE AS confidence, conforming AS evidence FROM (SELECT count(*) AS total, count(*) FILTER (WHERE regexp_full_match(short_name, '{pattern}')) AS conforming FROM nodes WHERE node_kind = '{kind}' AND visibility = 'public') WHERE total >= {least} AND conforming / total > 0.9"
_DISCOVERED = f"""{_SCOPES}, conventions AS ({_NAMED.format(what='Public functions use snake_case', pattern='[a-z_0-9]+', kind='function', least=5)} UNION ALL {_NAMED.format(what='Public types use PascalCase', pattern='[A-Z][^_]*', kind='type', least=3)}
  UNION ALL SELECT kind, description, confidence, evidence FROM (SELECT DISTINCT kind, description, confidence, evidence, CASE WHEN kind = 'MustPrecede' THEN node_id ELSE 0 END FROM scopes))"""


@_query("inv_discovered", f", {_DISCOVERED} SELECT * FROM conventions")
def inv_discovered(spark, sf_dir):
    at = _at(spark, sf_dir)
    return conventions.discovered(at.nodes, at.edges)


@_query("inv_stats", f", {_DISCOVERED} SELECT (SELECT count(*) FROM nodes) AS nodes_analyzed, count(*) AS found FROM conventions")
def inv_stats(spark, sf_dir):
    at = _at(spark, sf_dir)
    return conventions.mining_stats(at.nodes, at.edges)


@_query("manifest_rules", f", {_DISCOVERED} SELECT description, severity FROM (VALUES {', '.join(f"('{text}', 'required')" for _, text in snapshot.RULES)}) t(description, severity) UNION ALL SELECT description, 'warning' FROM conventions WHERE confidence >= 0.9")
def manifest_rules(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.manifest_rules(at.nodes, at.edges).select("description", "severity")


_VIOLATIONS = "SELECT file, line, 'warning' AS severity, concat('Changed file may affect invariant: ', description) AS description FROM scopes WHERE file IN (SELECT file FROM files)"


def _verification(at: Lens) -> report.Verification:
    return report.verified(at.functions, at.newer, at.edges, nodes=at.nodes)


@_query("invariant_violations", f", {_PAIRS}, {_SCOPES} {_VIOLATIONS}", newer=True)
def invariant_violations(spark, sf_dir):
    return _verification(_at(spark, sf_dir)).violations


_SUMMARY = f"""{_PAIRS}, {_SCOPES}, every AS (SELECT * FROM found UNION ALL {_STATIC}), bad AS ({_VIOLATIONS}), summary AS (
  SELECT CASE WHEN v = 0 THEN 'pass' ELSE 'pass' END AS status, round(least(breaking * 0.25 + security * 0.20 + needs_review * 0.05 + safe * 0.01 + files * 0.02 + CASE WHEN v > 0 THEN 0.15 ELSE 0 END, 1.0), 6)::DOUBLE AS risk_score, CASE WHEN files = 0 THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence, total_changes, breaking, needs_review, safe, 0::BIGINT AS errors, v + needs_review AS warnings
  FROM (SELECT count(*) AS total_changes, count(*) FILTER (WHERE risk = 'Breaking') AS breaking, count(*) FILTER (WHERE risk = 'SecuritySensitive') AS security, count(*) FILTER (WHERE risk = 'NeedsReview') AS needs_review, count(*) FILTER (WHERE risk = 'Safe') AS safe, (SELECT count(*) FROM bad) AS v, (SELECT count(*) FROM files) AS files FROM every))"""


@_query("verify_summary", f", {_SUMMARY} SELECT * FROM summary", newer=True)
def verify_summary(spark, sf_dir):
    return report.summary(_verification(_at(spark, sf_dir)))


@_query("ci_gate", f", {_SUMMARY} SELECT status, concat('status=', status, chr(10), 'risk-score=', printf('%.0f', risk_score * 100), chr(10), 'changes=', total_changes, chr(10)) AS output, errors > 0 AS fails_on_error, warnings > 0 OR errors > 0 AS fails_on_warning FROM summary", newer=True)
def ci_gate(spark, sf_dir):
    row = verify_summary(spark, sf_dir).first()
    return spark.createDataFrame([(row["status"], report.build_outputs(row)["output"], report.fails(row), report.fails(row, "warning"))], "status string, output string, fails_on_error boolean, fails_on_warning boolean")


@_query("verify_json")
def verify_json(spark, sf_dir):
    return report.json_document(_verification(_at(spark, sf_dir)))


@_query("sarif_document")
def sarif_document(spark, sf_dir):
    return report.sarif_document(_verification(_at(spark, sf_dir)))


@_query("check_issues", f", {_PAIRS} SELECT file, short_name, kind, risk, CASE kind WHEN 'FunctionAdded' THEN concat('New function ', nm) WHEN 'FunctionRemoved' THEN concat('Removed ', nm) WHEN 'ComplexityChange' THEN concat('Complexity ', CASE WHEN contains(description, ', +') THEN 'increased ' ELSE 'decreased ' END, regexp_extract(description, '\\((\\d+ → \\d+), ', 1)) ELSE description END AS short, CASE WHEN kind = 'SignatureChange' AND risk = 'Breaking' THEN 'Update all callers or add a backward-compatible wrapper' WHEN kind = 'FunctionRemoved' AND risk = 'Breaking' THEN 'Verify no external consumers depend on this' WHEN kind = 'FunctionAdded' AND risk = 'NeedsReview' THEN 'Add tests for the new function' WHEN kind = 'ComplexityChange' AND risk = 'NeedsReview' THEN 'Consider splitting into smaller functions' END AS action FROM (SELECT *, string_split(description, chr(39))[2] AS nm FROM found)", newer=True)
def check_issues(spark, sf_dir):
    return changes.advised(_at(spark, sf_dir).found).select("file", "short_name", "kind", "risk", "short", "action")


@_query("issues_per_file", f", {_PAIRS} SELECT file, count(*) AS issues, count(*) FILTER (WHERE risk IN ('Breaking', 'SecuritySensitive')) AS errors, count(*) FILTER (WHERE risk = 'NeedsReview') AS warnings FROM found GROUP BY file", newer=True)
def issues_per_file(spark, sf_dir):
    return changes.issues_by_file(_at(spark, sf_dir).found)


@_query("diff_impact_weight", f""", {_PAIRS}, own AS (SELECT * FROM one WHERE v = 'n' AND visibility = 'public' AND (file, short_name) IN (SELECT (file, short_name) FROM found WHERE kind NOT IN ('FunctionAdded', 'FunctionRemoved'))),
  up AS (SELECT dst AS root, src AS node_id FROM edges WHERE dst IN (SELECT node_id FROM own)), two AS (SELECT * FROM up UNION SELECT root, src FROM up JOIN edges ON dst = up.node_id)
  SELECT file, short_name, start_line AS line, 'ApiSurfaceChange' AS kind, 'NeedsReview' AS risk, concat(chr(39), name, chr(39), ': ', n, ' callers affected by above changes') AS description FROM own JOIN (SELECT root, count(DISTINCT two.node_id) AS n FROM two WHERE two.node_id <> root GROUP BY root HAVING count(DISTINCT two.node_id) > 5) c ON c.root = own.node_id""", newer=True)
def diff_impact_weight(spark, sf_dir):
    at = _at(spark, sf_dir)
    return changes.impact_weighted(at.found, at.newer, at.edges)


_CONTEXT = "SELECT * FROM info WHERE file = (SELECT min(file) FROM info WHERE file LIKE '%mod_7.ts')"


@_query("file_context", f", {_INFO} {_CONTEXT}")
def file_context(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.file_context(snapshot.taken(at.nodes, at.edges), "mod_7.ts")


@_query("before_edit", f", {_INFO}, own AS ({_CONTEXT}), deps AS ({_CROSS}) SELECT (SELECT count(*) FROM own WHERE contains(lower(name), 'red')) AS functions, (SELECT count(*) FROM (SELECT DISTINCT * FROM deps WHERE from_file IN (SELECT file FROM own) OR to_file IN (SELECT file FROM own))) AS dependencies, CASE WHEN (SELECT max(len(string_split(called_by, ','))) FROM own WHERE contains(lower(name), 'red')) > 3 THEN 'Some functions have many callers. Changes may have wide impact.' END AS warning")
def before_edit(spark, sf_dir):
    at = _at(spark, sf_dir)
    functions, near, warning = snapshot.before_edit(snapshot.taken(at.nodes, at.edges), "mod_7.ts", "red")
    return functions.agg(F.count("*").alias("functions")).crossJoin(near.agg(F.count("*").alias("dependencies"))).crossJoin(warning)  # one row each


@_query("plan_change", f", {_INFO} SELECT file, CAST(relevance AS BIGINT) AS relevance FROM (SELECT file, sum(CASE WHEN contains(lower(name), 'widget') OR contains('widget', string_split(lower(name), '::')[-1]) THEN 10 ELSE 0 END + len(list_filter(string_split(calls, ','), lambda c: contains(lower(c), 'widget'))) * 5 + CASE WHEN contains(lower(name), 'hot') THEN 20 ELSE 0 END) AS relevance FROM info GROUP BY file) WHERE relevance > 0 ORDER BY relevance DESC, file LIMIT 10")
def plan_change(spark, sf_dir):
    at = _at(spark, sf_dir)
    return snapshot.plan_change(snapshot.taken(at.nodes, at.edges), "Widget", "hot")


# --- source code --------------------------------------------------------------------------------------------------

_SOURCES = {
    "rs": "pub fn fn_{k}(a: i32, b: Vec<u8>) -> Option<String> {{\n    match a {{ 1 => helper_{k}(b), _ => None }}\n}}\nstruct C_{k} {{ x: i32 }}\n",
    "ts": "export function fn_{k}(a: number, b?: string): string[] {{\n  return a > 1 ? go_{k}(a) : [];\n}}\ninterface C_{k} {{ x: number }}\n",
    "py": "async def fn_{k}(a: int, b=None) -> str:\n    if a and b:\n        return other_{k}(a)\n\nclass C_{k}(Base):\n    pass\n",
}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part. Keys are dealt out before the texts are made: files of parts are small, parsing is not."""
    text = F.lit(None).cast("string")
    for number, source in enumerate(_SOURCES.values()):
        parts = source.replace("{{", "{").replace("}}", "}").split("{k}")
        made = F.concat(*[x for part in parts[:-1] for x in (F.lit(part), F.col("p_partkey").cast("string"))], F.lit(parts[-1]))
        text = F.when(F.col("p_partkey") % 3 == number, made).otherwise(text)
    path = F.concat(F.lit("src/m"), (F.col("p_partkey") % 20).cast("string"), F.lit("/f_"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % 3 + 1).cast("int")))
    keys = lens.table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select(path.alias("path"), text.alias("content"))


_PATH = "concat('src/m', p_partkey % 20, '/f_', p_partkey, '.', ['rs', 'ts', 'py'][p_partkey % 3 + 1])"


@_query("index_nodes", f"""SELECT {_PATH} AS file, concat('fn_', p_partkey) AS name, 'function' AS node_kind, 1 AS start_line, CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 3 END AS complexity, 'public' AS visibility, p_partkey % 3 = 2 AS is_async, ['a i32, b u8[]', 'a f64, b string', 'a i64, b unknown'][p_partkey % 3 + 1] AS params, ['string | null', 'string[]', 'string'][p_partkey % 3 + 1] AS returns, NULL AS data_kind FROM part
  UNION ALL SELECT {_PATH}, concat('C_', p_partkey), 'type', CASE p_partkey % 3 WHEN 2 THEN 5 ELSE 4 END, 0, CASE p_partkey % 3 WHEN 0 THEN 'private' ELSE 'public' END, false, NULL, NULL, ['Struct', 'Interface', 'Class'][p_partkey % 3 + 1] FROM part""")
def index_nodes(spark, sf_dir):
    parsed = frontends.nodes_of(frontends.parse_files(_sources(spark, sf_dir))).where("NOT (node_kind = 'function' AND complexity IS NULL)")
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(" "), p["type_display"])), ", ")
    return parsed.select("file", "name", "node_kind", "start_line", F.coalesce("complexity", F.lit(0)).alias("complexity"), "visibility", F.coalesce("is_async", F.lit(False)).alias("is_async"), params.alias("params"), F.col("return_type_display").alias("returns"), "data_kind")


@_query("index_calls", f"SELECT {_PATH} AS file, concat('fn_', p_partkey) AS caller, concat(['helper_', 'go_', 'other_'][p_partkey % 3 + 1], p_partkey) AS callee, CASE p_partkey % 3 WHEN 1 THEN 'conditional' ELSE 'conditional' END AS condition, false AS is_dynamic FROM part")
def index_calls(spark, sf_dir):
    return frontends.calls_in(_sources(spark, sf_dir)).drop("line")


@_query("index_stats", "SELECT count(*) FILTER (WHERE p_partkey % 7 = 0) AS files_analyzed, 1::BIGINT AS files_removed, count(*) * 3 AS nodes, count(*) AS edges, 0::BIGINT AS resolved, count(*) AS unresolved, 0::BIGINT AS merged, 0::BIGINT AS retargeted FROM part")
def index_stats(spark, sf_dir):
    files = _sources(spark, sf_dir)
    key = F.regexp_extract("path", r"f_(\d+)\.", 1).cast("int")
    older = files.withColumn("content", F.when(key % 7 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    gone = spark.createDataFrame([("src/gone.py", "def gone():\n    pass\n")], "path string, content string")
    return Engine(spark).index(older.unionByName(gone)).index(files).stats


# --- checks of pages and test runs --------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"))


@_query("html_tags")
def html_tags(spark, sf_dir):
    return checks.check_texts(_pages(spark, sf_dir), checks.tag_findings)


@_query("html_attributes", """, l AS (SELECT page_id, i AS line, regexp_replace(s[i], '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT page_id, string_split(replace(replace(html, '><', concat('>', chr(10), '<')), 'href=', '/ ='), chr(10)) AS s FROM pages), unnest(range(1, len(s) + 1)) AS u(i)),
  m AS (SELECT *, strpos(x, '/ ') AS pos, string_split(x, '/ ')[1] AS before FROM l)
  SELECT concat('p', page_id, '.html') AS path, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS col, 'error' AS severity, 'Malformed tag: ''/'' followed by space — did you mean ''/>'' (self-closing)?' AS message FROM m WHERE pos > 0 AND NOT starts_with(x, '//') AND NOT starts_with(x, '*') AND regexp_matches(x, '[<>]') AND NOT contains(before, '//') AND NOT contains(before, '<!--')
  UNION ALL SELECT concat('p', page_id, '.html'), CAST(line AS INTEGER), 0, 'error', 'Attribute value without attribute name' FROM m WHERE contains(x, ' ="') OR starts_with(x, '="')""")
def html_attributes(spark, sf_dir):
    return checks.html_attributes(_pages(spark, sf_dir).withColumn("text", F.replace("text", F.lit("href="), F.lit("/ ="))))


_RUN = "CASE event_type WHEN 'error' THEN concat('FAILED t/f', event_id % 9, '.py::T::test_', event_id, ' - boom') WHEN 'click' THEN concat('E   ValueError: v', event_id) WHEN 'view' THEN concat('t/f.py:', event_id, ': in test_x') WHEN 'signup' THEN 'E   plain' ELSE 'noise' END"


@_query("test_failures", f""", l AS (SELECT user_id AS run, event_id AS no, {_RUN} AS t, event_type FROM events), g AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY run ORDER BY no) AS failure FROM l),
  a AS (SELECT run, failure, min(no) FILTER (WHERE event_type = 'error') AS first, max(no) FILTER (WHERE event_type = 'click') AS typed, max(no) FILTER (WHERE event_type = 'view') AS place FROM g WHERE failure > 0 GROUP BY run, failure)
  SELECT run, concat('T::test_', first) AS test_name, concat('t/f', first % 9, '.py') AS file, coalesce(CAST(place AS INTEGER), 0) AS line, CASE WHEN typed IS NULL THEN 'TestFailure' ELSE 'ValueError' END AS error_type, CASE WHEN typed IS NULL THEN 'boom' ELSE concat('v', typed) END AS error_message FROM a""")
def test_failures(spark, sf_dir):
    lines = lens.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("no"), F.expr(_RUN).alias("text"))
    return checks.test_failures(lines).withColumn("line", F.coalesce("line", F.lit(0)))


__all__ = ["ORACLES", "QUERIES", "Lens", "QueryError"]
