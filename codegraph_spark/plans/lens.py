"""The driver tables seen as a code graph: parts are functions, suppliers types, nations modules, customers bindings.

Node and edge frames have the engine's schema, so every operator runs on them as on a parsed source tree. LENS_SQL
builds the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameter types after the first, by (key + position) % 5; return types, by key % 5. Fixed values of the lens.
PARAM_TYPES = ["Resolved(Primitive(Int32))", "Resolved(Primitive(String))", "Unknown", 'Unresolved("Vec<u8>")', "Resolved(Unit)"]
RETURN_TYPES = ["Resolved(Result { ok: Primitive(Int32), err: Primitive(String) })", 'Unresolved("Result<T>")', None, "Resolved(Primitive(Int32))", "Resolved(Unit)"]
DATA_KINDS = ["Struct", "Class", "Interface", "Trait", "Enum", "Union", "TypeAlias"]


def _pick(values: list[str | None], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v + "'") for k, v in enumerate(values)) + " END"


_SHORT = """CASE WHEN k % 30 = 18 THEN concat('fn_', CAST(k AS {s})) WHEN k % 30 = 19 THEN concat('self.graph.fn_', CAST(k - 1 AS {s}))
  WHEN k % 30 = 29 THEN concat('ext::call_', CAST(k % 300 AS {s})) WHEN k % 97 = 0 THEN concat('init_', CAST(k AS {s}))
  WHEN k % 52 = 0 THEN concat(upper(substring(p_name, 1, 1)), replace(substring(p_name, 2), ' ', '_')) ELSE replace(p_name, ' ', '_') END"""
_FILE = "concat('src/', lower(p_type), '/', CASE WHEN k % 17 = 0 THEN 'test_mod_' ELSE 'mod_' END, CAST(k % 40 AS {s}), CASE k % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' ELSE '.py' END)"
_PARAM = "CASE WHEN i = 0 THEN concat('Unresolved(\"T_', p_type, '_', CAST(k % 120 AS {s}), '\")') ELSE " + _pick(PARAM_TYPES, "(k + i) % 5") + " END"
_VISIBILITY = "CASE WHEN k % 10 = 9 THEN 'private' WHEN k % 4 = 0 THEN 'public' WHEN k % 4 = 1 THEN 'private' WHEN k % 4 = 2 THEN 'protected' ELSE 'internal' END"


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read once for each application."""
    key = spark.sparkContext.applicationId, id(spark), sf_dir, name
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function nodes; a NULL complexity marks a placeholder."""
    s = {"s": "STRING"}
    rows = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).withColumn("short_name", F.expr(_SHORT.format(**s)))
    params = f"transform(sequence(0, cast(k % 6 as int)), i -> named_struct('name', concat('p', cast(i as string)), 'type_debug', {_PARAM.format(**s)}))"
    return rows.select(
        (F.col("k") + 1_000_000).alias("node_id"), F.lit("function").alias("node_kind"), F.concat_ws("::", "p_brand", "short_name").alias("name"), "short_name",
        F.expr(_FILE.format(**s)).alias("file"), F.expr("cast(k % 500 + 1 as int)").alias("start_line"), F.expr(_VISIBILITY).alias("visibility"),
        F.expr("CASE WHEN k % 10 <> 9 THEN p_size END").alias("complexity"), F.expr("k % 3 = 0").alias("is_async"), F.expr("k % 7 = 0").alias("is_unsafe"),
        F.expr(f"slice({params}, 1, cast(k % 6 as int))").alias("params"), F.expr(_pick(RETURN_TYPES, "k % 5")).alias("return_type_debug"),
    )


def _empty(df: DataFrame) -> DataFrame:
    """The columns a kind of node does not have, as nulls."""
    kinds = {"visibility": "string", "complexity": "int", "is_async": "boolean", "is_unsafe": "boolean", "params": "array<struct<name:string,type_debug:string>>", "return_type_debug": "string", "data_kind": "string", "fields": "array<string>", "implements": "array<string>", "is_constant": "boolean"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node kinds in one wide frame."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    types = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (k + 2_000_000).alias("node_id"), F.lit("type").alias("node_kind"), F.col("s_name").alias("name"), F.col("s_name").alias("short_name"),
        F.concat(F.lit("src/types/t_"), (k % 12).cast("string"), F.lit(".ts")).alias("file"), F.expr("cast(s_suppkey % 500 + 1 as int)").alias("start_line"),
        F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'public' ELSE 'private' END").alias("visibility"), F.expr(_pick(DATA_KINDS, "s_nationkey % 7")).alias("data_kind"),
        F.expr("slice(transform(sequence(0, cast(s_suppkey % 9 as int)), i -> concat('f', cast(i as string))), 1, cast(s_suppkey % 9 as int))").alias("fields"),
        F.array(F.concat(F.lit('Unresolved("'), "n_name", F.lit('")'))).alias("implements"),
    )
    modules = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 3_000_000).cast("long").alias("node_id"), F.lit("module").alias("node_kind"), F.concat_ws("::", "r_name", "n_name").alias("name"),
        F.col("n_name").alias("short_name"), F.concat(F.lit("src/"), "r_name", F.lit("/mod.rs")).alias("file"), F.expr("cast(n_nationkey % 500 + 1 as int)").alias("start_line"),
    )
    bindings = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 4_000_000).alias("node_id"), F.lit("binding").alias("node_kind"), F.concat_ws("::", "c_mktsegment", "c_name").alias("name"), F.col("c_name").alias("short_name"),
        F.concat(F.lit("src/consts/c_"), (F.col("c_custkey") % 20).cast("string"), F.lit(".py")).alias("file"), F.expr("cast(c_custkey % 500 + 1 as int)").alias("start_line"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'internal' END").alias("visibility"), F.expr("c_custkey % 2 = 0").alias("is_constant"),
    )
    out = _empty(functions(spark, sf_dir))
    for other in (types, modules, bindings):
        out = out.unionByName(_empty(other))
    return out


def raw_edges(spark: SparkSession, sf_dir: str, into: DataFrame | None = None) -> DataFrame:
    """Calls between parts on neighbouring order lines, calls of types, containment, and some that dangle.

    into: (dst): only the edges that end there, all others being left out before lines are joined.
    """
    ends = lambda df: df if into is None else df.join(into, "dst", "left_semi").select(*df.columns)
    lines = table(spark, sf_dir, "lineitem")
    # The lines that call are few beside all lines: they are hashed, and the others are not sorted.
    a = lines.where("l_quantity <= 6").hint("shuffle_hash").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), (F.col("l_partkey") + 1_000_000).alias("src"))
    b = ends(lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1_000_000).alias("dst")))
    kind = lambda x: F.lit(x).alias("edge_kind")
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst", kind("calls")).distinct()
    made = lines.where("l_quantity <= 1").select((F.col("l_partkey") + 1_000_000).alias("src"), (F.col("l_suppkey") + 2_000_000).alias("dst"), kind("calls"))
    within = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 3_000_000).cast("long").alias("src"), (F.col("s_suppkey") + 2_000_000).alias("dst"), kind("contains"))
    loose = table(spark, sf_dir, "part").where("p_partkey % 500 = 0").select((F.col("p_partkey") + 1_000_000).alias("src"), (F.col("p_partkey") + 9_000_000).alias("dst"), kind("calls"))
    return calls.unionByName(ends(made).distinct()).unionByName(ends(within)).unionByName(ends(loose))


def new_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of the functions, with fixed edits by key."""
    k = "(node_id - 1000000)"
    old = functions(spark, sf_dir).where(f"{k} % 11 <> 0")
    turned = "CASE visibility WHEN 'public' THEN 'private' WHEN 'private' THEN 'protected' WHEN 'protected' THEN 'internal' ELSE 'public' END"
    edited = old.withColumns({
        "visibility": F.expr(f"CASE WHEN {k} % 29 = 0 THEN {turned} ELSE visibility END"),
        "complexity": F.expr(f"cast(complexity + {k} % 7 as int)"),
        "is_async": F.expr(f"CASE WHEN {k} % 31 = 0 THEN NOT is_async ELSE is_async END"),
        "return_type_debug": F.expr(f"CASE WHEN {k} % 23 = 0 THEN 'Resolved(Primitive(Bool))' ELSE return_type_debug END"),
        "params": F.expr(f"CASE WHEN {k} % 13 = 0 THEN concat(params, array(named_struct('name', 'extra', 'type_debug', 'Unknown'))) WHEN {k} % 19 = 0 THEN transform(params, (p, i) -> named_struct('name', p.name, 'type_debug', CASE WHEN i = 0 THEN 'Unresolved(\"Changed\")' ELSE p.type_debug END)) ELSE params END"),
    })
    added = old.limit(0).sparkSession.range(50).select((F.col("id") + 1_900_000).alias("node_id"), F.lit("function").alias("node_kind"), F.concat(F.lit("New::added_"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("added_"), F.col("id").cast("string")).alias("short_name"), F.lit("src/added/mod_0.rs").alias("file"), F.lit(1).alias("start_line"), F.expr("CASE id % 2 WHEN 0 THEN 'public' ELSE 'private' END").alias("visibility"), F.lit(1).alias("complexity"), F.lit(False).alias("is_async"), F.lit(False).alias("is_unsafe"), F.expr("cast(array() as array<struct<name:string,type_debug:string>>)").alias("params"), F.lit(None).cast("string").alias("return_type_debug"))
    return edited.unionByName(added)


_V = {"s": "VARCHAR"}
LENS_SQL = f"""
fns AS (
  SELECT k + 1000000 AS node_id, 'function' AS node_kind, concat(p_brand, '::', short_name) AS name, short_name, {_FILE.format(**_V)} AS file, CAST(k % 500 + 1 AS INTEGER) AS start_line,
    {_VISIBILITY} AS visibility, CASE WHEN k % 10 <> 9 THEN p_size END AS complexity, k % 3 = 0 AS is_async, k % 7 = 0 AS is_unsafe,
    list_transform(range(k % 6), lambda i: {_PARAM.format(**_V)}) AS params, {_pick(RETURN_TYPES, "k % 5")} AS return_type_debug
  FROM (SELECT *, p_partkey AS k, {_SHORT.format(**_V).replace(" k ", " p_partkey ").replace("(k ", "(p_partkey ")} AS short_name FROM part)),
nodes AS (
  SELECT *, NULL::VARCHAR AS data_kind, NULL::VARCHAR[] AS fields, NULL::VARCHAR[] AS implements, NULL::BOOLEAN AS is_constant FROM fns
  UNION ALL SELECT s_suppkey + 2000000, 'type', s_name, s_name, concat('src/types/t_', CAST(s_suppkey % 12 AS VARCHAR), '.ts'), CAST(s_suppkey % 500 + 1 AS INTEGER), CASE s_suppkey % 2 WHEN 0 THEN 'public' ELSE 'private' END, NULL, NULL, NULL, NULL, NULL,
    {_pick(DATA_KINDS, "s_nationkey % 7")}, list_transform(range(s_suppkey % 9), lambda i: concat('f', CAST(i AS VARCHAR))), [concat('Unresolved("', n_name, '")')], NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey + 3000000, 'module', concat(r_name, '::', n_name), n_name, concat('src/', r_name, '/mod.rs'), CAST(n_nationkey % 500 + 1 AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 4000000, 'binding', concat(c_mktsegment, '::', c_name), c_name, concat('src/consts/c_', CAST(c_custkey % 20 AS VARCHAR), '.py'), CAST(c_custkey % 500 + 1 AS INTEGER), CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'internal' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_custkey % 2 = 0 FROM customer),
raw_edges AS (
  SELECT DISTINCT a.l_partkey + 1000000 AS src, b.l_partkey + 1000000 AS dst, 'calls' AS edge_kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity <= 6 AND a.l_partkey <> b.l_partkey
  UNION ALL SELECT DISTINCT l_partkey + 1000000, l_suppkey + 2000000, 'calls' FROM lineitem WHERE l_quantity <= 1
  UNION ALL SELECT s_nationkey + 3000000, s_suppkey + 2000000, 'contains' FROM supplier
  UNION ALL SELECT p_partkey + 1000000, p_partkey + 9000000, 'calls' FROM part WHERE p_partkey % 500 = 0),
edges AS (SELECT * FROM raw_edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes))
"""
_K = "(node_id - 1000000)"
NEW_SQL = f"""
newer AS (
  SELECT node_id, node_kind, name, short_name, file, start_line,
    CASE WHEN {_K} % 29 = 0 THEN CASE visibility WHEN 'public' THEN 'private' WHEN 'private' THEN 'protected' WHEN 'protected' THEN 'internal' ELSE 'public' END ELSE visibility END AS visibility,
    CAST(complexity + {_K} % 7 AS INTEGER) AS complexity, CASE WHEN {_K} % 31 = 0 THEN NOT is_async ELSE is_async END AS is_async, is_unsafe,
    CASE WHEN {_K} % 13 = 0 THEN list_append(params, 'Unknown') WHEN {_K} % 19 = 0 THEN list_transform(params, lambda p, i: CASE WHEN i = 1 THEN 'Unresolved("Changed")' ELSE p END) ELSE params END AS params,
    CASE WHEN {_K} % 23 = 0 THEN 'Resolved(Primitive(Bool))' ELSE return_type_debug END AS return_type_debug
  FROM fns WHERE {_K} % 11 <> 0
  UNION ALL SELECT i + 1900000, 'function', concat('New::added_', i), concat('added_', i), 'src/added/mod_0.rs', 1, CASE i % 2 WHEN 0 THEN 'public' ELSE 'private' END, 1, false, false, [], NULL FROM range(50) t(i))
"""
