"""Project roll-ups: overview, file map, hotspots, health, callers and callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import STATUS_LANGUAGES, is_test_name, language


#: Nodes that are no placeholders.
REAL = "NOT (node_kind = 'function' AND complexity IS NULL)"


def overview(nodes: DataFrame) -> DataFrame:
    return nodes.where(REAL).agg(F.count_if(F.col("node_kind") == "function").alias("functions"), F.count_if(F.col("node_kind") == "type").alias("types"), F.countDistinct("file").alias("files"), F.countDistinct(language("file")).alias("languages"))


def languages(nodes: DataFrame) -> DataFrame:
    """(language, nodes): as the status shows them."""
    return nodes.where(REAL).groupBy(language("file", STATUS_LANGUAGES, "Other").alias("language")).agg(F.count("*").alias("nodes"))


def status(nodes: DataFrame) -> DataFrame:
    fn = (F.col("node_kind") == "function") & F.col("complexity").isNotNull()
    return nodes.agg(F.count_if(fn).alias("functions"), F.count_if(fn & (F.col("visibility") == "public")).alias("public_functions"), F.count_if(fn & F.col("is_async")).alias("async_functions"), F.count_if(F.col("node_kind") == "type").alias("types"), F.count_if(F.col("node_kind") == "module").alias("modules"))


def file_map(nodes: DataFrame) -> DataFrame:
    """(file, functions, types): sorted names of each file, joined."""
    names = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("node_kind") == kind, F.col("name")))), ",")
    return nodes.where(REAL).where("node_kind IN ('function', 'type')").groupBy("file").agg(names("function").alias("functions"), names("type").alias("types"))


def _neighbours(nodes: DataFrame, edges: DataFrame, own: str, other: str) -> DataFrame:
    """(own, name): real functions and the names of the real nodes that they are linked to, but for themselves."""
    functions = nodes.where("node_kind = 'function' AND complexity IS NOT NULL").select(F.col("node_id").alias(own))
    names = nodes.where(REAL).select(F.col("node_id").alias(other), "name")
    return edges.where("src <> dst").join(functions, own, "left_semi").join(names, other)


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, calls): sorted distinct names of what each function leads to."""
    return _neighbours(nodes, edges, "src", "dst").groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("calls"))


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, called_by): sorted distinct names of what leads to each function; tests are out."""
    found = _neighbours(nodes, edges, "dst", "src").where(~is_test_name("name"))
    return found.groupBy(F.col("dst").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("called_by"))


def hotspots(nodes: DataFrame, edges: DataFrame, complex_from: int = 15, callers_from: int = 5) -> DataFrame:
    """(node_id, reason, value): functions above a complexity, and public ones with many distinct callers."""
    own = nodes.where("node_kind = 'function' AND complexity IS NOT NULL")
    hard = own.where(F.col("complexity") > complex_from).select("node_id", F.lit("complexity").alias("reason"), F.col("complexity").cast("long").alias("value"))
    counted = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("value"))
    busy = own.where("visibility = 'public'").join(counted.where(F.col("value") > callers_from), "node_id").select("node_id", F.lit("callers").alias("reason"), "value")
    return hard.unionByName(busy)


def top(nodes: DataFrame, by: Column, above: int, n: int = 5) -> DataFrame:
    """The n functions of the highest value above a limit, ties by file, line and id."""
    own = nodes.where("node_kind = 'function' AND complexity IS NOT NULL").withColumn("value", by.cast("long")).where(F.col("value") > above)
    return own.orderBy(F.desc("value"), "file", "start_line", "node_id").limit(n).select("node_id", "name", "value")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """100, less three a hotspot up to 30: as snapshots have it."""
    return hotspots(nodes, edges).agg((F.lit(100) - F.least(F.count("*") * 3, F.lit(30))).alias("health"))


def health_by_nodes(nodes: DataFrame, wide: bool = False) -> DataFrame:
    """100, less three a function of a complexity above 15 up to 30, as manifests have it; with ``wide`` also two a
    function of more than four parameters up to 15, as the status has it."""
    own = nodes.where("node_kind = 'function' AND complexity IS NOT NULL")
    hard = F.least(F.count_if(F.col("complexity") > 15) * 3, F.lit(30))
    many = F.least(F.count_if(F.size("params") > 4) * 2, F.lit(15)) if wide else F.lit(0)
    return own.agg((F.lit(100) - hard - many).alias("health"))
