"""Conventions mined from the graph: error handling, naming, call order, type usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_pascal_case, is_snake_case
from .graph import impact


def error_handling(nodes: DataFrame) -> DataFrame:
    """If three functions or more return a Result: how many, of all nodes, and the confidence."""
    result = F.startswith("return_type_debug", F.lit("Resolved(Result")) | F.startswith("return_type_debug", F.lit('Unresolved("Result'))
    n = nodes.agg(F.count_if((F.col("node_kind") == "function") & F.coalesce(result, F.lit(False))).alias("functions"), F.count("*").alias("nodes"))
    return n.where("functions >= 3").withColumn("confidence", F.round(F.least(F.col("functions") / F.col("nodes"), F.lit(1.0)) * 0.8 + 0.1, 6))


def naming(nodes: DataFrame, kind: str, least: int) -> DataFrame:
    """Public functions in snake_case, or public types in PascalCase, if there are enough and nine in ten conform."""
    good = is_snake_case("short_name") if kind == "function" else is_pascal_case("short_name")
    own = nodes.where((F.col("node_kind") == kind) & (F.col("visibility") == "public"))
    n = own.agg(F.count("*").alias("total"), F.count_if(good).alias("conforming"))
    return n.where(f"total >= {least} AND conforming / total > 0.9").withColumn("confidence", F.round(F.col("conforming") / F.col("total"), 6))


def call_ordering(nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, affected): initialisers that reach three nodes or more."""
    roots = nodes.where("node_kind = 'function' AND (short_name IN ('init', 'new') OR startswith(short_name, 'init'))")
    reached = impact(edges, roots.select(F.col("node_id").alias("root")), depth)
    return reached.groupBy("root").agg(F.count("*").alias("affected")).where("affected >= 3")


def type_usage(nodes: DataFrame) -> DataFrame:
    """(type_debug, users, file): parameter types used three times or more, in one file only."""
    each = nodes.where("node_kind = 'function'").select("file", F.explode("params").alias("p")).select("file", "p.type_debug")
    n = each.groupBy("type_debug").agg(F.count("*").alias("users"), F.min("file").alias("file"), F.max("file").alias("last"))
    return n.where("users >= 3 AND file = last").drop("last")


def _percent(part: str, whole: str) -> F.Column:
    """A ratio as whole percents; halves go to the even neighbour."""
    return F.concat(F.bround(F.col(part) / F.col(whole) * 100).cast("int").cast("string"), F.lit("%"))


def scopes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, description, confidence, evidence, node_id, file, line): the nodes that each convention holds for.

    Naming conventions hold for no node in particular and are not here.
    """
    place = [F.col("node_id"), F.col("file"), F.col("start_line").alias("line")]
    result = F.startswith("return_type_debug", F.lit("Resolved(Result")) | F.startswith("return_type_debug", F.lit('Unresolved("Result'))
    errors = error_handling(nodes).select(F.concat(F.lit("Found "), F.col("functions").cast("string"), F.lit(" functions returning Result — errors should be handled, not silently ignored")).alias("description"), "confidence", F.col("functions").alias("evidence"))
    handled = nodes.where("node_kind = 'function'").where(F.coalesce(result, F.lit(False))).select(*place).join(F.broadcast(errors))  # one row at most
    order = call_ordering(nodes, edges).withColumnRenamed("root", "node_id")
    before = nodes.select(*place).join(order, "node_id").select(F.concat(F.lit("Initialization function leads to "), F.col("affected").cast("string"), F.lit(" downstream operations")).alias("description"), F.lit(0.7).alias("confidence"), F.col("affected").alias("evidence"), "node_id", "file", "line")
    users = nodes.where("node_kind = 'function'").select(*place, F.explode("params").alias("p")).select("node_id", "line", "p.type_debug")
    usage = type_usage(nodes).join(users, "type_debug").select(F.concat(F.lit("Type "), "type_debug", F.lit(" is only used in "), "file", F.lit(" ("), F.col("users").cast("string"), F.lit(" occurrences)")).alias("description"), F.lit(0.6).alias("confidence"), F.col("users").alias("evidence"), "node_id", "file", "line")
    kinds = (("ErrorsMustBeHandled", handled), ("MustPrecede", before), ("TypeUsageConstraint", usage))
    columns = ["kind", "description", "confidence", "evidence", "node_id", "file", "line"]
    first, *more = [df.withColumn("kind", F.lit(kind)).select(columns) for kind, df in kinds]
    for df in more:
        first = first.unionByName(df)
    return first


def discovered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, description, confidence, evidence): all conventions, one row each."""
    out = None
    for kind, least, what in (("function", 5, "Public functions use snake_case ("), ("type", 3, "Public types use PascalCase (")):
        rows = naming(nodes, kind, least)
        text = F.concat(F.lit(what), F.col("conforming").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" = "), _percent("conforming", "total"), F.lit(")"))
        rows = rows.select(F.lit("ConventionConstraint").alias("kind"), text.alias("description"), "confidence", F.col("conforming").alias("evidence"))
        out = rows if out is None else out.unionByName(rows)
    scoped = scopes(nodes, edges)
    one = F.when(F.col("kind") == "MustPrecede", F.col("node_id")).otherwise(F.lit(0))  # each such function is one
    return out.unionByName(scoped.withColumn("one", one).select("kind", "description", "confidence", "evidence", "one").distinct().drop("one"))


def mining_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes_analyzed, found): one row."""
    found = discovered(nodes, edges).agg(F.count("*").alias("found"))
    return nodes.agg(F.count("*").alias("nodes_analyzed")).crossJoin(found)  # one row each
