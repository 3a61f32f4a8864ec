"""The property graph: edge resolution, linking of placeholders, removal, and impact by bounded search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes. Ids are few and short beside edges, so they are hashed and no edge is sorted."""
    ids = nodes.select("node_id").hint("shuffle_hash")
    return edges.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")


def without_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Nodes that are not in the file, those without a file among them, and the edges that touch none of the file's ids:
    an id that other files have too goes with the file's edges."""
    inside = F.col("file").eqNullSafe(F.lit(file))
    left, gone = nodes.where(~inside), nodes.where(inside).select("node_id")
    kept = resolved(edges, left)
    for end in ("src", "dst"):
        kept = kept.join(gone, F.col(end) == F.col("node_id"), "left_anti")
    return left, kept


def retargeted(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced as mapping (old_id, new_id) says."""
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    return moved.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "edge_kind")


def link_key(short: str = "short_name") -> F.Column:
    """What a placeholder is looked up by: the short name behind its last '::' or, failing that, its last '.'."""
    dotted, scoped = F.substring_index(short, ".", -1), F.substring_index(short, "::", -1)
    return F.when(F.contains(F.col(short), F.lit(".")) & (dotted != ""), dotted).when(F.contains(F.col(short), F.lit("::")) & (scoped != ""), scoped).otherwise(F.col(short))


def _directory(file: str) -> F.Column:
    return F.regexp_replace(file, "/[^/]*$", "")


#: The scores that a candidate can have by itself, from the highest on.
SCORES = (10, 5, 0, -5)


def linked(nodes: DataFrame) -> DataFrame:
    """(old_id, new_id): each placeholder that has candidates, and the best of them.

    Public functions score 10, internal ones 5, the same directory 20, a path with 'test' -5; ties go to the smaller id.
    """
    empty = "node_kind = 'function' AND complexity IS NULL"
    # Unknown directories are '' where they offer and NULL where they ask, so they never meet, and no filter of NULLs
    # keeps the two uses of near from being one.
    directory = F.concat(F.lit("/"), _directory("file"))
    asked = nodes.where(empty).select(F.col("node_id").alias("old_id"), link_key().alias("key"), directory.alias("directory"))
    own = nodes.where(f"NOT ({empty})")
    names = F.array_distinct(F.array("short_name", F.substring_index("short_name", "::", -1), F.substring_index("short_name", ".", -1)))
    offered = own.select(F.col("node_id").alias("new_id"), F.explode(names).alias("key"), F.coalesce(directory, F.lit("")).alias("directory"), "file", "visibility", "node_kind").where("key <> ''")
    score = F.when((F.col("node_kind") == "function") & (F.col("visibility") == "public"), 10).when((F.col("node_kind") == "function") & (F.col("visibility") == "internal"), 5).otherwise(0) - F.when(F.contains("file", F.lit("test")), 5).otherwise(0)
    # The directory's 20 points are all that depends on who asks: a key's best in each directory and its best of all will
    # do. Scores are few, so the best is the smallest id of the highest score that has one; such minima need no sort.
    offered = offered.withColumn("score", score)
    near = offered.groupBy("key", "directory").agg(*(F.min(F.when(F.col("score") == x, F.col("new_id"))).alias(f"near{x}") for x in SCORES))
    all_best = near.groupBy("key").agg(*(F.min(f"near{x}").alias(f"any{x}") for x in SCORES))
    # The directory's own best, 20 points up, beats all others: scores differ by 15 at most.
    met = asked.join(all_best, "key").join(near, ["key", "directory"], "left")
    return met.groupBy("old_id").agg(*(F.min(f"{of}{x}").alias(f"{of}{x}") for of in ("near", "any") for x in SCORES)).select("old_id", F.coalesce(*(f"{of}{x}" for of in ("near", "any") for x in SCORES)).alias("new_id"))


def unresolved(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Placeholders without a candidate."""
    return nodes.where("node_kind = 'function' AND complexity IS NULL").join(links, F.col("node_id") == F.col("old_id"), "left_anti")


def merged_duplicates(left: DataFrame) -> DataFrame:
    """(old_id, new_id): unresolved placeholders of one name are one, the smallest."""
    first = left.groupBy("name").agg(F.min("node_id").alias("new_id"), F.count("*").alias("n")).where("n > 1")
    return left.join(first, "name").where("node_id <> new_id").select(F.col("node_id").alias("old_id"), "new_id")


def impact(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False, paths: bool = False) -> DataFrame:
    """(root, node_id, distance): what each root reaches within depth steps, itself left out.

    roots: (root). A level joins the last frontier with the edges and drops what was met before; the frontier and the
    visited set are keyed by root, so many searches run as one. Steps and frontiers are cut off from their plans, or
    each level would hold all former ones; the search ends where nothing new is met. With ``paths``, also the ids from
    the root on, by way of the smallest of the nodes that lead to a node.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct())
    path = [F.array("root").alias("path")] if paths else []
    seen = frontier = roots.select("root", F.col("root").alias("node_id"), F.lit(0).alias("distance"), *path).distinct()
    for level in range(1, depth + 1):
        step = frontier.join(steps, F.col("node_id") == F.col("at")).withColumnRenamed("next", "found")
        step = step.groupBy("root", "found").agg(F.min_by("path", "node_id").alias("path")) if paths else step.select("root", "found").distinct()
        new = [F.concat("path", F.array("node_id")).alias("path")] if paths else []
        step = step.withColumnRenamed("found", "node_id").join(seen.select("root", "node_id"), ["root", "node_id"], "left_anti")
        frontier = cut(step.select("root", "node_id", F.lit(level).alias("distance"), *new))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def impact_risk(reached: DataFrame) -> DataFrame:
    """(root, affected, risk): min(ln(affected) / 10, 1)."""
    n = reached.groupBy("root").agg(F.count("*").alias("affected"))
    return n.withColumn("risk", F.round(F.least(F.ln("affected") / 10, F.lit(1.0)), 6))


def find_target(nodes: DataFrame, file: str, name: str | None = None) -> DataFrame:
    """The function of that short name in the file, or the file's first node."""
    own = nodes.where(F.col("file") == file)
    if name is not None:
        own = own.where((F.col("node_kind") == "function") & (F.col("short_name") == name))
    return own.orderBy("start_line", "node_id").limit(1)


def file_by_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    """Nodes of the file of that path or, if there is none, of the first file that ends with it or is its end."""
    hit = nodes.where(F.endswith("file", F.lit(suffix)) | F.endswith(F.lit(suffix), F.col("file")))
    rank = F.struct((F.col("file") != suffix).alias("r"), F.col("file"))
    return hit.join(hit.agg(F.min(rank).alias("best")).select("best.file"), "file", "left_semi")


def cross_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_file, to_file, caller, callee) of edges from any node to functions of other files, by full names; callers
    that are tests are out, and so are placeholders as callees."""
    from ..functions.names import is_test_name

    a = nodes.select(F.col("node_id").alias("src"), F.col("file").alias("from_file"), F.col("name").alias("caller"))
    b = nodes.where("node_kind = 'function' AND complexity IS NOT NULL").select(F.col("node_id").alias("dst"), F.col("file").alias("to_file"), F.col("name").alias("callee"))
    met = edges.select("src", "dst").distinct().join(a.where(~is_test_name("caller")), "src").join(b, "dst")
    return met.where("from_file <> to_file").select("from_file", "to_file", "caller", "callee")


def without_node(nodes: DataFrame, edges: DataFrame, node_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes but one, and the edges that do not touch it."""
    return nodes.where(F.col("node_id") != node_id), edges.where((F.col("src") != node_id) & (F.col("dst") != node_id))


def with_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes with more added; of one id the added node stands."""
    return nodes.join(more.select("node_id"), "node_id", "left_anti").unionByName(more, allowMissingColumns=True)
