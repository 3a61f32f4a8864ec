"""The engine as one object: index files, then query, follow impact, verify, and mine conventions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conventions, graph, index, report, snapshot
from .operators.storage import cut
from .plans.language import described, execute
from .sources import frontends


@dataclass(frozen=True)
class State:
    """What an index holds: parsed nodes and edges as the frontends gave them, and the manifest (path, hash)."""

    nodes: DataFrame
    edges: DataFrame
    manifest: DataFrame


def link_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, loose, merged): placeholders with a candidate, those without, and what of these goes as one of a name."""
    links = cut(graph.linked(nodes))
    loose = graph.unresolved(nodes, links)
    return links, loose, cut(graph.merged_duplicates(loose))


def link_stats(links: DataFrame, loose: DataFrame, merged: DataFrame, touched: DataFrame) -> DataFrame:
    """One row, resolved, unresolved, merged, retargeted. touched: the edges that end in links or merged."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(links, "resolved").crossJoin(one(loose, "unresolved")).crossJoin(one(merged, "merged")).crossJoin(one(touched, "retargeted"))  # one row each


def linked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) after linking: placeholders with a candidate are replaced by it, the others of one name are
    one. stats: as link_stats() gives them."""
    links, loose, merged = link_tables(nodes)
    mapping = links.unionByName(merged)
    whole = edges.select("src", "dst", "edge_kind")
    moved = graph.retargeted(whole, mapping).distinct()
    touched = whole.join(mapping.select(F.col("old_id").alias("dst")), "dst", "left_semi")
    left = nodes.join(mapping, F.col("node_id") == F.col("old_id"), "left_anti")
    return left, moved, link_stats(links, loose, merged, touched)


def index_files(files: DataFrame, before: State | None = None, registry=frontends.FRONTENDS) -> tuple[State, DataFrame]:
    """(state, changes) of files (path, content) after those of a former state: only added and modified files are parsed,
    rows of modified and deleted ones go. Ids depend on path and name alone, so edges from files that stay still hold."""
    known = files.where(F.substring_index("path", ".", -1).isin(*frontends.by_extension(registry)))
    manifest = index.hashed(known)
    old = manifest.limit(0) if before is None else before.manifest
    changed = cut(index.detect_changes(old, manifest))
    fresh = known.join(changed.where("change <> 'Deleted'"), "path", "left_semi")
    parsed = cut(frontends.parse_files(fresh, registry))
    nodes, edges = frontends.nodes_of(parsed), frontends.edges_of(parsed)
    if before is not None:
        gone = changed.select(F.col("path").alias("file"))
        nodes = before.nodes.join(gone, "file", "left_anti").unionByName(nodes)
        edges = before.edges.join(gone, "file", "left_anti").unionByName(edges)
    return State(nodes, edges, index.commit_changes(old, manifest, changed)), changed


@dataclass(frozen=True)
class Engine:
    """A project. Frames are planned when asked for; nothing is gathered on the driver but documents."""

    spark: SparkSession
    state: State | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    stats: DataFrame | None = None
    registry: tuple = field(default=frontends.FRONTENDS)

    def register(self, frontend: frontends.Frontend) -> Engine:
        """An engine that asks this frontend first."""
        return replace(self, registry=(frontend, *self.registry))

    def index(self, files: DataFrame) -> Engine:
        """The engine after indexing files (path, content), the whole project; only what changed is parsed."""
        state, changed = index_files(files, self.state, self.registry)
        nodes, edges, stats = linked(state.nodes, state.edges)
        nodes, edges = cut(nodes), cut(graph.resolved(edges, nodes))
        counts = changed.agg(F.count_if(F.col("change") != "Deleted").alias("files_analyzed"), F.count_if(F.col("change") == "Deleted").alias("files_removed"))
        total = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
        return replace(self, state=state, nodes=nodes, edges=edges, stats=counts.crossJoin(total).crossJoin(stats))

    def index_folder(self, root: str) -> Engine:
        return self.index(index.discover(self.spark, root, tuple(frontends.by_extension(self.registry))))

    def query(self, text: str) -> DataFrame:
        """The nodes that a FIND query matches, as results show them."""
        return described(execute(text, self.nodes, lambda: self.edges))

    def impact(self, file: str, name: str | None = None, depth: int = 5, reverse: bool = False) -> DataFrame:
        """(root, node_id, distance, path) from a file's function of a name, or from its first node."""
        own = graph.file_by_suffix(self.nodes, file.replace("\\", "/"))
        if name is not None:
            own = own.where((F.col("node_kind") == "function") & (F.col("short_name") == name))
        root = own.orderBy("start_line", "node_id").limit(1).select(F.col("node_id").alias("root"))
        return graph.impact(self.edges, root, depth, reverse, paths=True)

    def verify(self, base: Engine | None, errors: DataFrame | None = None, **how) -> report.Verification:
        """This state against a former one."""
        real = lambda e: e.nodes.where("node_kind = 'function'")
        return report.verified(None if base is None else real(base), real(self), self.edges, errors=errors, nodes=self.nodes, **how)

    def invariants(self) -> DataFrame:
        return conventions.discovered(self.nodes, self.edges)

    def snapshot(self) -> snapshot.Snapshot:
        return snapshot.taken(self.nodes, self.edges)
