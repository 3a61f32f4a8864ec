"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are put in lexicographic order of concatenated random hashes (the signs of their
products with ``BITS`` random directions), and each is compared with its next ``window`` neighbours. Links found, of a
cosine of ``least`` or more in double precision, are united across passes to components. The number of passes follows
the number of vectors, so that a pair at the threshold stays likely to meet as tables grow; see passes_for().

A window bounds what a pass compares, but not what is counted: inside each component all pairs are then compared, in
blocks of ``CHUNK`` by ``CHUNK`` vectors dealt over tasks, and only counts leave the blocks. So however many vectors
lie close together, none is capped and no pair list is made. Passes hand on the links of a spanning forest of each
partition only.

Equal vectors of a label are one class, represented by the smallest vec_id; the classes go through the passes.
Vectors that are null, zero, or hold null, NaN or infinity, and rows without a label, link with nothing and are their
own component. Vectors of different lengths do not link. Rows that repeat a vec_id are vectors of their own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import saved

BITS, WINDOW, CHUNK, PARTITION = 32, 32, 1024, 20_000


def passes_for(n: int, least: float, window: int = WINDOW, missed: float = 0.001) -> int:
    """Passes after which a pair at the threshold has been missed with odds of about ``missed``.

    Signs of such a pair agree with odds of 1 - angle / pi each; in a sorted label of n vectors they are neighbours
    if about log2(n / window) leading signs agree.
    """
    same = 1 - math.acos(least) / math.pi
    met = same ** max(1.0, math.log2(max(2.0, n / window)))
    return max(4, math.ceil(math.log(missed) / math.log(1 - met)))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (of places) that suffice to connect what the given ones connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _window_links(group: np.ndarray, x: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs among rows that lie at most ``window`` apart and have the same group."""
    a, b = [], []
    for step in range(1, min(window, len(x) - 1) + 1):
        near = np.flatnonzero(group[:-step] == group[step:])
        near = near[np.einsum("ij,ij->i", x[near], x[near + step]) >= least]
        a.append(near)
        b.append(near + step)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _sorted_passes(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """(turn, label, dim, key, id, v): each class once a pass, with its hash."""

    def hashes(batches):
        for batch in batches:
            dims, v = batch.column(1).to_numpy(), batch.column(3)
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                own, x = batch.take(at), _unit(v.take(at))
                for turn in range(passes):
                    signs = x @ np.random.default_rng([seed, turn, int(dim)]).standard_normal((dim, BITS)) > 0
                    key = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), turn, np.int32)), own.column(0), own.column(1), pa.array(key), own.column(2), own.column(3)], names=["turn", "label", "dim", "key", "id", "v"])

    return classes.select("label", "dim", "id", "v").mapInArrow(hashes, "turn int, label string, dim int, key long, id long, v array<double>")


def _links(ordered: DataFrame, partitions: int, window: int, least: float) -> DataFrame:
    """(a, b): spanning links of each partition of the sorted passes, and of the windows across their borders."""
    columns = ["turn", "label", "dim", "key", "id"]
    dealt = ordered.repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)

    def group_of(batch):
        return np.array([hash((t, zlib.crc32(k.encode()), d)) for t, k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)

    names = ["a", "b", "border", "place", "grp", "v"]

    def links_of(group, ids, x):
        a, b = [], []
        for dim in {len(v) for v in x}:
            at = np.flatnonzero([len(v) == dim for v in x])
            m = np.stack([x[i] for i in at])
            p, q = _window_links(group[at], m, window, least)
            a.append(at[p])
            b.append(at[q])
        pairs = _forest(np.concatenate(a), np.concatenate(b)) if a else []
        return [(int(ids[p]), int(ids[q])) for p, q in pairs]

    def compare(batches):
        group, ids, x = [], [], []
        for batch in batches:
            group.append(group_of(batch))
            ids.append(batch.column(4).to_numpy())
            for dim, lo, hi in _runs(batch.column(2).to_numpy()):
                x.extend(_unit(batch.column(5).slice(lo, hi - lo)) if dim else [])
        if not ids:
            return
        group, ids, here = np.concatenate(group), np.concatenate(ids), TaskContext.get().partitionId()
        rows = [(a, b, None, None, None, None) for a, b in links_of(group, ids, x)]
        n = len(ids)
        for i in range(min(window, n)):
            rows.append((int(ids[i]), None, here, window + i, int(group[i]), x[i].tolist()))
        for i in range(max(0, n - window), n):
            rows.append((int(ids[i]), None, here + 1, i - n + window, int(group[i]), x[i].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
    found = saved(dealt.mapInArrow(compare, "a long, b long, border int, place int, grp long, v array<double>"), "passes")

    def across(table):
        table = table.sort_by("place")
        pairs = links_of(table.column("grp").to_numpy(), table.column("a").to_numpy(), [np.array(v) for v in table.column("v").to_pylist()])
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    border = found.where("border is not null").groupBy("border").applyInArrow(across, "a long, b long")
    return found.where("border is null").select("a", "b").unionByName(border)


def _runs(values: np.ndarray):
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(values[lo]), int(lo), int(hi)


def _counts(members: DataFrame, least: float, per_task: int = 4000) -> DataFrame:
    """(id, linked): how many vectors of other classes of its component each class links with.

    members: (component, id, n, dim, v), n the size of the class. Components larger than CHUNK are cut into chunks,
    and each pair of chunks is a group; smaller ones are put together in groups of about per_task vectors.
    """
    sizes = saved(members.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    small = sizes.where(F.col("size") <= CHUNK).agg(F.sum("size")).first()[0] or 0
    bins = max(1, small // per_task)
    placed = members.join(sizes, "component").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    placed = placed.withColumn("chunk", chunk).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    placed = placed.withColumn("home", F.when(F.col("chunks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bins))))
    placed = placed.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))

    def count(table):
        comp, chunk = table.column("component").to_numpy(), table.column("chunk").to_numpy()
        ids, n, v = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("v").combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(comp, kind="stable")
        linked = np.zeros(len(ids), np.int64)
        for _, lo, hi in _runs(comp[order]):
            at = order[lo:hi]
            x = _unit(v.take(pa.array(at)))
            if i == j:
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                linked[at] = near @ n[at]
            else:
                left, right = chunk[at] == i, chunk[at] == j
                near = x[left] @ x[right].T >= least
                linked[at[left]], linked[at[right]] = near @ n[at[right]], n[at[left]] @ near
        return pa.table({"id": ids, "linked": linked})

    rows = placed.select("home", "component", "i", "j", "chunk", "id", "n", "v").groupBy("home", "i", "j").applyInArrow(count, "id long, linked long")
    return rows.groupBy("id").agg(F.sum("linked").alias("linked"))


def dedup_vectors(vectors: DataFrame, least: float = 0.93, window: int = WINDOW, passes: int | None = None, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept, label: a row for each row of vectors (vec_id, embedding, label)."""
    whole = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    good = rows.withColumn("v", F.when(F.expr(whole), F.col("embedding")))
    classes = good.where("v is not null and vec_id is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = saved(classes.withColumn("dim", F.size("v")), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    passes = passes or passes_for(most[0] or 0, least, window)
    partitions = max(1, (most[1] or 0) * passes // PARTITION)
    links = saved(_links(_sorted_passes(classes, passes, seed), partitions, window, least), "vector-links")
    found = saved(connected(links), "components")
    members = classes.join(found, "id").select("component", "id", "n", "v")
    counts = _counts(members, least)
    done = classes.join(found, "id", "left").join(counts, "id", "left")
    done = done.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    done = saved(done, "class-results")
    out = good.join(done, (good["label"] == done["l"]) & (good["v"] == done["w"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(r) AS component_id, min(r) = e.vec_id AS kept
FROM embeddings e JOIN reached ON reached.id = e.vec_id GROUP BY e.vec_id
"""
