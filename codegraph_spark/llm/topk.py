"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are integers. They lie in ranges of some thousands, each a row of a table with its forward index (the matrix
of its vectors, sorted so that neighbours are alike), cut into blocks of ``block`` vectors. The components are the
terms: a block's maxima and minima a term, times a query's weights and summed, bound the scores in the block from
above. For each query the blocks are taken in the order of their bounds and scored in whole, until a bound falls
below the k-th best score so far; blocks whose bound equals it are still scored, as ties go to the smaller id.

Queries are blocks as well. Every query block meets every range once, in a join on the range's number; a task works
through several ranges of one query block and keeps its best scores between them. Each task hands on at most k rows a
query, and a ranked window keeps the k best of these.

Vectors that are null or hold null, NaN or infinity take no part; vectors of different lengths do not meet. A query
never finds its own row, nor another one that has its id. Scores beyond 64 bits end at the limits of the type. Empty
tables, or no other vectors, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

RANGE, BLOCK, QUERIES, RANGES_A_TASK = 8192, 128, 256, 8


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, in double precision, for the vectors that take part."""
    whole = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.where(whole).select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), F.expr(f"transform(embedding, x -> floor(cast({scale} as double) * cast(x as double)))").alias("v")).where("vec_id is not null")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, part, ids, matrix): rows of one length in parts of about ``size``, as bytes of int64."""
    counts = {r["dim"]: max(1, -(-r["n"] // size)) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], "dim int, part int, parts int, ids binary, matrix binary")
    parts = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("dim")]
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def pack(key, table):
        ids = table.column("vec_id").to_numpy()
        v = table.column("v").combine_chunks()
        v = v.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        if v.shape[1]:  # vectors that agree in the signs of the widest components lie side by side
            wide = np.argsort(-v.std(axis=0), kind="stable")[:16]
            order = np.lexsort((ids, *[v[:, c] > 0 for c in wide[::-1]]))
        return pa.table({"dim": [key[0].as_py()], "part": [key[1].as_py()], "parts": [int(table.column("parts")[0].as_py())], "ids": [ids[order].tobytes()], "matrix": [np.ascontiguousarray(v[order]).tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]))

    return dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, part int, parts int, ids binary, matrix binary")


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def search(self, ids: np.ndarray, matrix: np.ndarray, block: int) -> None:
        if not len(ids):
            return
        cuts = range(0, len(ids), block)
        peak = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
        if peak >= 2**62:  # no 64-bit sum holds these scores
            self.vectors, matrix = self.vectors.astype(object), matrix.astype(object)
        high = np.stack([matrix[c : c + block].max(axis=0) for c in cuts])
        low = np.stack([matrix[c : c + block].min(axis=0) for c in cuts])
        zero = self.vectors * 0
        bounds = np.maximum(self.vectors, zero) @ high.T + np.minimum(self.vectors, zero) @ low.T
        for q, own in enumerate(self.ids):
            scores, names = self.found[q]
            for b in np.argsort(-bounds[q], kind="stable"):
                if len(scores) == self.k and bounds[q][b] < scores[-1]:
                    break
                at = slice(b * block, (b + 1) * block)
                new = np.clip(matrix[at] @ self.vectors[q], -(2**63), 2**63 - 1).astype(np.int64) if peak >= 2**62 else matrix[at] @ self.vectors[q]
                good = ids[at] != own
                if len(scores) == self.k:
                    good &= new >= scores[-1]
                if good.any():
                    scores, names = np.append(scores, new[good]), np.append(names, ids[at][good])
                    order = np.lexsort((names, ~scores))[: self.k]
                    scores, names = scores[order], names[order]
            self.found[q] = scores, names

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate([n for _, n in self.found])), pa.array(np.concatenate([s for s, _ in self.found]))], names=["query_id", "vec_id", "score"])


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and vectors as integers() gives them."""
    ranges, asked = saved(_packed(vectors, size), "ranges"), saved(_packed(queries, QUERIES), "queries")
    parts = ranges.groupBy("dim").agg(F.max("parts").alias("n"))
    of = asked.select("dim", F.col("part").alias("q"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    of = of.join(parts, "dim").withColumn("part", F.explode(F.expr("sequence(0, n - 1)"))).drop("n")
    met = of.join(ranges.drop("parts"), ["dim", "part"]).withColumn("task", F.floor(F.col("part") / RANGES_A_TASK))
    met = met.repartition("dim", "q", "task").sortWithinPartitions("dim", "q", "task")

    def score(batches):
        now, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["dim"], row["q"], row["task"]
                if key != now:
                    if best:
                        yield best.rows()
                    q_ids = np.frombuffer(row["q_ids"], np.int64)
                    now, best = key, _Best(q_ids, np.frombuffer(row["q_matrix"], np.int64).reshape(len(q_ids), -1), k)
                ids = np.frombuffer(row["ids"], np.int64)
                best.search(ids, np.frombuffer(row["matrix"], np.int64).reshape(len(ids), -1), block)
        if best:
            yield best.rows()

    found = met.mapInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 100, k: int = 10, **how) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all rows."""
    rows = integers(vectors)
    return search(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), rows, k, **how)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
