"""Mixing sources to target weights.

The words of each source are one stream, packed into blocks of ``block`` words. The mix is a sequence of slots, one
block each, dealt to output shards of ``shard_slots`` slots. Per shard, the numbers of slots of the sources are drawn
from a multinomial, from which what the sources have left is held back; the k-th slot of a source takes block
``permutation(k mod blocks)`` of pass ``k div blocks``. Slots and blocks then meet in one join by block index.

Everything random is a function of ``seed``, so reruns agree. Null, empty and white texts have size 0 and are never
taken. Rows that repeat a doc_id, or have none, are documents of their own: where there are such, a row is known by its
doc_id, a hash of all its columns, and its number among equal rows. A null source is a source of its own.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved
from .textkit import portions, text_bytes, word_spans

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """What one source gives: its index, words, target words, blocks."""

    index: int
    source: str | None
    size: int
    target: float
    blocks: int

    @property
    def quota(self) -> int:
        """Whole words the mix takes."""
        return min(round(self.target), 2 * self.size)


def targets(sizes: list[int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target words of the sources, in order: by repeating weights, none above ``most`` times its size.

    What a source cannot take is shared again among the others by weight, until none is above.
    """
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        whole = sum(weight[k] for k in sorted(free))
        full = [k for k in sorted(free) if left * weight[k] / whole > most * sizes[k]]
        if not full:
            for k in free:
                out[k] = left * weight[k] / whole
            return out
        for k in full:
            out[k] = most * sizes[k]
            free.discard(k)
            left -= out[k]
    return out


def permutation(k: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Places of k under a pseudorandom permutation of 0..n-1, or under its inverse.

    A four-round Feistel network permutes the next even power of two; places beyond n walk on along their cycle
    until they come back into range, so no table of n entries is ever made.
    """
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, out = (1 << half) - 1, np.array(k, np.int64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        if inverse:
            left, right = right, left
        for turn in range(3, -1, -1) if inverse else range(4):
            noise = (right.astype(np.uint64) + np.uint64(seed * 4 + turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            noise ^= noise >> np.uint64(29)
            noise *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((noise >> np.uint64(40)).astype(np.int64) & mask)
        if inverse:
            left, right = right, left
        out[todo] = (left << half) | right
        todo = out >= n
    return out


KEY = ["doc_id", "llm_hash", "llm_copy"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with llm_hash and llm_copy, which with the doc_id are a row's KEY; both null if no doc_id repeats."""
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.withColumns({name: F.lit(None).cast("long") for name in KEY[1:]})
    hashed = docs.withColumns({"llm_hash": F.xxhash64(*docs.columns), "llm_second": F.xxhash64(F.lit(1), *docs.columns)})
    number = F.row_number().over(Window.partitionBy("doc_id", "llm_hash").orderBy("llm_second")).cast("long")
    return hashed.withColumn("llm_copy", number).drop("llm_second")


def _same_key(a: DataFrame, b: DataFrame, names: list[str]):
    """The condition that KEY of a is that of b, where it has those names."""
    return functools.reduce(operator.and_, (a[x].eqNullSafe(b[y]) for x, y in zip(KEY, names, strict=True)))


def stream_places(docs: DataFrame, rows_a_chunk: int = 4000) -> DataFrame:
    """(*KEY, source, size, start): where each document's words start in the stream of its source.

    The running sum is made in two levels, over chunks of a source and inside a chunk, so that a hot source is
    spread over as many tasks as it has chunks.
    """
    one = saved(keyed(docs).select(*KEY, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    chunks = max(1, one.count() // rows_a_chunk)
    placed = one.withColumn("chunk", F.pmod(F.xxhash64(*KEY), F.lit(chunks)))
    of = lambda *c: [F.coalesce("source", F.lit("")), F.col("source").isNull(), *c]
    sums = placed.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = sums.withColumn("base", F.sum("words").over(Window.partitionBy(*of()).orderBy("chunk")) - F.col("words"))
    inside = F.sum("size").over(Window.partitionBy(*of("chunk")).orderBy(*(F.col(name).asc_nulls_first() for name in KEY))) - F.col("size")
    rows = placed.withColumn("inside", inside)
    before = before.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    return rows.join(before, rows["source"].eqNullSafe(before["s"]) & (rows["chunk"] == before["c"])).select(*KEY, "source", "size", (F.col("base") + F.col("inside")).alias("start"))


def plan_sources(places: DataFrame, block: int, **how) -> list[MixPlan]:
    """One plan a source, in code point order, null last. The list of sources is the mixture's configuration: one
    name and one number each, the only rows that come to the driver."""
    rows = places.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["size"] for r in rows], **how)
    return [MixPlan(k, r["source"], r["size"], g, -(-r["size"] // block)) for k, (r, g) in enumerate(zip(rows, goal, strict=True))]


def _slots_of(plan: MixPlan, block: int) -> int:
    return 0 if not plan.quota else -(-plan.quota // block) + 2


def slots(spark: SparkSession, plans: list[MixPlan], block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, src, pass_no, block_no, words): the mix in output order.

    Per shard the counts come from a multinomial over what the sources have left. The loop on the driver is over
    shards, ten thousand or so at most as shards then grow, and keeps one number a source; slots are made on the
    executors.
    """
    rng, left = np.random.default_rng(seed), np.array([_slots_of(p, block) for p in plans], np.int64)
    shard_slots = max(shard_slots, int(left.sum()) // 10_000)
    done, shards = np.zeros(len(plans), np.int64), []
    while left.sum():
        size, count = int(min(shard_slots, left.sum())), np.zeros(len(plans), np.int64)
        while size:
            room = left - count
            draw = np.minimum(rng.multinomial(size, room / room.sum()), room)
            count += draw
            size -= int(draw.sum())
        shards.append((len(shards), done.tolist(), count.tolist()))
        done, left = done + count, left - count
    spec = {p.index: (p.size, p.quota, p.blocks) for p in plans}
    last = {p.index: int(permutation(np.array([p.blocks - 1]), p.blocks, seed + p.index, inverse=True)[0]) for p in plans if p.blocks}

    def deal(batches):
        for batch in batches:
            for shard, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for src, (start, n) in enumerate(zip(first, count, strict=True)):
                    if not n:
                        continue
                    size, quota, blocks = spec[src]
                    k = np.arange(start, start + n)
                    number = permutation(k % blocks, blocks, seed + src)
                    length = np.where(number == blocks - 1, size - (blocks - 1) * block, block)
                    missing = blocks * block - size
                    at = (k // blocks) * size + (k % blocks) * block - np.where(k % blocks > last[src], missing, 0)
                    words = np.clip(quota - at, 0, length)
                    out.append(np.stack([np.full(n, shard), np.full(n, src), k // blocks, number, words]))
                if out:
                    table = np.concatenate(out, axis=1)
                    order = np.random.default_rng([seed, shard]).permutation(table.shape[1])
                    table = table[:, order]
                    keep = table[4] > 0
                    names = ["shard", "src", "pass_no", "block_no", "words"]
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in table] + [pa.array(np.flatnonzero(keep))], names=[*names, "slot"])

    table = spark.createDataFrame(shards, "shard long, first array<long>, count array<long>")
    return table.repartition(max(1, min(len(shards), 2 * spark.sparkContext.defaultParallelism))).mapInArrow(deal, "shard long, src long, pass_no long, block_no long, words long, slot long")


def mix(docs: DataFrame, block: int = 256, shard_slots: int = 4096, seed: int = 7, **how) -> tuple[DataFrame, list[MixPlan], DataFrame]:
    """(parts, plans, places). parts has a row for each part of a document that a slot takes:
    (shard, slot, pass_no, *KEY, first_word, n_words), words counted from the document's first.
    """
    spark = docs.sparkSession
    places = saved(stream_places(docs), "places")
    plans = plan_sources(places, block, **how)
    names = spark.createDataFrame([(p.index, p.source) for p in plans], "src long, name string")
    dealt = slots(spark, plans, block, shard_slots, seed)
    # The names are as few as the sources, which plan_sources has just counted on the driver.
    known = places.where("size > 0").join(F.broadcast(names), places["source"].eqNullSafe(names["name"]))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = known.select(*KEY, "src", "start", "size", F.explode(F.sequence(first, last)).alias("block_no"))
    lo = F.greatest(F.col("start"), F.col("block_no") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block_no") * block + F.least(F.lit(block).cast("long"), F.col("words")))
    met = cut.join(dealt.hint("merge"), ["src", "block_no"])  # there are as many slots as blocks: never a broadcast
    parts = met.select("shard", "slot", "pass_no", *KEY, (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words")).where("n_words > 0")
    return parts, plans, places


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source: a row a document."""
    parts, plans, places = mix(docs, **how)
    spark = docs.sparkSession
    taken = parts.groupBy(*KEY).agg(F.sum("n_words").alias("taken"))
    goal = spark.createDataFrame([(p.source, p.size, p.target) for p in plans], "name string, source_size long, target double")
    rows = places.join(F.broadcast(goal), places["source"].eqNullSafe(goal["name"]), "left")
    names = [f"{name}_taken" for name in KEY]
    taken = taken.toDF(*names, "taken")
    rows = rows.join(taken, _same_key(rows, taken, names), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: one row for each pass over a document, its text cut to the words which that pass takes.

    Columns are those of docs. A document taken twice in whole is there twice; one that is not taken is not there.
    Parts keep the white space that follows their words in the document.
    """
    parts, _, _ = mix(docs, **how)
    names = docs.columns
    spans = parts.groupBy(*KEY, "pass_no").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
    spans = spans.groupBy(*KEY).agg(F.collect_list("spans").alias("llm_passes"))
    taken = [f"{name}_taken" for name in KEY]
    spans, one = spans.toDF(*taken, "llm_passes"), keyed(docs)
    joined = one.join(spans, _same_key(one, spans, taken)).select(*names, "llm_passes")

    def cut(batches):
        for batch in portions(batches, names.index("text")):
            column = batch.column(names.index("text"))
            data, offsets = text_bytes(column)
            starts, _, of = word_spans(data, offsets)
            rows, texts = [], []
            for d, passes in enumerate(batch.column(len(names)).to_pylist()):
                own = np.append(starts[of[d] : of[d + 1]], offsets[d + 1])
                own[0] = offsets[d]
                for spans in passes:
                    text = b"".join(data[own[min(s["first_word"], len(own) - 1)] : own[min(s["first_word"] + s["n_words"], len(own) - 1)]].tobytes() for s in spans)
                    rows.append(d)
                    texts.append(text)
            at = pa.array(rows, pa.int64())
            fields = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(i).take(at) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(fields, names=names)

    cutted = joined.mapInArrow(cut, docs.schema)
    return cutted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cutted
