"""Near-duplicate texts by b-bit MinHash.

A text's set holds its distinct shingles of ``width`` words. ``MINIMA`` permutations give a minimum each. Groups of
``rows`` whole minima are the band keys that find candidates; of each minimum the low two bits are kept, packed as bit
planes of 64-bit words, and similarity is estimated from bit counts, corrected for minima that agree by chance in two
bits. Pairs whose estimate lies far enough below the threshold go; the others are confirmed exactly on their full sets.

Copies: texts with equal sets are one class, whose smallest id stands for it; only these meet.

No bucket is expanded into all its pairs at once. First every bucket compares its members with one of them, the one
that shares most buckets with others (in a group of copies the original), and verified links are united. What is left
are buckets whose members are still in several components. In these, members of different components are compared by
signature, in blocks of ``CHUNK`` by ``CHUNK`` members that are dealt over tasks, and what passes is verified there and
united too. So all pairs of a bucket that could change the result are looked at, whatever the size of the bucket.

Bands are as many as make a pair at the threshold miss all of them with odds of ``missed``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import dropped, saved
from .textkit import U64, distinct, lowered, mixed, pieces, portions, prefix_sums, shingle_hashes, span_hashes, text_bytes, word_spans

MINIMA, BITS, CHUNK, MEMBERS = 128, 2, 512, 256
PLANES = MINIMA * BITS // 64


@dataclass(frozen=True)
class Rule:
    """Texts link if 100 * intersection >= percent * union of their sets of shingles of ``width`` words."""

    width: int = 5
    percent: int = 80
    rows: int = 4
    missed: float = 1e-6
    seed: int = 5

    @property
    def bands(self) -> int:
        odds = (self.percent / 100) ** self.rows
        bands = max(1, math.ceil(math.log(self.missed) / math.log(1 - odds))) if odds < 1 else 1
        if bands * self.rows > MINIMA:
            raise ValueError(f"{bands} bands of {self.rows} minima are needed to miss no more than {self.missed}, there are {MINIMA} minima: set fewer rows")
        return bands

    @property
    def least_matches(self) -> int:
        """Of MINIMA low bits, how many agree at least: 4.5 standard deviations below what the threshold makes likely."""
        chance = 0.5**BITS
        odds = chance + (1 - chance) * self.percent / 100
        return math.floor(MINIMA * odds - 4.5 * math.sqrt(MINIMA * odds * (1 - odds)))

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def text_sets(column: pa.Array, width: int):
    """(texts, set offsets, sorted distinct shingle hashes) of each piece of a column of texts."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        own, at = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, of = word_spans(own, at)
        grams, of = shingle_hashes(span_hashes(prefix_sums(own), starts, ends), of, width)
        sets = [distinct(grams[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
        yield lo, hi, np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets) if sets else grams


def signatures(items: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, h1, h2, sig, bands): a row for each row of items (id, text); sig and bands are null for empty sets."""
    rng = np.random.default_rng(rule.seed)
    odd, noise = rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, MINIMA, np.uint32)
    bands, rows = rule.bands, rule.rows

    def sign(batches):
        for batch in portions(batches, 1):
            for lo, hi, of, grams in text_sets(batch.column(1), rule.width):
                n = np.diff(of)
                full = np.flatnonzero(n)
                h1, h2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                packed, keys = np.zeros((0, PLANES), np.int64), np.zeros((0, bands), np.int64)
                if len(full):
                    cuts = of[full]
                    h1[full] = np.add.reduceat(grams, cuts).view(np.int64)
                    h2[full] = np.add.reduceat(mixed(grams ^ U64(0x5851F42D4C957F2D)), cuts).view(np.int64)
                    small = (grams >> U64(32)).astype(np.uint32)
                    least = np.empty((len(full), MINIMA), np.uint32)
                    turned = np.empty_like(small)
                    for k in range(MINIMA):
                        np.multiply(np.bitwise_xor(small, noise[k], out=turned), odd[k], out=turned)
                        least[:, k] = np.minimum.reduceat(turned, cuts)
                    low = np.stack([(least >> np.uint32(b)) & np.uint32(1) for b in range(BITS)], axis=1).astype(np.uint8)
                    packed = np.packbits(low.reshape(len(full), -1), axis=1).view(np.int64)
                    groups = least[:, : bands * rows].astype(U64).reshape(len(full), bands, rows)
                    keys = np.zeros((len(full), bands), U64) + np.arange(1, bands + 1, dtype=U64)
                    for r in range(rows):
                        keys = mixed(keys * U64(0xD6E8FEB86659FD93) + groups[:, :, r])
                    keys = keys.view(np.int64)
                has = n > 0

                def lists(values, wide, has=has):
                    cut = pa.array(np.concatenate([[0], np.cumsum(has * wide)]).astype(np.int32), mask=np.append(~has, False))
                    return pa.ListArray.from_arrays(cut, pa.array(values.ravel()))

                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h1), pa.array(h2), lists(packed, PLANES), lists(keys, bands)], names=["id", "n", "h1", "h2", "sig", "bands"])

    return items.select(F.col("id").cast("long"), "text").mapInArrow(sign, "id long, n long, h1 long, h2 long, sig array<long>, bands array<long>")


def _matches(a: str, b: str) -> str:
    """SQL for the number of minima whose low bits agree."""
    half = PLANES // BITS
    return " + ".join(f"64 - bit_count({' | '.join(f'({a}[{p * half + k}] ^ {b}[{p * half + k}])' for p in range(BITS))})" for k in range(half))


def _sizes_fit(rule: Rule, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {rule.percent} * greatest({a}, {b})"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b), those that link on their full sets (id, grams: bytes).

    The set of a meets those of its partners in chunks of about MEMBERS of them, so one with many partners is dealt
    over many tasks and its set is copied once a chunk, not once a pair.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("of_a"))
    chunked = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("of_a") / MEMBERS)).cast("int").alias("chunk"))
    chunked = saved(chunked, "pairs")  # as small as the pairs; the caller drops those
    b = chunked.join(sets, chunked["b"] == sets["id"]).select("a", "chunk", F.lit(1).alias("role"), "id", "grams")
    a = chunked.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("id")).select("a", "chunk", F.lit(0).alias("role"), "id", "grams")
    dealt = a.unionByName(b).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def confirm(batches):
        own = None
        for batch in batches:
            out = []
            for name, role, other, grams in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                grams = np.frombuffer(grams.as_buffer(), U64)
                if role == 0:
                    own = grams
                    continue
                if rule.linked(_common(own, grams), len(own), len(grams)):
                    out.append((name, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(confirm, "a long, b long")


def _sets(items: DataFrame, ids: DataFrame, rule: Rule, distinct: bool) -> DataFrame:
    """(id, h1, grams): full sets, as sorted 64-bit hashes, of the items whose id is asked for, and their hashes."""

    def build(batches):
        for batch in portions(batches, 1):
            for lo, hi, of, grams in text_sets(batch.column(1), rule.width):
                sums = np.concatenate([[U64(0)], np.cumsum(grams, dtype=U64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array((sums[of[1:]] - sums[of[:-1]]).view(np.int64)), pa.array([grams[a:b].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)], pa.binary())], names=["id", "h1", "grams"])

    asked = items.select(F.col("id").cast("long"), "text").join(ids, "id", "left_semi")
    if distinct:
        asked = asked.dropDuplicates(["id"])
    return saved(asked.mapInArrow(build, "id long, h1 long, grams binary"), "sets")


def _leftover_links(members: DataFrame, sets: DataFrame, rule: Rule, per_task: int = 4000) -> DataFrame:
    """(a, b): links between different components within a bucket.

    members: (key, id, n, sig, bands, component). Members bring their sets along, so candidates are verified where
    they meet and only links leave a task. A pair that shares several buckets is looked at in the first of them.
    """
    several = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = saved(several.where("lo <> hi and size > 2").select("key", "size"), "buckets")
    bins = max(1, (several.agg(F.sum("size")).first()[0] or 0) // per_task)
    rows = members.join(several, "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.withColumn("home", F.when(F.col("chunks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins))))
    rows = rows.select("home", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "n", "sig", "bands", "component")
    rows = rows.join(sets, "id")
    least, half = rule.least_matches, PLANES // BITS

    def compare(table):
        key, chunk, ids, n, comp = (table.column(c).to_numpy() for c in ("key", "chunk", "id", "n", "component"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(U64).reshape(len(ids), PLANES)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        grams = [np.frombuffer(g.as_buffer(), U64) for g in table.column("grams").combine_chunks()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            left = at if i == j else at[chunk[at] == i]
            right = at if i == j else at[chunk[at] == j]
            for x in left:
                fit = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= rule.percent * np.maximum(n[right], n[x]))]
                if i == j:
                    fit = fit[ids[fit] > ids[x]]
                if len(fit):
                    other = np.zeros((len(fit), half), U64)
                    for p in range(BITS):
                        other |= sig[fit, p * half : (p + 1) * half] ^ sig[x, p * half : (p + 1) * half]
                    near = fit[MINIMA - np.bitwise_count(other).sum(axis=1) >= least]
                    shared = bands[near] == bands[x]
                    near = near[bands[x][shared.argmax(axis=1)] == key[x]] if len(near) else near
                    out.extend((min(ids[x], ids[y]), max(ids[x], ids[y])) for y in near if rule.linked(_common(grams[x], grams[y]), n[x], n[y]))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return rows.groupBy("home", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _several(signed: DataFrame) -> DataFrame | None:
    """(id): those whose rows have different sets; None if there are none."""
    found = signed.where("n > 0 and id is not null").groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("h2").alias("lo2"), F.max("h2").alias("hi2"))
    found = saved(found.where("lo <> hi or lo2 <> hi2").select("id"), "several")
    return found if found.limit(1).count() else None


def near_duplicates(items: DataFrame, rule: Rule = Rule(), content_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signed, classes) for items (id, text); content_ids says that rows of one id have one set.

    signed has a row for each row of items: id, n (size of its set), h1, h2 (hashes of the set). classes has a row
    for each distinct set that is not empty: h1, h2, rep (smallest id with that set), component (smallest id reachable).
    The sets of one id are linked. Both are tables in the shared folder, for the caller to drop.
    """
    signed = saved(signatures(items, rule), "signed")
    several = None if content_ids else _several(signed)
    first = signed.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # A class is known by its smallest id, or, if that has several sets, by a hash of the set.
    own = F.col("rep") if several is None else F.when(F.col("many"), F.col("h1")).otherwise(F.col("rep"))
    if several is not None:
        first = first.join(several.select(F.col("id").alias("rep"), F.lit(True).alias("many")), "rep", "left")
    classes = saved(first.withColumn("id", own).select("id", "h1", "h2", "rep", "n", "sig", "bands"), "classes")
    slim = saved(signed.select("id", "n", "h1", "h2"), "signed-slim")
    dropped(signed)
    spread = classes.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    shared = saved(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared-bands")
    members = saved(spread.join(shared.hint("shuffle_hash"), "key"), "members")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top"))
    centres = saved(ranked.select("key", (-F.col("top.minus")).alias("a")), "centres")
    facts = classes.select("id", "n", "sig", "bands")
    pairs = members.join(centres, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    pairs = saved(_fitting(pairs, facts, rule), "star-pairs")
    ids = members.select("id").distinct()
    if several is None:
        sets = _sets(items, ids, rule, content_ids)
    else:
        reps = classes.join(ids, "id", "left_semi").select("id", F.col("rep").alias("name"), "h1")
        named = _sets(items, reps.select(F.col("name").alias("id")).distinct(), rule, False).withColumnRenamed("id", "name")
        sets = saved(named.join(reps, ["name", "h1"]).dropDuplicates(["id"]).select("id", "h1", "grams"), "named-sets")
        dropped(named)
    links = saved(_verified(pairs, sets, rule), "star-links")
    if several is not None:
        texts = slim.join(several, "id").join(classes.select("h1", "h2", F.col("id").alias("v")), ["h1", "h2"])
        least = texts.groupBy("id").agg(F.min("v").alias("a"))
        joined = texts.join(least, "id").where("a <> v").select("a", F.col("v").alias("b"))
        links = saved(links.unionByName(joined), "text-links")
    found = saved(connected(links), "star-components")
    dropped(pairs, centres, shared)
    known = members.select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(facts, "id")
    more = saved(_leftover_links(known, sets.select("id", "grams"), rule), "leftover-links")
    dropped(members, sets)
    if more.limit(1).count():
        found = saved(connected(links.unionByName(more)), "components")
    dropped(links, more)
    out = classes.select("h1", "h2", "rep", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("id")
    if several is not None:  # components are known by hashes in part
        least = out.groupBy("component").agg(F.min("rep").alias("least"))
        out = out.join(least, "component").select("h1", "h2", "rep", F.col("least").alias("component"))
    out = saved(out.select("h1", "h2", "rep", "component"), "class-components")
    dropped(classes, found)
    return slim, out


def _fitting(pairs: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose sizes and estimates allow a link."""
    a = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(_sizes_fit(rule, "na", "nb")).where(f"{_matches('sa', 'sb')} >= {rule.least_matches}").select("a", "b")


def dedup_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs (doc_id, text).

    Null, empty and white texts have an empty set and link with nothing; neither do rows without a doc_id, whose
    component is null. Rows that repeat a doc_id are one document with several texts, all of which link: with each
    other, and with whatever one of them is near to. Other columns are not read. Texts of any length are read in whole.
    """
    signed, classes = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), rule)
    rows = signed.join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS met FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM common WHERE 100 * met >= 85 * (na + nb - met)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached AS (SELECT doc_id AS id, doc_id AS r FROM s UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = s.doc_id AS kept
FROM s JOIN reached ON reached.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
