"""Suffix-array dedup: bytes covered by long strings that start in an earlier document too.

Repeated strings are found in merged Burrows-Wheeler transforms. To merge transforms of all texts at once, all texts
would have to lie in one place, so first the candidates are dealt: every ``LENGTH`` bytes in a row have one anchor, the
``GRAM`` bytes among them whose hash is smallest, and equal strings have equal anchors. Anchors that only one document
has are done with. For each other one the bytes of all strings that it stands for, a region of some 60 bytes, go to the
task of the anchor's hash; equal regions are one, with the smallest doc_id that has it.

There, regions are cut into shards, and each shard has its suffixes sorted and its transform made. The transforms are
merged by iterative interleave refinement: the interleave says from which shard each place of the merged order comes.
Starting with one shard after the other, each round puts the interleave through one stable counting sort by the merged
transform's symbols, which sorts the merged suffixes by one more symbol without ever comparing suffixes; where two
neighbours part in that round, their common prefix ends. After LENGTH bytes, the intervals that have not parted are the
repeated strings. Symbols are byte pairs (each region is the two rows of its even and odd pairs), which halves the
rounds. An anchor with one region has nothing to be merged with.

Copies: of equal texts the one of the smallest doc_id takes part, the others lose all bytes, if they have LENGTH.

A document loses the strings of an interval with a smaller doc_id. Strings are compared in whole, hashes only say where
to look. Null texts count as empty; rows without a doc_id lose nothing; rows that repeat a doc_id are one document here.
"""

from __future__ import annotations

from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved
from .textkit import U64, pieces, portions, power_tables, prefix_sums, sums_by, text_bytes

LENGTH, GRAM = 50, 28
SHARDS, DOCS_A_PART, REGIONS_A_TASK, REGIONS_AT_ONCE = 8, 2000, 4000, 1000
PLACE_BITS, SLICE = 24, 1 << 15


def _window_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, hashes): for all strings of ``length`` bytes inside a document, where they start and which
    gram is their anchor, and the grams' hashes by place."""
    n, near = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    sums, (_, down) = prefix_sums(data), power_tables(n)
    hashes, anchors = np.empty(n - GRAM + 1, U64), np.empty(n - length + 1, np.int64)
    # The place in the low bits breaks ties to the right; the few bits of the hash that go do not matter. Places are
    # counted in slices that overlap by a string, so they fit, however long the texts are, and so do caches.
    low = U64((1 << PLACE_BITS) - 1)
    slots = min(SLICE, 1 << PLACE_BITS)
    back = low - np.arange(slots, dtype=U64)
    for lo in range(0, len(anchors), slots - near):
        hi = min(lo + slots - 1, len(hashes))
        rank = (sums[lo + GRAM : hi + GRAM] - sums[lo:hi]) * down[lo:hi]
        rank ^= rank >> U64(29)
        rank *= U64(0xBF58476D1CE4E5B9)
        rank ^= rank >> U64(32)
        hashes[lo:hi] = rank
        rank &= ~low
        rank |= back[: len(rank)]
        size = 1
        while size < near:
            step = min(size, near - size)
            np.minimum(rank[: len(rank) - step], rank[step:], out=rank[: len(rank) - step])
            size += step
        own = rank[: len(rank) - near + 1] & low
        anchors[lo : lo + len(own)] = int(low) + lo - own.view(np.int64)
    fits = np.ones(n, bool)
    for cut in offsets[1:]:
        fits[max(0, cut - length + 1) : cut] = False
    starts = np.flatnonzero(fits[: n - length + 1])
    return starts, anchors[starts], hashes


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, anchors): the hashes (40 bits and their part's) of each document's anchors that different ones have too.

    docs: (doc_id, text, content), content being a hash of the text.
    """
    parts = max(8, docs.count() // DOCS_A_PART)

    def ask(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in portions(batches, 1):
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2)], axis=1)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, anchors, hashes = _window_anchors(own, at, length)
                spots = anchors[_runs(anchors)[:-1]]
                doc, key = np.searchsorted(at, spots, "right") - 1, hashes[spots] >> U64(24)
                part = (key % U64(parts)).astype(np.int64)
                part = part.astype(np.min_scalar_type(parts))  # narrow ones are sorted by counting
                order = np.argsort(part, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
                number += 1
                used = np.flatnonzero(np.diff(cuts))
                lists = [order[cuts[p] : cuts[p + 1]] for p in used]
                small = [np.ascontiguousarray(key[i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for i in lists]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), number)), pa.array([ids[lo:hi].tobytes()] * len(used), pa.binary()), pa.array([doc[i].astype(np.min_scalar_type(hi - lo)).tobytes() for i in lists], pa.binary()), pa.array(small, pa.binary())], names=["part", "piece", "ids", "doc", "key"])

    def answer(table):
        pieces_, keys, docs_ = table.column("piece").to_pylist(), [], []
        sizes = []
        for ids, doc, key in zip(table.column("ids").to_pylist(), table.column("doc").to_pylist(), table.column("key").to_pylist(), strict=True):
            docs_.append(np.frombuffer(ids, np.int64).reshape(-1, 2)[np.frombuffer(doc, f"u{len(doc) * 5 // len(key)}")])
            wide = np.zeros((len(docs_[-1]), 8), np.uint8)
            wide[:, :5] = np.frombuffer(key, np.uint8).reshape(-1, 5)
            keys.append(wide.view("<u8").ravel())
            sizes.append(len(docs_[-1]))
        doc, key = np.concatenate(docs_), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        cuts = _runs(key[order])
        doc, content = doc[:, 0], doc[order, 1]
        least, most = np.minimum.reduceat(content, cuts[:-1]), np.maximum.reduceat(content, cuts[:-1])
        hit = np.zeros(len(key), bool)
        hit[order] = np.repeat(least != most, np.diff(cuts))
        of = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(k, doc[a:b][hit[a:b]].tobytes(), key[a:b][hit[a:b]].tobytes()) for k, a, b in zip(pieces_, of[:-1], of[1:], strict=True) if hit[a:b].any()]
        return pa.table({"piece": pa.array([r[0] for r in rows], pa.int64()), "doc": pa.array([r[1] for r in rows], pa.binary()), "key": pa.array([r[2] for r in rows], pa.binary())})

    def by_doc(table):
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist()])
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("key").to_pylist()])
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        cuts = _runs(doc)
        return pa.table({"doc_id": doc[cuts[:-1]], "anchors": pa.array([key[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    asked = docs.mapInArrow(ask, "part int, piece long, ids binary, doc binary, key binary")
    answers = asked.groupBy("part").applyInArrow(answer, "piece long, doc binary, key binary")
    found = answers.groupBy("piece").applyInArrow(by_doc, "doc_id long, anchors binary")
    return found.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))  # several rows only where a doc_id repeats


def regions(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, first, text): of each repeated anchor the first string that it stands for and all their bytes."""

    def find(batches):
        for batch in portions(batches, 1):
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in pieces(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lists = batch.column(2).slice(lo, hi - lo)
                each = lists.flatten()
                of = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                of = np.repeat(of, pc.binary_length(each).to_numpy(zero_copy_only=False) // 8)
                wanted = np.frombuffer(b"".join(each.to_pylist()), np.uint64)
                starts, spots, hashes = _window_anchors(own, at, length)
                cuts = _runs(spots)
                first, last = starts[cuts[:-1]], starts[cuts[1:] - 1]
                doc, key = np.searchsorted(at, first, "right") - 1, hashes[spots[cuts[:-1]]] >> U64(24)
                # A key has 40 bits, so a document's place among the piece's fits beside it.
                hit = np.flatnonzero(np.isin(doc.astype(U64) << U64(40) | key, of.astype(U64) << U64(40) | wanted, kind="sort"))
                raw = own.tobytes()
                texts = [raw[a:b] for a, b in zip(first[hit].tolist(), (last[hit] + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[hit].astype(np.int64)), pa.array(ids[lo:hi][doc[hit]]), pa.array(first[hit] - at[doc[hit]]), pa.array(texts, pa.binary())], names=["key", "doc_id", "first", "text"])

    return docs.join(anchors, "doc_id").select("doc_id", "text", "anchors").mapInArrow(find, "key long, doc_id long, first long, text binary")


def _shard_order(symbols: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Places of a shard's suffixes in sorted order. symbols: 0 at ends; behind: for each place the number of places
    that its row still has, each two further on."""
    n, step = len(symbols), 1
    order = np.argsort(symbols, kind="stable")
    parted = symbols[order[1:]] != symbols[order[:-1]]
    rank, ranks = np.empty(n, np.int64), np.zeros(n, np.int64)
    while True:
        ranks[1:] = np.cumsum(parted)
        rank[order] = ranks
        if parted.all():
            return order
        follow = np.zeros(n, np.int64)
        on = np.flatnonzero(behind >= step)
        follow[on] = rank[np.minimum(on + 2 * step, n - 1)] + 1
        # Suffixes of ranks of their own stay where they are; only the others are sorted anew.
        tied = np.flatnonzero(np.append(False, ~parted) | np.append(~parted, False))
        own = order[tied]
        wide = (rank[own] << 32) | follow[own]
        sort = np.argsort(wide, kind="stable")
        order[tied], wide = own[sort], wide[sort]
        more = parted.copy()
        pairs = np.flatnonzero(np.diff(tied) == 1)
        more[tied[pairs]] = wide[pairs + 1] != wide[pairs]
        if not (more & ~parted).any():
            return order
        parted, step = more, step * 2


def smallest_owner(texts: list[bytes], owners: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each text, for each string of ``length`` (even) bytes in it, the smallest owner of a text that has it."""
    shards = max(1, min(shards, len(texts)))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16)
    n = int(sizes.sum())
    # A place is a pair of bytes; the last two of a text are the ends of its two rows. UTF-8 has no byte 0xFF, so the
    # symbols, pairs plus one, stay below 2**16.
    symbols = ((flat[:n] << np.uint16(8)) | flat[1 : n + 1]) + np.uint16(1)
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(n) - begin[text]
    left = sizes[text] - 1 - inside  # bytes from the place to the end of its text
    symbols[left < 2] = 0
    before = np.where(inside >= 2, symbols[np.maximum(np.arange(n) - 2, 0)], 0).astype(np.uint16)
    bounds = np.searchsorted(np.cumsum(sizes), np.linspace(0, n, shards + 1)[1:-1])
    cuts = np.concatenate([[0], begin[np.minimum(bounds, len(texts) - 1)], [n]])
    suffixes, transforms = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        order = lo + _shard_order(symbols[lo:hi], left[lo:hi] // 2)
        suffixes.append(order)
        transforms.append(before[order])
    interleave = np.repeat(np.arange(shards, dtype=np.uint8), np.diff(cuts))
    block, suffixes, transforms = np.zeros(n, np.int32), np.concatenate(suffixes), np.concatenate(transforms)
    merged = np.empty(n, np.uint16)
    for _ in range(length // 2):
        merged[np.argsort(interleave, kind="stable")] = transforms
        order = np.argsort(merged, kind="stable")
        symbol, block, interleave = merged[order], block[order], interleave[order]
        parted = np.ones(n, bool)
        parted[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]) | (symbol[1:] == 0)
        block = np.cumsum(parted, dtype=np.int32) - np.int32(1)
    place = np.empty(n, np.int64)
    place[np.argsort(interleave, kind="stable")] = suffixes
    least = np.minimum.reduceat(owners[text[place]], np.flatnonzero(parted))[block]
    out = np.empty(n, np.int64)
    out[place] = least
    return [out[b : b + max(0, s - length)] for b, s in zip(begin, sizes, strict=True)]


def _shares(keys: np.ndarray, size: int) -> np.ndarray:
    """Bounds of shares of sorted keys, of about ``size`` rows each; no key is parted."""
    bounds = _runs(keys)
    return bounds[np.unique(np.searchsorted(bounds, np.arange(0, len(keys) + size, size)).clip(max=len(bounds) - 1))]


def _class_runs(classes: DataFrame, length: int) -> DataFrame:
    """(key, h1, h2, start, n, owner): the strings of a region, in runs that have the same smallest owner.

    classes: (key, h1, h2, n, text, owner). Regions that share their anchor are merged; an anchor's regions are never parted, as
    long as a task can hold them: what they share an anchor for is 28 equal bytes, and equal regions are one already.
    """
    alone = saved(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-anchors")
    bins = max(1, (alone.agg(F.sum("n")).first()[0] or 0) // REGIONS_A_TASK)

    def merge(table):
        table = table.sort_by("key")
        texts, owners = table.column("text").to_pylist(), table.column("owner").to_numpy()
        starts, sizes, least, runs = [], [], [], []
        # Anchors have nothing to do with each other, and fewer regions fit the caches: about so many are merged at once.
        for found in chain.from_iterable(smallest_owner(texts[lo:hi], owners[lo:hi], length) for lo, hi in pairwise(_shares(table.column("key").to_numpy(), REGIONS_AT_ONCE).tolist())):
            cuts = _runs(found)
            starts.append(cuts[:-1])
            sizes.append(np.diff(cuts))
            least.append(found[cuts[:-1]])
            runs.append(len(cuts) - 1)
        of = pa.array(np.repeat(np.arange(len(texts)), runs))
        return pa.table({**{name: table.column(name).take(of) for name in ("key", "h1", "h2")}, **{name: np.concatenate(x) for name, x in (("start", starts), ("n", sizes), ("owner", least))}})

    shared = classes.join(alone.select("key"), "key").withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    merged = shared.groupBy("bin").applyInArrow(merge, "key long, h1 long, h2 long, start long, n long, owner long")
    own = classes.join(alone.select("key"), "key", "left_anti").select("key", "h1", "h2", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"), "owner")
    return merged.unionByName(own)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans): for each document with repeated strings, runs (first, n) of places at which such strings start."""
    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    each = saved(known.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n")), "contents")
    first = saved(each.groupBy("sha").agg(F.min("doc_id").alias("origin"), F.count("*").alias("times")).where("times > 1").drop("times"), "copied")
    copies = saved(each.join(first, "sha").where("doc_id > origin").select("doc_id", "n").distinct(), "copies")
    found = repeated_anchors(known.withColumn("content", F.xxhash64("text")), length)
    found = saved(found.join(copies.select("doc_id"), "doc_id", "left_anti"), "anchors")
    pieces_ = regions(known, found, length)
    pieces_ = saved(pieces_, "regions")
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    dropped(each, first, found)
    classes = saved(pieces_.groupBy("key", "text").agg(F.min("doc_id").alias("owner")).withColumns({**hashes, "n": F.octet_length("text") - (length - 1)}), "classes")
    # The texts are in the classes now; what is left of the regions is where they are.
    with_texts, pieces_ = pieces_, saved(pieces_.withColumns(hashes).select("key", "h1", "h2", "doc_id", "first"), "places")
    dropped(with_texts)
    runs = saved(_class_runs(classes, length), "runs")
    dropped(classes)
    met = pieces_.join(runs, ["key", "h1", "h2"]).where("owner < doc_id")
    rows = met.select("doc_id", (F.col("first") + F.col("start")).alias("first"), "n")
    whole = copies.where(F.col("n") >= length).select("doc_id", F.lit(0).cast("long").alias("first"), (F.col("n") - (length - 1)).alias("n"))
    rows = saved(rows.unionByName(whole), "spans")
    dropped(pieces_, runs)
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def dedup_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (binary: the bytes that are left) added; columns of those names are
    replaced. ``kept`` may cut a character where repeated bytes begin or end inside it."""
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in docs.columns if c not in new]
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias("llm_id"), F.col("spans").alias("llm_spans"))
    joined = docs.select(*keep).join(spans, F.col("doc_id").cast("long") == F.col("llm_id"), "left").drop("llm_id")
    at = keep.index("text")

    def cut(batches):
        for batch in portions(batches, at):
            data, offsets = text_bytes(batch.column(at))
            removed, runs, kept = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64), []
            for lo, hi in pieces(offsets):
                own, here = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lists = batch.column(len(keep)).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                first, n = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("first", "n"))
                first = first + here[doc]
                turn = np.bincount(first, minlength=len(own) + 1) - np.bincount(np.minimum(first + n + length - 1, here[doc + 1]), minlength=len(own) + 1)
                away = np.cumsum(turn)[:-1] > 0
                begins = away.copy()
                begins[1:] &= ~away[:-1]
                heads = here[:-1][here[:-1] < len(own)]
                begins[heads] = away[heads]
                removed[lo:hi], runs[lo:hi] = sums_by(away, here), sums_by(begins, here)
                kept.append(own[~away])
            left = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(left), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *kept]))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), texts], names=[*keep, *new])

    schema = docs.select(*keep).schema
    for name in new:
        schema = schema.add(name, "binary" if name == "kept" else "long")
    return joined.mapInArrow(cut, schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    done = dedup_strings(docs.select("doc_id", "text"), length)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
