"""Language identification by language-bitmask n-gram filters.

One table of bit masks holds a Bloom filter for every language: bit l of a slot belongs to language l, so looking an
n-gram up under its hashes and taking the AND of the slots returns all languages that contain it at once (bit-sliced
filters). Per language, the popcount over a text's n-grams is corrected for the false positives that the fill of its
slice makes likely; the language with the largest corrected share wins.

Learning uses a bounded sample: about ``sample`` documents a language, picked by a hash of the text, and the ``top``
most frequent n-grams of a language among those at least ``keen`` times as frequent in it as in any other one. The
filter has ``2 ** slots_log2`` slots whatever the input. Prediction reads nothing but the whole text.

Null texts and texts without a letter get ``und`` and score 0. Rows with a null lang are not learned from. Ties go to
the language whose name is smallest. Without anything to learn from, all rows get ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import U64, lowered, mixed, pieces, portions, sums_by, text_bytes

N = 4
HASHES = 3
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    masks: np.ndarray  # (words of 64 languages, slots)
    false_rate: np.ndarray  # by language: the odds that an absent n-gram looks present


def _grams(column: pa.Array):
    """(documents, their offsets, n-grams) of each piece: n-grams of N bytes over letters, all else as one blank."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in pieces(np.concatenate([[0], np.cumsum(sizes)])):  # a batch may hold 64 MB: only pieces are copied
        part = pc.fill_null(column.slice(lo, hi - lo).cast(pa.string()), "")
        data, at = text_bytes(pc.binary_join_element_wise(pa.scalar(" "), part, pa.scalar(" "), ""))
        own = _CLEAN[data]
        wide = own.astype(np.uint32)
        grams = np.zeros(len(own), np.uint32)
        for k in range(N):
            grams[: len(own) - k] = (grams[: len(own) - k] << np.uint32(8)) | wide[k:]
        valid = np.ones(len(own), bool)
        for k in range(1, N):  # those that would run into the next document
            cut = at[1:] - k
            valid[cut[cut >= 0]] = False
        of = np.concatenate([[0], np.cumsum(valid)])[at]
        yield lo, hi, grams[valid], of


def _slots(grams: np.ndarray, slots_log2: int) -> list[np.ndarray]:
    x = mixed(grams.astype(U64) + U64(0x51ED270B))
    y = mixed(x + U64(0x2545F491)) | U64(1)
    shift = U64(64 - slots_log2)
    return [((x + U64(k) * y) >> shift).astype(np.int64) for k in range(HASHES)]


def learn(labelled: DataFrame, sample: int = 2000, top: int = 12_000, keen: float = 0.25, slots_log2: int = 18) -> LanguageFilter:
    """labelled: (text, lang). At most about ``sample`` documents a language are read, chosen by a hash of the text."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(counts, key=str.encode))
    if not names:
        return LanguageFilter((), np.zeros((1, 1), U64), np.zeros(0))
    odds = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, sample / counts[name]))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < odds[F.col("lang")] * 1_000_000)

    def count(batches):
        for batch in portions(batches, 0):
            languages = np.array([names.index(x) for x in batch.column(1).to_pylist()], np.uint64)
            for lo, hi, grams, of in _grams(batch.column(0)):
                both = (np.repeat(languages[lo:hi], np.diff(of)) << U64(32)) | grams.astype(U64)
                keys, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> U64(32)).astype(np.int64)), pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["l", "gram", "n"])

    grams = picked.mapInArrow(count, "l long, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    rate = grams.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("l")))
    most = F.max("rate").over(Window.partitionBy("gram"))
    keenest = rate.withColumn("most", most).where(F.col("rate") >= keen * F.col("most"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))
    chosen = keenest.withColumn("rank", rank).where(F.col("rank") <= top).select("l", "gram").toPandas()
    masks = np.zeros((-(-len(names) // 64), 1 << slots_log2), U64)
    for at in _slots(chosen["gram"].to_numpy(), slots_log2):
        np.bitwise_or.at(masks, (chosen["l"].to_numpy() // 64, at), U64(1) << (chosen["l"].to_numpy() % 64).astype(U64))
    fill = np.array([np.mean((masks[k // 64] >> U64(k % 64)) & U64(1)) for k in range(len(names))])
    return LanguageFilter(names, masks, fill**HASHES)


def shares(column: pa.Array, known: LanguageFilter) -> np.ndarray:
    """(texts, languages): the corrected share of each text's n-grams that each language contains."""
    out = np.zeros((len(column), len(known.languages)))
    slots_log2 = known.masks.shape[1].bit_length() - 1
    for lo, hi, grams, of in _grams(column):
        slots = _slots(grams, slots_log2)
        total = np.maximum(np.diff(of), 1)
        for word in range(len(known.masks)):
            found = known.masks[word][slots[0]]
            for at in slots[1:]:
                found &= known.masks[word][at]
            for k in range(word * 64, min(len(known.languages), word * 64 + 64)):
                hits = sums_by(((found >> U64(k % 64)) & U64(1)).astype(np.int64), of)
                false = known.false_rate[k]
                out[lo:hi, k] = np.clip((hits / total - false) / max(1e-9, 1 - false), 0, 1)
    return out


def _has_letter(column: pa.Array) -> np.ndarray:
    plain = np.zeros(len(column), bool)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in pieces(np.concatenate([[0], np.cumsum(sizes)])):
        data, at = text_bytes(column.slice(lo, hi - lo))
        small = lowered(data)
        seen = np.append((small >= 0x61) & (small <= 0x7A), False)  # the last one is for empty texts at the end
        plain[lo:hi] = np.logical_or.reduceat(seen, at[:-1]) & (np.diff(at) > 0)
    for d in np.flatnonzero(~plain & (sizes > 0)):
        plain[d] = any(c.isalpha() for c in column[int(d)].as_py())
    return plain


def predict(docs: DataFrame, known: LanguageFilter) -> DataFrame:
    """docs with lang_pred and score (the winner's corrected share of the text's n-grams, 0 to 1) added.

    docs needs a column text; its other columns pass through, but for two of those names, which are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = keep.index("text")
    held = docs.sparkSession.sparkContext.broadcast(known)  # of a fixed size: masks of 2 ** slots_log2 slots

    def score(batches):
        known = held.value
        names = pa.array([*known.languages, "und"], pa.string())
        for batch in portions(batches, at):
            column = batch.column(at)
            letters = _has_letter(column)
            found = shares(column, known)
            best = found.argmax(axis=1) if found.shape[1] else np.zeros(len(column), np.int64)
            value = np.where(letters, found.max(axis=1), 0.0) if found.shape[1] else np.zeros(len(column))
            pick = np.where(letters, best, len(known.languages)) if found.shape[1] else best
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(pick)), pa.array(value)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(keep).mapInArrow(score, schema)


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the other folds of crc32(doc_id), predicts every row."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(0)) == held_out
    marked = docs.select("doc_id", fold.alias("held_out"), "text", "lang")
    known = learn(marked.where("not held_out"), **how)
    return predict(marked.drop("lang"), known).select("doc_id", "held_out", "lang_pred", "score")


def kept(docs: DataFrame, least: float = 0.02, **how) -> DataFrame:
    """The rows of docs whose language is told with a share of at least ``least``; ``und`` goes. Columns stay."""
    known = learn(docs.select("text", "lang"), **how)
    names = {name: f"llm_{k}" for k, name in enumerate(docs.columns) if name != "text"}  # none clashes with the new ones
    told = predict(docs.withColumnsRenamed(names), known)
    back = [F.col(names.get(name, name)).alias(name) for name in docs.columns]
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*back)
