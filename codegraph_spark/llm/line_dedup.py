"""Line dedup by winnowing over line hashes.

A text is the sequence of its lines, cut at 0x0A; lines of white space only are not counted. Every ``run`` lines in a
row have one fingerprint, the hash that is smallest among them (the last such), so any run of that length which two
places share has a fingerprint in common. Fingerprints met once are done with. From each other one its matches are
extended to the left and right: all windows of ``run`` lines whose smallest hash it is, each looked for at its first
place in the corpus, by (doc_id, line). A window is deleted if its first place is in a document with a smaller
doc_id, or earlier in the same document without overlapping it; overlapping windows make up longer runs. White lines
inside a deleted window go with it.

Windows are compared by the 64-bit hashes of all their lines. Minima per window are aggregated before the shuffle, and
the joins that bring them back are between two plain shuffles, which adaptive execution can split where a line is hot.

Null texts stay null; rows without a doc_id are kept as they are and delete nothing; rows that repeat a doc_id are at
the same places and so do not delete each other. Texts with fewer than ``run`` lines are never touched, unless ``words``
is given: then shorter runs, down to one line, are windows too, if they have so many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .textkit import pieces, portions, prefix_sums, span_hashes, sums_by, text_bytes, word_spans

RUN = 3
WORDS = 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of the documents, and the offsets of each document's lines among them."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break that ends a document opens an empty last line, which comes before the next document's first line.
    of = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = of[1:] - 1
    if len(last):
        ends[last] = offsets[1:]
    return starts, ends, of


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(fp, doc_id, first, line, hash): the selected fingerprints; first is the place of the first window it stands
    for, counted in lines that are not white; line and hash are those of all lines of its windows."""

    def select(batches):
        for batch in portions(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = _lines(own, at)
                ink = np.concatenate([[0], np.cumsum(~_WHITE[own])])
                full = ink[ends] > ink[starts]
                number = (np.arange(len(starts)) - np.repeat(of[:-1], np.diff(of)))[full]
                hashes = span_hashes(prefix_sums(own), starts[full], ends[full]).view(np.int64)
                of = np.concatenate([[0], sums_by(full.astype(np.int64), of).cumsum()])
                count = np.maximum(np.diff(of) - run + 1, 0)
                if not count.sum():
                    continue
                doc = np.repeat(np.arange(hi - lo), count)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = place + of[doc]
                window = np.stack([hashes[begin + k] for k in range(run - 1, -1, -1)])
                anchor = begin + run - 1 - window.argmin(axis=0)
                new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                size = np.diff(np.append(new, len(anchor))) + run - 1
                flat = np.repeat(begin[new], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                cut = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[anchor[new]]), pa.array(ids[lo:hi][doc[new]].astype(np.int64)), pa.array(place[new]), pa.ListArray.from_arrays(cut, pa.array(number[flat])), pa.ListArray.from_arrays(cut, pa.array(hashes[flat]))],
                    names=["fp", "doc_id", "first", "line", "hash"],
                )

    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return known.mapInArrow(select, "fp long, doc_id long, first long, line array<long>, hash array<long>")


def repeated_windows(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, lo, hi): the windows to delete, as ranges of line numbers."""
    marks = saved(fingerprints(docs, run), "fingerprints")
    often = saved(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "often")
    offset = F.posexplode(F.expr(f"transform(sequence(0, size(hash) - {run}), k -> struct(slice(hash, k + 1, {run}) as key, line[k] as lo, line[k + {run - 1}] as hi))")).alias("k", "w")
    grown = marks.join(often, "fp").select("doc_id", "first", offset).select("doc_id", (F.col("first") + F.col("k")).alias("place"), "w.*")
    grown = saved(grown, "windows")
    return _later(grown, run)


def _later(windows: DataFrame, run: int) -> DataFrame:
    """(doc_id, lo, hi) of the windows that have an earlier first place; windows: (key, doc_id, place, lo, hi)."""
    first = saved(windows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"), "origins")
    later = (F.col("origin.doc_id") < F.col("doc_id")) | ((F.col("origin.doc_id") == F.col("doc_id")) & (F.col("origin.place") + run <= F.col("place")))
    return windows.join(first, "key").where(later).select("doc_id", "lo", "hi")


def short_windows(docs: DataFrame, run: int, words: int) -> DataFrame:
    """(doc_id, lo, hi): the windows of ``run`` lines to delete, of those with at least ``words`` words.

    A window is compared by the hashes of its lines and its number of bytes.
    """

    def find(batches):
        for batch in portions(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = _lines(own, at)
                begins, _, _ = word_spans(own, at)
                size = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
                full = size > 0
                line = (np.arange(len(starts)) - np.repeat(of[:-1], np.diff(of)))[full]
                doc = np.repeat(np.arange(hi - lo), np.diff(of))[full]
                hashes = span_hashes(prefix_sums(own), starts[full], ends[full]).view(np.int64)
                size, length = size[full], (ends - starts)[full]
                n = max(len(doc) - run + 1, 0)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (size, length)]
                hit = np.flatnonzero((doc[:n] == doc[run - 1 :][:n]) & (sums[0][run:][:n] - sums[0][:n] >= words))
                place = hit - np.searchsorted(doc, doc[hit])
                key = np.stack([hashes[hit + k] for k in range(run)] + [sums[1][hit + run] - sums[1][hit]], axis=1)
                cut = pa.array(np.arange(0, (len(hit) + 1) * (run + 1), run + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, pa.array(key.ravel())), pa.array(ids[lo:hi][doc[hit]].astype(np.int64)), pa.array(place), pa.array(line[hit]), pa.array(line[hit + run - 1])], names=["key", "doc_id", "place", "lo", "hi"])

    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    found = saved(known.mapInArrow(find, "key array<long>, doc_id long, place long, lo long, hi long"), "short-windows")
    return _later(found, run)


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """docs with repeated runs of lines deleted from text, and n_lines, n_removed (lines that are not white) added.

    Columns of docs of those two names are replaced; n_chars, if there is one, follows the text.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_windows(docs, run)
    for short in range(1, run if words else 1):
        gone = gone.unionByName(short_windows(docs, short, words))
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("llm_gone"))
    gone = gone.withColumnRenamed("doc_id", "llm_id")
    joined = docs.select(*keep).join(gone, F.col("doc_id").cast("long") == F.col("llm_id"), "left").drop("llm_id")
    at = keep.index("text")

    def cut(batches):
        for batch in portions(batches, at):
            column, gone = batch.column(at), batch.column(len(keep))
            data, offsets = text_bytes(column)
            texts, lines, removed = column, np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            changed: dict[int, bytes] = {}
            where = np.flatnonzero(np.asarray(gone.is_valid()))
            for lo, hi in pieces(offsets):
                own, here = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = _lines(own, here)
                ink = np.concatenate([[0], np.cumsum(~_WHITE[own])])
                full = (ink[ends] > ink[starts]).astype(np.int64)
                lines[lo:hi] = sums_by(full, of)
                for d in where[(where >= lo) & (where < hi)]:
                    first, last = of[d - lo], of[d - lo + 1]
                    turn = np.zeros(last - first + 1, np.int64)
                    for span in gone[int(d)].as_py():
                        turn[span["lo"]] += 1
                        turn[span["hi"] + 1] -= 1
                    stay = np.cumsum(turn)[:-1] == 0
                    removed[d] = full[first:last][~stay].sum()
                    changed[int(d)] = b"\n".join(own[starts[k] : ends[k]].tobytes() for k in first + np.flatnonzero(stay))
            if changed:
                plain = column.cast(pa.binary()).to_pylist()
                texts = pa.array([changed.get(d, x) for d, x in enumerate(plain)], pa.binary()).cast(column.type)
            out = [texts if k == at else batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(lines), pa.array(removed)], names=[*keep, "n_lines", "n_removed"])

    schema = docs.select(*keep).schema.add("n_lines", "long").add("n_removed", "long")
    done = joined.mapInArrow(cut, schema)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in keep else done


def digest(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; null for a null text)."""
    done = dedup_lines(docs.select("doc_id", "text"), run, words)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, s[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)),
inked AS (
  SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS place FROM lines WHERE NOT regexp_matches(x, '^[\\x20\\x09-\\x0D]*$')),
windows AS (
  SELECT doc_id, place, line AS lo, lead(line, {RUN - 1}) OVER w AS hi, [x, {", ".join(f"lead(x, {k}) OVER w" for k in range(1, RUN))}] AS key
  FROM inked WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
origins AS (
  SELECT key, min((doc_id, place)) AS o FROM windows WHERE hi IS NOT NULL GROUP BY key),
gone AS (
  SELECT doc_id, lo, hi FROM windows JOIN origins USING (key)
  WHERE hi IS NOT NULL AND (o[1] < doc_id OR (o[1] = doc_id AND o[2] + {RUN} <= place))),
removed AS (SELECT DISTINCT g.doc_id, l.line FROM gone g JOIN lines l ON l.doc_id = g.doc_id AND l.line BETWEEN g.lo AND g.hi),
marked AS (
  SELECT l.doc_id, l.line, l.x, r.line IS NOT NULL AS gone, i.line IS NOT NULL AS ink
  FROM lines l LEFT JOIN removed r ON r.doc_id = l.doc_id AND r.line = l.line LEFT JOIN inked i ON i.doc_id = l.doc_id AND i.line = l.line),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE ink) AS n_lines, count(*) FILTER (WHERE ink AND gone) AS n_removed,
         sha256(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
