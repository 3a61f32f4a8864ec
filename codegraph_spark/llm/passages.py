"""Substring dedup of paragraphs and passages.

Paragraphs are the lines of a text with at least ``PARAGRAPH`` words. They are compared by MinHash banding with more
bands of fewer rows than whole documents have, colliding ones are verified by the exact Jaccard similarity of their
5-word shingles, and components of links are one paragraph: its first place by (doc_id, word) stays, all others go.

MinHash of lines misses a passage that stands inside longer, different ones. So there is a second kind of paragraph:
the ``PASSAGE`` words from a content-defined anchor on, anchors being the words whose hash is smallest among ``NEAR``
in a row. Whatever surrounds it, a passage of NEAR + PASSAGE words or more holds such a paragraph in full wherever it
occurs. One changed word takes a fourth of the shingles of one so short, which leaves no similarity of 0.8 but 1, so
these have one band, the hash of all their words, and need no verification. Their first places stay, too; places
in the same document only count if they do not overlap the first. From each one that goes, the words shared to its left
and right go with it: as far as the longer run, too, has a first place that is earlier, whichever that is. NEAR - 1
words to each side are looked at. Where more are shared, another anchor is among them, so that of a run of
NEAR + PASSAGE - 1 words or more that an earlier place has, no word stays.

Words are compared in lower case (A-Z) and without regard to white space. Null texts stay null, texts without such
paragraphs are not touched; rows without a doc_id are kept as they are; rows that repeat a doc_id are texts of their
own, none earlier than the other, so they do not delete each other. Texts of any length are read in whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minhash import Rule, near_duplicates
from .shared import dropped, saved
from .textkit import U64, lowered, mixed, pieces, portions, prefix_sums, span_hashes, text_bytes, word_spans

PARAGRAPH, PASSAGE, NEAR = 20, 24, 26
#: longer_runs() compares so many slices of the runs one after the other.
SLICES = 3
#: Places of one passage that are compared in one task; passages with more of them go through longer_runs().
GROUP = 20_000
RULE = Rule(width=5, percent=80, rows=3, missed=3e-4)


def _line_words(own: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Offsets among the words of runs that are one line of one document each."""
    breaks = np.searchsorted(starts, np.flatnonzero(own == 10))
    return np.unique(np.concatenate([of, breaks, [len(starts)]]))


def _run_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each run of words, from prefix sums of position-weighted hashes."""
    base = U64(0xD6E8FEB86659FD93)
    up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(words), base)]))
    back = U64(pow(int(base), -1, 1 << 64))
    down = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(words), back)]))
    sums = np.concatenate([[U64(0)], np.cumsum(words * up[:-1])])
    return mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64))


def _anchors(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of words that are the smallest of NEAR in a row and have PASSAGE words from there on in their document."""
    n = len(words)
    if n < NEAR:
        return np.zeros(0, np.int64)
    least, size = words.copy(), 1
    while size < NEAR:  # least[i] is the minimum of words[i : i + size]
        step = min(size, NEAR - size)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        size += step
    end = np.repeat(of[1:], np.diff(of))
    at = np.arange(n)
    least[at + NEAR > end] = 0
    most, size = least, 1
    while size < NEAR:  # most[i] is the maximum of least[i - size + 1 : i + 1]
        step = min(size, NEAR - size)
        grown = most.copy()
        grown[step:] = np.maximum(most[step:], most[: n - step])
        most, size = grown, size + step
    return np.flatnonzero((most == words) & (at + PASSAGE <= end))


def _known(docs: DataFrame) -> DataFrame:
    """(doc_id, text, body): body, a hash of the text, tells apart texts that repeat a doc_id."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))


def places(docs: DataFrame) -> DataFrame:
    """(passage, id, doc_id, body, first, n, left_run, right_run, room): paragraphs and, where passage is true, passages:
    content hash, first word, words; hashes of the passage with the NEAR - 1 words to each side, or those there are, and
    how many there are to the right."""

    def find(batches):
        for batch in portions(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bodies = batch.column(2).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                own, at = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = word_spans(own, at)
                words = span_hashes(prefix_sums(own), starts, ends)
                cuts = _line_words(own, starts, of)
                a, b = cuts[:-1], cuts[1:]
                long = b - a >= PARAGRAPH
                spots = _anchors(words, of)
                a, b = np.concatenate([a[long], spots]), np.concatenate([b[long], spots + PASSAGE])
                passage = np.arange(len(a)) >= long.sum()
                doc = np.searchsorted(of, a, "right") - 1
                hashes = _run_hashes(words, a, b).view(np.int64)
                # Of passages, the runs with all words beside them that longer_runs() looks at, and how many words follow.
                room = np.minimum(of[doc + 1] - b, NEAR - 1)
                left_run, right_run = _run_hashes(words, np.maximum(a - (NEAR - 1), of[doc]), b), _run_hashes(words, a, b + room)
                yield pa.RecordBatch.from_arrays([pa.array(passage), pa.array(hashes), pa.array(ids[lo:hi][doc].astype(np.int64)), pa.array(bodies[lo:hi][doc]), pa.array(a - of[doc]), pa.array(b - a), *(pa.array(np.where(passage, x, 0)) for x in (left_run.view(np.int64), right_run.view(np.int64), room))], names=["passage", "id", "doc_id", "body", "first", "n", "left_run", "right_run", "room"])

    return _known(docs).mapInArrow(find, "passage boolean, id long, doc_id long, body long, first long, n long, left_run long, right_run long, room long")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(id, text): the long lines, with the content hashes that places() gives them."""

    def find(batches):
        for batch in portions(batches, 0):
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in pieces(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                small = lowered(own)
                starts, ends, of = word_spans(small, at)
                cuts = _line_words(own, starts, of)
                a, b = cuts[:-1], cuts[1:]
                long = b - a >= PARAGRAPH
                a, b = a[long], b[long]
                hashes = _run_hashes(span_hashes(prefix_sums(small), starts, ends), a, b).view(np.int64)
                texts = [own[x:y].tobytes() for x, y in zip(starts[a], ends[b - 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    return docs.select("text").where("doc_id is not null and text is not null").mapInArrow(find, "id long, text string")


def _beside(gone: DataFrame) -> DataFrame:
    """gone with left_from and right_from: from which word beside them on, counted from 1, there are words that may go
    only with this place; NEAR if there are none.

    gone: (doc_id, body, first, ...): the places that go. Where they overlap or touch they are a block, whose words go
    anyway; only the words that lie beside the block, but no more than NEAR - 1 words from a place, matter to that place.
    """
    order = Window.partitionBy("doc_id", "body").orderBy("first")
    back = Window.partitionBy("doc_id", "body").orderBy(F.desc("first"))
    before, after = F.lag("first").over(order), F.lead("first").over(order)
    marked = gone.withColumn("opens", F.when(F.coalesce(before + PASSAGE < F.col("first"), F.lit(True)), F.col("first"))).withColumn("closes", F.when(F.coalesce(after > F.col("first") + PASSAGE, F.lit(True)), F.col("first")))
    begin = F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    end = F.last("closes", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    side = lambda inside: F.least(inside + 1, F.lit(NEAR)).cast("int")
    return marked.withColumn("left_from", side(F.col("first") - begin)).withColumn("right_from", side(end - F.col("first"))).drop("opens", "closes")


def _later(place: str, size) -> Column:
    """Whether a row's place lies behind the given one: in a later document, or in the same text without overlap."""
    inside = (F.col(f"{place}.doc_id") == F.col("doc_id")) & (F.col(f"{place}.body") == F.col("body")) & (F.col(f"{place}.first") + size <= F.col("first"))
    return (F.col(f"{place}.doc_id") < F.col("doc_id")) | inside


def repeated_passages(found: DataFrame) -> DataFrame:
    """(id, doc_id, body, first, room, later, left_whole, right_whole): the places of passages that are there more than
    once, later being true for those that go; whether an earlier place has all words to a side, as far as looked at.

    found: places(). A passage's places meet in one task; those of passages with more than GROUP places are spread.
    """
    passages = found.where("passage").select("id", "doc_id", "body", "first", "left_run", "right_run", "room")
    # Passages are counted in bins of about GROUP / 8 places first, so that hardly any has to be counted by itself. Of
    # bins with more than GROUP places there are fewer than places / GROUP.
    bins = 1 + 8 * passages.count() // GROUP
    binned = passages.select("id", F.pmod(F.xxhash64("id"), F.lit(bins)).alias("bin"))
    full = [x["bin"] for x in binned.groupBy("bin").agg(F.count("*").alias("places")).where(F.col("places") > GROUP).select("bin").collect()]
    many = saved(binned.where(F.col("bin").isin(full)).groupBy("id").agg(F.count("*").alias("places")).where(F.col("places") > GROUP).select("id"), "many-places")
    spread = many.limit(1).count() > 0

    def classify(batches):
        for table in _whole_passages(batches):
            columns = [table.column(c).to_numpy() for c in ("id", "doc_id", "body", "first", "left_run", "right_run", "room")]
            fresh = _changes(*columns[:4])  # a text that is there twice has its places twice
            ids = columns[0][fresh]
            cuts = np.flatnonzero(_changes(ids))
            sizes = np.diff(np.append(cuts, len(ids)))
            several = sizes > 1
            kept = np.flatnonzero(fresh)[np.repeat(several, sizes)]
            sizes = sizes[several]
            ids, doc, body, first, left_run, right_run, room = (x[kept] for x in columns)
            out = [_behind(np.repeat(np.cumsum(sizes) - sizes, sizes), doc, body, first, PASSAGE)]
            for run, beside in ((left_run, np.minimum(first, NEAR - 1)), (right_run, room)):
                order = np.argsort(run, kind="stable")
                cuts = np.flatnonzero(_changes(run[order], ids[order]))
                origin = np.empty_like(order)
                origin[order] = np.repeat(order[cuts], np.diff(np.append(cuts, len(order))))
                out.append(_behind(origin, doc, body, first, PASSAGE + beside))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, doc, body, first, room, *out)], names=["id", "doc_id", "body", "first", "room", "later", "left_whole", "right_whole"])

    few = passages.join(F.broadcast(many), "id", "left_anti") if spread else passages
    out = few.repartition("id").sortWithinPartitions("id", "doc_id", "body", "first").mapInArrow(classify, "id long, doc_id long, body long, first long, room long, later boolean, left_whole boolean, right_whole boolean")
    parts = [_spread_classes(passages.join(F.broadcast(many), "id", "left_semi").distinct())] if spread else []
    out = saved(reduce(DataFrame.unionByName, parts, out), "classed")
    dropped(many, *parts)
    return out


def _spread_classes(places: DataFrame) -> DataFrame:
    """What repeated_passages() finds, for passages whose places are too many for one task.

    Whatever lies in another document than the first place of its class is later than that, so only places in the
    first's document are looked at; the others are not joined with anything.
    """
    places = saved(places, "spread")
    sizes = {"later": F.lit(PASSAGE), "left_whole": PASSAGE + F.least(F.col("first"), F.lit(NEAR - 1)), "right_whole": PASSAGE + F.col("room")}
    runs = {"later": F.lit(0), "left_whole": F.col("left_run"), "right_whole": F.col("right_run")}
    rows = reduce(DataFrame.unionByName, [places.select("id", F.lit(flag).alias("flag"), runs[flag].cast("long").alias("run"), "doc_id", "body", "first", sizes[flag].cast("long").alias("size")) for flag in sizes])
    firsts = saved(rows.groupBy("id", "flag", "run").agg(F.min(F.struct("doc_id", "body", "first")).alias("origin")), "class-firsts")
    # Of equal starts to the right and of equal ends to the left, so the firsts' places tell whether runs overlap.
    inside = rows.join(firsts.withColumn("doc_id", F.col("origin.doc_id")), ["id", "flag", "run", "doc_id"]).where(~_later("origin", F.col("size")))
    key = ["id", "doc_id", "body", "first"]
    either = inside.select(*key, F.lit(None).cast("long").alias("room"), *((F.col("flag") != flag).alias(flag) for flag in sizes))
    either = either.unionByName(places.select(*key, "room", *(F.lit(True).alias(flag) for flag in sizes)))
    out = saved(either.groupBy(*key).agg(F.max("room").alias("room"), *(F.min(flag).alias(flag) for flag in sizes)), "spread-classes")
    dropped(places, firsts)
    return out


def extensions(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, body, first, left, right): of the passages that go, by how many words to each side an earlier place has
    the same.

    places: repeated_passages(). Places with the same words to a side, as far as these are looked at, are a class. All
    but the first of a class share them all with an earlier place; only the firsts, one for each class, are compared
    word by word, and only where words that no other place covers may go with one of them.
    """
    beside = _beside(places.where("later"))
    needs = [beside.where(f"not {side}_whole").groupBy("id").agg(F.min(f"{side}_from").alias(f"{side}_from")).where(F.col(f"{side}_from") < NEAR) for side in ("left", "right")]
    needs = saved(needs[0].join(needs[1], "id", "full"), "needs")
    asked = places.where("not left_whole or not right_whole").join(needs, "id")
    asked = asked.select("id", "doc_id", "body", "first", *(F.when(~F.col(f"{side}_whole"), F.col(f"{side}_from")).alias(side) for side in ("left", "right"))).where("left is not null or right is not null").fillna(NEAR, ["left", "right"])
    longer = longest(docs, asked)
    gone = places.where("later").join(longer, ["doc_id", "body", "first"], "left")
    left = F.when(F.col("left_whole"), F.least(F.col("first"), F.lit(NEAR - 1))).otherwise(F.coalesce("left", F.lit(0)))
    right = F.when(F.col("right_whole"), F.col("room")).otherwise(F.coalesce("right", F.lit(0)))
    out = saved(gone.select("doc_id", "body", "first", left.cast("int").alias("left"), right.cast("int").alias("right")), "extensions")
    dropped(needs, longer)
    return out


def longest(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """What longer_runs() finds for (id, doc_id, body, first, left, right), id being the passage.

    Places that share a run share its passage, so those of a passage are compared in one task, word by word; those of
    passages with more than GROUP places are spread over tasks by their runs, in longer_runs().
    """
    asked = saved(asked, "asked")
    many = saved(asked.groupBy("id").agg(F.count("*").alias("places")).where(F.col("places") > GROUP).select("id"), "many-places")
    found = saved(beside_passages(docs, asked.join(many, "id", "left_anti")), "longer-sorted")
    parts = [found]
    if many.limit(1).count():
        parts.append(longer_runs(docs, asked.join(many, "id", "left_semi").drop("id")))
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        out = saved(out, "longest")
        dropped(*parts)
    dropped(asked, many)
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _whole_passages(batches):
    """Tables of GROUP rows and more that hold all rows of their passages; batches are sorted by id."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += len(batch)
        if rows >= GROUP:
            table = pa.Table.from_batches(waiting)
            ids = table.column("id").to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))
            if whole:
                yield table.slice(0, whole)
                waiting, rows = table.slice(whole).to_batches(), rows - whole
    if rows:
        yield pa.Table.from_batches(waiting)


def _behind(origin: np.ndarray, doc: np.ndarray, body: np.ndarray, first: np.ndarray, size, at=slice(None)) -> np.ndarray:
    """_later() for rows at, whose origins are rows, too."""
    return (doc[origin] < doc[at]) | ((doc[origin] == doc[at]) & (body[origin] == body[at]) & (first[origin] + size <= first[at]))


def _shared_words(group: np.ndarray, words: np.ndarray, n: np.ndarray, doc: np.ndarray, body: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of its n words (a row each, from the passage on) a place shares with an earlier one of its group.

    Places are in order in their groups, which the stable sorts keep.
    """
    best = np.zeros(len(group), np.int32)
    at, keys = np.arange(len(group)), group
    for k in range(words.shape[1]):
        fit = n[at] > k
        at, keys = at[fit], keys[fit]
        if not len(at):
            break
        keys = mixed(keys * U64(0xD6E8FEB86659FD93) + words[at, k])
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        cuts = np.flatnonzero(_changes(keys))
        sizes = np.diff(np.append(cuts, len(at)))
        later = _behind(np.repeat(at[cuts], sizes), doc, body, first, PASSAGE + k + 1, at)
        best[at[later]] = k + 1
        several = np.repeat(sizes > 1, sizes)
        at, keys = at[several], keys[several]
    return best


def beside_passages(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, body, first, left, right): by how many words to each side an earlier one of a passage's places has the same.

    asked: (id, doc_id, body, first, left, right); a side that is NEAR is not looked at. All places of a passage meet
    in one task, each with the hashes of the words beside it.
    """
    wide = NEAR - 1
    lists = asked.groupBy("doc_id", "body").agg(F.collect_set(F.struct("id", "first", "left", "right")).alias("asked"))

    def find(batches):
        for batch in portions(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(batch.column(1))
            bodies, lists = batch.column(2).to_numpy(), batch.column(3)
            for lo, hi in pieces(offsets):
                own, at = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = word_spans(own, at)
                words = span_hashes(prefix_sums(own), starts, ends)
                part = lists.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                flat = part.flatten()
                first = flat.field("first").to_numpy()
                spot = of[doc] + first
                passage = flat.field("id").to_numpy()
                least = [flat.field(side).to_numpy() for side in ("left", "right")]
                lefts = np.where(least[0] < NEAR, np.minimum(first, wide), 0)
                rights = np.where(least[1] < NEAR, np.minimum(of[doc + 1] - spot - PASSAGE, wide), 0)
                for some in np.array_split(np.arange(len(spot)), 1 + len(spot) // 20_000):
                    # The words to the left from the passage on, then those to the right.
                    a, sizes = lefts[some], lefts[some] + rights[some]
                    cuts = np.concatenate([[0], np.cumsum(sizes)])
                    by = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)
                    to_left = np.repeat(a, sizes)
                    beside = words[np.repeat(spot[some], sizes) + np.where(by < to_left, -1 - by, PASSAGE + by - to_left)]
                    near = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(beside)])
                    yield pa.RecordBatch.from_arrays([pa.array(passage[some]), pa.array(ids[lo:hi][doc[some]]), pa.array(bodies[lo:hi][doc[some]]), pa.array(first[some]), *(pa.array(x[some]) for x in least), pa.array(a.astype(np.int32)), near], names=["id", "doc_id", "body", "first", "left", "right", "lefts", "near"])

    def compare(table: pa.Table) -> pa.RecordBatch:
        ids, doc, body, first, lefts = (table.column(c).to_numpy() for c in ("id", "doc_id", "body", "first", "lefts"))
        near = table.column("near").combine_chunks()
        data = np.frombuffer(near.buffers()[2] or b"", U64)
        cuts = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64) // 8
        start, sizes = cuts[:-1], np.diff(cuts)
        found = []
        for side, begin, n in (("left", start, lefts), ("right", start + lefts, sizes - lefts)):
            words = np.zeros((len(ids), wide), U64)
            inside = np.arange(wide) < n[:, None]
            words[inside] = data[(begin[:, None] + np.arange(wide))[inside]]
            shared = _shared_words(ids.view(U64), words, n, doc, body, first)
            found.append(np.where(shared >= table.column(side).to_numpy(), shared, 0))
        some = (found[0] > 0) | (found[1] > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (doc, body, first, *(x.astype(np.int32) for x in found))], names=["doc_id", "body", "first", "left", "right"])

    def meet(batches):
        for table in _whole_passages(batches):
            yield compare(table)

    joined = _known(docs).join(lists, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"]).select("doc_id", "text", "body", "asked")
    near = joined.mapInArrow(find, "id long, doc_id long, body long, first long, left int, right int, lefts int, near binary")
    return near.repartition("id").sortWithinPartitions("id", "doc_id", "body", "first").mapInArrow(meet, "doc_id long, body long, first long, left int, right int")


def longer_runs(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, body, first, left, right): by how many words to each side an earlier one of the places has the same.

    repeated: (doc_id, body, first, left, right): places of passages, and from which word beside them on, counted from
    1, the words are looked at.
    """
    asked = repeated.groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "left", "right")).alias("asked"))

    def find(batches):
        for batch in portions(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(batch.column(1))
            bodies, lists = batch.column(2).to_numpy(), batch.column(3)
            for lo, hi in pieces(offsets):
                own, at = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                starts, ends, of = word_spans(own, at)
                words = span_hashes(prefix_sums(own), starts, ends)
                part = lists.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                flat = part.flatten()
                spot = of[doc] + flat.field("first").to_numpy()
                left, right = (flat.field(side).to_numpy() for side in ("left", "right"))
                for some in np.array_split(np.arange(len(spot)), 1 + len(spot) // 20_000):
                    sizes = 2 * NEAR - left[some] - right[some]
                    place = np.repeat(spot[some], sizes)
                    by = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - (NEAR - 1)
                    by += np.where(by > -np.repeat(left[some], sizes), np.repeat(left[some] + right[some] - 1, sizes), 0)
                    of_doc = np.repeat(doc[some], sizes)
                    a, b = place + np.minimum(by, 0), place + PASSAGE + np.maximum(by, 0)
                    fit = (a >= of[of_doc]) & (b <= of[of_doc + 1])
                    hashes = _run_hashes(words, a[fit], b[fit]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[lo:hi][of_doc[fit]]), pa.array(bodies[lo:hi][of_doc[fit]]), pa.array((place - of[of_doc])[fit]), pa.array(by[fit].astype(np.int32))], names=["run", "doc_id", "body", "first", "by"])

    joined = _known(docs).dropDuplicates(["doc_id", "body"]).join(asked, ["doc_id", "body"]).select("doc_id", "text", "body", "asked")
    runs = saved(joined.mapInArrow(find, "run long, doc_id long, body long, first long, by int"), "longer-runs")
    start = F.col("first") + F.least("by", F.lit(0))
    size = PASSAGE + F.abs("by")
    later = (F.col("origin.doc_id") < F.col("doc_id")) | ((F.col("origin.doc_id") == F.col("doc_id")) & (F.col("origin.body") == F.col("body")) & (F.col("origin.start") + size <= start))
    found = []
    for k in range(SLICES):  # all places of a run are in one slice; only one slice's shuffles lie on disk at a time
        some = runs.where(F.pmod("run", F.lit(SLICES)) == k)
        origins = some.groupBy("run").agg(F.min(F.struct("doc_id", "body", start.alias("start"))).alias("origin"), F.count("*").alias("times")).where("times > 1").drop("times")
        origins = saved(origins, "longer-origins")
        shared = some.join(origins, "run").where(later)
        found.append(saved(shared.groupBy("doc_id", "body", "first").agg(F.max(F.greatest(-F.col("by"), F.lit(0))).alias("left"), F.max(F.greatest("by", F.lit(0))).alias("right")), "longer-slice"))
        dropped(origins)
    dropped(runs)
    out = saved(reduce(DataFrame.unionByName, found).groupBy("doc_id", "body", "first").agg(F.max("left").alias("left"), F.max("right").alias("right")), "longer")
    dropped(*found)
    return out


def removals(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, body, place, first, n, passage): the runs of words to remove, place being the first word without those
    to the left that go with it."""
    found = saved(places(docs), "places")
    signed, classes = near_duplicates(paragraphs(docs), rule, content_ids=True)
    # Only components of several classes or of a class of several texts, which has ids besides its smallest.
    spare = signed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("h1", "h2")
    linked = classes.where("component <> rep").select("component").unionByName(classes.join(spare, ["h1", "h2"], "left_semi").select("component")).distinct()
    several = saved(classes.join(linked, "component", "left_semi").select("h1", "h2", "component"), "several-texts")
    group = signed.select("id", "h1", "h2").join(several, ["h1", "h2"])
    merged = saved(group.select("id", "component").distinct(), "merged")
    dropped(signed, classes, several)
    # A passage and a line are never one paragraph: the flag is part of the key.
    # A passage and a line are never one paragraph.
    lines = found.where("not passage").join(merged, "id", "left").withColumn("id", F.coalesce("component", "id"))
    lines = saved(lines.select("id", "doc_id", "body", "first", "n"), "grouped")
    dropped(merged)
    first = lines.groupBy("id").agg(F.min(F.struct("doc_id", "body", "first", "n")).alias("origin"), F.count("*").alias("times"))
    first = saved(first.where("times > 1").drop("times"), "first-places")
    met = saved(lines.join(first, "id").where(_later("origin", F.col("origin.n"))).select("doc_id", "body", "first", "n").distinct(), "repeated")
    dropped(lines, first)
    places_met = repeated_passages(found)
    dropped(found)
    longer = extensions(docs, places_met)
    dropped(places_met)
    whole = longer.select("doc_id", "body", F.col("first").alias("place"), (F.col("first") - F.col("left")).alias("first"), (PASSAGE + F.col("left") + F.col("right")).cast("long").alias("n"), F.lit(True).alias("passage"))
    return met.withColumn("place", F.col("first")).withColumn("passage", F.lit(False)).unionByName(whole)


def dedup_passages(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """docs with later paragraphs and passages removed from text, and n_words, n_removed (words), n_paragraphs and
    n_passages (removed ones) added; columns of docs of those names are replaced, n_chars follows the text."""
    new = ["n_words", "n_removed", "n_paragraphs", "n_passages"]
    keep = [c for c in docs.columns if c not in new]
    gone = removals(docs, rule).groupBy(F.col("doc_id").alias("llm_id"), F.col("body").alias("llm_body")).agg(F.collect_set(F.struct("place", "first", "n", "passage")).alias("llm_gone"))
    same = (F.col("doc_id").cast("long") == F.col("llm_id")) & (F.xxhash64("text") == F.col("llm_body"))
    joined = docs.select(*keep).join(gone, same, "left").drop("llm_id", "llm_body")
    at = keep.index("text")

    def cut(batches):
        for batch in portions(batches, at):
            column, gone = batch.column(at), batch.column(len(keep))
            data, offsets = text_bytes(column)
            sizes = np.zeros((4, len(column)), np.int64)
            changed: dict[int, bytes] = {}
            where = np.flatnonzero(np.asarray(gone.is_valid()))
            cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = gone.flatten()
            first, n, passage = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "passage"))
            last = first + n
            for lo, hi in pieces(offsets):
                own, here = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, _, of = word_spans(own, here)
                sizes[0, lo:hi] = np.diff(of)
                for d in where[(where >= lo) & (where < hi)]:
                    runs = slice(cuts[d], cuts[d + 1])
                    begin = np.append(starts[of[d - lo] : of[d - lo + 1]], here[d - lo + 1])
                    turn = np.bincount(first[runs], minlength=len(begin)) - np.bincount(last[runs], minlength=len(begin))
                    sizes[3, d] = passage[runs].sum()
                    sizes[2, d] = len(first[runs]) - sizes[3, d]
                    away = np.cumsum(turn)[:-1] > 0
                    sizes[1, d] = away.sum()
                    head = own[here[d - lo] : begin[0]].tobytes()
                    changed[int(d)] = head + b"".join(own[begin[k] : begin[k + 1]].tobytes() for k in np.flatnonzero(~away))
            texts = column
            if changed:
                plain = column.cast(pa.binary()).to_pylist()
                texts = pa.array([changed.get(d, x) for d, x in enumerate(plain)], pa.binary()).cast(column.type)
            yield pa.RecordBatch.from_arrays([*(texts if k == at else batch.column(k) for k in range(len(keep))), *map(pa.array, sizes)], names=[*keep, *new])

    schema = docs.select(*keep).schema
    for name in new:
        schema = schema.add(name, "long")
    done = joined.mapInArrow(cut, schema)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in keep else done


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_paragraphs, n_passages, kept_sha256 (null for a null text)."""
    done = dedup_passages(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", "n_paragraphs", "n_passages", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
