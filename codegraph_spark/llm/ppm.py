"""Language model scores by prediction by partial matching (PPM).

A text is a sequence of tokens, its words in lower case (A-Z only) and one end. The model codes a word byte by byte,
then a blank; the end is one symbol of its own. A symbol is predicted in the context of up to ``DEPTH`` bytes before it,
over blanks and back to the blank before the first word. Contexts form a trie, with counts of all training texts; a context counts a
symbol once for each longer context that has it (update exclusion), the longest ones count each occurrence. If a symbol
was not seen in its context, an escape is coded, and the next shorter context is used without the symbols that the
longer one would have coded (exclusion), down to all bytes alike. How likely an escape is, is learned for each order
from all contexts with about as many occurrences and distinct symbols: by how often an occurrence, were it left out,
would be new there. The score is the log10 probability of the text. Beside it stands that of a word unigram model with
add-one smoothing.

Nothing of the model is gathered in one place. The trie lies dealt over ``home`` tasks by the last two bytes of its
contexts, so that each context is with all shorter ones but those of one byte, which are a table of 256 by 256 counts;
words are dealt by their hashes. Texts go through in batches of some megabytes. A batch sends each home the distinct
grams and words that it has of it, with their counts in its training texts, as one packed row; homes add these up and
send the code lengths and counts back, packed as well. So no row stands for a single gram, what crosses the network is
what batches have distinct, and no task holds more than the distinct grams of a home and one packed row at a time.
Words meet under 64-bit hashes.

Without ``across``, contexts end at the beginning of a word: the model then spells words one by one, and the end is
coded after a blank alone.

Null and empty texts have their end only. Rows that repeat a doc_id, or have none, are texts of their own; texts longer
than a batch are a batch of their own. With nothing to learn from, all symbols are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved
from .textkit import U64, distinct, lowered, mixed, pieces, portions, prefix_sums, span_hashes, text_bytes, word_spans

DEPTH = 6
BATCH = 20 << 20
FRACTION = 36
BYTES_A_HOME = 2 << 20
ROWS_A_MERGE = 64
PIECES_A_TALLY = 6
END = 0x0A


def _mask(bytes_: int) -> np.uint64:
    return U64((1 << (8 * bytes_)) - 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes: their number and width, then compressed, all first bytes first."""
    values = np.ascontiguousarray(values)
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return np.array([len(values), values.itemsize], np.int32).tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = np.frombuffer(data, np.int32, 2).tolist()
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def ascending(values: np.ndarray) -> bytes:
    """packed() for sorted integers: what each adds to the one before."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U64), dtype=U64)


def coded(place: np.ndarray, values: np.ndarray) -> bytes:
    """values[place], few of which are distinct, as places among those that are used, and these. values: sorted, none
    above zero; they travel as whole multiples of 2**-FRACTION."""
    used = distinct(place)
    narrow = np.uint16 if len(used) < 1 << 16 else np.uint32
    head = ascending(np.rint(-values[used][::-1] * 2.0**FRACTION).astype(U64))
    return np.array([len(head)], np.int64).tobytes() + head + packed(np.searchsorted(used, place).astype(narrow))


def uncoded(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    place = data[8 + size :]
    values = -(unpacked_ascending(data[8 : 8 + size])[::-1] / 2.0**FRACTION)
    return values[unpacked(place, np.uint16 if np.frombuffer(place, np.int32, 2)[1] == 2 else np.uint32)]


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts], np.add.reduceat(weights[order], cuts)


def symbols_of(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of documents in a row and how many each has: a blank, its words with a blank after each, the end."""
    width = ends - starts + 1  # with the blank
    sizes = np.concatenate([[0], np.cumsum(width)])[of]
    sizes = np.diff(sizes) + 2
    flat = np.full(int(sizes.sum()), 0x20, np.uint8)
    flat[np.cumsum(sizes) - 1] = END
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    begin = np.cumsum(width) - width + 2 * doc + 1
    size = ends - starts
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin, size) + step] = own[np.repeat(starts, size) + step]
    return flat, sizes


def text_grams(flat: np.ndarray, sizes: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) of each symbol but the documents' first blanks.

    A gram is the symbol and its context packed to one integer. From the highest byte on: the up to DEPTH bytes before
    the symbol, the nearest first; the symbol; the order, the length of the context. So grams of like contexts are
    neighbours, and those of a home lie in runs.
    """
    begin = np.cumsum(sizes) - sizes
    gram = np.ndarray(len(flat), "<u8", np.append(np.zeros(8, np.uint8), flat), strides=(1,)) & _top(DEPTH)
    gram |= (flat.astype(U64) << U64(8)) | U64(DEPTH)
    if across:
        fewer = np.concatenate([begin[sizes > k] + k for k in range(DEPTH)])
        order = np.repeat(np.arange(DEPTH), [int((sizes > k).sum()) for k in range(DEPTH)])
    else:
        at = np.arange(len(flat))
        order = at - np.append(0, np.maximum.accumulate(np.where(flat == 0x20, at, 0))[:-1])
        fewer = np.flatnonzero(order < DEPTH)
        order = order[fewer]
    tops = np.array([_top(k) for k in range(DEPTH + 1)], U64)
    gram[fewer] = (gram[fewer] & (tops[order] | U64(0xFF00))) | order.astype(U64)
    return np.delete(gram, begin), np.repeat(np.arange(len(sizes)), sizes - 1)


def _top(bytes_: int) -> np.uint64:
    return U64(((1 << (8 * bytes_)) - 1) << (64 - 8 * bytes_))


def parted(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the symbol in the lowest byte and then its context, from the nearest byte on; order) of grams."""
    own = np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(gram), 8), np.uint8)
    out[:, 0], out[:, 1:7] = own[:, 1], own[:, :1:-1]
    return out.view(U64).ravel(), own[:, 0].astype(np.int64)


def gram_tally(gram: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tally() of grams, train being 0 or 1: sorts them with that in a free bit."""
    both = np.sort(gram | (train.astype(U64) << U64(7)))
    gram = both & ~U64(0x80)
    cuts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    return gram[cuts], np.add.reduceat((both >> U64(7)) & U64(1), cuts).astype(np.uint32) if len(cuts) else np.zeros(0, np.uint32)


def _homes(parts: int) -> np.ndarray:
    """The home of each context's last two bytes, the nearest one higher."""
    return (mixed(np.arange(1 << 16, dtype=U64) + U64(0x51ED270B)) % U64(parts)).astype(np.int64)


def _home_of(gram: np.ndarray, homes: np.ndarray) -> np.ndarray:
    return homes[(gram >> U64(48)).astype(np.int64)]


def _home_of_word(words: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(words) % U64(parts)).astype(np.int64)


def _by_home(home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, used homes, cuts): places sorted by home, and where each used home's lie in that order."""
    order = np.argsort(home, kind="stable")
    own = home[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
    return order, own[cuts[:-1]], cuts


def _word_hashes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the words among symbols."""
    starts, ends, of = word_spans(flat, np.append(0, np.cumsum(sizes)))
    return span_hashes(prefix_sums(flat), starts, ends), np.repeat(np.arange(len(sizes)), np.diff(of))


ASKED = "home int, batch long, grams binary, counts binary, words binary, word_counts binary"
TEXTS = "batch long, doc_id array<long>, held_out array<boolean>, flat binary, sizes array<long>"


def _asked_rows(number: int, grams: list, words: list, homes: np.ndarray, parts: int) -> pa.RecordBatch:
    """What a batch asks its homes for. grams, words: (keys, counts) of its pieces."""
    gram, count = tally(*(np.concatenate(x) for x in zip(*grams, strict=True)))
    word, times = tally(*(np.concatenate(x) for x in zip(*words, strict=True)))
    order, used, cuts = _by_home(_home_of(gram, homes))
    w_order, w_used, w_cuts = _by_home(_home_of_word(word, parts))
    at, w_at = ({int(h): o[a:b] for h, a, b in zip(u, c[:-1], c[1:], strict=True)} for o, u, c in ((order, used, cuts), (w_order, w_used, w_cuts)))
    all_homes, none = sorted(at.keys() | w_at.keys()), np.zeros(0, np.int64)
    rows = [(ascending(gram[g]), packed(count[g]), ascending(word[w]), packed(times[w])) for g, w in ((at.get(h, none), w_at.get(h, none)) for h in all_homes)]
    columns = [pa.array(all_homes, pa.int32()), pa.array([number] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(4))]
    return pa.RecordBatch.from_arrays(columns, names=["home", "batch", "grams", "counts", "words", "word_counts"])


def batches_of(docs: DataFrame, parts: int, across: bool) -> DataFrame:
    """Batches of whole texts: rows with their texts as symbols (home is null) and what they ask of each home.

    docs: (doc_id, text, held_out).
    """
    names = ["home", "batch", "doc_id", "held_out", "flat", "sizes", "grams", "counts", "words", "word_counts"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def run(arrow):
        homes, number, size, grams, words = _homes(parts), TaskContext.get().partitionId() << 32, 0, [], []

        def filled(found: dict):
            n = len(next(iter(found.values())))
            return pa.RecordBatch.from_arrays([pa.array(found[x], t) if x in found else pa.nulls(n, t) for x, t in zip(names, kinds, strict=True)], names=names)

        def asked():
            found = _asked_rows(number, grams, words, homes, parts)
            return filled({x: found.column(x) for x in found.schema.names})

        for batch in portions(arrow, 1):
            held = np.asarray(batch.column(2)).astype(bool)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                own, at = lowered(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                flat, sizes = symbols_of(own, *word_spans(own, at))
                train = (~held[lo:hi]).astype(np.uint32)
                gram, doc = text_grams(flat, sizes, across)
                grams.append(gram_tally(gram, train[doc]))
                word, doc = _word_hashes(flat, sizes)
                words.append(tally(word, train[doc]))
                yield filled({"batch": [number], "doc_id": [batch.column(0).slice(lo, hi - lo).to_pylist()], "held_out": [held[lo:hi]], "flat": [packed(flat)], "sizes": [sizes]})
                size += len(flat)
                for keep in (grams, words):
                    if len(keep) >= PIECES_A_TALLY:
                        keep[:] = [tally(*(np.concatenate(x) for x in zip(*keep, strict=True)))]
                if size >= BATCH:
                    yield asked()
                    number, size, grams, words = number + 1, 0, [], []
        if grams:
            yield asked()

    schema = "home int, batch long, doc_id array<long>, held_out array<boolean>, flat binary, sizes array<long>, grams binary, counts binary, words binary, word_counts binary"
    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, schema)


def _bucket(x: np.ndarray) -> np.ndarray:
    """Few classes of counts: 0 to 8 each, then by powers of two, up to 2**24."""
    x = np.maximum(x, 0)
    return np.where(x <= 8, x, np.minimum(np.floor(np.log2(np.maximum(x, 1))) + 6, CLASSES - 1)).astype(np.int64)


CLASSES = 31


def _levels(gram: np.ndarray, order: np.ndarray, count: np.ndarray, pairs: np.ndarray | None, lowest: int = 0):
    """From the longest order down to ``lowest``: (order, grams, their counts, contexts, the context of each gram)."""
    keys = np.zeros(0, U64)
    for k in range(DEPTH, lowest - 1, -1):
        if k >= 2:
            own = (order == k) & (count > 0)
            wide, times = np.concatenate([gram[own], keys & _mask(k + 1)]), np.concatenate([count[own], np.ones(len(keys))])
            keys, times = tally(wide, times)
        else:
            table = pairs.ravel() if k else (pairs > 0).sum(axis=0)
            keys = np.flatnonzero(table).astype(U64)
            times = table[keys.astype(np.int64)].astype(float)
        contexts, of = keys >> U64(8), np.zeros(len(keys), np.int64)  # sorted, as the keys are
        if len(keys):
            new = np.append(True, contexts[1:] != contexts[:-1])
            contexts, of = contexts[new], np.cumsum(new) - 1
        yield k, keys, times, contexts, of


def novelty(gram: np.ndarray, order: np.ndarray, count: np.ndarray, pairs: np.ndarray | None, lowest: int) -> np.ndarray:
    """(order, class of n, class of q, 2): of the occurrences in contexts that would have n others, of q kinds, how many
    would be known and how many new there. For the orders from ``lowest`` on."""
    out = np.zeros((DEPTH + 1, CLASSES, CLASSES, 2))
    for k, _, times, contexts, of in _levels(gram, order, count, pairs, lowest):
        n, q = np.bincount(of, times, len(contexts)), np.bincount(of, minlength=len(contexts))
        once = np.bincount(of, times == 1, len(contexts))
        np.add.at(out, (k, _bucket(n - 1), _bucket(q), 0), n - once)
        np.add.at(out, (k, _bucket(n - 1), _bucket(q - 1), 1), once)
    return out


def escape_odds(new: np.ndarray) -> np.ndarray:
    """Of novelty() tables: the odds of an escape by order, n and q; q of n + q (method C) where little was seen."""
    known, fresh = new[..., 0], new[..., 1]
    size = np.where(np.arange(CLASSES) <= 8, np.arange(CLASSES), 2.0 ** (np.arange(CLASSES) - 6.0) * 1.5)
    prior = size[None, None, :] / np.maximum(size[None, :, None] + size[None, None, :], 1)
    return np.clip((fresh + 2 * prior) / (known + fresh + 2), 1e-6, 1 - 1e-6)


def code_lengths(gram: np.ndarray, order: np.ndarray, count: np.ndarray, pairs: np.ndarray, escape: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams whose contexts of two bytes or more are all there; pairs: counts by the last two
    bytes (256 by 256). Those with a count were seen in training."""
    out, still = np.zeros(len(gram)), np.ones(len(gram), bool)
    child = np.full(len(gram), -1)  # the place of the next longer context, if known, among the contexts of its order
    above = None  # grams, their contexts' places and numbers of distinct symbols, of the next longer order
    for k, keys, times, contexts, of in _levels(gram, order, count, pairs):
        total, distinct = np.bincount(of, times, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
        gone, fewer = np.zeros(1), np.zeros(1)
        if above is not None and len(above[0]):
            high, high_of, high_distinct = above
            gone = np.append(np.bincount(high_of, times[np.searchsorted(keys, high & _mask(k + 1))], len(high_distinct)), 0.0)
            fewer = np.append(high_distinct, 0.0)
        above = keys, of, distinct
        act = np.flatnonzero(still & (order >= k))
        key = gram[act] & _mask(k + 1)
        spot = np.minimum(np.searchsorted(contexts, key >> U64(8)), max(len(contexts) - 1, 0))
        known = contexts[spot] == key >> U64(8) if len(contexts) else np.zeros(len(act), bool)
        act, key, spot = act[known], key[known], spot[known]
        n, q = total[spot] - gone[child[act]], distinct[spot] - fewer[child[act]]
        leave = np.where(q > 0, escape[k, _bucket(n), _bucket(q)], 1.0)
        hit = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        found = keys[hit] == key if len(keys) else np.zeros(0, bool)
        out[act[found]] += np.log10((1 - leave[found]) * times[hit[found]] / n[found])
        still[act[found]] = False
        out[act[~found]] += np.log10(leave[~found])
        child[:] = -1
        child[act] = spot
    out[still] -= np.log10(max(1, 256 - len(above[0])))
    return out


def _merged(asked: DataFrame, batches: int) -> DataFrame:
    """(home, grams, counts, words, word_counts): sums over all batches, in steps of ROWS_A_MERGE rows or so."""

    def merge(table):
        read = lambda name, f: [f(x) for x in table.column(name).to_pylist()]
        out = {"home": table.column("home").slice(0, 1)}
        for keys, counts in (("grams", "counts"), ("words", "word_counts")):
            key, count = tally(np.concatenate(read(keys, unpacked_ascending)), np.concatenate([unpacked(x, kind).astype(U64) for x, kind in zip(read(counts, bytes), widths(table.column(counts)), strict=True)]))
            out |= {keys: pa.array([ascending(key)], pa.binary()), counts: pa.array([packed(count)], pa.binary())}
        return pa.table(out)

    def widths(column):
        return [np.uint32 if np.frombuffer(x, np.int32, 2)[1] == 4 else U64 for x in column.to_pylist()]

    kept = asked.select("home", "grams", "counts", "words", "word_counts", "batch")
    while batches > ROWS_A_MERGE:
        batches = -(-batches // ROWS_A_MERGE)
        kept = kept.withColumn("batch", F.pmod(F.xxhash64("batch", F.lit(batches)), F.lit(batches)))

        def step(key, table):
            return merge(table).append_column("batch", pa.array([key[1].as_py()], pa.int64()))

        kept = kept.groupBy("home", "batch").applyInArrow(step, "home int, grams binary, counts binary, words binary, word_counts binary, batch long")
    return kept.drop("batch").groupBy("home").applyInArrow(merge, "home int, grams binary, counts binary, words binary, word_counts binary")


def _home_grams(grams: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *parted(unpacked_ascending(grams)), unpacked(counts, U64).astype(np.int64)


class Model:
    """What all homes need besides their own part of the trie: tables of bounded size."""

    def __init__(self, homes: DataFrame):
        """homes: as _merged() gives them."""

        def facts(arrow):
            for batch in arrow:
                for grams, counts, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    gram, order, count = _home_grams(grams, counts)
                    seen = count > 0
                    gram, order, count = gram[seen], order[seen], count[seen]
                    new = novelty(gram, order, count, None, 2)
                    at = np.flatnonzero(new.any(axis=-1))
                    three = distinct(gram[order > 1] & _mask(3)) & _mask(2)
                    once = order == 1
                    two, n = tally(np.concatenate([three, gram[once]]), np.concatenate([np.ones(len(three), np.int64), count[once]]))
                    train = unpacked(words, U64).astype(np.int64)
                    rows = [(0, at, new.reshape(-1, 2)[at, 0], new.reshape(-1, 2)[at, 1]), (1, two.astype(np.int64), n, np.zeros(len(n))), (2, [0], [train.sum()], [(train > 0).sum()])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows])), *(pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64 if k == 1 else np.float64)) for k in (1, 2, 3))], names=["kind", "cell", "known", "fresh"])

        found = homes.select("grams", "counts", "word_counts").mapInArrow(facts, "kind int, cell long, known double, fresh double")
        # At most (DEPTH + 1) * CLASSES ** 2 cells and 256 by 256 pairs, whatever the input.
        table = found.groupBy("kind", "cell").agg(F.sum("known").alias("known"), F.sum("fresh").alias("fresh")).toPandas()
        cells, pairs, words = (table[table.kind == k] for k in range(3))
        self.pairs = np.zeros(1 << 16, np.int64)
        self.pairs[pairs.cell.to_numpy()] = pairs.known.to_numpy()
        self.pairs = self.pairs.reshape(256, 256)
        nothing = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = novelty(*nothing, self.pairs, 0)  # of orders 0 and 1
        new.reshape(-1, 2)[cells.cell.to_numpy()] += cells[["known", "fresh"]].to_numpy()
        self.escape = escape_odds(new)
        self.tokens, self.kinds = int(words.known.sum()), int(words.fresh.sum())

    def codes(self, gram: np.ndarray, order: np.ndarray, count: np.ndarray) -> np.ndarray:
        return code_lengths(gram, order, count, self.pairs, self.escape)


def _answers(homes: DataFrame, asked: DataFrame, batches: int, model: Model) -> DataFrame:
    """(asker, home, codes, word_counts): for each row of asked its grams' code lengths and its words' counts.

    A home that many batches ask is copied once for each 256 of them or so.
    """
    fan = -(-batches // 256)
    asks = asked.select("home", F.pmod(F.xxhash64("batch"), F.lit(fan)).alias("chunk"), F.lit(1).alias("role"), "batch", "grams", F.lit(None).cast("binary").alias("counts"), "words", F.lit(None).cast("binary").alias("word_counts"))
    owners = homes.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))).alias("chunk"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("batch"), "grams", "counts", "words", "word_counts")
    dealt = owners.unionByName(asks).repartition("home", "chunk").sortWithinPartitions("home", "chunk", "role")

    def answer(arrow):
        for batch in arrow:
            rows = []
            for row in batch.to_pylist():
                if row["role"] == 0:
                    whole = unpacked_ascending(row["grams"])
                    codes, place = np.unique(model.codes(*_home_grams(row["grams"], row["counts"])), return_inverse=True)
                    words, times = unpacked_ascending(row["words"]), unpacked(row["word_counts"], U64)
                    continue
                wanted = np.searchsorted(whole, unpacked_ascending(row["grams"])), np.searchsorted(words, unpacked_ascending(row["words"]))
                rows.append((row["batch"], row["home"], coded(place[wanted[0]], codes), packed(times[wanted[1]])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["asker", "home", "codes", "word_counts"])

    return dealt.mapInArrow(answer, "asker long, home int, codes binary, word_counts binary")


def _looked_up(own: np.ndarray, doc: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, value) of each of own, in the order of their keys; values: of the sorted keys."""
    order = np.argsort(own)
    own = own[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    return doc[order], values[np.searchsorted(keys, own[new])][np.cumsum(new) - 1]


def score(docs: DataFrame, across: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    docs: (doc_id, text, held_out); learns from the texts that are not held out. across: whether contexts reach over
    blanks.
    """
    facts = docs.agg(F.sum(F.octet_length("text") + 2).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    parts, ends = max(1, (facts["bytes"] or 0) // BYTES_A_HOME), facts["ends"]
    table = saved(batches_of(docs, parts, across), "batches")
    asked, texts = table.where("home is not null").select(*(c.split()[0] for c in ASKED.split(", "))), table.where("home is null").select(*(c.split()[0] for c in TEXTS.split(", ")))
    batches = max(1, texts.agg(F.count_distinct("batch")).first()[0])
    homes = saved(_merged(asked, batches), "homes")
    model = Model(homes)
    answers = _answers(homes, asked, batches, model)
    total, distinct_ = model.tokens + ends, model.kinds + (ends > 0)

    def add_up(texts, answers):
        out = {f.name: [] for f in schema}
        answers = answers.sort_by("home")
        codes, times = (np.concatenate([np.zeros(0), *(f(x) for x in answers.column(name).to_pylist())]) for name, f in (("codes", uncoded), ("word_counts", lambda x: unpacked(x, U64))))
        rows = [(unpacked(flat, np.uint8), np.array(sizes)) for flat, sizes in zip(texts.column("flat").to_pylist(), texts.column("sizes").to_pylist(), strict=True)]
        found = []  # of grams and of words: how they are found, all keys of the batch, and their values
        for f, home, values in ((lambda *x: text_grams(*x, across), lambda x: _home_of(x, _homes(parts)), codes), (_word_hashes, lambda x: _home_of_word(x, parts), times)):
            keys = distinct(np.concatenate([np.zeros(0, U64), *(distinct(f(*row)[0]) for row in rows)]))
            by_key = np.zeros(len(keys))
            by_key[np.argsort(home(keys), kind="stable")] = values
            found.append((f, keys, by_key))
        log = np.log10(total + distinct_ + 1)
        for k, row in enumerate(rows):
            n = len(row[1])
            (gram_doc, code), (word_doc, count) = (_looked_up(*f(*row), keys, by_key) for f, keys, by_key in found)
            out["doc_id"].append(texts.column("doc_id")[k].values)
            out["held_out"].append(texts.column("held_out")[k].values)
            out["n_tokens"].append(np.bincount(word_doc, minlength=n) + 1)
            out["n_known"].append(np.bincount(word_doc, count > 0, n).astype(np.int64) + (ends > 0))
            out["train_tokens"].append(np.full(n, total))
            out["base_score"].append(np.bincount(word_doc, np.log10(count + 1) - log, n) + np.log10(ends + 1) - log)
            out["score"].append(np.bincount(gram_doc, code, n))
        return pa.table({f.name: pa.chunked_array([pa.array(x, f.type) for x in out[f.name]], f.type) for f in schema}, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return texts.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_folds(docs: DataFrame, folds: int = 7, held_out: int = 2, across: bool = False) -> DataFrame:
    """score() with the fold ``held_out`` of crc32(doc_id) held out."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(0))
    return score(docs.select("doc_id", "text", (fold == held_out).alias("held_out")), across=across)
