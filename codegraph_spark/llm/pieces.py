"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over a text from left to right and keeps, for each place, the one piece that can end there. For a
vocabulary of merges that piece is unique: a row of pieces is an encoding exactly if no merge reaches across the
border of any two neighbours, so a piece may end at a place if it fits the piece that ends where it starts. Only the
places of the last ``longest`` characters can be gone back to; whenever the paths back from all of these meet at one
border, the pieces up to there are committed and forgotten. The window never holds more than a unit, or, of a long one,
2 * ``longest`` + STEP places, whatever the length of the text.

The ids are those of the SentencePiece library for the same model (identity normaliser, dummy prefix, byte fallback),
but that a U+2581 in a text is written as bytes, so that decoding gives back every text exactly. White space before a
word belongs to its first piece, and no piece holds a letter and then a stop, so no piece crosses the borders of such
units: there all paths meet. Texts stream through unit by unit, and ids of units that came by lately are looked up, in a
bounded cache below the pass.

Null texts have null ids, empty ones no ids. The vocabulary file is a parameter; it is read on the driver and sent
to the executors, a megabyte or so whatever the input. Columns pass through, but for those of the new names, which are
replaced; ids of rows do not matter.
"""

from __future__ import annotations

import collections
import itertools
import math
import operator
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .textkit import pieces, portions, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
STEP, LONGEST_KNOWN, HEAD = 64, 64, 4
_GROUP = operator.methodcaller("group")


class _Known(dict):
    """Ids, as bytes, of units seen lately; others are encoded when they are asked for. In two generations of ``most``
    units: when one is full, the older one goes, so memory does not grow with the length of a text."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = np.array(self.encode(unit), np.int32).tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(unit) <= LONGEST_KNOWN:
            self[unit] = found
        return found


class Pieces:
    """A vocabulary: (piece, score) of the normal pieces by id, and the ids of the 256 byte pieces."""

    def __init__(self, normal: dict[int, tuple[str, float]], byte_ids: list[int], cache: int = 300_000):
        self.ids = {piece: k for k, (piece, _) in normal.items()}
        self.rank = {piece: -score for piece, score in normal.values()}
        self.byte_ids = byte_ids
        self.bytes_of = {k: piece.replace(SPACE, " ").encode() for k, (piece, _) in normal.items()} | {k: bytes([b]) for b, k in enumerate(byte_ids)}
        self.made: dict[str, float] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in sorted(self.rank, key=len):
            if len(piece) == 1:
                self.made[piece] = -1.0
            elif (last := self._last_merge(piece)) is not None:
                self.made[piece], self.parts[piece] = self.rank[piece], last
        self.longest = max(map(len, self.made), default=1)
        self.fitting: dict[str, dict[str, bool]] = collections.defaultdict(dict)  # which pieces fit after one or not
        self.tails = {piece[k:]: -1 for piece in self.made for k in range(len(piece))} | {piece: self.ids[piece] for piece in self.made}
        stops = "".join(c for c in ".,;:!?|" if not any(a.isalpha() and b == c for piece in self.made for a, b in itertools.pairwise(piece)))
        if stops:  # no piece holds a letter and then one of these, so a unit may end between them
            self.units = re.compile(f" *[^ \n](?:[^ \n{stops}]|(?<![^\\W\\d_])[{stops}])*| +|\n")
        else:
            self.units = re.compile(" *[^ \n]+| +|\n")
        self.piece_of = {k: piece for piece, k in self.ids.items()}
        self.chars = ({piece for piece in self.made if len(piece) == 1} - {SPACE}) | {" "}
        self.known = _Known(self._unit, cache)
        self.begun: dict[str, tuple] = {}
        self.commits = self.widest = 0  # commits made, and the most places that the window had
        sizes = np.zeros(max(self.bytes_of, default=-1) + 2, np.int64)
        for k, found in self.bytes_of.items():
            sizes[k + 1] = len(found)
        self.places = np.cumsum(sizes)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of[k] for k in sorted(self.bytes_of)), np.uint8)

    @classmethod
    def load(cls, path: str = MODEL) -> tuple[dict, list[int]]:
        """What the constructor takes, from a SentencePiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(k, model.is_byte(k), model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in range(model.get_piece_size())]
        normal = {k: (model.id_to_piece(k), model.get_score(k)) for k, byte, other in kinds if not byte and not other}
        return normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge to the piece at the end, or None if merging does not arrive at it."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, math.inf) for a, b in itertools.pairwise(parts)]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] == math.inf:
                return None
            last = parts[best], parts[best + 1]
            parts[best : best + 2] = [last[0] + last[1]]
        return last

    def fits(self, a: str, b: str) -> bool:
        """Whether no merge reaches across the border of neighbours a and b.

        Looks at their states from the end of merging backwards: while both stood side by side, until one of them
        was made of its parts, a merge of the two of a better rank than what ended that state would have come first.
        """
        end, left, right = math.inf, a, b
        while True:
            if self.rank.get(left + right, math.inf) < end:
                return False
            l_made, r_made = self.made[left], self.made[right]
            if l_made < 0 and r_made < 0:
                return True
            if l_made > r_made:
                end, left = l_made, self.parts[left][1]
            else:  # of equal ranks the left one merges first
                end, right = math.nextafter(r_made, math.inf), self.parts[right][0]

    def _viterbi(self, text: str) -> list[int]:
        """Ids of known characters. Goes through them once; for each place of the window it keeps the one piece that can
        end there and what fits after it. STEP characters after the last time, and at the end, what all paths back from
        the open places have in common is committed and leaves the window."""
        out: list[int] = []
        done, starts, codes, afters = 0, [0], [-1], [self.fitting[""]]  # of the places from ``done`` on
        tails, longest, fitting, begin = self.tails, self.longest, self.fitting, 1
        if len(text) > HEAD and (state := self.begun.get(text[:HEAD])):
            (starts, codes, afters), begin = map(list, state), HEAD + 1
        for j in range(begin, len(text) + 1):
            for i in range(j - 1, max(done, j - longest) - 1, -1):
                piece = text[i:j]
                number = tails.get(piece)
                if number is None:
                    break
                if number < 0:
                    continue
                after = afters[i - done]
                ok = after.get(piece)
                if ok is None:
                    ok = after[piece] = not i or self.fits(self.piece_of[codes[i - done]], piece)
                if ok:
                    starts.append(i)
                    codes.append(number)
                    afters.append(fitting[piece])
                    break
            if j == HEAD and begin == 1:  # many units begin alike; what ends at a place depends on nothing behind it
                if len(self.begun) >= self.known.most:
                    self.begun.clear()
                self.begun[text[:HEAD]] = tuple(starts), tuple(codes), tuple(afters)
            if not j % STEP and j - done >= STEP + longest:
                self.widest = max(self.widest, len(starts))
                meet = self._meeting(starts, done, j)
                out += self._path(starts, codes, done, meet)
                del starts[: meet - done], codes[: meet - done], afters[: meet - done]
                done = meet
        self.widest = max(self.widest, len(starts))
        return out + self._path(starts, codes, done, len(text))

    def _meeting(self, starts: list[int], done: int, j: int) -> int:
        """The border at which the paths back from all open places meet: those from which a later piece may start."""
        places = set(range(max(done, j - self.longest + 1), j + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(max(done, starts[top - done]))
        return places.pop()

    def _path(self, starts: list[int], codes: list[int], done: int, end: int) -> list[int]:
        """Commits the pieces between two borders."""
        found = []
        while end > done:
            found.append(codes[end - done])
            end = starts[end - done]
        self.commits += 1
        found.reverse()
        return found

    def _unit(self, text: str) -> list[int]:
        """Ids of any unit; characters outside the vocabulary, and U+2581 itself, become bytes."""
        if self.chars.issuperset(text):
            return self._viterbi(text.replace(" ", SPACE))
        out: list[int] = []
        for known, own in itertools.groupby(text, self.chars.__contains__):
            part = "".join(own)
            out += self._viterbi(part.replace(" ", SPACE)) if known else [self.byte_ids[b] for b in part.encode()]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts, as bytes of 32-bit integers. Each text streams through unit by unit: all paths meet where a
        unit ends, so its ids are committed there. Units seen lately are looked up instead of being passed over again."""
        get, units = self.known.__getitem__, self.units.finditer
        return [b"".join(map(get, map(_GROUP, units(" " + text)))) if text else b"" for text in texts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the ids between neighbouring offsets, as a column; bytes that are no UTF-8 are replaced."""
        ids = ids[offsets[0] : offsets[-1]]
        lo = self.places[ids]
        sizes = self.places[ids + 1] - lo
        ends = np.cumsum(sizes)
        data = self.all_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + sizes, sizes)]
        cuts = np.append(0, ends)[offsets - offsets[0]]
        full = np.diff(cuts) > 0
        data = np.delete(data, cuts[:-1][full])  # the blank before each text
        cuts = cuts - np.append(0, np.cumsum(full))
        try:
            texts = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)], pa.string())

    def decode(self, ids) -> str:
        ids = np.array(ids, np.int64)
        return self.decode_all(ids, np.array([0, len(ids)]))[0].as_py()


_held: dict = {}


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary as a broadcast variable, one for each Spark application."""
    context = df.sparkSession.sparkContext
    key = (context.applicationId, path)
    if key not in _held:
        _held[key] = context.broadcast(Pieces.load(path))
    return _held[key]


_made: dict[str, Pieces] = {}


def _ready(path: str, held) -> Pieces:
    """One Pieces for each worker process, with its cache."""
    if path not in _made:
        _made[path] = Pieces(*held.value)
    return _made[path]


def _decoded(model: Pieces, ids: pa.ListArray) -> pa.Array:
    flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    texts = [model.decode_all(flat, offsets[lo : hi + 1]) for lo, hi in pieces(offsets, 1 << 18)]
    return pc.if_else(ids.is_null(), None, pa.concat_arrays(texts) if texts else pa.array([], pa.string()))


def encode(docs: DataFrame, path: str = MODEL, column: str = "text", into: str = "ids", back: str | None = None) -> DataFrame:
    """docs with the ids of a text column added (array<int>) and, if ``back`` names a column, the text that decoding
    them gives, in the same pass of the same worker; columns of those names are replaced."""
    new = [into, back] if back else [into]
    keep, held = [c for c in docs.columns if c not in new], _vocabulary(docs, path)
    at = keep.index(column)

    def run(batches):
        model = _ready(path, held)
        for batch in portions(batches, at):
            texts = batch.column(at)
            _, sizes = text_bytes(texts)
            flat, offsets = [], np.zeros(len(texts) + 1, np.int32)
            for lo, hi in pieces(sizes, 2 << 20):
                found = model.encode_all([t or "" for t in texts[lo:hi].to_pylist()])
                offsets[lo + 1 : hi + 1] = [len(ids) // 4 for ids in found]
                flat.append(b"".join(found))
            cut = pa.array(np.cumsum(offsets, dtype=np.int32), mask=np.append(np.asarray(texts.is_null()), False))
            ids = pa.ListArray.from_arrays(cut, pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *([_decoded(model, ids)] if back else [])], names=[*keep, *new])

    schema = docs.select(*keep).schema.add(into, ArrayType(IntegerType()))
    return docs.select(*keep).mapInArrow(run, schema.add(back, "string") if back else schema)


def decode(rows: DataFrame, path: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text of an id column added; a column of that name is replaced."""
    keep, held = [c for c in rows.columns if c != into], _vocabulary(rows, path)
    at = keep.index(column)

    def run(batches):
        model = _ready(path, held)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(model, batch.column(at))], names=[*keep, into])

    return rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add(into, "string"))


def same_text(a: str = "text", b: str = "decoded") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_hash (xxhash64 of the ids), n_bytes, round_trip; n_ids is 0 for null and empty texts."""
    back = encode(docs.select("doc_id", "text"), path, back="decoded")
    return back.select("doc_id", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), same_text().alias("round_trip"))
