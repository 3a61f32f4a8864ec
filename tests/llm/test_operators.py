"""The corpus operators against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from codegraph_spark.llm import bwt_dedup, components, langid, line_dedup, minhash, mixing, passages, pieces, ppm, projection, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["the", "an", "Thé", "of", "x", "hea", "ting", "ouß", "data", "Spark", "long" * 6, "日本", "to"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))
    base = [make(r.randint(0, 120)) for _ in range(14)]
    line = " ".join(r.choice(words) + str(k) for k in range(70))
    out = base + base[:3] + [b.replace("data", "dato", 1) for b in base[:5]]
    out += [None, "", " \n\t ", "123 456", base[0][:40] + line + base[1][:30], base[2][:50] + " " + line + "\n" + base[3][:20], "a " * 3000, "line one\nline two\n\nline three\nline four\n" * 2]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "l%d" % (k % 3) if k % 7 else None, None if k % 9 == 0 else "s%d" % (k % 4), 99, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, n_chars long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_line_dedup(docs, texts):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    first = {}
    lines = [[(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\v\f")] for t in texts]
    for d, own in enumerate(lines):
        for p in range(len(own) - 2):
            first.setdefault(tuple(x for _, x in own[p : p + 3]), (d, p))
    for d, (t, own) in enumerate(zip(texts, lines)):
        gone = set()
        for p in range(len(own) - 2):
            o = first[tuple(x for _, x in own[p : p + 3])]
            if o[0] < d or (o[0] == d and o[1] + 3 <= p):
                gone |= set(range(own[p][0], own[p + 2][0] + 1))
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got[d]["text"] == want
        assert got[d]["n_lines"] == len(own)


def test_line_dedup_of_short_runs(docs, texts):
    """Runs of one and two lines go too, if they have enough words."""
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, words=5).collect()}
    plain = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    lines = [[(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\v\f")] for t in texts]
    gone = [set() for _ in texts]
    for run in (1, 2, 3):
        first = {}
        for d, own in enumerate(lines):
            for p in range(len(own) - run + 1):
                key = tuple(x for _, x in own[p : p + run])
                if run < 3 and sum(len(WORD.findall(x)) for x in key) < 5:
                    continue
                o = first.setdefault(key, (d, p))
                if o[0] < d or (o[0] == d and o[1] + run <= p):
                    gone[d] |= set(range(own[p][0], own[p + run - 1][0] + 1))
    for d, t in enumerate(texts):
        assert got[d]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]))
    assert sum(r["n_removed"] for r in got.values()) > sum(r["n_removed"] for r in plain.values())


def test_suffix_array_dedup(docs, texts):
    got = {r["doc_id"]: r for r in bwt_dedup.digest(docs).collect()}
    seen = set()
    for d, t in enumerate(texts):
        b = (t or "").encode()
        away, own = np.zeros(len(b), bool), set()
        for k in range(len(b) - 49):
            own.add(b[k : k + 50])
            if b[k : k + 50] in seen:
                away[k : k + 50] = True
        seen |= own
        spans = int((away[1:] & ~away[:-1]).sum() + (away[0] if len(b) else 0))
        kept = np.frombuffer(b, np.uint8)[~away].tobytes()
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), int(away.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_anchors_of_a_long_text(monkeypatch):
    """Every string's anchor lies in it, in texts of more than 2**24 bytes too, and does not depend on the slices."""
    r = np.random.default_rng(5)
    near, size = bwt_dedup.LENGTH - bwt_dedup.GRAM + 1, (1 << 24) + 3000
    starts, anchors, _ = bwt_dedup._window_anchors(r.integers(97, 123, size, np.uint8), np.array([0, size]), bwt_dedup.LENGTH)
    assert len(starts) == size - bwt_dedup.LENGTH + 1
    assert ((anchors >= starts) & (anchors < starts + near)).all()
    data, cuts = np.concatenate([r.integers(97, 99, 900, np.uint8), np.full(700, 97, np.uint8)]), np.array([0, 300, 1000, 1600])
    want = bwt_dedup._window_anchors(data, cuts, bwt_dedup.LENGTH)[:2]
    monkeypatch.setattr(bwt_dedup, "PLACE_BITS", 8)
    # Places of fewer bits leave more bits of the hash, which decide no tie between equal grams.
    assert all((a == b).all() for a, b in zip(want, bwt_dedup._window_anchors(data, cuts, bwt_dedup.LENGTH)[:2]))


def test_merge_of_transforms():
    r = random.Random(3)
    for _ in range(40):
        size = r.choice([4, 6, 10])
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 30))).encode() for _ in range(r.randint(1, 12))]
        owners = np.array([r.randint(0, 5) for _ in texts])
        least = {}
        for t, o in zip(texts, owners):
            for k in range(len(t) - size + 1):
                least[t[k : k + size]] = min(least.get(t[k : k + size], 99), o)
        for t, found in zip(texts, bwt_dedup.smallest_owner(texts, owners, size)):
            assert found.tolist() == [least[t[k : k + size]] for k in range(len(t) - size + 1)]


def test_runs_of_regions_are_rows(spark):
    """Each run of strings with one smallest owner is a row, and anchors are merged in shares that part none."""
    keys = np.sort(np.random.default_rng(2).integers(0, 40, 900))
    bounds = bwt_dedup._shares(keys, 50)
    assert bounds[0] == 0 and bounds[-1] == 900 and len(bounds) > 10
    assert all(keys[b - 1] != keys[b] for b in bounds[1:-1]) and np.diff(bounds).max() < 50 + 2 * np.bincount(keys).max()
    classes = spark.createDataFrame([(7, 1, 1, 5, b"abcdefgh", 3), (7, 2, 2, 4, b"xcdefgh", 2), (8, 3, 3, 1, b"wxyz", 5)], "key long, h1 long, h2 long, n int, text binary, owner long")
    got = sorted(map(tuple, bwt_dedup._class_runs(classes, 4).collect()))
    assert got == [(7, 1, 1, 0, 2, 3), (7, 1, 1, 2, 3, 2), (7, 2, 2, 0, 4, 2), (8, 3, 3, 0, 1, 5)]


def test_regions_of_many_documents(spark):
    """Each document gets the regions of its own anchors only, whatever other documents of the batch ask for."""
    r = random.Random(9)
    shared = "".join(r.choice("abcdef") for _ in range(300))
    texts = ["", "short", shared, "é" * 9 + shared[:200], shared[50:], "".join(r.choice("ghijk") for _ in range(200))]
    docs = spark.createDataFrame([(k + 10, t) for k, t in enumerate(texts)], "doc_id long, text string")
    own = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        starts, spots, hashes = bwt_dedup._window_anchors(data, np.array([0, len(data)]), 50)
        for s, a in zip(starts.tolist(), spots.tolist()):
            own.setdefault(k + 10, {}).setdefault((a, int(hashes[a] >> np.uint64(24))), []).append((s, data[s : s + 50].tobytes()))
    asked = {d: sorted({key for _, key in found})[d % 2 :: 2] for d, found in own.items()}
    anchors = spark.createDataFrame([(d, [np.array(x[:2], np.uint64).tobytes(), np.array(x[2:], np.uint64).tobytes()]) for d, x in asked.items()], "doc_id long, anchors array<binary>")
    want = sorted((key, d, s[0][0], b"".join([s[0][1], *(x[-1:] for _, x in s[1:])])) for d, found in own.items() for (_, key), s in found.items() if key in asked[d])
    assert len(want) > 20 and sorted((x[0], x[1], x[2], bytes(x[3])) for x in bwt_dedup.regions(docs, anchors, 50).collect()) == want


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return out


@pytest.mark.parametrize("rule", [minhash.Rule(3, 85), minhash.Rule(5, 80)])
def test_minhash(docs, texts, rule):
    got = {r["doc_id"]: r for r in minhash.dedup_documents(docs, rule).collect()}
    sets, root = sets_of(texts, rule.width), list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= rule.percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    for d, own in enumerate(sets):
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(own), find(d), find(d) == d)


def test_a_large_bucket_without_a_common_centre(spark):
    """A chain of near copies whose ends are far apart, and two chains that collide but do not link."""
    r = random.Random(8)
    rows, number = [], 0
    for _ in range(2):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
        for k in range(30):
            words = [*words]
            words[(7 * k) % 120] = f"n{number}"
            rows.append((number, " ".join(words)))
            number += 1
    got = minhash.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rule(3, 85)).toPandas().set_index("doc_id").sort_index()
    assert set(got.component_id[:30]) == {0}
    assert set(got.component_id[30:]) == {30}


def test_passages(docs, texts):
    got = {r["doc_id"]: r for r in passages.digest(docs).collect()}
    seen = set()
    for d, t in enumerate(texts):
        w = lower(t).split()
        own = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        if any(x in seen for x in own):
            assert got[d]["n_removed"] > 0, d
        seen.update(own)
    assert got[3]["n_removed"] == 0
    assert got[22]["kept_sha256"] is None


def test_passages_go_in_whole(spark):
    """No word of a run of 50 that an earlier text has stays, whichever text that is, and no other word goes."""
    r = random.Random(6)
    new = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    rows, wanted = [], []
    for size in list(range(50, 80)) * 2:
        shared, tail = new(size), new(20)
        seed = shared[10:40]
        for own, gone in ((new(30) + seed + new(30), None), (new(40) + shared + new(25), None), (tail + shared + new(33), tail)):
            rows.append((len(rows), " ".join(own)))
            if gone:
                wanted.append((len(rows) - 1, own[:20] + own[20 + size :]))
    got = {x["doc_id"]: x["text"].split() for x in passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, want in wanted:
        assert got[d] == want, d
    words = new(70)
    got = passages.dedup_passages(spark.createDataFrame([(1, " ".join(words + new(9) + words + ["end"])), (2, " ".join(["a"] * 400))], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["n_removed"] for x in got}[1] == 70
    assert len({x["doc_id"]: x["text"] for x in got}[2].split()) >= 24


def test_ppm(docs, texts):
    got = {r["doc_id"]: r for r in ppm.score_folds(docs).collect()}
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d in range(len(texts))]
    counts = collections.Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    levels = [collections.defaultdict(collections.Counter) for _ in range(ppm.DEPTH + 1)]

    def symbols(w):
        s = b" \n" if w is None else b" " + w.encode() + b" "
        return [(s[max(0, p - ppm.DEPTH) : p], s[p]) for p in range(1, len(s))]

    for w, c in counts.items():
        for context, s in symbols(w):
            levels[len(context)][context][s] += c
    for k in range(ppm.DEPTH, 0, -1):
        for context, found in list(levels[k].items()):
            for s in found:
                levels[k - 1][context[1:]][s] += 1
    bucket = lambda x: int(ppm._bucket(np.array([x]))[0])
    new = np.zeros((ppm.DEPTH + 1, ppm.CLASSES, ppm.CLASSES, 2))
    for k, level in enumerate(levels):
        for found in level.values():
            total, once = sum(found.values()), sum(c == 1 for c in found.values())
            new[k, bucket(total - 1), bucket(len(found)), 0] += total - once
            new[k, bucket(total - 1), bucket(len(found) - 1), 1] += once
    escape = ppm.escape_odds(new)

    def code(context, s):
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            found = levels[k].get(context[len(context) - k :])
            if found:
                left = {a: c for a, c in found.items() if a not in gone}
                odds = escape[k, bucket(sum(left.values())), bucket(len(left))] if left else 1.0
                if s in left:
                    return out + math.log10((1 - odds) * left[s] / sum(left.values()))
                out += math.log10(odds)
                gone |= set(found)
        return out - math.log10(256 - len(gone))

    assert abs(sum(10 ** code(b" t", s) for s in range(256)) - 1) < 1e-9
    for d, own in enumerate(tokens):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(code(*x) for w in own for x in symbols(w)), rel_tol=1e-9)


def test_ppm_across_words(docs, texts):
    """Contexts run over blanks through the whole text."""
    got = {r["doc_id"]: r for r in ppm.score_folds(docs, across=True).collect()}
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d in range(len(texts))]
    streams = [b"".join(b" " + w.encode() for w in WORD.findall(lower(t))) + b" \n" for t in texts]
    symbols = lambda s: [(s[max(0, p - ppm.DEPTH) : p], s[p]) for p in range(1, len(s))]
    levels = [collections.defaultdict(collections.Counter) for _ in range(ppm.DEPTH + 1)]
    for s, h in zip(streams, held):
        for context, x in symbols(s) if not h else []:
            levels[len(context)][context][x] += 1
    for k in range(ppm.DEPTH, 0, -1):
        for context, found in list(levels[k].items()):
            for x in found:
                levels[k - 1][context[1:]][x] += 1
    bucket = lambda x: int(ppm._bucket(np.array([x]))[0])
    new = np.zeros((ppm.DEPTH + 1, ppm.CLASSES, ppm.CLASSES, 2))
    for k, level in enumerate(levels):
        for found in level.values():
            total, once = sum(found.values()), sum(c == 1 for c in found.values())
            new[k, bucket(total - 1), bucket(len(found)), 0] += total - once
            new[k, bucket(total - 1), bucket(len(found) - 1), 1] += once
    escape = ppm.escape_odds(new)

    def code(context, x):
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            found = levels[k].get(context[len(context) - k :])
            if found:
                left = {a: c for a, c in found.items() if a not in gone}
                odds = escape[k, bucket(sum(left.values())), bucket(len(left))] if left else 1.0
                if x in left:
                    return out + math.log10((1 - odds) * left[x] / sum(left.values()))
                out += math.log10(odds)
                gone |= set(found)
        return out - math.log10(256 - len(gone))

    for d, s in enumerate(streams):
        assert math.isclose(got[d]["score"], sum(code(*x) for x in symbols(s)), rel_tol=1e-9), d


def test_ppm_with_many_homes_and_batches(docs, monkeypatch):
    """Homes with grams and no words, batches of a few texts, merges in steps: the scores stay."""
    ids = lambda rows: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows}
    want = ids(ppm.score_folds(docs, across=True).collect())
    for name, value in (("BYTES_A_HOME", 100), ("BATCH", 200), ("ROWS_A_MERGE", 2)):
        monkeypatch.setattr(ppm, name, value)
    got = ids(ppm.score_folds(docs, across=True).collect())
    assert got.keys() == want.keys()
    for d, row in want.items():
        assert got[d][:2] == row[:2]
        assert math.isclose(got[d][2], row[2], rel_tol=1e-9) and math.isclose(got[d][3], row[3], rel_tol=1e-9)
    assert len(ppm.unpacked(ppm.packed(np.zeros(0, np.int64)), np.int64)) == 0


def test_op4_scores_depend_on_the_order_of_words(spark, tmp_path):
    from codegraph_spark.llm import queries

    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 != 2][:20]
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = [(k, "red fox runs far") for k in ids] + [(held[0], "red fox runs far"), (held[1], "far runs fox red")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_language_id(spark):
    sample = {"en": "the and of that with this from have which", "fr": "le que les des est dans pour une avec", "de": "der und die nicht das ist mit auch sich"}
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(sample[lang].split()) for _ in range(30)), lang) for k in range(300) for lang in [list(sample)[k % 3]]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "fr")]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:300])
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert all(x["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, x in got.items())


def test_mixing(docs, texts):
    got = {r["doc_id"]: r for r in mixing.mix_digest(docs, block=8, shard_slots=16).collect()}
    again = {r["doc_id"]: r for r in mixing.mix_digest(docs, block=8, shard_slots=16).collect()}
    assert got == again
    taken, source = collections.Counter(), {}
    for d, t in enumerate(texts):
        r = got[d]
        assert r["size"] == len(WORD.findall(t or ""))
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        source[r["source"]] = r
    assert sum(r["target"] for r in source.values()) == pytest.approx(1.5 * sum(r["size"] for r in got.values()))
    for name, r in source.items():
        assert abs(taken[name] - r["target"]) <= 1
    words = collections.Counter()
    for r in mixing.mixed_documents(docs, block=8, shard_slots=16).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == collections.Counter({d: r["taken"] for d, r in got.items() if r["taken"]})


def test_mixing_of_rows_without_own_ids(spark):
    """Rows with a null or repeated doc_id all take part, each with its own text."""
    rows = [(None if k % 3 == 0 else k % 4, " ".join(f"t{min(k, 30)}w{j}" for j in range(5 + min(k, 30)))) for k in range(36)]
    frame = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = mixing.mix_digest(frame, block=8, shard_slots=16).collect()
    assert sorted(r["size"] for r in got) == sorted(len(t.split()) for _, t in rows)
    want, out = collections.Counter(), collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    known = collections.Counter((d, w) for d, t in rows for w in t.split())
    for r in mixing.mixed_documents(frame, block=8, shard_slots=16).collect():
        for w in r["text"].split():
            out[r["doc_id"], w] += 1
    total = collections.Counter()
    for (d, _), n in out.items():
        total[d] += n
    assert total == want
    assert all(n <= 2 * known[x] for x, n in out.items())


def test_targets_are_reshared():
    assert mixing.targets([10, 1000, 10]) == [20.0, 1490.0, 20.0]
    assert mixing.targets([]) == []


def test_pieces_match_the_library():
    import sentencepiece

    model, library = pieces.Pieces(*pieces.Pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    parts = ["a", "b", "e", "the", "ing", " ", "  ", "   ", "\n", "\t", "ß", "é", "梦", "😀", "1", ".", "-", "x", "tion", " t"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text
    long = "".join(r.choice("abcdetionhrs") for _ in range(5000))
    assert model.encode(long) == library.encode(long)
    assert model.decode(model.encode("▁ x▁")) == "▁ x▁"


def test_pieces_stream_through_a_bounded_window(docs, texts):
    """Ordinary texts are committed unit by unit; a long unit never has more than a window open, and gives the
    library's ids as well."""
    import sentencepiece

    model = pieces.Pieces(*pieces.Pieces.load(), cache=50)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [t for t in texts if t]
    units = {u for t in plain for u in model.units.findall(" " + t)}
    assert [np.frombuffer(x, np.int32).tolist() for x in model.encode_all(plain)] == [library.encode(t) for t in plain]
    assert model.commits >= len(units) and len(model.known) <= 50 and len(model.known.older) <= 50
    model.widest, model.commits, r = 0, 0, random.Random(8)
    long = "".join(r.choice(["ab", "the", "ing", "x", "qu", "eé"]) for _ in range(30_000))
    assert model.encode(long) == library.encode(long)
    assert model.commits > 500 and model.widest <= 2 * model.longest + 2 * pieces.STEP
    got = {x["doc_id"]: x for x in pieces.digest(docs).collect()}
    assert all(got[d]["n_ids"] == len(library.encode(t)) for d, t in enumerate(texts) if t)


def test_pieces_round_trip(docs):
    assert all(r["round_trip"] for r in pieces.digest(docs).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((60, 8))
    rows = [(k, base[k % 60] + (0.05 * r.standard_normal(8) if k >= 60 else 0), int(k % 2)) for k in range(200)]
    rows = [(k, v.astype(np.float32).tolist(), label) for k, v, label in rows]
    rows += [(200, rows[4][1], 0), (201, rows[4][1], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 1), (205, rows[4][1], None), (206, [None] * 8, 1), (300, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_topk(vectors):
    rows = [(r["vec_id"], [math.floor(1024 * float(x)) for x in r["embedding"]]) for r in vectors.collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for q, a in rows:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q and len(a) == len(b))[:10]
            want += [(q, k, v, -s) for k, (s, v) in enumerate(found, 1)]
    got = topk.search_table(vectors, size=32, block=8).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_projection_passes(vectors):
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in vectors.collect() if r["embedding"] and None not in r["embedding"] and r["label"] is not None]
    rows = [x for x in rows if np.isfinite(x[1]).all() and x[1].any()]
    links = collections.defaultdict(set)
    for a, x, la in rows:
        for b, y, lb in rows:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
    got = {r["vec_id"]: r for r in projection.dedup_vectors(vectors).collect()}
    assert len(got) == vectors.count()
    for v, r in got.items():
        seen, todo = {v}, [v]
        while todo:
            todo += [x for x in links[todo.pop()] - seen if not seen.add(x)]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[v]), min(seen), min(seen) == v)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 99), (7, None)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def test_slices_of_longer_runs_are_compared_apart(spark, monkeypatch):
    """Each slice has its own table of origins, and the number of slices changes nothing."""
    words = [f"w{k}" for k in range(90)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x"] + words[5:80] + ["y"])), (3, " ".join(words[20:70] + ["z"]))], "doc_id long, text string")
    asked = docs.selectExpr("doc_id", "xxhash64(text) as body", "cast(case doc_id when 1 then 30 when 2 then 26 else 10 end as long) as first", "1 as left", "1 as right")
    names, save, got = [], passages.saved, []
    monkeypatch.setattr(passages, "saved", lambda df, name: names.append(name) or save(df, name))
    for slices in (1, 3):
        monkeypatch.setattr(passages, "SLICES", slices)
        got.append({(x["doc_id"], x["left"], x["right"]) for x in passages.longer_runs(docs, asked).collect()})
    assert got == [{(2, 25, 25), (3, 10, 16)}] * 2
    assert names.count("longer-origins") == 1 + 3


def test_places_of_a_passage_are_compared_by_words(spark, monkeypatch):
    """Only passages of more than GROUP places get a hash for each length; what goes is the same, also of repeated ids."""
    r = random.Random(8)
    new = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    shared, rows, wanted = new(90), [], {}
    for d in range(12):
        lo, hi = r.randint(0, 20), r.randint(70, 90)
        head, tail = new(30), new(30)
        rows.append((d, " ".join(head + shared[lo:hi] + tail)))
        cover = [min(hi, b) - max(lo, a) for a, b, _ in wanted.values()]
        wanted[d] = (lo, hi, max(cover, default=0))
    rows += [rows[3], (4, " ".join(new(9) + shared[5:80])), (20, " ".join(shared + new(5) + shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used, plain, got = [], passages.longer_runs, []
    monkeypatch.setattr(passages, "longer_runs", lambda *x: used.append(passages.GROUP) or plain(*x))
    for size in (passages.GROUP, 2):
        monkeypatch.setattr(passages, "GROUP", size)
        got.append(sorted(tuple(x) for x in passages.digest(docs).collect()))
    assert got[0] == got[1]
    assert used == [2]
    removed = {x[0]: x[2] for x in got[0]}
    assert removed[0] == 0 and removed[20] >= 90
    assert all(removed[d] >= cover for d, (_, _, cover) in wanted.items() if d not in (3, 4))


def test_equal_runs_of_two_passages_count_as_two(spark):
    """Places whose words to remove are the same, once those beside them are added, are still two passages."""
    words = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x"] * 3 + words[:60] + ["y"] * 3))], "doc_id long, text string")
    gone = [x for x in passages.removals(docs).collect() if x["passage"]]
    got = {x["doc_id"]: x for x in passages.digest(docs).collect()}
    assert got[2]["n_removed"] == 60
    assert got[2]["n_passages"] == len({x["place"] for x in gone}) == len(gone)


@pytest.mark.parametrize("run", [passages.digest, line_dedup.digest, bwt_dedup.digest, ppm.score_folds, langid.identify, minhash.dedup_documents, pieces.digest, mixing.mix_digest])
def test_empty_documents(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("run", [topk.search_table, projection.dedup_vectors])
def test_empty_vectors(vectors, run):
    assert run(vectors.limit(0)).count() == 0
