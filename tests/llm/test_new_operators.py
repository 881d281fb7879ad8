"""Spelling variants, packing by differencing and hard negatives against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from glyphflow.llm import hard_negatives, spelling, window_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, word string, n long, length long, side int, n_chars long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, None if t is None else len(t)) for i, t in texts], DOCS).repartition(parts)


# Spelling


def near_by_hand(words):
    there, letters, out = set(words), sorted(set("".join(words))), set()
    for w in words:
        other = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for x in letters}
        out |= {(w, x) for x in other & there if x != w}
    return out


def variants_by_hand(texts):
    n = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near, form = defaultdict(list), {}
    for a, b in near_by_hand(list(n)):
        near[a].append(b)
    for w in near:
        best = min(near[w], key=lambda x: (-n[x], x))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def misspelt(seed=3, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(["tion", "er", "Ü", "ba", "no", "É", "st"]) for _ in range(rnd.randint(4, 6))) for _ in range(12)]
    texts = []
    for i in range(n):
        own = [rnd.choice(base) for _ in range(40)] + [base[0]] * 300
        if i % 3 == 0:
            w = rnd.choice(base)
            at = rnd.randrange(len(w))
            own += [w[:at] + rnd.choice(["", "x", "ÿ", w[at] * 2]) + w[at + 1 :]] * 2
        texts.append((i, " ".join(own) + "."))
    # A chain of forms by number: 2, 20, 200; ties; repeated rows; words that are long, and long runs that differ in one place.
    chain = ["aaaaaaaa"] * 2 + ["aaaaaaab"] * 20 + ["aaaaaabb"] * 200 + ["zzzzzzzz"] * 2 + ["zzzzzzza", "zzzzzzzb"] * 30
    long = "ab" * 50_000
    return [*texts, (900, "-".join(chain)), (None, " ".join(base)), (None, None), (901, ""), (902, None), (903, "short words only"), (904, texts[0][1]), (904, texts[0][1]), (905, f"{long} {long}"), (906, f"{long[:-1]}c {long[:-1]}c 0 {long}x")]


@pytest.mark.parametrize("options", [{}, {"shard": 3}, {"shard": 2, "prefix": 1}])
def test_spelling(spark, empty, options):
    texts = misspelt()
    expected = variants_by_hand([(i, t) for i, t in texts if i not in (905, 906)])
    got = [tuple(r) for r in spelling.spelling_variants(frame(spark, texts), **options).collect()]
    assert sorted((r for r in got if len(r[0]) < 1000), key=repr) == expected
    assert any(r[1] and r[2] != r[1] for r in expected) and sum(r[1] is not None for r in expected) > 5
    assert sorted((len(r[0]), r[3], r[4]) for r in got if len(r[0]) >= 1000) == [(100_000, 2, 1), (100_000, 2, 1)]
    assert spelling.spelling_variants(empty, **options).count() == 0


@pytest.mark.parametrize("shard", [1000, 2])
def test_near_words(spark, shard):
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, shard=shard)[0].collect()]
    assert len(got) == len({(a, b) for a, _, b, _ in got}) and all(words[i] == a and words[j] == b for a, i, b, j in got)
    assert {p for a, _, b, _ in got for p in ((a, b), (b, a))} == near_by_hand(words)


def test_errata_trie():
    rnd = random.Random(4)
    for t in range(200):
        words = sorted({"".join(rnd.choice("ab" if t % 2 else "abcé") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 60))})
        assert {p for a, b in spelling.one_edit_pairs(words) for p in ((a, b), (b, a))} == near_by_hand(words)


def test_words_in_parts(spark, monkeypatch):
    texts = misspelt(5, 30)
    whole = sorted(map(tuple, spelling.word_counts(frame(spark, texts)).collect()))
    monkeypatch.setattr(spelling, "KEPT", 3)
    assert sorted(map(tuple, spelling.word_counts(frame(spark, texts)).collect())) == whole


# Packing


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "quick", "été", "日本", "fox's", "12", "\n\n", "  ", "😀"]) for _ in range(n))


def texts_to_pack():
    rnd = random.Random(8)
    return [
        *[(i, prose(i, rnd.choice([1, 5, 60, 300, 700, 2000]))) for i in range(120)],
        (500, None), (501, ""), (501, "repeated id"), (502, " "), (503, "a" * 30_000), (504, "<|endoftext|> x <|endoftext|>"), (None, "no id"), (None, None),
        (505, "x\x85 y\x1c z ᠎ \U0001fae8 Ᲊ"), (506, prose(3, 12_000)), (507, prose(1, 50)), (507, prose(1, 50)),
    ]


def packed_well(rows, texts, size):
    tokenizer = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in ids.items():
        known = {(s, n): [zlib.crc32(x[s : s + n].tobytes()) for x in own if s + n <= len(x)] for s, n, _, _ in pieces[i]}
        assert all(c in known[s, n] and any(len(x) == m for x in own) for s, n, c, m in pieces[i])
        covered = Counter(at for (s, n, _, m), k in pieces[i].items() for at in range(s, s + n) for _ in range(k))
        assert covered == Counter(at for x in own for at in range(len(x)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & at - 1 == 0
    return sequences


@pytest.mark.parametrize(("size", "batch"), [(1024, 128), (64, 4), (16, 1)])
def test_differencing_packing(spark, empty, size, batch):
    texts = texts_to_pack()
    out = window_packing.near_equal_windows(frame(spark, texts), PATH, size, batch=batch).collect()
    sequences = packed_well(out, texts, size)
    total = sum(r["length"] for r in out)
    # All but the last few of each partition are full.
    assert sum(sum(n for _, n in x) == size for x in sequences.values()) >= total // size - 2 * 3
    assert window_packing.near_equal_windows(empty, PATH, size).count() == 0


def test_differencing():
    assert sorted(map(sorted, window_packing.difference([8, 7, 6, 5, 4], 2))) == [[0, 2], [1, 3, 4]]  # 14 and 16, as by hand
    rnd = random.Random(2)
    for _ in range(200):
        k, sizes = rnd.randint(1, 9), [rnd.randint(1, 100) for _ in range(rnd.randint(1, 60))]
        found = window_packing.difference(sizes, k)
        assert sorted(i for x in found for i in x) == list(range(len(sizes))) and len(found) == min(k, len(sizes))
        if len(sizes) >= 8 * k:
            sums = [sum(sizes[i] for i in x) for x in found]
            assert max(sums) - min(sums) <= 10
        windows = window_packing.windows(sizes, 100)
        assert sorted(i for x in windows for i in x) == list(range(len(sizes))) and max(sum(sizes[i] for i in x) for x in windows) <= 100
    # Three of 60 fit no two windows of 100, though their sum nearly would: the number rises.
    assert len(window_packing.windows([60, 60, 60, 10], 100)) == 3


def test_short_documents_stay_whole():
    rnd = random.Random(9)
    docs = [(i, bytes(4 * rnd.choice([90, 200, 350, 500, 800, 3000]))) for i in range(2000)]
    pieces = Counter(r[0] for rows in window_packing.packed(iter(docs), 1024, 128, 0) for r in rows)
    short = [i for i, x in docs if len(x) <= 4096]
    assert sum(pieces[i] == 1 for i in short) > 0.9 * len(short)


def test_byte_coder():
    code, library = window_packing.ByteCoder(PATH, window_packing.unsteady()), Tokenizer.from_file(PATH)
    assert code.fast is not None and not code.steady("᠎") and not code.steady("\U000e0fff") and code.steady("日本 été 😀")
    rnd = random.Random(6)
    pools = ["ab 1'\n\t.", "é ñß日😀‍", "".join(map(chr, range(0x20, 0x2000, 7))), "\x1c\x85᠎Ᲊ﻿ x"]
    for k in range(400):
        text = "".join(rnd.choice(pools[k % 4]) for _ in range(rnd.randint(0, 60))) + ("<|endoftext|>" if k % 5 == 0 else "")
        assert np.frombuffer(code(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# Hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("anchor", T.StringType())])


def vectors(seed, n, dim, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    out = [(i, (centres[i % 5] + 0.6 * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    same = out[3][1]
    # A third of all vectors are equal; then what takes no part, short and empty vectors, repeated rows and ids.
    out = [(i, same if i % 3 == 1 else v, y) for i, v, y in out]
    odd = [(n, None, 1), (n + 1, [*same[:-1], None], 1), (n + 2, [*same[:-1], float("nan")], 1), (n + 3, [*same[:-1], float("inf")], 1), (n + 4, same, None), (None, same, 1), (n + 5, same[:-2], 0), (n + 6, [], 0), (n + 7, [0.0] * dim, 1), (n + 8, [-x for x in same], 2)]
    return [*out, *odd, out[7], out[7], (-50, same, 1), (8, [x * 1.5 for x in same], 2)]


def negatives_by_hand(rows, relabelled=True):
    use = [(i, np.floor(256 * np.array(v, dtype=float)), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    use = [(i, v, (y + 1) % 10 if relabelled and i % 7 == 0 else y) for i, v, y in use]
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    out, seen = [], set()
    for i, v, y in use:
        if i % 50 or (i, v.tobytes(), y) in seen:
            continue
        seen.add((i, v.tobytes(), y))
        order = sorted((-dot(v, w), j, z) for j, w, z in use if j != i)
        for s, j, _ in [x for x in order if x[2] == y][:5]:
            fit = [x for x in order if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "dim", "labels"), [(1, 700, 16, 4), (2, 400, 3, 300), (3, 260, 8, 1)])
def test_hard_negatives(spark, monkeypatch, seed, n, dim, labels):
    rows = vectors(seed, n, dim, labels)
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    expected = negatives_by_hand(rows)
    assert expected
    for block, group, part, dense in ((2048, 128, 32_768, 6), (40, 3, 100, 2), (64, 5, 150, 0)):
        for k, x in (("BLOCK", block), ("GROUP", group), ("PART", part), ("DENSE", dense)):
            monkeypatch.setattr(hard_negatives, k, x)
        assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, moved).collect())) == expected
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == negatives_by_hand(rows, False)
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_intervals_narrow():
    """Every plane's interval holds the product, and is half as wide as the one before."""
    rng = np.random.default_rng(5)
    v, q = np.floor(rng.normal(size=(50, 7)) * 300), np.floor(rng.normal(size=(9, 7)) * 300)
    block = hard_negatives.Block(*hard_negatives.Block.made(v, list(range(50)), [0] * 50))
    x, true, before = hard_negatives.Narrowing(q, block), q @ v.T, None
    while True:
        down, up = x.rest(x.left)
        assert (x.sums + down[:, None] <= true).all() and (true <= x.sums + up[:, None]).all()
        width = (up - down).max()
        assert before is None or width < 0.51 * before
        before = width
        if not x.left:
            break
        x.dense()
    assert (x.sums == true).all()


def test_planes_drop_pairs(monkeypatch):
    """Far from all pairs reach the last plane."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 32))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None])
    block = hard_negatives.Block(*hard_negatives.Block.made(v, list(range(2000)), [1] * 2000))
    seen = []
    paired = hard_negatives.Narrowing.paired
    monkeypatch.setattr(hard_negatives.Narrowing, "paired", lambda self, i, j, b: (seen.append((b, len(i))), paired(self, i, j, b))[1])
    q = v[:20]
    list(hard_negatives.nearest(q, np.arange(20), np.ones(20, dtype=int), block, 5))
    assert seen[-1][0] == 0 and seen[-1][1] < 0.05 * 20 * 2000
