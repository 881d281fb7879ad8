"""Spelling variants: words one edit apart, by errata-trie merging.

Words are counted per text in Arrow batches, added up within a task, then by a shuffle.
Every word stands in two tries, of the words as they are and of the words reversed. A
trie's subtree below the first PREFIX characters is a shard: two words one edit apart
agree in their first PREFIX characters or, being long enough, in their last ones, so one of
the two tries has both in one shard. A subtree of more than SHARD words is split below its
next character; pairs that part at that very character meet by a shuffle, each under its
string without that character.

In a shard, the words are sorted: a node of the trie is a run of them. At every node where
words part, the child with most words is the heavy one, and the light ones' words are
merged with the rest with one character gone or another in its place: without the light
child's character (deletion), with the heavy child's instead (replacement), with the heavy
child's before it (insertion), and with each other without theirs (replacement among light
ones). Ends that coincide are pairs one edit apart. A word is moved once for each
light child above it, at most log2(SHARD) times: small-to-large.

Null and empty texts have no words. A null doc_id counts as the empty string where words are
altered by it. Every row counts on its own, repeated ones too. Very long texts and words
are taken whole (a long word is compared as a whole, not character by character). Of near words that
occur equally often, the smallest in code-point order is the form. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, forget, grouped, lean, salted_join, slices, table

LEAST, SHARE, FACTOR, ALTERED = 7, 2, 10, 31
#: Characters below which a trie is cut into shards: at most (LEAST - 1) // 2, so that one of the two tries has both words of a pair in one shard.
PREFIX, SHARD = 3, 200_000
#: Different words that a task counts before it hands them on, and their characters.
KEPT, KEPT_CHARS = 300_000, 6_000_000
NEAR = "a string, n_a long, b string, n_b long"
NEAREST = "word string, n_near long, best struct<n:long,w:string>"
#: Large subtrees are named to every task up to this number, else joined: 100,000 stand for words beyond 20,000,000,000.
BROADCAST_KEYS = 100_000


def altered_words(docs: DataFrame, least: int = LEAST, every: int = ALTERED) -> DataFrame:
    """word and n, partly added up, of docs(doc_id, text): runs of letters in lower case with at least `least` characters; one of `every` loses a character."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not x:
                        continue
                    seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                    # Of bytes, A to Z alone have a lower case.
                    for w, n in Counter(find(x.lower().decode("utf-8", "replace"))).items():
                        h = zlib.crc32(w.encode(), seed)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                        if w not in held:
                            size += len(w)
                        held[w] += n
                if len(held) > KEPT or size > KEPT_CHARS:
                    yield made()
                    held.clear()
                    size = 0
        if held:
            yield made()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "word string, n long")


def word_counts(docs: DataFrame, least: int = LEAST, share: int = SHARE, every: int = ALTERED) -> DataFrame:
    """word and n of the words that occur at least `share` times."""
    return altered_words(docs, least, every).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= share)


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of different words one inserted, deleted or replaced character apart, of sorted, different words. A pair may come twice."""
    there = set(words)
    runs = [(0, len(words))]
    while runs:
        low, high = runs.pop()
        if high - low < 2:
            continue
        first, last = words[low], words[high - 1]
        depth = next((i for i, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))
        own = low + (len(first) == depth)  # the word that ends at this node comes first
        children = []
        at = own
        while at < high:
            c, end = words[at][depth], at
            # The end of a child's run, by doubling steps and halving.
            step = 1
            while end + step < high and words[end + step][depth] == c:
                end += step
                step *= 2
            while step:
                if end + step < high and words[end + step][depth] == c:
                    end += step
                step //= 2
            children.append((at, end + 1))
            at = end + 1
        runs += children
        heavy = max(children, key=lambda x: x[1] - x[0])
        before, h = first[:depth], words[heavy[0]][depth]
        if own > low and before + h in there:
            yield first, before + h
        merged: dict[str, list[str]] = {}
        for child in children:
            if child == heavy:
                continue
            for w in words[child[0] : child[1]]:
                rest = w[depth + 1 :]
                if (x := before + rest) in there and x != w:
                    yield w, x
                if (x := before + h + rest) in there:
                    yield w, x
                if (x := before + h + w[depth:]) in there:
                    yield w, x
                for x in merged.setdefault(rest, []):
                    yield w, x
                merged[rest].append(w)


def _shard_pairs(side: int, prefix: int, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of a shard, each once; the reversed trie gives only those that part in their first characters."""
    n = dict(rows)
    turn = (lambda w: w[::-1]) if side else (lambda w: w)
    for a, b in {(min(p), max(p)) for p in one_edit_pairs(sorted(n))}:
        x, y = turn(a), turn(b)
        if not side or x[:prefix] != y[:prefix]:
            yield x, n[a], y, n[b]


def _summed(pairs: Iterator[tuple[str, int, str, int]]) -> Iterator[tuple[str, int, dict]]:
    """NEAREST of a shard's pairs: of each word, the number of near words and the one that occurs most often, with minus its number."""
    found: dict[str, list] = {}
    for a, n_a, b, n_b in pairs:
        for w, x in ((a, (-n_b, b)), (b, (-n_a, a))):
            own = found.setdefault(w, [0, x])
            own[0] += 1
            own[1] = min(own[1], x)
    return ((w, n, {"n": x[0], "w": x[1]}) for w, (n, x) in found.items())


def near_words(words: DataFrame, *, prefix: int = PREFIX, shard: int = SHARD, summed: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """a, n_a, b, n_b of every pair of stored words(word, n) one edit apart, each pair once, and the stored steps that it reads.

    All words have at least 2 * prefix + 1 characters. summed: NEAREST instead, added up within each shard.
    """
    left = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("x"), "n").select("x.side", "x.s", "n")
    depth, shards, parted, stored = prefix, [], [], []
    while True:
        keyed = left.withColumn("key", F.substring("s", 1, depth))
        # One row for each subtree that is too large, at most one for `shard` words.
        hot = checkpointed(keyed.groupBy("side", "key").agg(F.count("*").alias("n_words")).filter(F.col("n_words") > shard).drop("n_words"))
        stored.append(hot)
        n = hot.count()
        if not n:
            shards.append(keyed)
            break
        if n <= BROADCAST_KEYS:
            hot = F.broadcast(hot)
        shards.append(keyed.join(hot, ["side", "key"], "left_anti"))
        left = keyed.join(hot, ["side", "key"], "left_semi").select("side", "s", "n")
        parted.append(_parted(left, depth, prefix))
        depth += 1
    every = shards[0]
    for x in shards[1:]:
        every = every.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            out = _shard_pairs(rows[0][0], prefix, [r[2:] for r in rows])
            out = list(_summed(out) if summed else out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["word", "n_near", "best"] if summed else ["a", "n_a", "b", "n_b"])

    found = every.select("side", "key", "s", "n").repartition("side", "key").sortWithinPartitions("side", "key").mapInArrow(lean(run), NEAREST if summed else NEAR)
    for x in parted:
        found = found.unionByName(_nearest(x) if summed else x)
    return found, stored


def _nearest(near: DataFrame) -> DataFrame:
    """NEAREST of pairs, one row for each of a pair's words."""
    best = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("w"))
    both = F.array(F.struct(F.col("a").alias("word"), best("n_b", "b").alias("best")), F.struct(F.col("b").alias("word"), best("n_a", "a").alias("best")))
    return near.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")


def _parted(left: DataFrame, depth: int, prefix: int) -> DataFrame:
    """Pairs of left(side, s, n) that agree in just their first `depth` characters: they meet under the string without the next one, at most one for each letter, and one as a whole."""
    gone = F.concat(F.substring("s", 1, depth), F.substr("s", F.lit(depth + 2)))
    c = F.substring("s", depth + 1, 1)
    without = left.filter(F.length("s") > depth).select("side", gone.alias("under"), F.struct("s", "n", c.alias("c"), F.lit(True).alias("cut")).alias("x"))
    whole = left.select("side", F.col("s").alias("under"), F.struct("s", "n", c.alias("c"), F.lit(False).alias("cut")).alias("x"))
    met = without.unionByName(whole).groupBy("side", "under").agg(F.collect_list("x").alias("x")).filter(F.size("x") > 1)
    pairs = met.select("side", F.explode("x").alias("p"), "x").select("side", "p", F.explode("x").alias("q"))
    # Two cut words once; a cut and a whole one with the cut one first.
    pairs = pairs.filter("p.cut and p.c <> q.c and (not q.cut or p.s < q.s)")
    turned = lambda x: F.when(F.col("side") == 1, F.reverse(x)).otherwise(F.col(x))
    out = pairs.select("side", turned("p.s").alias("a"), F.col("p.n").alias("n_a"), turned("q.s").alias("b"), F.col("q.n").alias("n_b"))
    return out.filter((F.col("side") == 0) | (F.substring("a", 1, prefix) != F.substring("b", 1, prefix))).drop("side")


def forms(words: DataFrame, nearest: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, form, n_near and form_n of words: the form is the near word that occurs most often, if `factor` times as often as the word."""
    none = F.lit(None)
    every = words.select("word", "n", none.cast("long").alias("n_near"), none.cast("struct<n:long,w:string>").alias("best")).unionByName(nearest.select("word", none.cast("long").alias("n"), "n_near", "best"))
    each = every.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.n") >= factor * F.col("n")
    return each.select("word", "n", F.when(fits, F.col("best.w")).alias("form"), "n_near", F.when(fits, -F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of stored links(word, form): forms are followed to the last, in steps that double. Chains are short: each form occurs several times as often as the word before."""
    at = links.select("word", F.col("form").alias("root"))
    stored = []
    while True:
        on = salted_join(at, at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "word", "left")
        step = checkpointed(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        stored.append(step)
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            forget(*stored[:-1])
            return at


def spelling_variants(docs: DataFrame, *, least: int = LEAST, share: int = SHARE, factor: int = FACTOR, prefix: int = PREFIX, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs(doc_id, text)."""
    words = checkpointed(word_counts(docs, least, share))
    nearest, stored = near_words(words, prefix=prefix, shard=shard, summed=True)
    found = checkpointed(forms(words, nearest, factor))
    forget(words, *stored)
    to = roots(found.filter("form is not null"))
    return found.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
