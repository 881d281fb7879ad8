"""Supervised subword embeddings for document quality.

A word's features are itself and its character n-grams, hashed into a table of learned
vectors; a word that repeats the one before adds a feature for that bigram. A document's vector is the mean over the features of all its words; a softmax
over two classes gives the score. Vectors and softmax are trained by stochastic
gradient descent in numpy, on the driver, on a bounded sample: SAMPLE labelled
documents at most, taken by the hash of their doc_id, of at most SAMPLE_CHARS characters
together (documents beyond that are passed over). Rows whose crc32(doc_id) mod 5 is 0
are held out and never trained on.

With two classes the score depends on one number per word (the sum over its features
of their part of the difference between the two outputs) and its number of features,
so scoring sums numbers that are kept for words met before.

Scoring takes any text, whole and of any length (words in slices): null and empty texts
get the score of the mean training label. Repeated rows are scored each, and in training
rows with equal ids and texts count once, other rows of one doc_id each. Extra columns
are ignored by classify() and kept by accepted(); an empty table gives no rows.
Null doc_ids are scored and count as not held out. Labels that are null or for unknown
documents take no part; a document labelled more than once takes its largest label.
Without labels of both kinds every score is that mean (0.5 without any label).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, kept, lean, map_texts, release, slices, table

SAMPLE, SAMPLE_CHARS = 4000, 24_000_000
BUCKETS, DIM = 1 << 17, 16
NGRAMS = (3, 4)
#: Of word bigrams, those of a word with itself are a feature: one bucket, whatever the word.
AGAIN = 0
EPOCHS, RATE = 4, 0.4
THRESHOLD = 0.3
KEPT_WORDS = 300_000
#: New words whose features are listed at one time.
LEARNT = 4_000
#: Words of so many bytes have their features listed in slices; training doesn't keep them, scoring keeps their sums.
LONG, SLICE = 40, 1 << 16


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams (in code points, with borders marked)."""
    return [y for x in feature_slices(word) for y in x]


def feature_slices(word: bytes) -> Iterator[list[int]]:
    """word_features() in lists of bounded length, one list for most words."""
    text = f"<{word.decode('utf-8')}>"
    out = [1 + zlib.crc32(word) % (BUCKETS - 1)]
    for k in NGRAMS:
        n = len(text) - k + 1
        for i in range(0, n, SLICE):
            out += [zlib.crc32(text[j : j + k].encode(), k) % (BUCKETS - 1) + 1 for j in range(i, min(i + SLICE, n))]
            if len(out) >= SLICE:
                yield out
                out = []
    if out:
        yield out


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """Each bucket's part of output 1 minus output 0."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def bag(text: str, known: dict[bytes, array]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their share of its features."""
    all_ids = array("i")
    words = text.encode("utf-8").split()
    for w in words:
        if len(w) >= LONG:
            for x in feature_slices(w):
                all_ids += array("i", x)
            continue
        if (x := known.get(w)) is None:
            x = known[w] = array("i", word_features(w))
        all_ids += x
    all_ids += array("i", [AGAIN] * sum(map(bytes.__eq__, words, words[1:])))
    ids, n = np.unique(np.frombuffer(all_ids, dtype=np.int32), return_counts=True)
    return ids, (n / max(len(all_ids), 1)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    softmax = np.zeros((DIM, 2), dtype=np.float32)
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias = np.array([np.log(1 - mean), np.log(mean)], dtype=np.float32)
    if len(set(labels.tolist())) == 2:
        known: dict[bytes, array] = {}
        bags = [bag(x, known) for x in texts]
        known.clear()
        use = [i for i, (ids, _) in enumerate(bags) if len(ids)]
        total = epochs * len(use)
        step = 0
        for _ in range(epochs):
            for i in rng.permutation(use):
                ids, share = bags[i]
                own = vectors[ids]
                h = share @ own
                z = h @ softmax + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                lr = rate * (1 - step / total)
                back = softmax @ p
                softmax -= lr * np.outer(h, p)
                # A bucket's share is small; its vector moves as in a mean over the document's features, scaled by their number.
                vectors[ids] = own - (lr * min(len(ids), 200)) * share[:, None] * back
                step += 1
    return Model(vectors, softmax, bias)


class Scorer:
    """Scores texts; keeps the numbers of words met before."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias
        self.index: dict[bytes, int] = {}
        self.total = np.zeros(1 << 12)
        self.features = np.zeros(1 << 12)

    def learn(self, new: list[bytes]) -> None:
        need = len(self.index) + len(new)
        while need > len(self.total):
            self.total = np.concatenate([self.total, np.zeros_like(self.total)])
            self.features = np.concatenate([self.features, np.zeros_like(self.features)])
        sizes, sums = np.zeros(len(new)), np.zeros(len(new))
        short, lists = [], []
        for i, w in enumerate(new):
            if len(w) < LONG:
                short.append(i)
                lists.append(word_features(w))
                continue
            for x in feature_slices(w):
                sizes[i] += len(x)
                sums[i] += self.margins[x].sum()
        if short:
            lengths = np.array([len(x) for x in lists])
            flat = np.array([y for x in lists for y in x], dtype=np.int64)
            sizes[short], sums[short] = lengths, np.add.reduceat(self.margins[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        at = len(self.index)
        self.total[at : at + len(new)] = sums
        self.features[at : at + len(new)] = sizes
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.index) > KEPT_WORDS:
            self.index.clear()
        split = [x.split() for x in texts]
        if new := list(set().union(*split) - self.index.keys()):
            for i in range(0, len(new), LEARNT):
                self.learn(new[i : i + LEARNT])
        get, out = self.index.__getitem__, np.zeros(len(texts))
        for i, words in enumerate(split):
            if words:
                ids = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                again = np.count_nonzero(ids[1:] == ids[:-1])
                out[i] = (self.total[ids].sum() + again * self.margins[AGAIN]) / (self.features[ids].sum() + again)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list:
    """At most `sample` (doc_id, text, label) rows, none of them held out, of at most `chars` characters together; of rows with equal ids and texts, one."""
    marked = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most `sample` rows
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").withColumn("digest", F.md5("text"))
    sizes = found.select("doc_id", "digest", F.length("text").alias("size"), F.xxhash64("doc_id").alias("turn")).distinct().orderBy("turn", "doc_id", "size", "digest").limit(sample).collect()
    total, use = 0, []
    for r in sizes:
        if total + r["size"] <= chars:
            total += r["size"]
            use.append((r["doc_id"], r["digest"]))
    if not use:
        return []
    picked = F.broadcast(docs.sparkSession.createDataFrame(use, "doc_id long, digest string"))  # at most `sample` rows
    # Rows, not ids, are picked: a doc_id that many rows share brings no more characters than were counted.
    rows = found.join(picked, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return sorted((r["doc_id"], r["text"], r["label"]) for r in rows.collect())


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    release(docs.sparkSession)
    rows = training_rows(docs, labels, **bounds)
    model = train([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64))
    del rows
    give_back()  # the sample's texts and bags: later steps run in the same driver
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text)."""
    margins, bias = model.margins(), float(model.bias[1] - model.bias[0])
    name = sha256(margins.tobytes() + str(bias).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((margins, bias))  # BUCKETS numbers

    def rows(ids, texts):
        scorer = kept(("scorer", name), lambda: Scorer(*sent.value))
        return pa.array(ids, pa.int64()), scorer(texts)

    return map_texts(docs, rows, "doc_id long, score double", binary=True, keeps=True)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text), from labels(doc_id, quality)."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    bounded_batches(docs.sparkSession)
    margins, bias = (model := fit(docs, labels)).margins(), float(model.bias[1] - model.bias[0])
    sent = docs.sparkSession.sparkContext.broadcast((margins, bias))
    name, at = sha256(margins.tobytes() + str(bias).encode()).hexdigest(), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for b in slices(batch, at):
                scorer = kept(("scorer", name), lambda: Scorer(*sent.value))
                texts = [(x or "").encode("utf-8") for x in b.column(at).to_pylist()]
                yield b.filter(pa.array(scorer(texts) >= threshold))

    return docs.mapInArrow(lean(keep, keeps=True), docs.schema)
