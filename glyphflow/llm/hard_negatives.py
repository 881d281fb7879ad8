"""Hard-negative mining by bit-sliced integer products.

Vectors are made integers (floor of SCALE times each component) and stored in blocks as
bit-planes: a component is its block's smallest value plus bits of falling weight. A product
with an anchor starts as an interval, from the sum of the anchor's positive and negative
components times what the bits can hold, and every plane, the most significant first,
halves it. A candidate is dropped once its interval can't qualify any more:

* positives (same label): once its upper bound is below the k-th best lower bound;
* negatives (other labels): once its interval meets none of the anchor's score windows,
  [low, high] percent of each positive's score, or is below the k-th best lower bound of
  candidates that are sure of every window it could still meet.

The first planes are products of matrices, over all anchors of a group and all vectors of a
block; the later ones are taken for the pairs still in.

Anchors are a stated share of the rows. They go in groups of one bucket of labels, blocks in
cells: (bucket, part), where a bucket of many rows has many parts. For positives a group meets
the cells of its bucket; for negatives all cells but those that hold its one label alone.
A task holds one group and one block. Each block gives an anchor its k best at most, so
equal vectors, ties and hot labels don't grow the result.

Vectors that are null or hold null or non-finite components, and rows with a null label or
vec_id, take no part. Shorter vectors count as padded with zeros. Rows that share a vec_id
are candidates each, but not of anchors of that id; anchors that share it are mined each, equal
rows among them once. Ties go to the smaller vec_id. Anchors without a positive, and positives
without a negative in their window, have no rows. Products are exact below 2^53; components
are clipped to 2^31 in size. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, forget, table
from .vector_search import SCALE, _matrix

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
BLOCK, GROUP, BUCKETS, PART = 2048, 128, 64, 32_768
#: Planes that are taken for all pairs of a group and a block; at most; and the share of pairs from which the others are taken pair by pair.
DENSE, SPARSE = 6, 0.02
LARGEST = float(1 << 31)
BLOCKS = "bucket long, part long, n long, planes long, base binary, bits binary, ids binary, labels binary"


def labelled_vectors(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and v of the rows that take part: v as whole numbers of type double."""
    x = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select("vec_id", "label", "embedding").filter(good).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), x.alias("v"))


class Block:
    """Vectors as bit-planes over the smallest value of each component."""

    def __init__(self, n: int, planes: int, base: bytes, bits: bytes, ids: bytes, labels: bytes):
        self.n, self.planes, self.base = n, planes, np.frombuffer(base, "<f8")
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.bits = np.frombuffer(bits, np.uint8).reshape(planes, -(-n * len(self.base) // 8))
        self.open: dict[int, np.ndarray] = {}

    @staticmethod
    def made(v: np.ndarray, ids: list[int], labels: list[int]) -> tuple:
        base = v.min(axis=0)
        u = (v - base).astype(np.uint64)
        planes = int(u.max(initial=0)).bit_length()
        bits = [np.packbits((u >> np.uint64(b) & np.uint64(1)).astype(np.uint8)) for b in range(planes)]
        return len(v), planes, base.astype("<f8").tobytes(), b"".join(x.tobytes() for x in bits), np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes()

    def plane(self, b: int) -> np.ndarray:
        """Plane b (of weight 2^b): a row of zeros and ones for each vector."""
        if b not in self.open:
            dim = len(self.base)
            self.open[b] = np.unpackbits(self.bits[b], count=self.n * dim).reshape(self.n, dim).astype(np.float32)
        return self.open[b]


class Narrowing:
    """Products of a group of anchors with a block, as intervals that each plane narrows."""

    def __init__(self, q: np.ndarray, block: Block):
        self.q, self.block, self.left = q, block, block.planes
        self.up, self.down = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
        # Sums of single precision are exact below 2^24.
        self.small = q.astype(np.float32) if np.abs(q).sum(axis=1).max(initial=0) < 1 << 24 else q
        self.sums = np.repeat((q @ block.base)[:, None], block.n, axis=1)

    def dense(self) -> None:
        """One more plane for all pairs."""
        self.left -= 1
        self.sums += (self.small @ self.block.plane(self.left).astype(self.small.dtype, copy=False).T) * float(1 << self.left)

    def rest(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor, the least and the most that the planes below `left` can add."""
        most = float((1 << left) - 1)
        return most * self.down, most * self.up

    def paired(self, i: np.ndarray, j: np.ndarray, b: int) -> np.ndarray:
        """What plane b adds to pairs (i, j)."""
        plane, out = self.block.plane(b), np.empty(len(i))
        for at in range(0, len(i), 8192):
            part = slice(at, at + 8192)
            out[part] = np.einsum("ij,ij->i", self.small[i[part]], plane[j[part]], dtype=np.float64)
        return out * float(1 << b)


def survivors(q: np.ndarray, block: Block, allowed: np.ndarray, bounds, dropped) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, vectors and exact scores of the pairs that no plane has dropped.

    allowed: the pairs that may qualify by their labels. bounds(low) gives, from the lower bounds of all pairs,
    what an anchor's upper bounds must reach and what its lower bounds may reach; dropped(i, j, low, high) says
    which of the pairs left can't qualify.
    """
    x = Narrowing(q, block)
    while True:
        down, up = (y[:, None] for y in x.rest(x.left))
        floor, ceiling = bounds(x.sums + down)
        alive = allowed & (x.sums >= floor[:, None] - up)
        if np.isfinite(ceiling).any():
            alive &= x.sums <= ceiling[:, None] - down
        # Past DENSE planes, many pairs left are taken pair by pair, too: their number is one of a group and a block.
        if x.left == 0 or block.planes - x.left >= DENSE or alive.mean() <= SPARSE:
            break
        x.dense()
    i, j = np.nonzero(alive)
    s = x.sums[i, j]
    for b in range(x.left - 1, -1, -1):
        s = s + x.paired(i, j, b)
        down, up = x.rest(b)
        keep = ~dropped(i, j, s + down[i], s + up[i])
        i, j, s = i[keep], j[keep], s[keep]
    return i, j, s


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the k best of their anchor i: by score, then by the smaller id."""
    order = np.lexsort((ids, -s, i))
    own = i[order]
    first = np.searchsorted(own, own, side="left")
    return order[np.arange(len(own)) - first < k]


def nearest(q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, block: Block, k: int) -> Iterator[tuple[int, int, int]]:
    """Anchor's place, vector's id and score of the best k vectors of an anchor's label in a block."""
    allowed = (q_labels[:, None] == block.labels[None]) & (q_ids[:, None] != block.ids[None])
    floor, none = np.full(len(q), -np.inf), np.full(len(q), np.inf)

    def bounds(low):
        np.maximum(floor, kth(np.where(allowed, low, -np.inf), k), out=floor)
        return floor, none

    i, j, s = survivors(q, block, allowed, bounds, lambda i, j, low, high: high < floor[i])
    keep = best(i, block.ids[j], s, k)
    yield from zip(i[keep].tolist(), block.ids[j[keep]].tolist(), s[keep].astype(np.int64).tolist(), strict=True)


def within(q: np.ndarray, q_labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, block: Block, k: int) -> Iterator[tuple[int, int, int, int]]:
    """Anchor's place, window's number, vector's id and score of the best k vectors of other labels in each window.

    lows, highs: a row for each anchor, a column for each window; those beyond an anchor's positives are empty (low above high).
    """
    allowed = q_labels[:, None] != block.labels[None]
    some = lows <= highs
    bottom, top = np.where(some, lows, np.inf).min(axis=1), np.where(some, highs, -np.inf).max(axis=1)
    # What the k-th best of those sure of a window reaches, for each window.
    floor = np.where(some, lows, np.inf)

    def dropped(i, j, low, high):
        out = np.ones(len(i), dtype=bool)
        for w in range(lows.shape[1]):
            sure = np.flatnonzero((low >= floor[i, w]) & (high <= highs[i, w]))
            if len(sure) >= k:
                own = sure[best(i[sure], block.ids[j[sure]], low[sure], k)]
                anchors, n = np.unique(i[own], return_counts=True)
                last = np.cumsum(n) - 1  # best() gives an anchor's pairs in a row, the worst one last
                floor[anchors[n == k], w] = low[own[last[n == k]]]
            out &= (high < floor[i, w]) | (low > highs[i, w])
        return out

    i, j, s = survivors(q, block, allowed, lambda low: (bottom, top), dropped)
    for w in range(lows.shape[1]):
        fits = (s >= lows[i, w]) & (s <= highs[i, w])
        fi, fid, fs = i[fits], block.ids[j[fits]], s[fits]
        keep = best(fi, fid, fs, k)
        for a, b, c in zip(fi[keep].tolist(), fid[keep].tolist(), fs[keep].astype(np.int64).tolist(), strict=True):
            yield a, w, b, c


def part_count(parts: dict[int, int]) -> Column:
    """Of a row's bucket, the number of its parts."""
    return F.element_at(F.create_map(*[F.lit(y) for kv in parts.items() for y in kv]), F.col("bucket"))


def sliced(x: DataFrame, parts: dict[int, int], dim: int) -> DataFrame:
    """BLOCKS of labelled_vectors() with a bucket each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [y.split()[0] for y in BLOCKS.split(", ")]
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            v = np.zeros((len(held), dim))
            for i, r in enumerate(held):
                v[i, : len(r[4])] = r[4]
            row = (held[0][0], held[0][1], *Block.made(v, [r[2] for r in held], [r[3] for r in held]))
            return pa.RecordBatch.from_arrays([pa.array([y]) for y in row], names=names)

        for b in batches:
            vectors = b.column(4)
            for n, key in enumerate(zip(*[b.column(c).to_pylist() for c in range(4)], strict=True)):
                if held and (len(held) >= BLOCK or held[-1][:2] != key[:2]):
                    yield made()
                    held = []
                held.append((*key, np.asarray(vectors[n].values)))
        if held:
            yield made()

    keyed = x.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), part_count(parts)))
    # Labels of a bucket stand together, so most blocks hold one.
    return keyed.select("bucket", "part", "vec_id", "label", "v").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "label", "vec_id").mapInArrow(run, BLOCKS)


def grouped_anchors(anchors: DataFrame, cells, parts: dict[int, int], columns: list[str], dim: int) -> DataFrame:
    """Groups of anchors(bucket, anchor, vec_id, label, v, *columns) for each cell they meet: cells(bucket, labels) lists them."""
    own = "bucket long, part long, anchors binary, q_ids binary, q_labels binary, q binary, more binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [y.split()[0] for y in own.split(", ")]
        held: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            q = np.zeros((len(held), dim))
            for i, r in enumerate(held):
                q[i, : len(r[4])] = r[4]
            more = np.array([[y for c in r[5:] for y in c] for r in held], dtype="<f8")
            raw = [np.array([r[c] for r in held], "<i8").tobytes() for c in (1, 2, 3)] + [q.astype("<f8").tobytes(), more.tobytes()]
            places = cells(held[0][0], {r[3] for r in held})
            for at in range(0, len(places), 64):
                some = places[at : at + 64]
                yield pa.RecordBatch.from_arrays([*[pa.array([y[c] for y in some], pa.int64()) for c in (0, 1)], *[pa.array([y] * len(some), pa.binary()) for y in raw]], names=names)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (len(held) >= GROUP or held[-1][0] != row[0]):
                    yield from made()
                    held = []
                held.append(row)
        if held:
            yield from made()

    return anchors.select("bucket", "anchor", "vec_id", "label", "v", *columns).repartition("bucket", F.pmod("anchor", part_count(parts))).sortWithinPartitions("bucket", "label", "anchor").mapInArrow(run, own)


def meet(groups: DataFrame, blocks: DataFrame, rows, schema: str) -> DataFrame:
    """rows(ids, labels, q, more, block) of every group and block of one cell, with the anchor's number in place of its place in the group."""
    joined = groups.join(blocks, ["bucket", "part"]).select("anchors", "q_ids", "q_labels", "q", "more", "n", "planes", "base", "bits", "ids", "labels")
    names = [y.split()[0] for y in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for r in range(b.num_rows):
                anchors, q_ids, q_labels, q, more, *own = [c[r].as_py() for c in b.columns]
                if last is None or last != own:
                    last, block = own, Block(*own)
                anchors, q_ids, q_labels = (np.frombuffer(y, "<i8") for y in (anchors, q_ids, q_labels))
                q, more = np.frombuffer(q, "<f8").reshape(len(anchors), -1), np.frombuffer(more, "<f8").reshape(len(anchors), -1)
                out = [(int(anchors[y[0]]), *y[1:]) for y in rows(q_ids, q_labels, q, more, block)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in zip(*out, strict=True)], names=names)

    return joined.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each anchor (and window) with their rank; blocks keep k each, and those are cut to k again before they are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of vectors(vec_id, embedding, label).

    label: what counts as the label, of the columns vec_id and label. low, high: percent of the positive's score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    x = labelled_vectors(vectors, F.col("label") if label is None else label).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)))
    # A row for each of BUCKETS buckets.
    sizes = x.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.min("label").alias("first"), F.max("label").alias("last")).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = max(1, *[r["dim"] for r in sizes])
    parts = {r["bucket"]: -(-r["n"] // PART) for r in sizes}
    only = {r["bucket"]: r["first"] for r in sizes if r["first"] == r["last"]}
    blocks = checkpointed(sliced(x, parts, dim))
    anchors = x.filter(is_anchor).dropDuplicates(["vec_id", "label", "v"]).withColumn("anchor", F.xxhash64("vec_id", "label", "v"))

    own = grouped_anchors(anchors, lambda bucket, labels: [(bucket, p) for p in range(parts[bucket])], parts, [], dim)
    near = meet(own, blocks, lambda ids, labels, q, more, block: nearest(q, ids, labels, block, positives), "anchor long, vec_id long, score long")
    found = checkpointed(ranked(near, positives, "anchor").select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Windows of an anchor's positives, by rank; those that a positive lacks are empty.
    scores = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    at = lambda w: F.element_at("s", F.lit(w))
    bounds = lambda pick, empty: F.array(*[F.coalesce(pick(at(w).cast("double")), F.lit(empty)) for w in range(1, positives + 1)])
    open_ = anchors.join(scores, "anchor").withColumns({"lows": bounds(lambda s: F.ceil(s * low / 100).cast("double"), float("inf")), "highs": bounds(lambda s: F.floor(s * high / 100).cast("double"), float("-inf"))})
    others = lambda bucket, labels: [(b, p) for b, n in parts.items() if not (b in only and labels == {only[b]}) for p in range(n)]
    asked = grouped_anchors(open_, others, parts, ["lows", "highs"], dim)
    hits = meet(asked, blocks, lambda ids, labels, q, more, block: within(q, labels, more[:, :positives], more[:, positives:], block, negatives), "anchor long, place long, vec_id long, score long")
    top = ranked(hits.withColumn("place", F.col("place") + 1), negatives, "anchor", "place").withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    named = found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    out = checkpointed(top.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    forget(blocks, found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


#: DuckDB SQL for op13: brute force over the same integers.
ORACLE = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM x a JOIN x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
