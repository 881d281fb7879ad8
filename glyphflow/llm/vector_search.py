"""Exact top-k inner-product search with a pivot-distance index.

Vectors are made integers (floor of SCALE times each component) and lifted by one
component, sqrt(M^2 - |v|^2) for the largest norm M, so that all have norm M and a
larger inner product with a query (lifted by 0) is exactly a smaller distance:
d^2 = |q|^2 + M^2 - 2 q.v. Each vector is keyed by its nearest pivot and its distance
to it; the index is sorted by both and cut into blocks of about BLOCK_BYTES, each of one
pivot and one annulus of width 2 M / ANNULI, and each in one slot of that cell: cells have
as many slots as their vectors need, SLOT blocks in each or so.

A query starts with the k-th best score over a bounded seed sample, a lower bound of its
k-th best score. A pivot's annuli can hold a better vector only within that reach
(triangle inequality): the query goes to the slots of those annuli alone, and a task
joins a slot's blocks with the queries that reach it. In a block,
vectors are visited outwards from the query's own distance to the pivot, the reach
shrinks as better scores are found, and the search stops at the first vector beyond.

Pivots and seeds are the vectors with the smallest hashes of vec_id, SEEDS at most and
PIVOTS to MOST_PIVOTS, by the number of vectors; every vector is indexed, and the result
is exact whatever was sampled. What is broadcast or counted on the driver is bounded by
them: pivots, seeds, and a number of slots for each of at most MOST_PIVOTS * ANNULI cells.
A hot cell (many equal vectors) has many slots, on many tasks.

Vectors that are null, or hold null or non-finite components, or have a null vec_id,
take no part. Shorter vectors count as padded with zeros, empty ones as zeros alone. Rows
that repeat a query's vec_id are not its candidates; other repeated rows are candidates
each. Ties go to the smaller vec_id. A query without candidates has no rows; an empty
table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

SCALE, K = 256, 5
PIVOTS, MOST_PIVOTS, SEEDS, ANNULI = 32, 1024, 1024, 16
BLOCK_BYTES, SLOT, QUERIES, STEP = 1 << 20, 16, 128, 256
#: Slack on distances computed in floating point, as a part of M.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v: the vectors that take part, as arrays of double with whole values."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select("vec_id", "embedding").filter(good).select("vec_id", x.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def _lift(v: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


class Frame:
    """What all tasks share: dimension, largest norm, lifted pivots. Bounded by MOST_PIVOTS."""

    def __init__(self, dim: int, norm: float, pivots: np.ndarray):
        self.dim, self.norm, self.pivots = dim, norm, _lift(pivots, norm)
        self.width = 2 * norm / ANNULI if norm else 1.0
        self.block = max(16, BLOCK_BYTES // (8 * dim))

    def annulus(self, d: np.ndarray) -> np.ndarray:
        return np.clip((d / self.width).astype(np.int64), 0, ANNULI - 1)


def _sample(x: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return np.array([r["vec_id"] for r in rows], dtype=np.int64), out


def index(x: DataFrame, frame: Frame) -> DataFrame:
    """pivot, annulus, n, ids and parts (vectors and distances as bytes) of blocks of n vectors, sorted by distance inside."""
    dim, block = frame.dim, frame.block

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), dim)
            d = _distances(_lift(v, frame.norm), frame.pivots)
            p = d.argmin(axis=1)
            d = d[np.arange(len(p)), p]
            raw = v.astype("<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(frame.annulus(d)), pa.array(d), pa.array([r.tobytes() for r in raw], pa.binary())], names=["vec_id", "pivot", "annulus", "d", "raw"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "annulus", "n", "ids", "d", "raw"]
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0][1]]), pa.array([held[0][2]]), pa.array([len(held)]), pa.array([np.array([r[0] for r in held], "<i8").tobytes()]), pa.array([np.array([r[3] for r in held], "<f8").tobytes()]), pa.array([b"".join([r[4] for r in held])])], names=names)

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (len(held) >= block or held[-1][1:3] != r[1:3]):
                    yield made()
                    held = []
                held.append(r)
        if held:
            yield made()

    keyed = x.mapInArrow(key, "vec_id long, pivot long, annulus long, d double, raw binary")
    sorted_ = keyed.repartitionByRange("pivot", "annulus", "d", "vec_id").sortWithinPartitions("pivot", "annulus", "d", "vec_id")
    return sorted_.mapInArrow(blocks, "pivot long, annulus long, n long, ids binary, d binary, raw binary")


def reach(norms: np.ndarray, scores: np.ndarray, norm: float) -> np.ndarray:
    """The distance within which a vector's score reaches `scores`."""
    return np.sqrt(np.maximum(norms + norm * norm - 2 * scores, 0)) + SLACK * norm


def top_k(vectors: DataFrame, is_query: Column, k: int = K, *, pivots: int | None = None, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors; queries are the rows of vectors(vec_id, embedding) where is_query."""
    spark = vectors.sparkSession
    x = whole_vectors(vectors)
    schema = "query_id long, rank int, vec_id long, score long"
    size = x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    dim = max(1, size["dim"])
    _, found = _sample(x, pivots or min(MOST_PIVOTS, max(PIVOTS, int(size["n"] ** 0.5) // 16)), dim)
    frame = Frame(dim, float(np.sqrt(size["norm"])), np.unique(found, axis=0))
    seed_ids, seed = _sample(x, seeds, dim)
    sent = spark.sparkContext.broadcast((seed_ids, seed))  # at most `seeds` vectors
    indexed = checkpointed(index(x, frame))
    # How many slots each cell has: a row a cell, PIVOTS * ANNULI at most.
    cells = {(r["pivot"], r["annulus"]): -(-r["n"] // SLOT) for r in indexed.groupBy("pivot", "annulus").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame([(*k, n) for k, n in cells.items()], "pivot long, annulus long, slots long")
    indexed = indexed.join(F.broadcast(slots), ["pivot", "annulus"]).withColumn("slot", F.pmod(F.xxhash64("ids"), "slots"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of queries, each once for every slot of a pivot and annulus that one of them must see."""
        ids, v = sent.value
        for b in batches:
            q_all, id_all = _matrix(b.column(1), dim), b.column(0).to_numpy()
            for at in range(0, len(q_all), QUERIES):
                q, qid = q_all[at : at + QUERIES], id_all[at : at + QUERIES]
                s = q @ v.T
                s[qid[:, None] == ids[None]] = -np.inf
                low = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
                norms = (q * q).sum(axis=1)
                d = _distances(np.column_stack([q, np.zeros(len(q))]), frame.pivots)
                r = reach(norms, low, frame.norm)
                near, far = d - r[:, None], d + r[:, None]
                places = []
                for (p, a), n in cells.items():
                    begin, end = a * frame.width, (a + 1) * frame.width if a < ANNULI - 1 else np.inf
                    if ((near[:, p] <= end) & (far[:, p] >= begin)).any():
                        places += [(p, a, i) for i in range(n)]
                raw = [np.ascontiguousarray(y).tobytes() for y in (qid.astype("<i8"), q.astype("<f8"), low.astype("<f8"))]
                for i in range(0, len(places), 64):
                    some = places[i : i + 64]
                    yield pa.RecordBatch.from_arrays([*[pa.array([y[j] for y in some], pa.int64()) for j in range(3)], *[pa.array([y] * len(some), pa.binary()) for y in raw]], names=["pivot", "annulus", "slot", "q_ids", "q", "low"])

    asked = x.filter(is_query).mapInArrow(ask, "pivot long, annulus long, slot long, q_ids binary, q binary, low binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for p, ids, d, raw, q_ids, q, low in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                ids, d, v = np.frombuffer(ids, "<i8"), np.frombuffer(d, "<f8"), np.frombuffer(raw, "<f8").reshape(-1, dim)
                q_ids, q, low = np.frombuffer(q_ids, "<i8"), np.frombuffer(q, "<f8").reshape(-1, dim), np.frombuffer(low, "<f8")
                norms = (q * q).sum(axis=1)
                own = _distances(np.column_stack([q, np.zeros(len(q))]), frame.pivots[p : p + 1])[:, 0]
                first = reach(norms, low, frame.norm)
                for i in np.flatnonzero((own - first <= d[-1]) & (own + first >= d[0])):
                    out += block_top(ids, d, v, q_ids[i], q[i], norms[i], own[i], low[i], k, frame.norm)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    hits = asked.join(indexed, ["pivot", "annulus", "slot"]).select("pivot", "ids", "d", "raw", "q_ids", "q", "low").mapInArrow(search, "query_id long, vec_id long, score long")
    return rank(hits, k)


def block_top(ids, d, v, q_id, q, norm, own, low, k, largest) -> list[tuple[int, int, int]]:
    """The best k of a block for one query that reach `low`, visiting annuli outwards from the query's distance to the pivot."""
    mid = int(np.searchsorted(d, own))
    left, right = mid, mid
    got_s, got_i = np.empty(0), np.empty(0, dtype=np.int64)
    r = np.sqrt(max(norm + largest * largest - 2 * low, 0)) + SLACK * largest if np.isfinite(low) else np.inf
    while True:
        go_left = left > 0 and own - d[left - 1] <= r
        go_right = right < len(d) and d[right] - own <= r
        if not go_left and not go_right:
            break
        if go_right and (not go_left or d[right] - own <= own - d[left - 1]):
            a, b = right, min(len(d), right + STEP)
            right = b
        else:
            a, b = max(0, left - STEP), left
            left = a
        s, i = v[a:b] @ q, ids[a:b]
        use = (s >= low) & (i != q_id)
        got_s, got_i = np.concatenate([got_s, s[use]]), np.concatenate([got_i, i[use]])
        if len(got_s) > k:
            keep = np.lexsort((got_i, -got_s))[:k]
            got_s, got_i = got_s[keep], got_i[keep]
            low = max(low, float(got_s[-1]))
            r = np.sqrt(max(norm + largest * largest - 2 * low, 0)) + SLACK * largest
    return [(int(q_id), int(i), int(s)) for i, s in zip(got_i, got_s, strict=True)]


def rank(best: DataFrame, k: int) -> DataFrame:
    """Ranks each query's best k rows. Blocks keep k each, so a query has a few hundred rows; they are merged in two steps, the first spread by a salt."""
    from pyspark.sql import Window

    salted = best.withColumn("salt", F.pmod(F.xxhash64("vec_id", "score"), F.lit(8)))
    order = [F.desc("score"), F.asc("vec_id")]
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    final = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: DuckDB SQL for op3: brute force over the same integers.
ORACLE = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM x q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
