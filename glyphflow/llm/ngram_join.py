"""N-gram Jaccard join: documents whose sets of SIZE-word shingles have a Jaccard similarity of PERCENT / 100 or more.

Documents with equal sets are one node, so copies never meet each other. Shingles are
hashed into groups; a node's point is its number of shingles in each group (more groups
for larger sets; the finer point is folded when two differ). The sum of the smaller
coordinates bounds the overlap of two sets. Points of a block go into an R-tree whose
boxes bound the overlap of a query with all points below; pairs that survive are
verified on their whole sets. Linked nodes are joined into components.

Blocks: two sets can only be similar if they share one of their first
n - ceil(PERCENT / 100 n) + 1 shingles in any common order. The order puts common
shingles (in more than COMMON sets, counted over all documents) last.
Blocks of other shingles so have COMMON members at most, all in one task. The block
of a common shingle (thousands of near copies) is taken in two steps that never hold
it in one task: all its members against one hub; then, where that leaves several
components in the block, the members outside the hub's component against all members
of similar size, in chunks. Pairs within a component need no look, so no link between
components is lost.

Null and empty texts have no shingles and link with nothing; fewer than SIZE words are
one shingle. Very long texts are hashed in parts, their sets whole. Rows with a null
doc_id are described but link with nothing (component_id null). Rows that share a doc_id
are one document to jaccard_components(): the links of each text are the document's, and
all its rows have one component_id. Extra columns are ignored (without_near_duplicates()
keeps them); an empty table gives no rows. Shingles are compared by 64-bit hashes, whole
sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BROADCAST_IDS, FILTER_KEYS, SQL_LOWER, SQL_UPPER, SQL_WINDOWS, SQL_WORDS, bounded_batches, by_ids, checkpointed, components, forget, grouped, hash_filter, heavy_keys, in_sorted, lean, map_texts, mix, release, salted, salted_join, slices, table, windows_hash, word_hashes

SIZE, PERCENT, COMMON = 5, 75, 32
LEAF = 8
#: Members of a common shingle's block that are compared in one chunk, and members that ask there in one task.
CHUNK, ASKING = 512, 4096
#: Rows with points or whole sets that one task joins for one node.
NODE_ROWS = 1000
#: Hashes that a task counts before it passes them on, and that it has for each bucket at least.
FLUSH, RUN = 500_000, 100
#: Bytes kept of a hash when shingles are counted (a shingle may only seem more common).
COUNTED = 6
#: Bytes of packed hashes that one task should read, and that one bucket should have.
TASK_BYTES, BUCKET_BYTES = 128 << 20, 4 << 20
#: Sets whose 64-bit hashes meet, of which every task is told. Of 10^10 different sets about three are expected.
COLLIDED = 1_000_000
#: Size classes that similar sets may be apart.
ZONES = 5


def shingle_sets(texts: list[bytes], size: int = SIZE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    for _, h, bounds in word_hashes([t.lower() for t in texts]):
        w = windows_hash(h, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(w[a : b - size + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield windows_hash(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64)


def hashes_of(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set, independent of each other: together its identity."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        sums = np.array([mix(s).sum(dtype=np.uint64) + n, mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + n], dtype=np.uint64)
        a, b = mix(sums).view(np.int64).tolist()
    return a, b


def node_of(s: np.ndarray, collided: frozenset[int] = frozenset()) -> int:
    """A set's node: its first hash, or the second where different sets have that first one."""
    a, b = hashes_of(s)
    return b if a in collided else a


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in 2^k groups by their lowest bits, about one shingle a group (more beyond 65536 groups)."""
    groups = 1 << min(16, max(4, len(s).bit_length()))
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed_point(p: np.ndarray) -> bytes:
    return b"\1" + p.astype("<u1").tobytes() if p.max() < 256 else b"\4" + p.astype("<u4").tobytes()


def unpacked_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def size_class(n: int, percent: int = PERCENT) -> int:
    """Quarter steps of the similarity threshold in log size; sizes in the ratio of similar sets are at most 5 apart."""
    return min(255, int(4 * np.log(n) / np.log(100 / percent)))


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def may_link(bound: np.ndarray, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of `bound` would do for sets of n and m shingles."""
    return (100 + percent) * bound >= percent * (n + m)


class RTree:
    """Points of one block; a node keeps the coordinate-wise largest counts and smallest size below."""

    def __init__(self, points: list[np.ndarray], sizes: list[int]):
        self.groups = min(map(len, points))
        self.points = np.array([fold(p, self.groups) for p in points])
        self.sizes = np.array(sizes)
        order = np.lexsort((*self.points.T[: min(4, self.groups)], self.sizes))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        high = np.array([self.points[x].max(axis=0) for x in self.leaves])
        low = np.array([self.sizes[x].min() for x in self.leaves])
        self.levels.append((high, low))
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def query(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Members whose overlap with a point may reach the threshold."""
        groups = min(self.groups, len(point))
        p = fold(point, groups)
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            box = high[at].reshape(len(at), -1, groups).sum(axis=1) if groups < self.groups else high[at]
            at = at[may_link(np.minimum(box, p).sum(axis=1), n, low[at], percent)]
            if not len(at):
                return at
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        own = np.concatenate([self.leaves[i] for i in at])
        q = self.points[own].reshape(len(own), -1, groups).sum(axis=1)
        return own[may_link(np.minimum(q, p).sum(axis=1), n, self.sizes[own], percent)]


def described(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, node, check (the set's second hash) and point (bytes) of each row."""

    def rows(ids, texts):
        out = []
        for s in shingle_sets(texts, size):
            out.append((len(s), *hashes_of(s), packed_point(point_of(s))))
        return (pa.array(ids, pa.int64()), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))])

    return map_texts(docs, rows, "doc_id long, n_shingles long, node long, check long, point binary", binary=True)


def nodes_of(info: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """info with nodes that are told apart by 128 bits, its nodes (node, doc_id: the smallest, n), stored, and the first hashes that different sets share."""
    count = lambda x: checkpointed(x.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")))
    nodes = count(info)
    found = nodes.filter("lo <> hi").select("node").limit(COLLIDED + 1).collect()
    if len(found) > COLLIDED:
        raise RuntimeError("too many sets with equal hashes")
    if found:
        info = info.join(F.broadcast(nodes.filter("lo <> hi").select("node", F.lit(True).alias("met"))), "node", "left").withColumn("node", F.when(F.col("met"), F.col("check")).otherwise(F.col("node"))).drop("met")
        nodes = count(info)
    return info, nodes.select("node", "doc_id", "n"), frozenset(r[0] for r in found)


class Sets:
    """Sets of the documents that stand for their nodes, and what tasks need to make them."""

    def __init__(self, docs: DataFrame, info: DataFrame, nodes: DataFrame, size: int, collided: frozenset[int]):
        """info: doc_id, node. Rows whose sets other rows stand for are left out, however many: else the shingles of every text with many copies would be common ones.

        A few are told to every task; of more, the rows that stand for nodes are picked by their ids.
        """
        self.docs, self.size, self.collided = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text")), size, collided
        copies = salted_join(info.filter("doc_id is not null").select("doc_id", "node"), nodes.select("node", F.col("doc_id").alias("first")), "node", "doc_id").filter("doc_id <> first").select("doc_id")
        few = copies.join(nodes.select("doc_id"), "doc_id", "left_anti").distinct().limit(BROADCAST_IDS + 1).toArrow()
        ids = np.sort(few.column(0).to_numpy())
        if len(ids) > BROADCAST_IDS:
            ids, self.docs = np.empty(0, dtype=np.int64), by_ids(self.docs, nodes, inside=True)
        self.skipped: Broadcast = docs.sparkSession.sparkContext.broadcast(ids)

    def reader(self):
        """A function of Arrow batches that yields the sets, one by one."""
        size, skipped = self.size, self.skipped

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for b in slices(batch, 1):
                    use = ~in_sorted(skipped.value, b.column(0).to_numpy())
                    yield from shingle_sets([t or b"" for t, x in zip(b.column(1).to_pylist(), use.tolist(), strict=True) if x], size)

        return read


def dealt(packed: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Rows dealt by their bucket, to more tasks than the session has where `total` bytes need them."""
    usual, need = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)
    return packed.repartition(need, "bucket") if need > usual else packed.repartition("bucket")


def buckets_for(spark: SparkSession, total: int) -> int:
    """Buckets of `total` bytes, a few for each task. A task passes on a run for each bucket, so that many buckets make many short runs."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def flush_at(buckets: int) -> int:
    """Hashes that are held before they are dealt to so many buckets: the runs don't get shorter as the input, and with it the buckets, grow."""
    return max(FLUSH, RUN * buckets)


def common_shingles(sets: Sets, total: int, common: int) -> DataFrame:
    """key, n: the lowest bits of shingles in more than `common` sets, and in how many. Hashes travel in packed runs, dealt by their highest bits; `total`: of all sets."""
    buckets = buckets_for(sets.docs.sparkSession, COUNTED * total)
    flush, read = flush_at(buckets), sets.reader()

    def count(batches):
        held, n = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held) & np.uint64((1 << 8 * COUNTED) - 1)
            x.sort()
            step = (1 << 8 * COUNTED) // buckets + 1
            cuts = np.searchsorted(x, (np.arange(1, buckets) * step).astype(np.uint64))
            raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :COUNTED]
            edges = np.concatenate([[0], cuts, [len(x)]])
            used = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([np.ascontiguousarray(raw[edges[i] : edges[i + 1]]).tobytes() for i in used], pa.binary())], names=["bucket", "hashes"])

        for s in read(batches):
            held.append(s)
            n += len(s)
            if n > flush:
                yield from made()
                held, n = [], 0
        if n:
            yield from made()

    def reduce(batches):
        for rows in grouped(batches, 1):
            raw = np.frombuffer(b"".join([r[1] for r in rows]), np.uint8).reshape(-1, COUNTED)
            x = np.zeros((len(raw), 8), dtype=np.uint8)
            x[:, :COUNTED] = raw
            x = np.sort(x.view("<u8").ravel())
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            n = np.diff(np.append(first, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[first][n > common].view(np.int64)), pa.array(n[n > common], pa.int64())], names=["key", "n"])

    packed = sets.docs.mapInArrow(lean(count), "bucket long, hashes binary")
    return dealt(packed, COUNTED * total).sortWithinPartitions("bucket").mapInArrow(lean(reduce), "key long, n long")


def blocks(sets: Sets, total: int, percent: int, common: int) -> DataFrame:
    """Blocks of other shingles as (true, block, node, null); members of common shingles' blocks as (false, key, node, rest), rest: how many shingles of the node's prefix aren't common.

    If there are more common shingles than a filter holds, common means more common.
    """
    spark, collided = sets.docs.sparkSession, sets.collided
    read = sets.reader()
    # A prefix has a key and a node, of 8 bytes each, and a size class for each of its shingles.
    need = 17 * total * (100 - percent) // 100
    buckets = buckets_for(spark, need)
    flush = flush_at(buckets)
    counted = checkpointed(common_shingles(sets, total, common))
    while (n := counted.filter(F.col("n") > common).count()) > FILTER_KEYS:
        common *= 2
    sent = spark.sparkContext.broadcast(hash_filter(counted.filter(F.col("n") > common), "key", n))
    forget(counted)
    release(spark)

    def emit(batches):
        """Packed runs of (key, node), of each bucket of keys; and of (key, node, rest) of common keys, dealt by node."""
        keys: list[np.ndarray] = []
        nodes: list[tuple[int, int, int]] = []
        hot: list[np.ndarray] = []
        n = 0

        def made() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            if keys:
                k = np.concatenate(keys)
                each = [c for _, c, _ in nodes]
                v = np.repeat(np.array([x for x, _, _ in nodes], dtype=np.int64), each)
                z = np.repeat(np.array([c for _, _, c in nodes], dtype=np.uint8), each)
                order = np.argsort(k)
                k, v, z = k[order], v[order], z[order]
                edges = np.searchsorted(k, (np.arange(buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64))
                edges = np.append(edges, len(k))
                rows += [(int(i), True, *[x[edges[i] : edges[i + 1]].tobytes() for x in (k, v, z)], None) for i in np.flatnonzero(np.diff(edges))]
            hot_once = {int(x[0, 1]): x for x in hot}.values()
            rows += [(int(x[0, 1] % buckets), False, x[:, 0].tobytes(), x[:1, 1].tobytes(), b"", int(x[0, 2])) for x in hot_once]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["bucket", "cold", "keys", "nodes", "sizes", "rest"])

        for s in read(batches):
            if not len(s):
                continue
            node, take = node_of(s, collided), len(s) + (-percent * len(s) // 100) + 1
            is_common = sent.value(s & np.uint64((1 << 8 * COUNTED) - 1))
            own = s[~is_common][:take]
            if len(own):
                keys.append(own)
                nodes.append((node, len(own), size_class(len(s), percent)))
            if len(own) < take:
                x = s[is_common][: take - len(own)].view(np.int64)
                hot.append(np.column_stack([x, np.full(len(x), node), np.full(len(x), len(own))]))
            n += take
            if n > flush:
                yield from made()
                keys, nodes, hot, n = [], [], [], 0
        yield from made()

    def gather(batches):
        names = ["cold", "block", "nodes", "rest"]
        for rows in grouped(batches, 2):
            if not rows[0][1]:
                seen = {(r[3], r[2]): r for r in rows}.values()
                keys = [np.frombuffer(r[2], "<i8") for r in seen]
                each = [len(k) for k in keys]
                node = np.repeat(np.array([int.from_bytes(r[3], "little", signed=True) for r in seen], dtype=np.int64), each)
                yield pa.RecordBatch.from_arrays([pa.array([False] * sum(each)), pa.array(np.concatenate(keys)), pa.array([x.tobytes() for x in node], pa.binary()), pa.array(np.repeat(np.array([r[5] for r in seen]), each), pa.int64())], names=names)
                continue
            k = np.frombuffer(b"".join([r[2] for r in rows]), "<u8")
            v = np.frombuffer(b"".join([r[3] for r in rows]), "<i8")
            z = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8)
            order = np.lexsort((v, z, k))
            k, v, z = k[order], v[order], z[order].astype(np.int64)
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v, z = k[new], v[new], z[new]
            # Members whose sizes are too far apart to be similar are blocks of their own.
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (z[1:] - z[:-1] > ZONES)]))
            ends = np.append(first[1:], len(k))
            several = ends - first > 1
            made = list({np.sort(v[a:b]).tobytes() for a, b in zip(first[several].tolist(), ends[several].tolist(), strict=True)})
            ids = [node_of(np.frombuffer(x, "<u8")) for x in made]
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(ids), pa.bool_()), pa.array(ids, pa.int64()), pa.array(made, pa.binary()), pa.array([None] * len(ids), pa.int64())], names=names)

    def unpacked(batches):
        for b in batches:
            members = [np.frombuffer(x, "<i8") for x in b.column("nodes").to_pylist()]
            at = np.repeat(np.arange(len(members)), [len(x) for x in members])
            yield pa.RecordBatch.from_arrays([b.column("cold").take(pa.array(at)), b.column("block").take(pa.array(at)), pa.array(np.concatenate([*members, np.empty(0, "<i8")]), pa.int64()), b.column("rest").take(pa.array(at))], names=["cold", "block", "node", "rest"])

    packed = sets.docs.mapInArrow(lean(emit), "bucket long, cold boolean, keys binary, nodes binary, sizes binary, rest long")
    found = checkpointed(dealt(packed, need).sortWithinPartitions("bucket", "cold").mapInArrow(lean(gather), "cold boolean, block long, nodes binary, rest long"), sent)
    release(spark)
    # Equal member lists, found by their whole content, are one block.
    one = found.filter("cold").dropDuplicates(["block", "nodes"]).unionByName(found.filter("not cold"))
    out = checkpointed(one.mapInArrow(lean(unpacked), "cold boolean, block long, node long, rest long"))
    forget(found)
    return out


PAIR = "a long, b long"


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])


def block_pairs(cold: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that an R-tree of a block can't rule out."""

    def search(batches):
        for rows in grouped(batches, 1):
            node, size = [r[1] for r in rows], [r[2] for r in rows]
            p = [unpacked_point(r[3]) for r in rows]
            tree, found = RTree(p, size), []
            for i in range(len(rows)):
                found += [(node[i], node[j]) for j in tree.query(p[i], size[i], percent).tolist() if node[j] > node[i]]
            if found:
                yield _pairs(found)

    members = cold.join(points, "node").select("block", "node", "n", "point")
    return members.repartition("block").sortWithinPartitions("block", "node").mapInArrow(lean(search), PAIR).distinct()


def hub_pairs(hot: DataFrame, hubs: DataFrame, points: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a common block's hub and its members that the bound can't rule out; and the stored step that they are read from."""

    def bound(batches):
        for b in batches:
            found = []
            for a, n, p, c, m, q in zip(*[x.to_pylist() for x in b.columns], strict=True):
                p, q = unpacked_point(p), unpacked_point(q)
                g = min(len(p), len(q))
                if may_link(np.minimum(fold(p, g), fold(q, g)).sum(), n, m, percent):
                    found.append((a, c))
            yield _pairs(found)

    star = checkpointed(salted_join(hot, hubs, "key", "node").filter("node <> hub").select("hub", "node").distinct())
    hub = points.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("point").alias("hub_point"))
    # A hub's members are dealt over several tasks, the hub sent to each.
    members = salted_join(star.join(points, "node"), hub, "hub", "node", rows=NODE_ROWS)
    return members.select("hub", "hub_n", "hub_point", "node", "n", "point").mapInArrow(lean(bound), PAIR), star


def merged(each: DataFrame) -> DataFrame:
    """Members (key, hub, node, root, outside) of blocks as (key, node, root, outside), stored, where a hub's blocks are one, with the hub as its key, if that makes no more pairs.

    Blocks that are taken as one have all their pairs. Should a hub equal another block's key, the two are one block, which loses no pair either.
    """
    pairs = lambda: F.count("*").cast("double") * F.count(F.when(F.col("outside"), 1))
    apart = each.groupBy("key", "hub").agg(pairs().alias("pairs")).groupBy("hub").agg(F.sum("pairs").alias("apart"))
    together = each.select("hub", "node", "outside").distinct().groupBy("hub").agg(pairs().alias("together"))
    one = checkpointed(apart.join(together, "hub").filter("together <= apart").select("hub", F.lit(True).alias("one")))
    out = checkpointed(salted_join(each, one, "hub", "node", "left").select(F.when(F.col("one"), F.col("hub")).otherwise(F.col("key")).alias("key"), "node", "root", "outside").distinct())
    forget(one)
    return out


def rest_pairs(hot: DataFrame, hubs: DataFrame, roots: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in common blocks that hubs left with several components: members outside the hub's component against all of similar size, in chunks.

    Near copies meet in the blocks of all the shingles that they share, mostly with one hub: a hub's blocks are taken as one where that makes fewer pairs.
    """
    root = roots.select(F.col("v").alias("node"), "root")
    hub_root = hubs.join(roots.withColumnRenamed("v", "hub"), "hub", "left").select("key", "hub", F.coalesce("root", "hub").alias("hub_root"))
    of = checkpointed(hot.select("key", "node").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    open_keys = checkpointed(of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key").join(hub_root, "key"))
    zone = F.least(F.lit(255), F.floor(4 * F.log("n") / float(np.log(100 / percent))).cast("int"))
    each = checkpointed(salted_join(of, open_keys, "key", "node").select("key", "hub", "node", "root", (F.col("root") != F.col("hub_root")).alias("outside")))
    fewer = merged(each)
    members = checkpointed(fewer.join(points.select("node", "n"), "node").select("key", zone.alias("zone"), "node", "root", "outside"))
    forget(of, each, fewer)
    sizes = checkpointed(members.groupBy("key", "zone").agg(F.count("*").alias("n"), F.count(F.when(F.col("outside"), 1)).alias("asking")))
    near = F.explode(F.sequence(F.col("zone") - ZONES, F.col("zone") + ZONES))
    # Of each zone of sizes: chunks of members, and parts of those that ask there, from it and the zones around.
    asking = sizes.filter("asking > 0").select("key", near.alias("zone"), "asking").groupBy("key", "zone").agg(F.sum("asking").alias("asking"))
    grid = checkpointed(sizes.drop("asking").join(asking, ["key", "zone"]).select("key", "zone", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("asking") / ASKING).cast("int").alias("parts")))
    turn = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "zone", "chunk", "part", "asks", "node", "root"]
    all_of = members.join(grid, ["key", "zone"]).withColumn("chunk", turn("chunks")).withColumn("part", every("parts")).withColumn("asks", F.lit(False))
    asks = members.filter("outside").withColumn("zone", near).join(grid, ["key", "zone"]).withColumn("part", turn("parts")).withColumn("chunk", every("chunks")).withColumn("asks", F.lit(True))

    def search(batches):
        tree, block, now, found = None, [], None, []
        for rows in _streamed(batches):
            if rows[:4] != now:
                now, block, tree = rows[:4], [], None
            if not rows[4]:
                block.append(rows[5:])
                continue
            if not block:
                continue
            if tree is None:
                tree = RTree([unpacked_point(r[3]) for r in block], [r[2] for r in block])
            node, own, n, p = rows[5:]
            found += [(node, block[j][0]) for j in tree.query(unpacked_point(p), n, percent).tolist() if block[j][1] != own]
            if len(found) > 20_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    both = all_of.select(*columns).unionByName(asks.select(*columns)).join(points, "node").select(*columns, "n", "point")
    out = checkpointed(both.repartition("key", "zone", "chunk", "part").sortWithinPartitions("key", "zone", "chunk", "part", "asks").mapInArrow(lean(search), PAIR).distinct())
    forget(open_keys, members, sizes, grid)
    return out


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def verified(sets: Sets, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar, stored; `pairs` is stored.

    Of a pair, the node with very many pairs is held: its pairs are dealt over several tasks, its set sent to each.
    """
    size, collided = sets.size, sets.collided
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    heavy = heavy_keys(both, "node", NODE_ROWS)
    used = by_ids(sets.docs, nodes.join(both.distinct(), "node", "left_semi"), inside=True)

    def read(ids, texts):
        found = [s for s in shingle_sets(texts, size) if len(s)]
        return pa.array([node_of(s, collided) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())

    def compare(batches):
        for b in batches:
            found = []
            for x, y, p, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    found.append((x, y))
            yield _pairs(found)

    whole = map_texts(used, read, "node long, shingles binary", binary=True)
    side = lambda k: whole.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}"))
    is_heavy = lambda k: F.col(k).isin([int(x) for x in heavy]) if heavy else F.lit(False)
    turned = is_heavy("b") & ~is_heavy("a")
    of_other = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("held"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other")).join(side("other"), "other")
    many, one = salted(of_other, side("held"), "held", "other", heavy) if heavy else (of_other, side("held"))
    rows = many.join(one, ["held", "__salt"] if heavy else "held").select("held", "other", "of_held", "of_other")
    out = checkpointed(rows.mapInArrow(lean(compare), PAIR).distinct())
    release(sets.docs.sparkSession)
    return out


def linked(docs: DataFrame, size: int, percent: int, common: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """info (doc_id, n_shingles, node of each row), nodes (node, doc_id: the smallest, n), links (a, b) of nodes that join all similar ones and their components (v, root), all stored; and nodes_of()'s hashes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    all_info = checkpointed(described(docs, size))
    full, nodes, collided = nodes_of(all_info)
    total = full.filter("doc_id is not null").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    sets = Sets(docs, full, nodes, size, collided)
    found = blocks(sets, total, percent, common)
    release(spark)
    cold = found.filter("cold").select("block", "node")
    hot = found.filter("not cold").select(F.col("block").alias("key"), "node", "rest")
    # One row of points for each node of a block: the row of its smallest doc_id.
    used = nodes.join(found.select("node").distinct(), "node", "left_semi")
    points = checkpointed(full.select("doc_id", "node", "point").join(used, ["doc_id", "node"]).select("node", "n", "point").dropDuplicates(["node"]))
    info = checkpointed(full.select("doc_id", "n_shingles", "node"))
    forget(all_info)
    release(spark)
    # A block's hub: the member with the fewest uncommon shingles in its prefix, as the text that its near copies were made from has.
    hubs = checkpointed(hot.groupBy("key").agg(F.min(F.struct("rest", "node")).alias("m")).select("key", F.col("m.node").alias("hub")))
    of_hubs, star = hub_pairs(hot, hubs, points, percent)
    pairs = checkpointed(block_pairs(cold, points, percent).unionByName(of_hubs).distinct())
    forget(star)
    release(spark)
    links = verified(sets, pairs, nodes, percent)
    roots = components(links)
    rest = rest_pairs(hot, hubs, roots, points, percent)
    more = checkpointed(rest.join(pairs, ["a", "b"], "left_anti"))
    forget(found, points, hubs, pairs, rest)
    release(spark)
    if not more.isEmpty():
        found = verified(sets, more, nodes, percent)
        links, before = checkpointed(links.unionByName(found)), links
        forget(before, found, roots)
        roots = components(links)
    forget(more)
    sets.skipped.destroy()
    return info, nodes, links, roots, collided


def jaccard_components(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id linked, directly or not) of each row of docs(doc_id, text)."""
    info, nodes, links, roots, _ = linked(docs, size, percent, common)
    # Rows with one doc_id are one document: their nodes are linked.
    repeated = checkpointed(info.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("doc_id"))
    several = not repeated.isEmpty()
    if several:
        own = info.filter("n_shingles > 0").join(repeated, "doc_id").select("doc_id", "node")
        roots = components(links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))))
    # From nodes to the smallest doc_id of each component, then back to the rows.
    of = nodes.join(roots.withColumnRenamed("v", "node"), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = checkpointed(of.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = checkpointed(salted_join(of, least, "root", "node").select("node", "component_id"))
    forget(least, roots)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    out = salted_join(info, named, "node", "doc_id", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    if several:
        # A document's empty rows belong to its component, too.
        whole = out.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("whole"))
        out = out.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
    return out


def without_near_duplicates(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """The rows of docs, all columns, that stay when of all linked texts one does: the one with the smallest doc_id; of rows with equal doc_ids and sets, any one.

    Rows are judged by their own texts, also where they share a doc_id. Rows without doc_id or words stay.
    """
    info, nodes, _, roots, collided = linked(docs, size, percent, common)
    of = nodes.join(roots.withColumnRenamed("v", "node"), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    stay = checkpointed(of.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("x")).select("x.doc_id", "x.node"))
    rows = info.filter("doc_id is not null")
    several = checkpointed(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    gone = rows.filter("n_shingles > 0").join(stay, ["doc_id", "node"], "left_anti").select("doc_id").distinct()
    out = by_ids(docs, gone.unionByName(several), inside=False)
    if several.isEmpty():
        return out
    # A doc_id that several rows have: each is looked at by its own set.
    at, columns = docs.columns.index("text"), docs.columns

    def add(batches):
        for b in batches:
            found = list(shingle_sets([(x or "").encode() for x in b.column(at).to_pylist()], size))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(s, collided) if len(s) else None for s in found], pa.int64())], names=[*columns, "__node"])

    own = by_ids(docs, several, inside=True).mapInArrow(lean(add), StructType([*docs.schema.fields, StructField("__node", LongType())]))
    kept = own.join(stay.withColumnRenamed("node", "__node"), ["doc_id", "__node"], "left_semi").dropDuplicates(["doc_id", "__node"])
    return out.unionByName(own.filter("__node is null").select(*columns)).unionByName(kept.select(*columns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op6: all pairs of sets that share a shingle, and the closure of their links.
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format(f"translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, gram AS shingle FROM {SQL_WINDOWS.format(SIZE)} UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {SIZE - 1}
), n AS (
  SELECT doc_id, count(shingle) AS size FROM (SELECT doc_id FROM documents) LEFT JOIN s USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= {PERCENT} * (p.size + q.size - common)
), reached(v, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.y, reached.root FROM reached JOIN links ON reached.v = links.x)
SELECT doc_id, size AS n_shingles, component_id FROM n JOIN (SELECT v, min(root) AS component_id FROM reached GROUP BY v) ON v = doc_id
"""
