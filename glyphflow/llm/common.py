"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 1 << 19


#: DuckDB SQL for a text's words between ASCII white space, as a list.
SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\v\f]+'), lambda x: x <> '')"
#: Of a table w(r, ..., ws), a row r each with its words: words with their places, and windows of so many words as strings.
SQL_PLACES = "(SELECT * EXCLUDE ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w)"
SQL_WINDOWS = (
    "(SELECT * EXCLUDE (word, n) FROM (SELECT *, string_agg(word, ' ') OVER a AS gram, count(*) OVER a AS n FROM "
    + SQL_PLACES
    + " WINDOW a AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {0} - 1 FOLLOWING)) WHERE n = {0})"
)
SQL_UPPER, SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (local-cluster is not)."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where nothing names one, a local session gets a temporary folder of its own; on a
    cluster, where executors would write to disks that nothing else reads, this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame, *sent: Broadcast | None) -> DataFrame:
    """df cut from its lineage, kept in shared_folder() until forget() or the end of the application.

    Broadcasts `sent` that only df's own steps read are destroyed: each keeps a file on the driver,
    as long as the session lasts, and one on every executor.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    for x in sent:
        if x is not None:
            x.destroy()
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*stored: DataFrame) -> None:
    """Deletes the files of checkpointed() steps. Only for steps whose every reader is stored itself: nothing can be computed from them again."""
    for df in stored:
        plan = df._jdf.logicalPlan()
        while plan.getClass().getSimpleName() == "Project":
            plan = plan.child()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            remove_folder(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now, not when the driver next collects garbage. Checkpoints stay: forget() deletes those.

    The driver's Python and the JVM's native heap, which grows with the number of steps, give back what they don't use, too.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Native memory that the driver's JVM has freed goes back to the system; whether this JVM could."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        # The server's class isn't open to reflection, its interface is.
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(name)
        for i, x in enumerate((command, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0))):
            values[i] = x
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


#: Rows cross to Python code and back in Arrow batches of about so many bytes.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own: Spark's is 64 MB a task, in the JVM and once more in Python.

    The setting stays in the session, as DataFrames are run after the function that made them has returned.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


#: Of this worker process: the words and models that the operator at work keeps between slices.
_kept: dict[tuple, object] = {}


def give_back() -> None:
    """Memory that nothing uses goes back to the system: a worker process waits for its next task with what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What make() gave for this name. A worker keeps one such thing: another operator's goes when this one starts."""
    found = _kept.get(name)
    if found is None:
        _kept.clear()
        give_back()
        found = _kept[name] = make()
    return found


def lean(run: Callable, keeps: bool = False) -> Callable:
    """A function of Arrow batches that leaves no unused memory behind; unless it keeps() something itself, what operators before it kept goes first."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(text)
    sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    part = np.floor(np.cumsum(sizes) / SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, rows: Callable, schema: str, *, text: str = "text", binary: bool = False, keys: tuple[str, ...] = ("doc_id",), keeps: bool = False) -> DataFrame:
    """A DataFrame of `schema` from whole texts, through Arrow batches.

    rows(ids..., texts) gets a list for each key column and the list of texts
    (str, or UTF-8 bytes if `binary`; null is empty) and returns the output columns
    as lists or arrays in the order of `schema`. keeps: whether rows() uses kept().
    """
    names = [x.split()[0] for x in schema.split(", ")]
    bounded_batches(docs.sparkSession)
    col = F.col(text).cast("binary") if binary else F.col(text)
    empty = b"" if binary else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys)):
                ids = [part.column(i).to_pylist() for i in range(len(keys))]
                texts = [empty if x is None else x for x in part.column(len(keys)).to_pylist()]
                out = rows(*ids, texts)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return docs.select(*[F.col(k) for k in keys], col.alias("text")).mapInArrow(lean(run, keeps), schema)


#: Texts are hashed in runs of about so many bytes.
RUN_BYTES = 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Of each byte, the number it stands for; and the odd base of the polynomial over them.
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _INVERSE = 0xC6BC279692B5CC8B, pow(0xC6BC279692B5CC8B, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    while len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, len(_powers[i]), 1 << 64))])
    return _powers


def _run_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a run."""
    x = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[x], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    power, inverse = _grown(len(x) + 1)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[x] * power[: len(x)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """64-bit hashes of the words (between ASCII white space) of texts, all in numpy.

    Yields (i, hashes, bounds) for runs of texts: the words of text i + j are
    hashes[bounds[j]:bounds[j + 1]]. A word's hash depends on its bytes alone. Long
    texts are hashed in parts cut at white space.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > RUN_BYTES:
            t, parts, start = texts[at], [], 0
            while start < len(t):
                end = min(len(t), start + RUN_BYTES)
                while end < len(t) and not _BLANK[t[end]]:
                    nearest = [p for p in (t.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0] if end - start <= 2 * RUN_BYTES else []
                    end = min(nearest, default=len(t))
                parts.append(_run_hashes(t[start:end])[0])
                start = end
            h = np.concatenate(parts)
            yield at, h, np.array([0, len(h)])
            at += 1
            continue
        n, size = at, 0
        while n < len(texts) and size + len(texts[n]) < RUN_BYTES:
            size += len(texts[n]) + 1
            n += 1
        n = max(n, at + 1)
        h, starts = _run_hashes(b" ".join(texts[at:n]))
        yield at, h, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:n]])]))
        at = n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        acc, power, done = h.copy(), base, 1  # acc[i]: hash of the `done` words from i on, doubled as far as it goes
        total, length, parts = None, 0, k
        while parts:
            if parts & 1:
                total = _join(total, length, acc, done, base)
                length += done
            parts >>= 1
            if parts:
                acc = acc[: len(acc) - done] * power + acc[done:]
                power = power * power
                done *= 2
        return mix(total[:n])


def _join(total: np.ndarray | None, length: int, acc: np.ndarray, done: int, base: np.uint64) -> np.ndarray:
    if total is None:
        return acc.copy()
    n = min(len(total), len(acc) - length)
    p = np.uint64(pow(int(base), done, 1 << 64))
    return total[:n] * p + acc[length : length + n]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first `keys` columns; the rows come sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


#: Bits of a HashFilter for each of its numbers (one in twenty other numbers is found too), and the most bits it may have: 64 MB.
FILTER_RATIO, FILTER_BITS = 8, 29
#: Numbers that such a filter can hold.
FILTER_KEYS = (1 << FILTER_BITS) // FILTER_RATIO
#: Where the second of a number's two bits is taken from: both together need no more than the lowest 48.
SECOND = 19
#: Words of a filter that the driver takes at once: 16 MB with their places.
FILTER_WORDS = 1 << 20


class HashFilter:
    """A set of 64-bit numbers, each as two bits at what its lowest 48 bits say, sized by their count. Numbers of the set are always found; of others about one in twenty."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def _at(self, x: np.ndarray) -> np.ndarray:
        low = x & np.uint64(len(self.words) * 64 - 1)
        return (self.words[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x.view(np.uint64)
        found = self._at(x)
        found[found] = self._at(x[found] >> np.uint64(SECOND))
        return found


def hash_filter(df: DataFrame, column: str, n: int) -> HashFilter:
    """The filter of a column of n 64-bit numbers, at most FILTER_KEYS: past those it would be full, and the caller needs a join.

    The driver takes the filter's words in parts: beside the filter itself it holds one part.
    """
    if n > FILTER_KEYS:
        raise ValueError(f"{n} numbers are too many for a filter")
    bits = max(10, (n * FILTER_RATIO - 1).bit_length() if n else 0)
    both = df.select(F.explode(F.array(*[F.shiftright(column, k).bitwiseAND((1 << bits) - 1) for k in (0, SECOND)])).alias("low"))
    words = both.select(F.shiftright("low", 6).alias("at"), F.expr("shiftleft(1L, cast(low & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    parts = -(-len(out) // FILTER_WORDS)
    stored = checkpointed(words) if parts > 1 else words
    for k in range(parts):
        part = (stored.filter((F.col("at") >= k * FILTER_WORDS) & (F.col("at") < (k + 1) * FILTER_WORDS)) if parts > 1 else words).toArrow()
        out[part.column("at").to_numpy()] = part.column("bits").to_numpy().view(np.uint64)
        del part
        give_back()
    if parts > 1:
        forget(stored)
    return HashFilter(out)


#: A key is heavy if it has over one in so many of the rows (so fewer keys than this are) and more rows than one task should have.
HEAVY_SHARE, HEAVY_ROWS = 1024, 100_000


def heavy_keys(df: DataFrame, key: str, rows: int | None = None) -> dict:
    """Heavy keys of a column, with the number of parts of `rows` rows that each makes: fewer than HEAVY_SHARE keys, whatever the table. `df` is read twice."""
    rows = rows or HEAVY_ROWS
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total, top = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max((total or 0) / HEAVY_SHARE, rows)
    if not top or top <= limit:
        return {}
    return {bytes(r[0]) if isinstance(r[0], bytearray) else r[0]: -(-r["n"] // rows) for r in sizes.filter(F.col("n") > limit).collect()}


def salted(many: DataFrame, one: DataFrame, key: str, by: str, heavy: dict) -> tuple[DataFrame, DataFrame]:
    """Both with a column __salt: rows of heavy keys in `many` are dealt over their parts by a hash of `by`, rows of those keys in `one` are in every part."""
    if not heavy:
        return many.withColumn("__salt", F.lit(0)), one.withColumn("__salt", F.lit(0))
    parts = F.broadcast(many.sparkSession.createDataFrame(list(heavy.items()), f"`{key}` {many.schema[key].dataType.simpleString()}, __parts int"))
    n = F.coalesce("__parts", F.lit(1))
    dealt = many.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), n).cast("int")).drop("__parts")
    spread = one.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return dealt, spread


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """many joined with `one`, which has a row a key; a key that holds a third of `many` is on many tasks."""
    heavy = heavy_keys(many, key, rows)
    if not heavy:
        return many.join(one, key, how)
    a, b = salted(many, one, key, by, heavy)
    return a.join(b, [key, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """v and root of every vertex of edges(a, b): root is the smallest vertex of v's component.

    Rounds of contraction: every vertex goes to its smallest neighbour if that is smaller,
    chains are followed, edges are renamed and doubles dropped, until no edge is left. The
    vertices at least halve in few rounds. A vertex's neighbours meet in an aggregate that
    starts before the shuffle; the joins deal the edges of a heavy vertex over many tasks.
    """
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    steps: list[DataFrame] = []
    # Few edges can't have a heavy vertex.
    plain = lambda many, one, key, by, how="inner": many.join(one, key, how)
    big = False
    while n := left.count():
        join = salted_join if n > HEAVY_ROWS else plain
        big |= n > HEAVY_ROWS
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        to = checkpointed(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")))
        for _ in range(2):
            before, to = to, checkpointed(join(to, to.select(F.col("v").alias("to"), F.col("to").alias("next")), "to", "v").select("v", F.col("next").alias("to")))
            forget(before)
        steps.append(to)
        at = lambda name: to.select(F.col("v").alias(name), F.col("to").alias(f"to_{name}"))  # noqa: B023, E731
        renamed = join(join(left, at("a"), "a", "b"), at("b"), "b", "a").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        before, left = left, checkpointed(renamed.filter("a < b").distinct())
        forget(before)
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = steps[0].select("v", F.col("to").alias("root"))
    for to in steps[1:]:
        out = (salted_join if big else plain)(out, to.select(F.col("v").alias("root"), F.col("to").alias("next")), "root", "v", "left").select("v", F.coalesce("next", "root").alias("root"))
    out = checkpointed(out)
    forget(*steps)
    return out


#: Ids are broadcast up to this number: 16 MB or so.
BROADCAST_IDS = 500_000


def in_sorted(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in sorted ids."""
    if not len(ids):
        return np.zeros(len(x), dtype=bool)
    return ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x


def by_ids(docs: DataFrame, ids: DataFrame, *, inside: bool) -> DataFrame:
    """Rows of docs whose doc_id is (inside) or isn't (rows with null doc_id too) in the column doc_id of `ids`.

    A short list is broadcast and the texts stay where they are; a long one is joined by a shuffle.
    """
    ids = ids.select("doc_id").filter("doc_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).toArrow()
    if few.num_rows <= BROADCAST_IDS:
        ids = F.broadcast(docs.sparkSession.createDataFrame(few.cast(pa.schema([("doc_id", pa.int64())]))))
    return docs.join(ids, "doc_id", "left_semi" if inside else "left_anti").select(*docs.columns)
