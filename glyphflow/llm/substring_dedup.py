"""Removal of passages of WINDOW or more words that stand in a document with a smaller doc_id.

Passages are found by suffix automata of reference shards: a shard is the text around
one anchor. A window's anchor is the smallest hash among its K-word grams, so equal
windows have equal anchors wherever they stand, and only windows whose anchor stands in
documents of different texts can repeat. The documents of an anchor are streamed in the
order of their doc_id against the automaton of those before them; where the matching
statistic reaches WINDOW, the window is removed.

An anchor in more than HOT documents (a passage that is everywhere, thousands of near
copies) would need an ever larger shard. There the windows themselves are counted: the
smallest doc_id of each window's hash, by partial aggregation. Windows that repeat are
taken in runs, as long as they follow each other in a document: a passage that is
everywhere is one run, joined with the smallest doc_ids once and then once a document,
its rows dealt over several tasks. Both ways are exact but for equal 64-bit hashes of
different windows or words; texts and runs are told apart by 128 bits.

Documents with the same words throughout are one text: of WINDOW words or more, all but
the one with the smallest doc_id lose all words, without looking at their windows.

Null and empty texts have no words. Rows with a null doc_id lose nothing and are no
reference. Of repeated rows with one doc_id, none removes another; where their texts
differ, each loses its own words. Very long texts are hashed in parts and windows span
the parts. Extra columns are ignored by deduplicated() and kept by without_repeats(); an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import FILTER_KEYS, SQL_PLACES, SQL_WINDOWS, SQL_WORDS, by_ids, bounded_batches, checkpointed, forget, grouped, hash_filter, lean, map_texts, release, salted_join, slices, table, windows_hash, word_hashes

WINDOW, K, HOT = 50, 10, 48
#: Rows of one run of windows that one task joins.
RUN_ROWS = 1000


def identity(data: bytes) -> bytes:
    """128 bits that stand for a text or a run of windows."""
    return sha256(data).digest()[:16]


def text_class(text: bytes) -> bytes:
    """The identity of a whole sequence of words."""
    return identity(b" ".join(text.split()))


def anchors(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of its k-word grams."""
    if len(h) < window:
        return np.empty(0, dtype=np.uint64)
    g, span, done = windows_hash(h, k), window - k + 1, 1
    while 2 * done <= span:
        g = np.minimum(g[:-done], g[done:])
        done *= 2
    if done < span:
        g = np.minimum(g[: len(g) - (span - done)], g[span - done :])
    return g


class Automaton:
    """A suffix automaton that grows by whole sequences; a window never spans two of them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self.copy(last, c, q)
                continue
            new, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self.copy(p, c, q)
            last = new

    def copy(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matched(self, sequence: list[int], at_least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) made of windows of `at_least` items that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        spans: list[tuple[int, int]] = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if (q := nxt[state].get(c)) is not None:
                state = q
                size += 1
            if size >= at_least:
                if spans and spans[-1][1] >= i + 1 - at_least:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - at_least, i + 1))
        return spans


def shard_spans(rows: list[tuple], window: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(doc_id, class, start, end) of repeated spans among an anchor's rows (anchor, doc_id, class, start, raw words), sorted by doc_id."""
    automaton, seen = Automaton(), set()
    same: list[bytes] = []
    doc = None
    for _, doc_id, cls, start, raw in rows:
        if doc_id != doc:
            for x in same:
                automaton.add(np.frombuffer(x, "<i8").tolist())
            seen.update(same)
            same, doc = [], doc_id
        if raw in seen:
            yield doc_id, cls, start, start + len(raw) // 8
        else:
            if seen:
                for a, b in automaton.matched(np.frombuffer(raw, "<i8").tolist(), window):
                    yield doc_id, cls, start + a, start + b
            same.append(raw)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def described(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, cls, digest of all words, and the anchors (bytes) of each row."""

    def rows(ids, texts):
        out = []
        for i, h, bounds in word_hashes(texts):
            all_anchors = anchors(h, window, k)
            for j, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.unique(all_anchors[a : max(a, b - window + 1)])
                digest = sha256(b" ".join(texts[i + j].split()))
                out.append((b - a, digest.digest()[:16], digest.hexdigest(), own.tobytes()))
        return (pa.array(ids, pa.int64()), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string(), pa.binary()))])

    return map_texts(docs, rows, "doc_id long, n_words long, cls binary, digest string, anchors binary", binary=True)


def emitted(docs: DataFrame, info: DataFrame, shared: DataFrame, window: int, k: int, hot: int) -> DataFrame:
    """is_hot, key, doc_id, cls, start, words, stored: of cold shared anchors the words around them, of hot ones runs of window hashes (no key); `shared` is stored.

    Up to FILTER_KEYS anchors are broadcast as filters; more are joined with the anchors that info has of each text.
    """
    spark = docs.sparkSession
    names, schema = ["is_hot", "key", "doc_id", "cls", "start", "words"], "is_hot boolean, key long, doc_id long, cls binary, start long, words binary"
    types = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    burning = F.col("n") > hot

    def rows(ids, texts, of):
        """of(i, anchors): which anchors of text i are shared, and which are hot."""
        out: list[tuple] = []
        for first, all_h, bounds in word_hashes(texts):
            all_a = anchors(all_h, window, k)
            for j, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                stop = end - window + 1
                if stop <= begin:
                    continue
                a = all_a[begin:stop]
                is_shared, warm = of(first + j, a)
                if not is_shared.any():
                    continue
                i, h, cls = ids[first + j], all_h[begin:end], text_class(texts[first + j])
                at = np.flatnonzero(is_shared & warm)
                if len(at):
                    w = windows_hash(h, window)[at].view(np.int64)
                    turns = np.flatnonzero(np.diff(at) != 1) + 1
                    out += [(True, 0, i, cls, int(own[0]), x.tobytes()) for own, x in zip(np.split(at, turns), np.split(w, turns), strict=True)]
                at = np.flatnonzero(is_shared & ~warm)
                if len(at):
                    cut = np.flatnonzero((np.diff(at) != 1) | (a[at][1:] != a[at][:-1])) + 1
                    for run in np.split(at, cut):
                        s, e = int(run[0]), int(run[-1]) + window
                        out.append((False, int(a[s].view(np.int64)), i, cls, s, h[s:e].tobytes()))
        return out

    def batches_of(part):
        for at in range(0, len(part), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part[at : at + 50_000]], t) for i, t in enumerate(types)], names=names)

    texts = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    n, n_hot = shared.agg(F.count("*"), F.count(F.when(burning, 1))).first()
    if n <= FILTER_KEYS:
        sent = spark.sparkContext.broadcast((hash_filter(shared, "anchor", n), hash_filter(shared.filter(burning), "anchor", n_hot)))

        def emit(batches):
            known, warm = sent.value
            for b in (x for batch in batches for x in slices(batch, 1)):
                yield from batches_of(rows(b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()], lambda i, a: (known(a), warm(a))))

        return checkpointed(texts.mapInArrow(lean(emit), schema), sent)

    def with_class(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_class(x or b"") for x in b.column(1).to_pylist()], pa.binary()), b.column(1)], names=["doc_id", "cls", "text"])

    def emit_own(batches):
        for b in (x for batch in batches for x in slices(batch, 1)):
            known = [np.frombuffer(x, "<u8") for x in b.column(2).to_pylist()]
            warm = [np.frombuffer(x, "<u8") for x in b.column(3).to_pylist()]
            yield from batches_of(rows(b.column(0).to_pylist(), b.column(1).to_pylist(), lambda i, a: (np.isin(a, known[i]), np.isin(a, warm[i]))))  # noqa: B023

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array([np.array(x, "<i8").tobytes() for x in c.to_pylist()], pa.binary()) for c in b.columns[2:]]], names=["doc_id", "cls", "known", "warm"])

    # A text's own anchors meet here, fewer than it has words.
    listed = exploded(info, "doc_id long, cls binary, anchor long").distinct().join(shared, "anchor")
    wanted = listed.groupBy("doc_id", "cls").agg(F.collect_list("anchor").alias("known"), F.collect_list(F.when(burning, F.col("anchor"))).alias("warm")).mapInArrow(lean(packed), "doc_id long, cls binary, known binary, warm binary")
    return checkpointed(texts.mapInArrow(lean(with_class), "doc_id long, cls binary, text binary").join(wanted, ["doc_id", "cls"]).select("doc_id", "text", "known", "warm").mapInArrow(lean(emit_own), schema))


def exploded(info: DataFrame, schema: str) -> DataFrame:
    """A row for each anchor of a described() row, with the columns that `schema` names before it."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def each(batches):
        for b in batches:
            raw = b.column(len(columns) - 1).to_pylist()
            at = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(columns) - 1)], pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=columns)

    return info.filter("doc_id is not null and length(anchors) > 0").select(*columns[:-1], "anchors").mapInArrow(lean(each), schema)


def spans(docs: DataFrame, info: DataFrame, window: int = WINDOW, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, cls and the repeated spans (starts, ends) of rows that share windows with other texts, stored; `info` is a stored described()."""
    spark = docs.sparkSession
    bounded_batches(spark)
    listed = exploded(info, "cls binary, anchor long")
    release(spark)
    shared = checkpointed(listed.groupBy("anchor").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n")).filter("a <> b").select("anchor", "n"))
    found = emitted(docs, info, shared, window, k, hot)
    forget(shared)

    def cold(batches):
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "cls", "start", "end"])
        for rows in grouped(batches, 1):
            if len(rows) > 1:
                out += shard_spans(rows, window)
            if len(out) > 20_000:
                yield pack()
                out = []
        yield pack()

    sharded = found.filter("not is_hot").select("key", "doc_id", "cls", "start", "words").repartition("key").sortWithinPartitions("key", "doc_id", "start")
    cold_spans = sharded.mapInArrow(lean(cold), "doc_id long, cls binary, start long, end long")
    hot_spans, used = run_spans(found.filter("is_hot").select("doc_id", "cls", "start", "words"), window)
    # A document's own spans meet here: as many as it has windows at most.
    out = checkpointed(cold_spans.unionByName(hot_spans).groupBy("doc_id", "cls").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))
    forget(found, *used)
    return out


def run_spans(hot: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, cls, start and end of repeated windows among runs of window hashes (doc_id, cls, start, words), and the stored steps it reads; `hot` is stored."""
    spark = hot.sparkSession

    def counted(batches):
        """Smallest and largest doc_id of each window of a batch."""
        for b in batches:
            raw = b.column(1).to_pylist()
            key = np.frombuffer(b"".join(raw), "<i8")
            if not len(key):
                continue
            doc = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(doc[first]), pa.array(doc[np.append(first[1:], len(key)) - 1])], names=["key", "lo", "hi"])

    counts = hot.select("doc_id", "words").mapInArrow(lean(counted), "key long, lo long, hi long")
    first = checkpointed(counts.groupBy("key").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last").select("key", "first"))
    n = first.count()
    # Of more windows than a filter holds, runs keep those that don't repeat, too: they find no partner in the join below.
    sent = spark.sparkContext.broadcast(hash_filter(first, "key", n)) if n <= FILTER_KEYS else None

    def repeating(batches):
        """The parts of runs whose windows all repeat, named by their content."""
        for b in batches:
            out: list[tuple] = []
            for doc_id, cls, start, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = np.frombuffer(raw, "<i8")
                inside = np.concatenate([[False], np.ones(len(w), dtype=bool) if sent is None else sent.value(w), [False]])
                turns = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
                out += [(doc_id, cls, start + s, identity(w[s:e].tobytes()), w[s:e].tobytes()) for s, e in zip(turns[::2], turns[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "cls", "start", "run", "words"])

    runs = checkpointed(hot.mapInArrow(lean(repeating), "doc_id long, cls binary, start long, run binary, words binary"), sent)

    def windows(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            sizes = [len(x) // 8 for x in raw]
            at = np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(raw)), sizes), pa.int64())), pa.array(at, pa.int64()), pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=["run", "at", "key"])

    def intervals(batches):
        """Of each run, where windows in a row have one smallest doc_id."""
        for rows in grouped(batches, 1):
            at, least = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(least) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.append(cut, len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.binary()), *[pa.array([x.astype("<i8").tobytes()]) for x in (at[begin], at[end], least[begin])]], names=["run", "begin", "last", "least"])

    listed = runs.select("run", "words").dropDuplicates(["run"]).mapInArrow(lean(windows), "run binary, at long, key long")
    known = listed.join(first, "key").select("run", "at", "first").repartition("run").sortWithinPartitions("run", "at")
    known = checkpointed(known.mapInArrow(lean(intervals), "run binary, begin binary, last binary, least binary"))
    forget(first)

    def placed(batches):
        for b in batches:
            out: list[tuple] = []
            for doc_id, cls, start, begin, last, least in zip(*[c.to_pylist() for c in b.columns], strict=True):
                begin, last, least = (np.frombuffer(x, "<i8") for x in (begin, last, least))
                earlier = least < doc_id
                out += [(doc_id, cls, start + s, start + e + window) for s, e in zip(begin[earlier].tolist(), last[earlier].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "cls", "start", "end"])

    # A passage that is everywhere is one run, whose rows are dealt over several tasks.
    joined = salted_join(runs.drop("words"), known, "run", "doc_id", rows=RUN_ROWS).select("doc_id", "cls", "start", "begin", "last", "least")
    return joined.mapInArrow(lean(placed), "doc_id long, cls binary, start long, end long"), [runs, known]


def copies(info: DataFrame) -> DataFrame:
    """cls and smallest doc_id of texts that several rows have."""
    return info.filter("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("cls", "first")


def with_words(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) whose doc_id is in `cut`, with all columns and __cls, the identity of their words."""
    columns = docs.columns
    at = columns.index("text")

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_class((x or "").encode()) for x in b.column(at).to_pylist()], pa.binary())], names=[*columns, "__cls"])

    return by_ids(docs, cut, inside=True).mapInArrow(lean(add), StructType([*docs.schema.fields, StructField("__cls", BinaryType())]))


def remaining(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, cls, n_removed, the kept words joined by blanks and their digest, of the rows with spans, stored; `found` is a stored spans()."""

    def cut(batches):
        for b in batches:
            n, text = [], []
            for t, starts, ends in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                words, kept, at = t.encode().split(), [], 0
                for a, e in merged(starts, ends):
                    kept += words[at:a]
                    at = e
                kept += words[at:]
                n.append(len(words) - len(kept))
                text.append(b" ".join(kept).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "cls", "n_removed", "kept"])

    involved = with_words(docs.select("doc_id", "text"), found).withColumnRenamed("__cls", "cls")
    left = involved.join(found, ["doc_id", "cls"]).select("doc_id", "cls", "text", "starts", "ends").dropDuplicates(["doc_id", "cls"]).mapInArrow(lean(cut), "doc_id long, cls binary, n_removed long, kept string")
    return checkpointed(left.withColumn("partial_digest", F.sha2(F.col("kept").cast("binary"), 256)))


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and cls of each row of docs(doc_id, text); kept: the kept words where some but not all are removed, else null."""
    info = checkpointed(described(docs, window, k))
    found = spans(docs, info, window, k, hot)
    release(docs.sparkSession)
    partial = remaining(docs, found)
    forget(found)
    # Of a text that is everywhere, rows are dealt over several tasks.
    rows = salted_join(info.drop("anchors"), copies(info), "cls", "doc_id", "left").join(partial, ["doc_id", "cls"], "left")
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id",
        "cls",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("partial_digest", "digest")).alias("kept_sha256"),
        F.when(~F.coalesce(whole, F.lit(False)) & (F.col("n_removed") > 0), F.col("kept")).alias("kept"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = HOT) -> DataFrame:
    """docs, all columns, without the words that deduplicated() removes: such texts become their kept words joined by blanks, each row's its own; n_chars, where there is one, follows."""
    cut = deduplicated(docs, window, k, hot).filter("n_removed > 0").select("doc_id", F.col("cls").alias("__cls"), F.coalesce("kept", F.lit("")).alias("__kept"))
    cut = checkpointed(cut.dropDuplicates(["doc_id", "__cls"]))
    changed = with_words(docs, cut).join(cut, ["doc_id", "__cls"], "left").withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return by_ids(docs, cut, inside=False).unionByName(changed.select(*docs.columns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB SQL for op9: every window of every document, word by word.
ORACLE = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), least AS (
  SELECT r, pos, doc_id, min(doc_id) OVER (PARTITION BY gram) AS first FROM {SQL_WINDOWS.format(WINDOW)}
), gone AS (
  SELECT DISTINCT r, unnest(range(pos, pos + {WINDOW})) AS pos FROM least WHERE first < doc_id
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM {SQL_PLACES} ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
