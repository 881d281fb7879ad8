"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one separator. Whole windows are cut off documents longer
than a window; what is left of them, and all shorter documents, are differenced in
batches of about BATCH windows: every document starts as a partial partition of its own,
and the two partial partitions of the largest imbalance are merged again and again, the
fullest window of one with the emptiest of the other, until one partition into windows
is left. Its windows are near equal. While one of them exceeds the capacity, the number of
windows rises and the batch is differenced anew. Windows come out uncut, but not full.

Cuts are free, so a batch's documents are then levelled: as many windows as the batch has
too many are dissolved (those that hold most of documents that are cut anyway, first),
and their ids fill the gaps of the others. A batch takes just as many ids as its
windows hold, cutting its last document. What is left at the end of a partition
fills windows of powers of two, which need no padding. So documents that fit a window stay
whole, but for those of dissolved windows, and nothing is padded.

A partition of docs is packed on its own, while its texts are read: no shuffle, and a task
holds one batch. The result is stored, so that its sequence_ids hold whatever order a
lost task's rows come in when they are read again.

Null and empty texts are the separator alone. Null doc_ids are kept; repeated rows are
packed each. Texts of any length are packed whole. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import bounded_batches, checkpointed, kept, lean, slices, table

SIZE, SEPARATOR, BATCH = 1024, 0, 128
COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
#: Fixed value: how byte-level vocabularies split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def unsteady() -> tuple[str, str]:
    """Patterns of the characters up to U+FFFF, and beyond, that Unicode versions don't all take for the same: letter, number, white space or other."""

    def kind(data, c: str) -> str:
        x = data.category(c)
        return x[0] if x[0] in "LNZ" else "Z" if c in "\t\n\v\f\r\x85" else "-"

    now, old = unicodedata, unicodedata.ucd_3_2_0
    def pattern(chars: range) -> str:
        odd = [c for c in chars if 0x1C <= c <= 0x1F or c == 0x180E or 0xD800 <= c < 0xE000 or now.category(x := chr(c)) == "Cn" or kind(now, x) != kind(old, x)]
        out, at = "", 0
        while at < len(odd):
            end = at
            while end + 1 < len(odd) and odd[end + 1] == odd[end] + 1:
                end += 1
            out += f"\\U{odd[at]:08x}-\\U{odd[end]:08x}"
            at = end + 1
        return f"[{out}]"

    return pattern(range(0x10000)), pattern(range(0x10000, 0x110000))


class ByteCoder:
    """Ids of whole texts as the tokenizers library makes them of a byte-level vocabulary file.

    Vocabularies whose merges are numbered in their order are encoded by tiktoken, which is several times as fast and gives the
    same ids where the split of a text doesn't depend on the Unicode version; other texts and other vocabularies go to the library.
    """

    def __init__(self, path: str, odd: tuple[str, str]):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # Python searches for a class fast if all or none of it is beyond U+FFFF.
        self.low, self.high, self.beyond, self.fast = *map(re.compile, odd), re.compile("[\U00010000-\U0010ffff]"), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        plain &= not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain &= not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]] if plain else []
        if plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges):
            own = {x: b for b, x in enumerate(byte_letters())}
            special = {x["content"]: x["id"] for x in spec["added_tokens"]}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(map(own.__getitem__, w)): i for w, i in model["vocab"].items()}, special_tokens=special)

    def steady(self, text: str) -> bool:
        return not self.low.search(text) and (text.isascii() or not self.beyond.search(text) or not self.high.search(text))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is not None and self.steady(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def byte_coder(path: str, odd: tuple[str, str]) -> ByteCoder:
    return kept(("byte coder", path), lambda: ByteCoder(path, odd))


def merged(a: list[tuple], b: list[tuple], k: int) -> list[tuple]:
    """Two partial partitions as one; each is its non-empty windows as (sum, number, items), from the emptiest to the fullest."""
    if len(a) + len(b) <= k:
        if len(b) > len(a):
            a, b = b, a
        if len(b) == 1:
            bisect.insort(a, b[0])
            return a
        return sorted(a + b)
    # The fullest windows of one meet the emptiest, also the empty ones, of the other.
    alone = k - len(b)
    rest = a[::-1]
    out = rest[:alone] + b[len(a) - alone :] if len(a) > alone else rest + b
    for x, y in zip(rest[alone:], b, strict=False):
        out.append((x[0] + y[0], min(x[1], y[1]), x[2] + y[2]))
    return sorted(out)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items in at most k groups of near-equal sums, by multiway differencing."""
    heap = [(-x, i, [(x, i, [i])]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = merged(a, b, k)
        heapq.heappush(heap, ((both[0][0] if len(both) == k else 0) - both[-1][0], turn, both))
        turn += 1
    return [items for _, _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], size: int) -> list[list[int]]:
    """The items, each of at most `size`, in windows of at most `size`: their number starts at the least that could do and rises while one exceeds it."""
    k = max(-(-sum(sizes) // size), sum(2 * x > size for x in sizes), 1)
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in x) <= size for x in found):
            return found
        k += 1


#: A piece: its document's number in the batch, its start and length there.
Piece = tuple[int, int, int]


def levelled(pieces: list[Piece], whole: list[bool], found: list[list[int]], size: int) -> Iterator[list[Piece]]:
    """Full windows from uncut ones: some are dissolved and fill the gaps of the others; the rest makes windows of powers of two.

    whole: whether a piece is all of its document.
    """
    full, rest = divmod(sum(p[2] for p in pieces), size)
    # Windows of documents that are cut anyway go first, then the emptiest.
    order = sorted(found, key=lambda x: (sum(pieces[i][2] for i in x if whole[i]), len(x)))
    loose = [pieces[i] for x in order[: len(found) - full] for i in x][::-1]

    def take(n: int) -> list[Piece]:
        out = []
        while n:
            d, start, length = loose.pop()
            if length > n:
                loose.append((d, start + n, length - n))
                length = n
            out.append((d, start, length))
            n -= length
        return out

    for x in order[len(found) - full :]:
        own = [pieces[i] for i in x]
        yield own + take(size - sum(p[2] for p in own))
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield take(1 << bit)


def packed(rows: Iterator[tuple[int | None, bytes]], size: int, batch: int, first: int) -> Iterator[list[tuple]]:
    """Rows of COLUMNS for (doc_id, ids) in their order; sequence_ids count from `first`. Holds `batch` windows or one document."""
    docs: list[tuple[int | None, bytes]] = []
    pieces: list[Piece] = []
    held, sequence = 0, first

    def row(doc: tuple, p: Piece, at: int) -> tuple:
        return doc[0], p[1], p[2], zlib.crc32(doc[1][4 * p[1] : 4 * (p[1] + p[2])]), len(doc[1]) // 4, sequence, at

    def flush(limit: int | None) -> Iterator[tuple]:
        nonlocal docs, pieces, held, sequence
        over = []
        if limit is not None and held > limit:
            d, start, length = pieces.pop()
            cut = held - limit
            over = [(0, start + length - cut, cut)]
            if length > cut:
                pieces.append((d, start, length - cut))
            last = docs[d]
        whole = [4 * p[2] == len(docs[p[0]][1]) for p in pieces]
        for window in levelled(pieces, whole, windows([p[2] for p in pieces], size), size):
            at = 0
            for p in window:
                yield row(docs[p[0]], p, at)
                at += p[2]
            sequence += 1
        docs, pieces, held = ([last], over, over[0][2]) if over else ([], [], 0)

    for doc in rows:
        n = len(doc[1]) // 4
        out = []
        for start in range(0, n - n % size, size):
            out.append(row(doc, (0, start, size), 0))
            sequence += 1
        if out:
            yield out
        if n % size:
            docs.append(doc)
            pieces.append((len(docs) - 1, n - n % size, n % size))
            held += n % size
            if held >= batch * size:
                yield list(flush(batch * size))
    if pieces:
        yield list(flush(None))


def near_equal_windows(docs: DataFrame, path: str, size: int = SIZE, *, separator: int = SEPARATOR, batch: int = BATCH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of docs(doc_id, text), stored."""
    bounded_batches(docs.sparkSession)
    odd = unsteady()
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_coder(path, odd)
        texts = ((i, code(t or "") + end) for b in batches for s in slices(b, 1) for i, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True))
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))

        for rows in packed(texts, size, batch, TaskContext.get().partitionId() << 40):
            held += rows
            if len(held) >= 10_000:
                yield made()
                held = []
        if held:
            yield made()

    return checkpointed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, True), ", ".join(f"{k} long" for k in COLUMNS)))


def op12_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return near_equal_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
