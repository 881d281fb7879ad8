"""Best-two-fit packing of token sequences into bins.

A document's ids and one separator are cut into pieces of at most `size` ids. How many
pieces there are of each length (at most `size` numbers, whatever the corpus) is all
that the plan depends on: bins are filled greedily by the largest piece that fits, then
a bin's smallest piece is replaced by two unpacked ones that fit the widened gap more
tightly, as long as that helps. One such filling is made as often as the counts allow,
so a plan has a few thousand fillings at most. Pieces find their place from their rank
among the pieces of their length: no task or driver sees the pieces of the corpus.

Null and empty texts are one piece of the separator alone. Null doc_ids are kept;
repeated rows are packed each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import library_coder
from .common import checkpointed, map_texts, table

SIZE = 2048
SEPARATOR = 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"


def pieces(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and the partition that made it."""
    last = np.array([separator], dtype="<u4").tobytes()

    def rows(ids, texts):
        doc, piece, start, length, crc = [], [], [], [], []
        step = 4 * size
        for i, x in zip(ids, library_coder(path)(texts), strict=True):
            x += last
            for k, at in enumerate(range(0, len(x), step)):
                y = x[at : at + step]
                doc.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(y) // 4)
                crc.append(zlib.crc32(y))
        return pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), start, length, crc, pa.array([TaskContext.get().partitionId()] * len(doc), pa.int32())

    return map_texts(docs, rows, SCHEMA, keeps=True)


@dataclass
class Filling:
    """`times` bins that each hold the pieces of these lengths."""

    lengths: dict[int, int]
    times: int


def plan(counts: np.ndarray, size: int = SIZE) -> list[Filling]:
    """Fillings that use up counts[length] pieces of each length from 1 to size."""
    left, out = counts.astype(np.int64).copy(), []
    at = np.arange(size + 1)
    while left.any():
        used: dict[int, int] = {}
        gap = size

        def add(x: int, n: int = 1) -> None:
            used[x] = used.get(x, 0) + n
            left[x] -= n
            if not used[x]:
                del used[x]

        below = np.maximum.accumulate(np.where(left > 0, at, 0))
        while gap and (x := int(below[gap])):
            n = min(gap // x, int(left[x])) if used else 1
            add(x, n)
            gap -= n * x
            if not left[x]:
                below = np.maximum.accumulate(np.where(left > 0, at, 0))
        while gap and len(used) + max(used.values()) > 2:  # the first, largest piece stays
            small = min(used)
            room = gap + small
            first = np.flatnonzero(left[: room + 1] > 0)
            below = np.maximum.accumulate(np.where(left > 0, at, 0))
            if not len(first):
                break
            second = below[room - first]
            lone = (second == first) & (left[first] < 2)
            second = np.where(lone, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            add(small, -1)
            add(int(first[best]))
            add(int(second[best]))
            gap = room - int(total[best])
        times = 1 + min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= (times - 1) * n
        out.append(Filling(used, times))
    return out


class Places:
    """Bin and offset of the piece with a given rank among the pieces of its length."""

    def __init__(self, fillings: list[Filling], size: int = SIZE):
        per: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size + 1)]
        used, bins = [0] * (size + 1), 0
        for f in fillings:
            offset = 0
            for x, n in sorted(f.lengths.items(), reverse=True):
                per[x].append((used[x], n, bins, offset))
                used[x] += n * f.times
                offset += n * x
            bins += f.times
        self.bins = bins
        self.per = [np.array(x, dtype=np.int64).reshape(-1, 4) for x in per]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            t = self.per[x]
            row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
            turn, slot = np.divmod(rank[own] - row[:, 0], row[:, 1])
            sequence[own], offset[own] = row[:, 2] + turn, row[:, 3] + slot * x
        return sequence, offset


def pack(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces(); `made` must not change between reads (a checkpoint or table)."""
    counted = checkpointed(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    places = Places(plan(counts, size), size)
    base = counted.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = made.withColumn("rank", rank.cast("long") - 1).join(checkpointed(base.na.fill(0, ["base"])), ["part", "length"])

    def place(batches):
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = places.find(length, r)
            yield pa.RecordBatch.from_arrays([b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, (F.col("rank") + F.col("base")).alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_two_fit(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs(doc_id, text)."""
    return pack(checkpointed(pieces(docs, path, size, separator)), size)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_two_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
