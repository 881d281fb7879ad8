"""Token counts of whole documents by overlap resynchronisation.

A text of at most CHUNK characters is one chunk, and its count is the sum of its words'
counts (words are split and encoded as the vocabulary file says, each new one once, see
bpe.py). A longer text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a position
inside their overlap that is provably a border in the encoding of the whole text: it
follows an ASCII white space character (no step of the tokenizer joins what stands on
its two sides) and both chunks have a token that starts there. Where an overlap has no
such position, it is widened (twice as long each time, up to the rest of the text).

Null and empty texts have 0 bytes and 0 tokens. A null doc_id is kept, and each row
of repeated rows is counted on its own. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .bpe import LibraryCoder, Words
from .common import kept, map_texts, table

#: Characters of a chunk, and of the first try of an overlap.
CHUNK, OVERLAP = 32_768, 256
LIMIT = 2048
BLANK = re.compile(r"(?<=[ \t\n\r\f\v])[^ \t\n\r\f\v]")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = WordCounts(Words(path))
        self.tokenizer = self.words.words.tokenizer
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of a chunk start, as places in the whole text."""
        return [begin + a for a, _ in self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets]

    def long(self, text: str) -> int:
        """Tokens of a text, by chunks."""
        size = len(text)
        end = min(size, self.chunk)
        left, border, total = self.starts(text, 0, end), 0, 0
        while end < size:
            overlap = self.overlap
            while True:
                nxt = max(border, end - overlap)
                stop = min(size, max(nxt + self.chunk, end + 1))
                # A chunk may cut a word at its ends: only places inside the overlap count, and its left end only if it is a border itself.
                right = self.starts(text, nxt, stop)
                both = set(left).intersection(right)
                at = next((m.start() for m in BLANK.finditer(text, nxt + 1, end) if m.start() in both), None)
                if at is not None:
                    total += sum(border <= x < at for x in left)
                    left, border, end = right, at, stop
                    break
                self.widened += 1
                if nxt == border:  # no place to splice since the last border: take more text on the right
                    end = min(size, 2 * end - border)
                    left = self.starts(text, border, end)
                    if end == size:
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
        return total + sum(x >= border for x in left)

    def __call__(self, texts: list[str]) -> list[int]:
        short = [i for i, x in enumerate(texts) if len(x) <= self.chunk]
        out = {i: n for i, n in zip(short, self.words([texts[i] for i in short]), strict=True)}
        return [out[i] if i in out else self.long(x) for i, x in enumerate(texts)]


class WordCounts(LibraryCoder):
    """Numbers of tokens of texts: of each word met before, its number is kept."""

    def __call__(self, texts: list[str]) -> list[int]:
        get = self.lookup()
        return [sum(map(get, self.words.units(x))) for x in texts]

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def joined(self, values: Iterable[int]) -> int:
        return sum(values)


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return kept(("counter", path, chunk, overlap), lambda: Counter(path, chunk, overlap))


def token_counts(docs: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs(doc_id, text)."""

    def rows(ids, texts):
        n = counter(path, chunk, overlap)(texts)
        return ids, [len(x.encode("utf-8")) for x in texts], n, [x > limit for x in n]

    return map_texts(docs, rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keeps=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
