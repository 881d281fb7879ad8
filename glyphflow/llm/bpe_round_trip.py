"""BPE encoding and decoding of whole documents by prefix-sharing trie traversal.

The distinct words of a slice of documents go into a trie; a depth-first walk gives
each prefix its last-token state once, however many words share it (bpe.TrieCoder).
Words met before are kept per worker process, up to a fixed number.

Null and empty texts have no tokens and decode to an empty text. Very long texts are
coded whole. A null doc_id is kept, and each row of repeated rows is coded on its own.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from .bpe import trie_coder
from .common import map_texts, table


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row of docs(doc_id, text)."""
    import numpy as np

    def rows(ids, texts):
        out = trie_coder(path)(texts)
        return ids, [np.frombuffer(x, "<u4").astype("int32") for x, _ in out], [y for _, y in out]

    return map_texts(docs, rows, "doc_id long, ids array<int>, decoded string", keeps=True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same as digests: the coder is the same, but ids and texts needn't leave the worker."""

    def rows(ids, texts):
        out = trie_coder(path)(texts)
        return ids, [len(x) // 4 for x, _ in out], [sha256(x).hexdigest() for x, _ in out], [sha256(y.encode("utf-8")).hexdigest() for _, y in out]

    return map_texts(docs, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
