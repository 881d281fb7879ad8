"""What the driver holds doesn't follow the number of copies, and a filter is taken in parts."""

import numpy as np
from pyspark.sql import functions as F

from glyphflow.llm import common, ngram_join


def test_many_copies_are_no_common_shingles(spark, monkeypatch):
    """Copies are one set also where they are too many to tell every task: no shingle of theirs is common."""
    for module in (ngram_join, common):
        monkeypatch.setattr(module, "BROADCAST_IDS", 3)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % 4) for i in range(30)]).alias("text"))
    info, nodes, collided = ngram_join.nodes_of(common.checkpointed(ngram_join.described(docs)))
    sets = ngram_join.Sets(docs, info, nodes, ngram_join.SIZE, collided)
    assert sets.docs.count() == 4
    assert ngram_join.common_shingles(sets, 40 * 26, 2).count() == 0
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, common=2).collect())) == [(i, 26, i % 4) for i in range(40)]


def test_filter_in_parts(spark, monkeypatch):
    """All numbers of the set are found, few others are, in at most 16 bits a number; taken at once or in parts it is the same filter."""
    df = spark.range(20_000).select(F.expr("xxhash64(id) & 281474976710655L").alias("key"))
    whole = common.hash_filter(df, "key", 20_000)
    monkeypatch.setattr(common, "FILTER_WORDS", 1000)
    parts = common.hash_filter(df, "key", 20_000)
    assert (whole.words == parts.words).all() and len(parts.words) * 64 <= 16 * 20_000
    assert parts(df.toArrow().column(0).to_numpy()).all()
    assert parts(np.random.default_rng(1).integers(0, 1 << 48, 100_000)).mean() < 0.06
    assert 1 << common.FILTER_BITS <= 8 * (64 << 20)
