"""The pipeline's stages, each held against brute force on its own input."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_operators import DOCS, jaccard, texts
from tokenizers import Tokenizer

import corpus_pipeline
from glyphflow.llm import common, quality_classifier

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def key(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2) for i, t in texts()]
    with_secret = lambda i, t: (i, f'{t} token = "{SECRET}" more words', "en", "s", len(t) + 62, 1, "x", 2)
    rows += [with_secret(80, "Some words"), with_secret(80, "Other words with the same id"), with_secret(None, "No id")]
    rows += [(100 + i, "junk### &&& $$$ " * 30 + str(i), "en", "s", 500, 1, "x", 2) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    labels = sorted({(r[0], int(r[0] < 100)) for r in rows if r[0] is not None})
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def kept_texts(rows):
    """Of linked texts one row stays, the one with the smallest doc_id; rows are told apart by number, so that ids may repeat."""
    with_id = [(n, t) for n, (i, t) in enumerate(rows) if i is not None and (t or "").split()]
    group = defaultdict(list)
    for n, _, root in jaccard(with_id):
        group[root].append(n)
    stay = {min(own, key=lambda n: rows[n][0]) for own in group.values()}
    return [x for n, x in enumerate(rows) if n in stay or x[0] is None or not (x[1] or "").split()]


def cut_texts(rows, window=50):
    """Each row without the words of windows that start in a document with a smaller doc_id."""
    first = {}
    for i, t in rows:
        own = (t or "").encode().split()
        for s in range(len(own) - window + 1 if i is not None else 0):
            first[tuple(own[s : s + window])] = min(first.get(tuple(own[s : s + window]), i), i)
    out = []
    for i, t in rows:
        own = (t or "").encode().split()
        gone = {j for s in range(len(own) - window + 1) if i is not None and first[tuple(own[s : s + window])] < i for j in range(s, s + window)}
        out.append((i, b" ".join(w for j, w in enumerate(own) if j not in gone).decode() if gone else t))
    return out


def packed_pieces(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out += [(i, k, at, len(x := ids[at : at + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return key(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        after = key((r["doc_id"], r["text"]) for r in out.collect())
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect()) or name == "quality_classifier"
        if name == "quality_classifier":
            kept = quality_classifier.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1")
            assert [x[0] for x in after] == key(r["doc_id"] for r in kept.collect()) and not {x[0] for x in after} & set(range(100, 160))
        if name == "near_duplicates":
            assert after == key(kept_texts(before)) and len(after) < len(before)
        if name == "substring_dedup":
            assert after == key(cut_texts(before)) != key(before)
        if name == "secret_scan":
            assert after == key((i, t if t is None else t.replace(SECRET, "[SECRET]")) for i, t in before)
            assert sum("[SECRET]" in (t or "") for _, t in after) == 3
        docs = out
    expected = packed_pieces((r["doc_id"], r["text"]) for r in docs.collect())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, folder), corpus_pipeline.run(spark, folder)):
        assert key(tuple(r) for r in out.select(*columns).collect()) == expected
    # Stage folders are gone when the pipeline returns.
    assert not [x for x in os.listdir(common.shared_folder(spark).removeprefix("file:")) if x.startswith("pipeline-")]


def test_empty_table(spark, folder, tmp_path):
    for x in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{x}.parquet").limit(0).write.parquet(f"{tmp_path}/{x}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder(spark):
    """A cluster needs spark.checkpoint.dir; a local session may do without."""
    from types import SimpleNamespace as Fake

    none = Fake(get=lambda *a: None)
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://x:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(Fake(conf=none, sparkContext=Fake(master=master, getCheckpointDir=lambda: None)))
    assert common.is_local(spark) and common.is_local(Fake(sparkContext=Fake(master="local")))
