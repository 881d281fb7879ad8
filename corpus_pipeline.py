"""The corpus pipeline: five stages over `documents`, each with one of the operators.

1. quality_classifier: documents scored below the threshold go.
2. near_duplicates: of documents linked by shingle similarity, directly or not, the one
   with the smallest doc_id stays; of rows with equal texts and doc_ids, one.
3. substring_dedup: passages that also stand in a document with a smaller doc_id are cut
   out; the words left are joined by blanks. Documents without such passages keep
   their text as it is; one that loses every word stays, empty.
4. secret_scan: secrets are replaced by a mark, at their places.
5. best_fit_packing: the documents' token ids are packed into sequences.

Stages 1 to 4 return the columns of documents, extra ones too (n_chars follows the
text); the last returns the pieces and their places. Each row is judged by its own text,
also where rows share a doc_id. Rows with a null doc_id pass stages 2 and 3 as they are.
Null and empty texts get the mean label as their score in stage 1, pass stages 2 to 4
and are one piece in the last. An empty table gives no rows. Each stage's result is
written as Parquet and read again as the next one's input; it is deleted when the next
one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphflow.llm import ngram_join, packing, quality_classifier, secret_scan, substring_dedup
from glyphflow.llm.common import remove_folder, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_two_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]

#: A trained model decides in stages 1 and 4: SQL can't express the pipeline. tests/llm hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the table documents in sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    # The last stage has stored what it takes from its input when it returns.
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, folder)
    return out
