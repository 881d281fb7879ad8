"""Document quality rules as a bitmask ledger.

Every rule is evaluated once: the ledger holds the measurements and one failure bit per
rule. A policy is a version's set of rules; a document is kept if none of its bits is
set. Ablations are counts over the ledger: how many documents a rule fails, and how
many it alone fails. New policies need no new pass over the texts.

Words are what stands between ASCII white space. Null and empty texts have no words and
fail the word count. Very long texts are measured whole. Null doc_ids are kept; repeated
rows are measured each. Extra columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_WINDOWS, SQL_WORDS, map_texts, table

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_distinct_words long, n_alpha_words long, n_shouted_words long, n_marks long"


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    code = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:] if distinct < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    if len(counts) == len(code):
        return 0
    twice = (counts > 1)[inverse]
    cover = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    inside = len(text.decode("utf-8")) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    alpha = shouted = 0
    counts = np.bincount(ids, minlength=len(index)) if n else ()
    for w, c in zip(index, counts, strict=True):
        x = w.decode("utf-8")
        if any(map(str.isalpha, x)):
            alpha += int(c)
            shouted += int(c) * (len(x) > 1 and x.isupper())
    marks = text.count(b"!!") + text.count(b"??")
    return n, inside, symbols, len(lines) - len(set(lines)), len(lines), repeated(ids, len(index)), len(index), alpha, shouted, marks


#: The rules in the order of their bits, as SQL over the measurements; true is a failure.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "shouting": "100 * n_shouted_words > 50 * n_words",
    "marks": "100 * n_marks > 30 * n_words",
    "few_alphabetic": "100 * n_alpha_words < 50 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines AND n_lines > 4",
    "long_words": "word_chars > 40 * n_words",
}
BITS = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that a kept document must pass.
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols", "shouting", "marks"), "v3": tuple(BITS)}


def mask(names: Iterable[str]) -> int:
    return sum(1 << BITS[x] for x in names)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of each row of docs(doc_id, text)."""

    def rows(ids, texts):
        found = np.array([measure(x) for x in texts], dtype=np.int64).reshape(-1, 10)
        return (ids, *found.T)

    measured = map_texts(docs, rows, SCHEMA, binary=True)
    bits = sum((F.when(F.expr(r), F.lit(1 << i)).otherwise(0) for i, r in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failed", bits.cast("int"))


def apply_policy(kept: DataFrame, version: str) -> DataFrame:
    """The ledger with `kept`: whether a version of the policy keeps the document."""
    return kept.withColumn("kept", F.col("failed").bitwiseAND(mask(POLICIES[version])) == 0)


def ablations(kept: DataFrame, version: str) -> DataFrame:
    """For each rule of a version: documents that fail it, and those kept if it alone were left out."""
    m, bits = mask(POLICIES[version]), F.col("failed")
    sums = [F.sum(f(x).cast("long")).alias(f"{kind}_{x}") for x in POLICIES[version] for kind, f in (("all", lambda x: bits.bitwiseAND(1 << BITS[x]) != 0), ("only", lambda x: bits.bitwiseAND(m) == 1 << BITS[x]))]
    one = kept.agg(*sums)
    rows = F.array(*[F.struct(F.lit(x).alias("rule"), F.coalesce(F.col(f"all_{x}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"only_{x}"), F.lit(0)).alias("n_only")) for x in POLICIES[version]])
    return one.select(F.inline(rows))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "v3")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(mask(BASE)) != 0).alias("base_failed"), "kept", "failed")


def _oracle() -> str:
    bits = " + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(RULES.values()))
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), grams AS (
  SELECT r, pos AS i, count(*) OVER (PARTITION BY r, gram) AS n FROM {SQL_WINDOWS.format(3)}
), again AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM grams WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	

]')) AS own FROM w
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(own) - len(list_distinct(own)) AS n_dup_lines, len(own) AS n_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shouted_words,
    (length(t) - length(replace(t, '!!', ''))) // 2 + (length(t) - length(replace(t, '??', ''))) // 2 AS n_marks
  FROM w JOIN lines USING (r) LEFT JOIN again USING (r)
), judged AS (SELECT *, CAST({bits} AS INTEGER) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & {mask(BASE)} <> 0 AS base_failed, failed & {mask(POLICIES["v3"])} = 0 AS kept, failed
FROM judged"""


#: DuckDB SQL for op7: the measures and rules, word by word.
ORACLE = _oracle()
