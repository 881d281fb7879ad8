"""Arrow UDFs get batches bounded by bytes; the single pass searches for matches instead of trying every place."""

import random
import threading
import time

from pyspark.sql import functions as F

from glyphflow.functions import arrow
from glyphflow.functions import text as fn


def test_single_pass_skips_what_matches_nothing():
    """A long text with few matches takes a few searches, and results are the longest match at each place, the table first."""
    convert = fn.single_pass({"a": "1", "in": "2"}, [("an(?=d)", "3"), ("in", "4"), ("(?<=z)q+|x+", "5")])
    assert convert("and an in inn zqqx q") == "3d 1n 2 2n z55 q"
    began = time.perf_counter()
    assert convert("t" * 2_000_000 + "and") == "t" * 2_000_000 + "3d"
    assert time.perf_counter() - began < 3
    many = {"".join(random.Random(k).choices("abcd", k=3)): "x" for k in range(200)}
    assert fn.single_pass(many)("abcdabd") == fn.single_pass({k: v for k, v in many.items() if k in "abcdabd"})("abcdabd")


def test_batches_are_bounded(spark):
    """No batch holds much more than BATCH_BYTES of text."""
    df = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = arrow.text_lists(F.col("text"), lambda: lambda xs: [str(sum(map(len, xs)))] * len(xs))
    found = df.select(sizes.alias("n")).agg(F.max(F.col("n").cast("long"))).first()[0]
    assert found <= 2 * arrow.BATCH_BYTES


def test_catalog_is_dealt_out(spark, tmp_path):
    """Parts of one small file are parsed by all tasks."""
    from glyphflow import queries

    columns = ["p_name", "p_brand", "p_type"]
    spark.range(0, 400, 1, 1).select(F.col("id").alias("p_partkey"), *[F.lit(x).alias(x) for x in columns], F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    out = queries.QUERIES["catalog_rules"](spark, str(tmp_path))
    assert out.count() == 2400 and out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_parts_are_bounded_in_any_session(spark):
    """A worker holds about PART_BYTES of texts as strings, whatever bounds the batches of the session that runs the Column; rows stay in order, nulls null."""
    other = spark.newSession()
    x = F.when(F.col("id") % 7 != 0, F.repeat(F.lit("ж"), 5_000))
    sizes = arrow.text_lists(F.col("text"), lambda: lambda xs: [t and f"{sum(len(y or '') for y in xs)}" for t in xs])
    out = other.range(0, 3000, 1, 1).select("id", x.alias("text")).select("id", sizes.alias("n")).collect()
    assert [r.id for r in out] == list(range(3000)) and all((r.n is None) == (r.id % 7 == 0) for r in out)
    assert max(2 * int(r.n) for r in out if r.n) <= arrow.PART_BYTES


def test_batches_are_bounded_from_a_thread(spark):
    """A thread without an active session of its own bounds the process's."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    thread = threading.Thread(target=lambda: arrow.texts(F.col("text"), lambda: str))
    thread.start()
    thread.join()
    assert spark.conf.get(key) == str(arrow.BATCH_BYTES)


def test_batches_are_bounded_in_the_session_that_runs(spark, tmp_path):
    """Queries, and what takes a DataFrame, bound the batches of its session, though another one is active; a bound of its own stays."""
    from glyphflow import queries
    from glyphflow import maps as m

    key, made = "spark.sql.execution.arrow.maxBytesPerBatch", lambda: spark.newSession()
    spark.range(0, 50, 1, 1).select(F.col("id").alias("doc_id"), F.lit("é a").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("funcall_decompose", "parallel_large_table", "long_texts"):
        other = made()
        queries.QUERIES[name](other, str(tmp_path))
        assert other.conf.get(key, None) == str(arrow.BATCH_BYTES)
    e = queries.engine(*m.ukrainian())
    for use in (e.convert_long, e.convert_rows):
        other = made()
        rows = other.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("Київ "), 1_000).alias("text"))
        out = use(rows, "text", "bgnpcgn-ukr-Cyrl-Latn-2019", "id", to="out")
        assert other.conf.get(key, None) == str(arrow.BATCH_BYTES)
    assert out.select("out").distinct().collect()[0].out == "Kyiv " * 1_000
    other = made()
    other.conf.set(key, 1 << 20)
    e.convert_long(other.range(1).select("id", F.lit("Київ").alias("text")), "text", "bgnpcgn-ukr-Cyrl-Latn-2019", "id")
    assert other.conf.get(key) == str(1 << 20)


def test_kept_words_are_bounded(monkeypatch):
    """What a task keeps of its words doesn't grow with its texts, however many words are new."""
    import tracemalloc

    from glyphflow.operators import rewrite

    monkeypatch.setattr(rewrite, "KEPT_WORDS", 2_000)
    convert = rewrite.by_words(str.upper, "[ ]")
    tracemalloc.start()
    try:
        sizes = []
        for k in range(100):
            texts = [None, " ".join(f"ж{k}-{i}" for i in range(500)), "ж" * 100]
            assert convert(texts) == [None, texts[1].upper(), texts[2].upper()]
            sizes.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert max(sizes[10:]) < 1.5 * max(sizes[:10])
