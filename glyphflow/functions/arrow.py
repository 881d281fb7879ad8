"""Texts through Arrow UDFs in parts that are bounded by their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about: Spark's own bound is 64 MB, which a worker holds several times, as strings of Python and what becomes of them.
BATCH_BYTES = 4 << 20
#: Bytes of text that a worker holds as strings of Python at once.
PART_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own. The setting stays, as Columns run later.

    What knows its DataFrame or session gives that one: it may be none that is active. Else the session is the thread's, or the
    process's first one. A Column may run in another: slices() bounds what is held as strings there, but not the batch itself.
    """
    if spark is None:
        try:
            spark = SparkSession.active()
        except PySparkRuntimeError:
            return
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def slices(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """A batch's columns of texts in runs of rows of about PART_BYTES, whatever bounds the batch; a longer text is a run of its own."""
    rows = len(columns[0])
    if sum(c.nbytes for c in columns) <= PART_BYTES:
        yield list(columns)
        return
    at = size = 0
    for i, own in enumerate(zip(*[pc.binary_length(c).fill_null(0).to_pylist() for c in columns], strict=True)):
        if i > at and size + sum(own) > PART_BYTES:
            yield [c.slice(at, i - at) for c in columns]
            at, size = i, 0
        size += sum(own)
    if at < rows:
        yield [c.slice(at) for c in columns]


def strings(texts: list[str | None]) -> pa.Array:
    return pa.array(texts, pa.string(), from_pandas=True)


def text_lists(c: Column, make: Callable[[], Callable[[list[str | None]], list[str | None]]]) -> Column:
    """A string column from lists of texts; make() gives a task its function of them."""
    bounded_batches()

    @F.arrow_udf("string")
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        convert = make()
        for batch in batches:
            for (own,) in slices(batch):
                yield strings(convert(own.to_pylist()))

    return converted(c)


def texts(c: Column, make: Callable[[], Callable[[str], str | None]]) -> Column:
    """A string column from its texts, null from null; make() gives a task its function of a text."""

    def each() -> Callable[[list[str | None]], list[str | None]]:
        convert = make()
        return lambda xs: [x if x is None else convert(x) for x in xs]

    return text_lists(c, each)
