"""Text in and out: a file is one string, as the command line has it; or a row a line for large inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_text(spark: SparkSession, path: str, *, whole: bool = True) -> DataFrame:
    """text: a row a file, or a row a line (the same result for maps that don't look across lines, and splittable)."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "text")


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """A line for each row: the text and one line end."""
    df.select(column).write.text(path)
