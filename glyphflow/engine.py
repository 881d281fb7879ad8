"""The engine: maps in, Columns out; and a default engine for the module-level functions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DependencyMissingError, MapNotFoundError, ScriptError, SystemConversionError
from .functions.arrow import bounded_batches
from .operators import detect as detection
from .operators.rewrite import apply_steps, python_steps
from .plans.compiler import Compiler, Step
from .plans.cuts import separators
from .plans.model import ScriptMap
from .sources.maps import MapLoader, Strategy


#: Characters of a long text's pieces.
PIECE = 1 << 20


class Engine:
    def __init__(self, strategies: Sequence[Strategy] = (), default_stage: str = "main", strategy: str = "auto"):
        self.loader = MapLoader(strategies)
        self.default_stage, self.strategy = default_stage, strategy

    def load_map(self, code: str) -> ScriptMap:
        """A map, with its direct dependencies loaded too."""
        found = self.loader.load(code)
        for dependency in found.dependencies:
            try:
                self.loader.load(dependency)
            except MapNotFoundError as e:
                raise DependencyMissingError(dependency) from e
        return found

    def loaded_maps(self) -> list[str]:
        return self.loader.loaded_maps()

    def steps(self, code: str, stage: str | None = None) -> list[Step]:
        found = self.load_map(code)
        return Compiler(self.loader).stage(found, stage or self.default_stage)

    def transliterate(self, column: Column | str, code: str, stage: str | None = None) -> Column:
        """A string column converted by a map; null stays null. Works on batch and streaming DataFrames."""
        try:
            return apply_steps(F.col(column) if isinstance(column, str) else column, self.steps(code, stage), self.strategy)
        except ScriptError:
            raise
        except Exception as e:
            raise SystemConversionError(f"Transliteration failed for {code}: {e}", cause=e) from e

    def convert(self, text: str, code: str, stage: str | None = None) -> str:
        """One string, without Spark."""
        try:
            return python_steps(self.steps(code, stage))(text)
        except ScriptError:
            raise
        except Exception as e:
            raise SystemConversionError(f"Transliteration failed for {code}: {e}", cause=e) from e

    def _candidates(self, map_pattern: str | None, candidates: Sequence[str] | None) -> list[tuple[str, list[Step]]]:
        """Codes and steps of candidates, else of the maps loaded so far; those that can't be compiled are left out."""
        out = []
        for code in detection.chosen(list(self.loaded_maps() if candidates is None else candidates), map_pattern):
            try:
                out.append((code, Compiler(self.loader).stage(self.loader.load(code), "main")))
            except ScriptError:
                continue
        return out

    def detect(self, source: Column | str, output: Column | str, *, map_pattern: str | None = None, candidates: Sequence[str] | None = None, utf16: bool = False, best: int | None = None) -> Column:
        """array<struct<map_name, distance>>: candidates (else the maps loaded so far) by how near they bring source to output. Candidates that can't be compiled are left out.

        best: only so many, whose distances are all that is computed to the end. detect_rows() computes what candidates share once.
        """
        source, output = (F.col(x) if isinstance(x, str) else x for x in (source, output))
        converted = [(code, apply_steps(source, steps, self.strategy)) for code, steps in self._candidates(map_pattern, candidates)]
        return detection.ranked(converted, output, utf16=utf16) if best is None else detection.best(converted, output, best, utf16=utf16)

    def detect_rows(self, df: DataFrame, source: str, output: str, *keys: str, map_pattern: str | None = None, candidates: Sequence[str] | None = None, utf16: bool = False, best: int | None = None) -> DataFrame:
        """A row for each row of df and candidate (or each of the best), with its rank. Steps that candidates share are computed once."""
        bounded_batches(df.sparkSession)
        wide, converted = detection.converted_columns(df, F.col(source), self._candidates(map_pattern, candidates), self.strategy)
        seen = F.col(output)
        result = detection.ranked(converted, seen, utf16=utf16) if best is None else detection.best(converted, seen, best, utf16=utf16)
        return detection.ranked_rows(wide, result, *keys)

    def convert_long(self, df: DataFrame, column: str, code: str, *keys: str, to: str = "converted", piece: int = PIECE, stage: str | None = None) -> DataFrame:
        """df's keys with a converted column, as transliterate() gives it, where a text may be too long for one task.

        Texts are cut into pieces of about `piece` characters where the map can't tell (see plans/cuts.py), the pieces are dealt over
        tasks, converted and joined again. Maps whose rules may see past any character take each text whole. Null stays null; a
        text without a place to cut stays whole.
        """
        bounded_batches(df.sparkSession)
        steps = self.steps(code, stage)
        between = separators(steps)
        if between is None:
            return df.select(*keys, apply_steps(F.col(column), steps, self.strategy).alias(to))
        # So many characters, then to the end of the word, and what stands behind it.
        cut = F.regexp_extract_all(F.col("__text"), F.lit(f"(?s).{{1,{piece}}}[^{between[1:-1]}]*+[{between[1:-1]}]?+"), F.lit(0))
        rows = df.select(F.struct(*keys).alias("__keys"), F.col(column).alias("__text")).withColumn("__row", F.monotonically_increasing_id())
        pieces = rows.select("__row", "__keys", F.col("__text").isNull().alias("__null"), F.posexplode_outer(cut).alias("__at", "__piece"))
        done = pieces.repartition("__row", "__at").withColumn("__piece", apply_steps(F.col("__piece"), steps, self.strategy))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__piece"))), lambda x: F.coalesce(x["__piece"], F.lit(""))), "")
        joined = done.groupBy("__row").agg(F.first("__keys").alias("__keys"), F.first("__null").alias("__null"), whole.alias("__text"))
        return joined.select(*[F.col(f"__keys.{k}").alias(k) for k in keys], F.when(~F.col("__null"), F.col("__text")).alias(to))

    def convert_rows(self, df: DataFrame, column: str, code: str, *keys: str, to: str = "converted", error: str = "error", stage: str | None = None) -> DataFrame:
        """df's keys with a converted column and an error column: a row that a step fails on has a null and the message, and the others go on.

        One Arrow UDF over the whole map, so that a function which raises for one text doesn't end the query.
        """
        bounded_batches(df.sparkSession)
        convert = python_steps(self.steps(code, stage))

        @F.pandas_udf("converted string, error string")
        def guarded(s: pd.Series) -> pd.DataFrame:
            out = []
            for x in s:
                try:
                    out.append((x if x is None else convert(x), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"Transliteration failed for {code}: {e}"))
            return pd.DataFrame(out, columns=["converted", "error"], dtype=object)

        return df.select(*keys, guarded(F.col(column)).alias("__x")).select(*keys, F.col("__x.converted").alias(to), F.col("__x.error").alias(error))

    def register_sql(self, spark: SparkSession, name: str, code: str, stage: str | None = None) -> None:
        """A SQL function name(text), as an Arrow UDF over the same steps; in DataFrames transliterate() stays in the JVM."""
        bounded_batches(spark)
        convert = python_steps(self.steps(code, stage))

        @F.pandas_udf("string")
        def own(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x if x is None else convert(x))

        spark.udf.register(name, own)

    def register_detect_sql(self, spark: SparkSession, name: str, *, map_pattern: str | None = None, candidates: Sequence[str] | None = None, utf16: bool = False) -> None:
        """A SQL function name(source, output) that returns what detect() does, as an Arrow UDF."""
        bounded_batches(spark)
        known = [(code, python_steps(steps)) for code, steps in self._candidates(map_pattern, candidates)]

        @F.pandas_udf(detection.RESULT)
        def own(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([detection.ranked_strings(x, y, known, utf16=utf16) for x, y in zip(a, b, strict=True)], dtype=object)

        spark.udf.register(name, own)


_default: Engine | None = None


def _engine() -> Engine:
    global _default
    if _default is None:
        _default = Engine()
    return _default


def configure(strategies: Sequence[Strategy] = (), default_stage: str = "main") -> Engine:
    global _default
    _default = Engine(strategies, default_stage)
    return _default


def reset() -> None:
    global _default
    _default = None


def load_map(code: str) -> ScriptMap:
    return _engine().load_map(code)


def transliterate(column: Column | str, code: str, stage: str | None = None) -> Column:
    return _engine().transliterate(column, code, stage)


def convert(text: str, code: str, stage: str | None = None) -> str:
    """One string, without Spark."""
    return _engine().convert(text, code, stage)


def detect(source: Column | str, output: Column | str, **options) -> Column:
    return _engine().detect(source, output, **options)
