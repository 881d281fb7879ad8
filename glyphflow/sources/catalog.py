"""The rule corpus as DataFrames: maps, rules, aliases and dependencies, of map files in any file system or of a column of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import ScriptMap, normalise_map

MAPS = "system_code string, schema_version int, dependencies array<string>, metadata map<string,string>, authority_id string, language string, source_script string, destination_script string, name string"
RULES = "system_code string, stage string, path array<int>, kind string, from_json string, to_json string, before_json string, after_json string, not_before_json string, not_after_json string, run_stage string, run_doc string, fn_name string, kwargs_json string"
ALIASES = "system_code string, alias string, item_json string"
DEPENDENCIES = "system_code string, dependency string, position int"
ERRORS = "path string, error string"


#: Made once: json.dumps makes an encoder at each call that asks for its own options.
_ENCODE = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def _json(x) -> str | None:
    return None if x is None else _ENCODE(x)


def _map_row(m: ScriptMap) -> tuple:
    meta = {k: v if isinstance(v, str) else _json(v) for k, v in (m.metadata or {}).items()}
    return (m.system_code, m.schema_version, m.dependencies, meta, *[meta.get(k) for k in ("authority_id", "language", "source_script", "destination_script", "name")])


def _walk(code: str, stage: str, rules: list[dict], path: list[int]) -> Iterator[tuple]:
    for i, r in enumerate(rules):
        at = [*path, i]
        yield (code, stage, at, r["kind"], *[_json(r.get(k)) for k in ("from", "to", "before", "after", "notBefore", "notAfter")], r.get("stage"), r.get("docName"), r.get("name"), _json(r.get("kwargs")))
        yield from _walk(code, stage, r.get("rules", []), at)


#: Of each table, its columns and a map's rows.
TABLES = {
    "maps": (MAPS, lambda m: [_map_row(m)]),
    "rules": (RULES, lambda m: [row for s in m.stages for row in _walk(m.system_code, s["name"], s.get("rules", []), [])]),
    "aliases": (ALIASES, lambda m: [(m.system_code, k, _json(x)) for k, x in m.aliases.items()]),
    "dependencies": (DEPENDENCIES, lambda m: [(m.system_code, d, i) for i, d in enumerate(m.dependencies)]),
}


def _table(spark: SparkSession, maps: Iterable[ScriptMap], name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame([r for m in maps for r in rows(m)], schema)


def maps_table(spark: SparkSession, maps: Iterable[ScriptMap]) -> DataFrame:
    return _table(spark, maps, "maps")


def rules_table(spark: SparkSession, maps: Iterable[ScriptMap]) -> DataFrame:
    return _table(spark, maps, "rules")


def aliases_table(spark: SparkSession, maps: Iterable[ScriptMap]) -> DataFrame:
    return _table(spark, maps, "aliases")


def dependencies_table(spark: SparkSession, maps: Iterable[ScriptMap]) -> DataFrame:
    return _table(spark, maps, "dependencies")


def map_files(spark: SparkSession, path: str) -> DataFrame:
    """path and spec (the JSON) of map files of any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("spec"))


def parsed(specs: DataFrame, name: str) -> DataFrame:
    """One of TABLES of specs(spec), parsed where they lie. What is no map has no rows here; errors() names it."""
    schema, rows = TABLES[name]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["spec"]:
                try:
                    out += rows(normalise_map(json.loads(x)))
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(out, columns=names, dtype=object)

    return specs.select("spec").mapInPandas(run, schema)


def errors(specs: DataFrame) -> DataFrame:
    """path and error of specs(path, spec) that are no maps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, x in zip(b["path"], b["spec"], strict=True):
                try:
                    for _, rows in TABLES.values():
                        rows(normalise_map(json.loads(x)))
                except Exception as e:  # noqa: BLE001
                    out.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "error"], dtype=object)

    return specs.select("path", "spec").mapInPandas(run, ERRORS)
