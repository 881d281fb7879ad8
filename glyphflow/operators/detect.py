"""Which map turns an input into an output best: edit distances of each candidate, ranked.

Candidates often run each other: what they share is computed once. Equal first steps are one
column, from which the others go on; equal last steps over different inputs are one
conversion by words, in which the inputs' words, nearly all the same, are converted once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import bounded_batches, slices, strings
from ..functions.text import distance, glob_regex, levenshtein, utf16_units
from ..plans.compiler import Step
from ..plans.cuts import separators
from .rewrite import WORDS, apply_steps, by_words, cost, python_steps

RESULT = "array<struct<map_name:string,distance:int>>"


def chosen(codes: list[str], pattern: str | None) -> list[str]:
    """Candidates that fit a glob pattern, in their order."""
    return [c for c in codes if re.match(glob_regex(pattern), c)] if pattern else list(codes)


@dataclass
class Part:
    """Steps in a row that the same candidates share, after those of its parent."""

    steps: list[Step] = field(default_factory=list)
    parent: Part | None = None
    below: dict[str, Part] = field(default_factory=dict)
    #: Candidates that end here.
    names: list[str] = field(default_factory=list)


def parts(candidates: list[tuple[str, list[Step]]]) -> list[Part]:
    """The candidates' steps as a tree, parents first: candidates with equal first steps share a part."""
    root = Part()
    for name, steps in candidates:
        at = root
        for s in steps:
            at = at.below.setdefault(repr(s), Part([s], at))
        at.names.append(name)
    out, open_ = [], [root]
    while open_:
        p = open_.pop()
        # A part that one other alone goes on from, and where nothing ends, is one with it.
        while p is not root and len(p.below) == 1 and not p.names:
            (only,) = p.below.values()
            p.steps, p.below, p.names = p.steps + only.steps, only.below, only.names
        for x in p.below.values():
            x.parent = p
        out.append(p)
        open_ += p.below.values()
    return out


def common_end(first: list[list[Step]]) -> int:
    """How many last steps all have in common."""
    turned = [list(map(repr, x))[::-1] for x in first]
    return next((i for i, x in enumerate(zip(*turned, strict=False)) if len(set(x)) > 1), min(map(len, turned)))


def converted_columns(df: DataFrame, source: Column, candidates: list[tuple[str, list[Step]]], strategy: str = "auto") -> tuple[DataFrame, list[tuple[str, Column]]]:
    """df with helper columns (named __shared...), and each candidate's conversion of source as a Column of it."""
    tree = parts(candidates)
    root = tree[0]
    df = df.withColumn("__shared", source)
    made = {id(root): "__shared"}
    # Parts that start from the source and end alike.
    by_end: dict[str, list[Part]] = {}
    for p in tree:
        if p.parent is root:
            by_end.setdefault(repr(p.steps[-1]), []).append(p)
    for alike in by_end.values():
        n = common_end([p.steps for p in alike])
        end = alike[0].steps[len(alike[0].steps) - n :]
        between = separators(end) if strategy == "auto" and len(alike) > 1 and len(alike) * sum(map(cost, end)) >= WORDS else None
        if between:
            heads = [apply_steps(F.col("__shared"), p.steps[: len(p.steps) - n], strategy) for p in alike]
            names = [f"__shared{len(made) + i}" for i in range(len(alike))]
            df = df.withColumns({f"{x}_in": h for x, h in zip(names, heads, strict=True)})
            df = df.withColumn(f"{names[0]}_all", words_of_many([F.col(f"{x}_in") for x in names], end, between))
            df = df.withColumns({x: F.col(f"{names[0]}_all.x{i}") for i, x in enumerate(names)})
            made |= {id(p): x for p, x in zip(alike, names, strict=True)}
    for p in tree[1:]:
        if id(p) not in made:
            name = f"__shared{len(made)}"
            df = df.withColumn(name, apply_steps(F.col(made[id(p.parent)]), p.steps, strategy))
            made[id(p)] = name
    by_name = {x: made[id(p)] for p in tree for x in p.names}
    return df, [(name, F.col(by_name[name])) for name, _ in candidates]


def words_of_many(inputs: list[Column], steps: list[Step], between: str) -> Column:
    """struct<x0, x1, ...>: each input converted by words, in one Arrow UDF that keeps the words of all."""
    bounded_batches()
    names = [f"x{i}" for i in range(len(inputs))]

    @F.arrow_udf(", ".join(f"{x} string" for x in names))
    def converted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        convert = by_words(python_steps(steps), between)
        for columns in batches:
            for own in slices(*columns):
                yield pa.StructArray.from_arrays([strings(convert(c.to_pylist())) for c in own], names)

    return converted(*inputs)


def best(converted: list[tuple[str, Column]], output: Column, k: int, *, utf16: bool = False) -> Column:
    """The first k of ranked(): a candidate's distance is only followed up to the k-th best before it."""
    if not converted or k < 1:
        return F.array().cast(RESULT)
    form = utf16_units if utf16 else lambda c: c
    seen = form(output)
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("map_name"), form(c).alias("c")) for i, (name, c) in enumerate(converted)])

    def merge(acc: Column, x: Column) -> Column:
        # No distance is above the longer one's length; of equal ones the earlier candidate stays.
        most = F.when(F.size(acc) < k, F.greatest(F.length(x["c"]), F.length(seen))).otherwise(F.get(acc, F.lit(k - 1))["distance"] - 1)
        d = F.call_function("levenshtein", x["c"], seen, most)
        with_it = lambda y: F.slice(F.array_sort(F.array_append(acc, F.struct(y.alias("distance"), x["at"].alias("at"), x["map_name"].alias("map_name")))), 1, k)
        return F.transform(F.array(d), lambda y: F.when(y < 0, acc).otherwise(with_it(y)))[0]

    found = F.aggregate(each, F.array().cast("array<struct<distance:int,at:int,map_name:string>>"), merge)
    return F.transform(found, lambda x: F.struct(x["map_name"].alias("map_name"), x["distance"].alias("distance")))


def ranked(converted: list[tuple[str, Column]], output: Column, *, utf16: bool = False) -> Column:
    """array<struct<map_name, distance>> by distance, then by the candidates' order."""
    if not converted:
        return F.array().cast(RESULT)
    each = [F.struct(levenshtein(c, output, utf16=utf16).alias("distance"), F.lit(i).alias("at"), F.lit(name).alias("map_name")) for i, (name, c) in enumerate(converted)]
    return F.transform(F.array_sort(F.array(*each)), lambda x: F.struct(x["map_name"].alias("map_name"), x["distance"].alias("distance")))


def ranked_rows(df: DataFrame, result: Column, *keys: str) -> DataFrame:
    """A row for each candidate, with its rank."""
    return df.select(*keys, F.posexplode(result).alias("at", "x")).select(*keys, (F.col("at") + 1).alias("rank"), "x.map_name", "x.distance")


def ranked_strings(source: str | None, output: str | None, converters: list[tuple[str, Callable[[str], str]]], *, utf16: bool = False) -> list[dict]:
    """ranked() of two strings, without Spark; distances are null if one of them is."""
    if source is None or output is None:
        return [{"map_name": name, "distance": None} for name, _ in converters]
    each = sorted((distance(convert(source), output, utf16=utf16), i, name) for i, (name, convert) in enumerate(converters))
    return [{"map_name": name, "distance": d} for d, _, name in each]
