"""Registered queries of the conversion engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maps as m
from .engine import Engine
from .functions import text as fn
from .functions.arrow import bounded_batches
from .operators.trie import CompiledTable
from .sources.catalog import parsed

#: Pairs of Latin and Cyrillic letters, to make Cyrillic texts of Latin ones.
LATIN, CYRILLIC = "abvhgdezyiklmnoprstufABVHGDEZYIKLMNOPRSTUF", "абвгґдезиіклмнопрстуфАБВГҐДЕЗИІКЛМНОПРСТУФ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in a session whose Arrow batches are bounded: it need not be the active one."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(*maps, **options) -> Engine:
    known = {x.system_code: x for x in maps}
    return Engine([known.get], **options)


def _register(name: str, build: Callable[[Column], Column], oracle: str | None, *, table: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).select(key, build(F.col(column)).alias("out"))

    QUERIES[name] = query
    if oracle:
        ORACLES[name] = f"SELECT {key}, {oracle} AS out FROM {table}"


def _rules(name: str, oracle: str | None, *rules: dict, source: Callable[[Column], Column] = lambda c: c, **options) -> None:
    """A query that runs a map of these rules over documents; source: what it does to the texts before."""
    more = {k: options.pop(k) for k in ("aliases", "functions", "dependencies") if k in options}
    others = options.pop("others", ())
    stages = options.pop("stages", {})
    _register(name, lambda c: engine(m.script_map(name, *rules, **more, **stages), *others).transliterate(source(c), name), oracle, **options)


def _tokens(pattern: str, pairs: dict[str, str], source: str = "text") -> str:
    keys = ", ".join(f"'{k}'" for k in pairs)
    values = ", ".join(f"'{v}'" for v in pairs.values())
    return f"array_to_string(list_transform(regexp_extract_all({source}, '(?s)({pattern}|.)'), lambda t: coalesce(map([{keys}], [{values}])[t], t)), '')"


_rules("sub_literal", "replace(text, 'th', 'þ')", m.sub("th", "þ"))
_rules("sub_any", "regexp_replace(text, 'the|and|of', '_', 'g')", m.sub(m.any_of("the", "and", "of"), "_"))
_rules("sub_delete", "replace(text, 'e', '')", m.sub("e"))
_rules("sub_escaped", "regexp_replace(text, '[.]', '$', 'g')", m.sub(".", "$"))
_rules("sub_before", "replace(text, 'an', 'aN')", m.sub("n", "N", before="a"))
_rules("sub_after", "replace(text, 'th', 'Th')", m.sub("t", "T", after="h"))
_rules("sub_not_before", "replace(replace(replace(text, 'he', chr(1)), 'e', 'E'), chr(1), 'he')", m.sub("e", "E", notBefore="h"))
_rules("sub_not_after", "replace(replace(replace(text, 'he', chr(1)), 'h', 'H'), chr(1), 'he')", m.sub("h", "H", notAfter="e"))
_rules("sub_capture_ref", r"regexp_replace(text, '([aeiou])n', 'n\1', 'g')", m.sub(m.group(m.captured(m.any_of(*"aeiou")), "n"), m.group("n", m.reference(1))))
_rules("sub_unset_group", r"regexp_replace(replace(text, 'an', chr(1)), 'en', 'enx', 'g').replace(chr(1), 'ax')", m.sub(m.group(m.any_of(m.captured("a"), "e"), "n"), m.group(m.reference(1), "x")))
_rules("sub_boundary", r"regexp_replace(text, '(^|[^\p{L}\p{M}])t', '\1T', 'g')", m.sub(m.group(m.alias("boundary"), "t"), "T"))
_rules("sub_non_word_boundary", r"regexp_replace(text, '([\p{L}\p{M}])q', '\1Q', 'g')", m.sub(m.group(m.alias("non_word_boundary"), "q"), "Q"))
_rules("sub_any_empty", "text", m.sub("e", "E", notBefore=m.any_of()))
_rules("sub_repeat", "regexp_replace(regexp_replace(text, 'e+', 'E', 'g'), 'l{2,3}', 'L', 'g')", m.sub(m.repeated("e", 2, None), "E"), m.sub(m.repeated("l", 2, 3), "L"))
# Alternatives of several lengths, over some 25 documents in one text: loops of tens of thousands of rounds.
def _joined(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """Documents by 25, one text each: part and text."""
    docs = _table(spark, sf_dir, "documents").filter("doc_id is not null")
    each = F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), "")
    return docs.groupBy(F.floor(F.col("doc_id") / 25).cast("long").alias("part")).agg(whole.alias("text")).select("part", text.alias("text"))


_JOINED = "SELECT CAST(floor(doc_id / 25) AS BIGINT) AS part, string_agg(coalesce(text, ''), '' ORDER BY doc_id, text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1"


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in pieces of some 4,000 characters, by the Ukrainian system of 2019."""
    e = engine(*m.ukrainian())
    return e.convert_long(_joined(spark, sf_dir, _cyrillic(F.col("text"))), "text", "bgnpcgn-ukr-Cyrl-Latn-2019", "part", to="out", piece=4096)


def sub_repeat_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by 25, one text each, as runs of a and bc between number signs."""
    joined = _joined(spark, sf_dir, F.regexp_replace("text", "[^a#]", "bc"))
    e = engine(m.script_map("loops", m.sub(m.group(m.captured("b"), m.repeated(m.any_of("a", "cb"), 1, None)), m.group("<", m.reference(1), ">"))))
    return joined.select("part", e.transliterate("text", "loops").alias("out"))


QUERIES["sub_repeat_alternatives"] = sub_repeat_alternatives
ORACLES["sub_repeat_alternatives"] = f"SELECT part, regexp_replace(regexp_replace(text, '[^a#]', 'bc', 'g'), 'b(a|cb)+', '<b>', 'g') AS out FROM ({_JOINED})"
_rules("sub_inline_function", "replace(text, 'the', 'THE')", m.sub("the", m.inline("upcase")))
_rules("alias_any_character", r"regexp_replace(text, '[^\n\r]', '.', 'g')", m.sub(m.alias("any_character"), "."))
_rules("alias_space", "replace(text, ' ', '_')", m.sub(m.alias("space"), "_"))
_rules("alias_whitespace", r"regexp_replace(text, '[ \t\n\r\f\v]+', '_', 'g')", m.sub(m.alias("whitespace"), "_"))
_rules("alias_none", "replace(text, 'a', '')", m.sub("a", m.alias("none")))
_rules("alias_word", r"regexp_replace(text, '\p{L}\p{N}_', '-', 'g')", m.sub(m.alias("word"), "-"))
# The alias is a letter, a digit and an underscore in a row: texts are given some.
_rules("alias_word_found", r"regexp_replace(replace(text, 'th', 'x7_'), '\p{L}\p{N}_', '-', 'g')", m.sub(m.alias("word"), "-"), source=lambda c: F.replace(c, F.lit("th"), F.lit("x7_")))
_rules("alias_not_word", r"regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')", m.sub(m.alias("not_word")))
_rules("alias_alpha", r"regexp_replace(text, '\p{L}', 'x', 'g')", m.sub(m.alias("alpha"), "x"))
_rules("alias_not_alpha", r"regexp_replace(text, '\P{L}', '', 'g')", m.sub(m.alias("not_alpha")))
_rules("alias_digit", r"regexp_replace(text, '\p{N}', '#', 'g')", m.sub(m.alias("digit"), "#"))
_rules("alias_not_digit", r"regexp_replace(text, '\P{N}', '', 'g')", m.sub(m.alias("not_digit")))
_rules("alias_line_start", "'>' || replace(text, chr(10), chr(10) || '>')", m.sub(m.alias("line_start"), ">"))
_rules("alias_string_start", "'>' || replace(text, chr(10), chr(10) || '>')", m.sub(m.alias("string_start"), ">"))
_rules("alias_line_end", "replace(text, chr(10), '<' || chr(10)) || '<'", m.sub(m.alias("line_end"), "<"))
_rules("alias_string_end", "replace(text, chr(10), '<' || chr(10)) || '<'", m.sub(m.alias("string_end"), "<"))
# Carriage returns end lines, too: texts are given some, alone and before line feeds.
_CR = "replace(replace(text, 'e', chr(13)), 'o', chr(13) || chr(10))"
_ENDS = {"source": lambda c: F.replace(F.replace(c, F.lit("e"), F.lit("\r")), F.lit("o"), F.lit("\r\n"))}
for _kind in ("line", "string"):
    _rules(f"alias_{_kind}_start_cr", f"'>' || regexp_replace({_CR}, '([\r\n])', '\\1>', 'g')", m.sub(m.alias(f"{_kind}_start"), ">"), **_ENDS)
    _rules(f"alias_{_kind}_end_cr", f"regexp_replace({_CR}, '([\r\n])', '<\\1', 'g') || '<'", m.sub(m.alias(f"{_kind}_end"), "<"), **_ENDS)
_rules("alias_own", "regexp_replace(text, '[aeiou]', '_', 'g')", m.sub(m.alias("vowel"), "_"), aliases={"vowel": m.any_of(*"aeiou")})
_rules("alias_of_dependency", "regexp_replace(text, '[aeiou]', '_', 'g')", m.sub(m.alias("vowel"), "_"), dependencies=("letters",), others=(m.script_map("letters", aliases={"vowel": m.any_of(*"aeiou")}),))
_rules("sequential", "replace(replace(text, 'a', 'b'), 'b', 'c')", m.sequential(m.sub("a", "b"), m.sub("b", "c")))
_rules("run_local", "replace(replace(text, 'a', 'X'), 'X', 'Y')", m.sub("a", "X"), m.run("second"), stages={"second": [m.sub("X", "Y")]})
_rules("run_remote", "replace(replace(text, 'a', 'X'), 'X', 'Y')", m.sub("a", "X"), m.run("main", "other"), others=(m.script_map("other", m.sub("X", "Y")),))

TRIE = {"the": "1", "th": "2", "and": "3", "an": "4", "e": "a", "a": "e", "in": ""}
_rules("parallel_table", _tokens("the|and|th|an|in|e|a", TRIE), m.parallel(**TRIE))
_rules("parallel_no_rescan", "translate(text, 'abc', 'bca')", m.parallel(a="b", b="c", c="a"))
_rules("parallel_dropped", "replace(text, 'b', 'B')", m.parallel(m.call("upcase"), m.sub("a", m.alias("none")), m.sub(m.alias("alpha"), "x"), b="B"))
_rules("parallel_expanded", _tokens("ab|ac|ae", {"ab": "X", "ac": "X", "ae": "X"}), m.parallel(m.sub(m.group("a", m.any_of("b", "c", "e")), "X")))
_rules("parallel_constrained", "replace(replace(replace(text, 'th', 'T'), 'Te', 'TEE'), 'na', 'nA')", m.parallel(m.sub("a", "A", before="n"), m.sub("e", "EE", before="T"), m.sub("th", "T")))
#: 182 pairs of letters: far more rules with context than one expression can nest.
MANY = [(a, b) for a in "aeioudlnrstmhc" for b in "aeioudlnrstmhc" if a != b]


def _many_oracle() -> str:
    out = "text"
    for a, b in MANY:
        out = f"replace({out}, '{a}{b}', '{a}{b.upper()}')"
    return out


_rules("sub_many_constrained", _many_oracle(), *[m.sub(b, b.upper(), before=a) for a, b in MANY])
_rules("german_umlauts", "replace(replace(replace(replace(replace(replace(text, 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')", m.parallel(**m.GERMAN))
_rules("funcall_downcase", "lower(text)", m.call("downcase"))
_rules("funcall_upcase", "upper(replace(text, 'ß', 'SS'))", m.call("upcase"))
_rules("funcall_compose", "nfc_normalize(text)", m.call("decompose"), m.call("compose"))
# Letters that decompose into two: in both engines' results the marks stand alone.
_GONE = "èëàâäáãîïíìôöóòõûüúùñÿÀÂÄÁÃÇÉÈÊËÎÏÍÌÔÖÓÒÕÛÜÚÙÑ"
_rules("funcall_decompose", f"replace(replace(replace(translate(text, '{_GONE}', ''), 'é', 'e' || chr(769)), 'ê', 'e' || chr(770)), 'ç', 'c' || chr(807))", m.call("decompose"), source=lambda c: F.translate(c, _GONE, ""))
_WORD = "list_transform(string_split({0}, '{1}'), lambda w: upper(w[1:1]) || lower(w[2:]))"
_rules("funcall_title_case", f"array_to_string({_WORD.format('p_name', ' ')}, ' ')", m.call("title_case"), table="part", key="p_partkey", column="p_name")
_rules("funcall_title_case_separator", f"array_to_string({_WORD.format('c_name', '#')}, '#')", m.call("title_case", wordSeparator="#"), table="customer", key="c_custkey", column="c_name")
_rules("funcall_separate", "array_to_string(string_split(text, ''), '-')", m.call("separate", separator="-"))
_register("regexp_escape", fn.regexp_escape, r"regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')")
_register("parallel_replace_function", lambda c: fn.parallel_replace(c, [("ab", "x"), ("a", "y"), ("a", "z")]), _tokens("ab|a", {"ab": "x", "a": "z"}))
_register("parallel_replace_arrow", lambda c: fn.parallel_replace(c, TRIE, "arrow"), _tokens("the|and|th|an|in|e|a", TRIE))
_LOW = "abcdefghijklmnopqrstuvwxyz"
#: 36,504 keys: words of four letters with th, all of three, all of two, by what they become.
LARGE = {f"th{a}{b}": f"TH{a}{b}".upper() for a in _LOW for b in _LOW} | {f"{x}{b}{c}": f"{c}{b}{x}" for x in _LOW + _LOW.upper() for b in _LOW for c in _LOW} | {a + b: f"={a}{b}" for a in _LOW for b in _LOW}
_LARGE_VALUE = "CASE WHEN len(t) = 4 THEN upper(t) WHEN len(t) = 3 THEN reverse(t) WHEN len(t) = 2 THEN '=' || t ELSE t END"
_register("parallel_large_table", lambda c: CompiledTable(LARGE).column(c), f"array_to_string(list_transform(regexp_extract_all(text, '(?s)(th[a-z]{{2}}|[A-Za-z][a-z]{{2}}|[a-z]{{2}}|.)'), lambda t: {_LARGE_VALUE}), '')")
_register("parallel_single_pass", lambda c: fn.parallel_single_pass(c, {"a": "1", "in": "2"}, [("an(?=d)", "3"), ("in", "4")]), "replace(replace(replace(replace(replace(text, 'and', chr(1)), 'a', '1'), 'in', '2'), chr(1), '3d'), chr(2), '')")
_register("levenshtein", lambda c: fn.levenshtein(c, F.reverse(c)), "CAST(levenshtein(p_name, reverse(p_name)) AS INTEGER)", table="part", key="p_partkey", column="p_name")
# Characters beyond U+FFFF are two units: each "a" put in place of one costs two edits. Of names without "a" or "e", both sides are equal.
_register("levenshtein_utf16", lambda c: fn.levenshtein(F.replace(c, F.lit("a"), F.lit("😀")), F.replace(c, F.lit("a"), F.lit("")), utf16=True), "CAST(2 * (len(p_name) - len(replace(p_name, 'a', ''))) AS INTEGER)", table="part", key="p_partkey", column="p_name")
_register("glob_match", lambda c: fn.glob_matches(c, "*a*e*"), "coalesce(p_name LIKE '%a%e%', false)", table="part", key="p_partkey", column="p_name")


def _cyrillic(c: Column) -> Column:
    return F.translate(c, LATIN, CYRILLIC)


def ukrainian_2019(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents in Cyrillic letters, romanised by the system of 2019 through its chain of three others."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", engine(*m.ukrainian()).transliterate(_cyrillic(F.col("text")), "bgnpcgn-ukr-Cyrl-Latn-2019").alias("out"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ukrainian_2019(spark, sf_dir)


QUERIES["ukrainian_2019"] = ukrainian_2019


_APOSTROPHES = "'’"


def _literal(x) -> str:
    """A value as a DuckDB literal."""
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return f"[{', '.join(map(_literal, x))}]"
    if isinstance(x, dict):
        return f"map([{', '.join(map(_literal, x))}], [{', '.join(map(_literal, x.values()))}])"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _ukrainian_oracle(column: str = "text", apostrophes: str = _APOSTROPHES) -> str:
    # The texts hold neither the letters of the rules at word starts nor soft signs; З before г is the one rule with context that applies.
    low = m.UKRAINIAN
    table = {k.upper(): v[:1].upper() + v[1:] for k, v in low.items()} | low
    out = f"translate({column}, '{LATIN}', '{CYRILLIC}')"
    for x in apostrophes:
        out = f"replace({out}, {_literal(x)}, '')"
    for a, b in (("ЗГ", "ЗGh"), ("зГ", "зGh"), ("Зг", "Зgh"), ("зг", "зgh")):
        out = f"replace({out}, '{a}', '{b}')"
    for k, v in table.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


QUERIES["long_texts"] = long_texts
ORACLES["long_texts"] = f"SELECT part, {_ukrainian_oracle()} AS out FROM ({_JOINED})"
ORACLES["ukrainian_2019"] = f"SELECT doc_id, {_ukrainian_oracle()} AS out FROM documents"

CANDIDATES = [
    m.script_map("low-all", m.call("downcase")),
    m.script_map("low-vowels", m.parallel(A="a", E="e", I="i", O="o", U="u")),
    m.script_map("up-none", m.sub("x", "y")),
]
_CONVERTED = {"low-all": "lower(p_name)", "low-vowels": "translate(p_name, 'AEIOU', 'aeiou')", "up-none": "replace(p_name, 'x', 'y')"}


def _detected(spark: SparkSession, sf_dir: str, pattern: str | None = None, best: int | None = None) -> DataFrame:
    """Names of parts in upper case as the source, with capitals at the start of words as what was seen."""
    e = engine(*CANDIDATES)
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"), F.initcap("p_name").alias("seen"))
    return e.detect_rows(parts, "name", "seen", "p_partkey", candidates=[x.system_code for x in CANDIDATES], map_pattern=pattern, best=best)


def _detected_oracle(pattern: str | None = None) -> str:
    seen = "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
    rows = " UNION ALL ".join(f"SELECT p_partkey, {i} AS pos, '{k}' AS map_name, levenshtein({x}, seen) AS d FROM names" for i, (k, x) in enumerate(_CONVERTED.items()) if not pattern or k.startswith(pattern.rstrip("*")))
    return f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY d, pos) AS INTEGER) AS rank, map_name, CAST(d AS INTEGER) AS distance FROM (WITH names AS (SELECT p_partkey, upper(p_name) AS p_name, {seen} AS seen FROM part) {rows})"


def detect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, best=1)


def map_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).groupBy("map_name").agg(F.count("*").alias("n"), F.sum((F.col("rank") == 1).cast("long")).alias("n_best"), F.avg("distance").alias("mean_distance"))


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four Ukrainian maps, which run each other, over names of parts in Cyrillic letters with apostrophes for blanks."""
    e = engine(*m.ukrainian())
    parts = _table(spark, sf_dir, "part").select("p_partkey", _cyrillic(F.replace("p_name", F.lit(" "), F.lit("'"))).alias("name"), "p_name")
    return e.detect_rows(parts, "name", "p_name", "p_partkey", candidates=[x.system_code for x in m.ukrainian()])


def _shared_oracle() -> str:
    name = "replace(p_name, ' ', chr(39))"
    rows = " UNION ALL ".join(f"SELECT p_partkey, {i} AS pos, '{x.system_code}' AS map_name, levenshtein({_ukrainian_oracle(name, '’' if '1996' in x.system_code else _APOSTROPHES)}, p_name) AS d FROM part" for i, x in enumerate(m.ukrainian()))
    return f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY d, pos) AS INTEGER) AS rank, map_name, CAST(d AS INTEGER) AS distance FROM ({rows})"


QUERIES |= {"detect_shared": _shared, "detect_top": lambda s, d: _detected(s, d, best=2)}
ORACLES |= {"detect_shared": _shared_oracle(), "detect_top": f"SELECT * FROM ({_detected_oracle()}) WHERE rank <= 2"}
QUERIES |= {"detect_rank": _detected, "detect_glob": lambda s, d: _detected(s, d, "low-*"), "detect_best": detect_best, "map_accuracy": map_accuracy}
ORACLES |= {
    "detect_rank": _detected_oracle(),
    "detect_glob": _detected_oracle("low-*"),
    "detect_best": f"SELECT * FROM ({_detected_oracle()}) WHERE rank = 1",
    "map_accuracy": f"SELECT map_name, count(*) AS n, CAST(sum(CAST(rank = 1 AS INTEGER)) AS BIGINT) AS n_best, avg(distance) AS mean_distance FROM ({_detected_oracle()}) GROUP BY map_name",
}


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each part, as JSON: a rule of each kind, with the part's own strings."""
    text = lambda x: F.struct(F.lit("string").alias("kind"), (F.lit(x) if isinstance(x, str) else x).alias("value"))
    rule = lambda kind, **own: F.to_json(F.struct(F.lit(kind).alias("kind"), *[x.alias(k) for k, x in own.items()]))
    own = rule("sub", **{"from": text(F.col("p_brand")), "to": text(F.col("p_type")), "before": text("x"), "notAfter": text("y")})
    call = rule("funcall", name=F.lit("title_case"), kwargs=F.struct(F.lit("_").alias("wordSeparator")))
    run = rule("run", stage=F.lit("main"), docName=F.concat(F.lit("part-"), (F.col("p_partkey") + 1).cast("string")))
    inline = F.to_json(F.struct(F.lit("sub").alias("kind"), text(F.col("p_name")).alias("from"), F.struct(F.lit("funcall_inline").alias("kind"), F.lit("upcase").alias("name")).alias("to")))
    nested = F.format_string('{"kind": "parallel", "rules": [%s, {"kind": "sequential", "rules": [%s]}]}', inline, call)
    code = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    spec = F.format_string(
        '{"schemaVersion": 1, "systemCode": "%s", "dependencies": ["part-%d", "size-%d"], "stages": [{"name": "main", "rules": [%s, %s]}, {"name": "second", "rules": [%s]}], "aliases": {"brand": %s}}',
        code, F.col("p_partkey") + 1, F.col("p_size"), own, nested, run, F.to_json(text(F.col("p_brand"))),
    )
    # A small file is one task however many rows it has: the parts are dealt out before they become much longer maps.
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(2 * spark.sparkContext.defaultParallelism)
    return parts.select(code.alias("path"), spec.alias("spec"))


def _catalog_oracle() -> str:
    text = lambda x: f"""'{{"kind": "string", "value": "' || {x} || '"}}'"""
    names = ("from_json", "to_json", "before_json", "after_json", "not_before_json", "not_after_json", "run_stage", "run_doc", "fn_name", "kwargs_json")
    call = {"fn_name": "'title_case'", "kwargs_json": """'{"wordSeparator": "_"}'"""}
    rows = [
        ("main", [0], "sub", {"from_json": text("p_brand"), "to_json": text("p_type"), "before_json": text("'x'"), "not_after_json": text("'y'")}),
        ("main", [1], "parallel", {}),
        ("main", [1, 0], "sub", {"from_json": text("p_name"), "to_json": """'{"kind": "funcall_inline", "name": "upcase"}'"""}),
        ("main", [1, 1], "sequential", {}),
        ("main", [1, 1, 0], "funcall", call),
        ("second", [0], "run", {"run_stage": "'main'", "run_doc": "'part-' || (p_partkey + 1)"}),
    ]
    each = [f"SELECT 'part-' || p_partkey AS system_code, '{stage}' AS stage, CAST({path} AS INTEGER[]) AS path, '{kind}' AS kind, {', '.join(f'CAST({own.get(k, _NULL)} AS VARCHAR) AS {k}' for k in names)} FROM part" for stage, path, kind, own in rows]
    return " UNION ALL ".join(each)


_NULL = "NULL"
QUERIES |= {
    "catalog_rules": lambda spark, sf_dir: parsed(_specs(spark, sf_dir), "rules"),
    "catalog_maps": lambda spark, sf_dir: parsed(_specs(spark, sf_dir), "maps").select("system_code", "schema_version", F.array_join("dependencies", ",").alias("dependencies")),
    "catalog_aliases": lambda spark, sf_dir: parsed(_specs(spark, sf_dir), "aliases"),
    "catalog_dependencies": lambda spark, sf_dir: parsed(_specs(spark, sf_dir), "dependencies"),
    "catalog_bundled": lambda spark, sf_dir: parsed(_specs(spark, sf_dir), "rules").groupBy("stage", "kind").agg(F.count("*").alias("n"), F.countDistinct("from_json").alias("n_sources")),
}
ORACLES |= {
    "catalog_rules": _catalog_oracle(),
    "catalog_maps": "SELECT 'part-' || p_partkey AS system_code, CAST(1 AS INTEGER) AS schema_version, 'part-' || (p_partkey + 1) || ',size-' || p_size AS dependencies FROM part",
    "catalog_aliases": """SELECT 'part-' || p_partkey AS system_code, 'brand' AS alias, '{"kind": "string", "value": "' || p_brand || '"}' AS item_json FROM part""",
    "catalog_dependencies": "SELECT 'part-' || p_partkey AS system_code, unnest(['part-' || (p_partkey + 1), 'size-' || p_size]) AS dependency, CAST(unnest([0, 1]) AS INTEGER) AS position FROM part",
    "catalog_bundled": f"SELECT stage, kind, count(*) AS n, count(DISTINCT from_json) AS n_sources FROM ({_catalog_oracle()}) GROUP BY stage, kind",
}
