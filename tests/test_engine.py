import functools
import json

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphflow import cli, engine as api, maps as m
from glyphflow.engine import Engine
from glyphflow.errors import DependencyMissingError, MapLogicError, MapNotFoundError, SystemConversionError
from glyphflow.functions import text as fn
from glyphflow.operators.rewrite import apply_steps, is_native, java_template, python_steps, table_column
from glyphflow.plans.compiler import Call, Compiler, Delete, Table
from glyphflow.plans.patterns import regexp_escape
from glyphflow.queries import QUERIES, engine
from glyphflow.sources.maps import MapLoader, bundled_strategy, folder_strategy, relative_folder_strategy

SPEC = {"schemaVersion": 1, "systemCode": "own", "dependencies": [], "stages": [{"kind": "stage", "name": "main", "rules": [m.sub("a", "b")]}], "aliases": {"x": m.text("y")}, "functions": {"gone": {}}}


def converted(spark, steps, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in df.select("i", apply_steps(F.col("text"), steps).alias("out")).orderBy("i").collect()]


def both(spark, texts, *rules, **options):
    """Results as a Column; the same from the function of one string."""
    e = engine(m.script_map("t", *rules, **options))
    out = converted(spark, e.steps("t"), texts)
    assert [None if x is None else e.convert(x, "t") for x in texts] == out
    return out


GOLDEN_INPUTS = ["Hello World", "Антон", "Михаил Тимофеевич", "Tschüß!", "привет мир", "Київ", "ኢትዮጵያ", "தமிழ்"]
# What the inputs become; those not named stay as they are.
GOLDEN = {
    "bgnpcgn-ukr-Cyrl-Latn-2019": {"Антон": "Anton", "Михаил Тимофеевич": "Mykhayl Tymofeevych", "привет мир": "pryvet myr", "Київ": "Kyiv"},
    "un-tam-Taml-Latn-1972": {"தமிழ்": "tamil̮"},
}


@pytest.mark.parametrize("code", GOLDEN)
def test_golden(spark, code):
    e = Engine([bundled_strategy({}), m.bundled().get])
    expected = [GOLDEN[code].get(x, x) for x in GOLDEN_INPUTS]
    assert converted(spark, e.steps(code), [*GOLDEN_INPUTS, None]) == [*expected, None]
    assert [e.convert(x, code) for x in GOLDEN_INPUTS] == expected
    df = e.convert_rows(spark.createDataFrame(list(enumerate(GOLDEN_INPUTS)), "i int, text string"), "text", code, "i")
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(i, x, None) for i, x in enumerate(expected)]


def test_ukrainian(spark):
    e = engine(*m.ukrainian())
    texts = {"Згорани": "Zghorany", "Щука": "Shchuka", "": ""}
    assert converted(spark, e.steps("bgnpcgn-ukr-Cyrl-Latn-2019"), [*texts, None]) == [*texts.values(), None]
    assert e.loaded_maps()[0] == "bgnpcgn-ukr-Cyrl-Latn-2019"


def test_edge_inputs(spark):
    """Long, astral, blank and unmatched texts: as a Column and as a string."""
    e = engine(*m.ukrainian(), m.tamil())
    texts = ["", "A", "привет " * 1500, "😀🚀", " \t\n  ", "Антон\nМихаил\t\tпривет", "!@#$%^&*()", "\x00", "привет мир\r\n"]
    for code in GOLDEN:
        out = converted(spark, e.steps(code), texts)
        assert out == [e.convert(x, code) for x in texts] == converted(spark, e.steps(code), texts)
        assert out[0] == "" and out[1] == "A" and out[3] == "😀🚀" and out[4] == " \t\n  "
    assert e.convert("привет " * 1500, "bgnpcgn-ukr-Cyrl-Latn-2019") == "pryvet " * 1500


@pytest.mark.parametrize("n", [23, 50, 150, 500])
def test_many_rules(spark, n):
    """Rules beyond what one expression can nest: constrained ones, plain ones, and both around a function that builds a Column."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [(x, y) for x in letters for y in letters if x != y][:n]
    texts = ["the quick brown fox jumps over the lazy dog", letters, letters[::-1], "", None, "Ab ba aB"]
    expected = []
    for t in texts:
        for x, y in pairs if t else ():
            t = t.replace(x + y, x + y.upper())
        expected.append(t)
    assert both(spark, texts, *[m.sub(y, y.upper(), before=x) for x, y in pairs]) == expected
    plain = [m.sub(x + y, f"{y}{x}-") for x, y in pairs]
    assert len(both(spark, texts, *plain)) == len(texts)
    own = fn.column_function(lambda c, options: F.reverse(c))
    mixed = engine(m.script_map("t", *plain, m.call("turned"), *plain, functions={"turned": own}))
    changed = lambda t: functools.reduce(lambda t, p: t.replace(p[0] + p[1], f"{p[1]}{p[0]}-"), pairs, t)
    assert converted(spark, mixed.steps("t"), ["ab", "xyz", None]) == [changed(changed("ab")[::-1]), changed(changed("xyz")[::-1]), None]


def test_convert_rows(spark):
    def picky(text, options):
        if "x" in text:
            raise ValueError("no x")
        return text.upper()

    e = engine(m.script_map("t", m.call("picky"), functions={"picky": picky}))
    df = e.convert_rows(spark.createDataFrame([(1, "ab"), (2, "ax"), (3, None)], "i int, text string"), "text", "t", "i")
    rows = {r["i"]: (r["converted"], r["error"]) for r in df.collect()}
    assert rows[1] == ("AB", None) and rows[3] == (None, None) and rows[2][0] is None and "no x" in rows[2][1]
    with pytest.raises(SystemConversionError, match="no x"):
        e.convert("ax", "t")


def test_module_functions(spark):
    api.reset()
    with pytest.raises(MapNotFoundError):
        api.load_map("deu-Latn-Latn-2000")
    made = api.configure([m.bundled().get])
    assert api.load_map("deu-Latn-Latn-2000").system_code == "deu-Latn-Latn-2000" and api.convert("Tschüß", "deu-Latn-Latn-2000") == "Tschueß"
    df = spark.createDataFrame([("Äpfel", "Aepfel")], "a string, b string")
    assert tuple(df.select(api.transliterate("a", "deu-Latn-Latn-2000"), api.detect("a", "b")[0]["distance"]).first()) == ("Aepfel", 0)
    assert made.loaded_maps() == ["deu-Latn-Latn-2000"]
    api.reset()
    with pytest.raises(MapNotFoundError):
        api.convert("x", "deu-Latn-Latn-2000")


def test_register_and_stage_ref(spark):
    loader = MapLoader()
    loader.register("own", m.script_map("own", m.sub("a", "b")))
    assert loader.load("own").system_code == "own" and loader.loaded_maps() == ["own"]
    loader.clear()
    assert loader.load("own")
    # A reference to a stage stands for nothing, in patterns and replacements.
    assert both(spark, ["ab"], m.sub(m.group({"kind": "stage_ref", "name": "x"}, "a"), m.group("z", {"kind": "stage_ref", "name": "x"}))) == ["zb"]


@settings(max_examples=40, deadline=None)
@given(st.text("abc.*+?^${}()|[]\\", max_size=15), st.text("abcXYZ ", max_size=20))
def test_laws(special, text):
    """Laws of the string forms: what the functions of one string promise."""
    low, up, title = (python_steps([Call(k, {}, fn.BUILT_IN[k])]) for k in ("downcase", "upcase", "title_case"))
    assert low(up(text)) == low(text) and up(low(text)) == up(text) and title(low(text)) == title(text)
    assert all(w[0].isupper() for w in title(text).split()) and len(title(text).split(" ")) == len(text.split(" "))
    apart = python_steps([Call("separate", {}, fn.BUILT_IN["separate"])])
    assert len(apart(text)) == max(0, 2 * len(text) - 1) and python_steps([Call("separate", {"separator": ""}, fn.BUILT_IN["separate"])])(text) == text
    nfc, nfd = (python_steps([Call(k, {}, fn.BUILT_IN[k])]) for k in ("compose", "decompose"))
    assert nfc(nfd("Ångström café ኢትዮጵያ" + text)) == "Ångström café ኢትዮጵያ" + text
    escaped = regexp_escape(special)
    assert regex.fullmatch(escaped, special) and regex.sub(r"\\(.)", r"\1", escaped) == special
    assert python_steps([Table({})])(text) == text and python_steps([Table({x: x for x in "abc"})])(text) == text
    assert len(python_steps([Table({"a": "AAAA", "b": "BB"})])(text)) <= 4 * len(text)


def test_rules(spark):
    assert both(spark, ["hello there"], m.sub("hello", "world"), m.sub(m.any_of("a", "e"), "_")) == ["world th_r_"]
    assert both(spark, ["a.b.c"], m.sub(".", "_")) == ["a_b_c"]
    assert both(spark, ["hello world"], m.sub(m.alias("v"), "_"), aliases={"v": m.any_of(*"aeiou")}) == ["h_ll_ w_rld"]
    assert both(spark, ["a"], m.sequential(m.sub("a", "b"), m.sub("b", "c"))) == ["c"]
    assert both(spark, ["a"], m.parallel(a="b", b="c")) == ["b"]
    assert both(spark, ["HELLO"], m.call("low"), functions={"low": lambda s, o: s.lower()}) == ["hello"]
    assert both(spark, ["xabyab"], m.sub("ab", m.inline("upcase"), before=m.any_of("x", "y"))) == ["xAByAB"]
    assert both(spark, ["a\n", "\na"], m.sub(m.alias("line_start"), ">")) == [">a\n>", ">\n>a"]


def test_templates_and_groups(spark):
    unset = m.sub(m.group(m.any_of(m.captured("a"), "b"), "n"), m.group(m.reference(1), "x"))
    assert both(spark, ["an bn"], unset) == ["ax bnx"]
    assert both(spark, ["xa"], m.sub("a", m.reference(1))) == ["x1"]  # one past the groups: the place
    assert both(spark, ["xa"], m.sub("a", m.reference(2))) == ["xxa"]  # two past: the whole text
    assert both(spark, ["aXbX"], m.sub(m.group(m.captured(m.any_of("a", "b")), "X"), m.group("<", m.reference(1), ">$"))) == ["<a>$<b>$"]
    assert both(spark, ["aab"], m.sub(m.group(m.captured("a"), m.reference(1)), "z")) == ["zb"]
    assert both(spark, ["aaab"], m.sub("b", "c", before=m.repeated("a", 1, None))) == ["aaac"]


def test_parallel_is_two_phase(spark):
    assert both(spark, ["tha"], m.parallel(m.sub("a", "A", before="T"), m.sub("th", "T"))) == ["TA"]
    with pytest.warns(UserWarning):
        assert both(spark, ["ab"], m.parallel(m.call("upcase"), m.sub("a", m.alias("none")), b="c")) == ["ac"]
    assert both(spark, ["a"], m.sub("a", m.alias("none"))) == [""]
    assert both(spark, ["aaa", "the quick brown fox"], m.parallel(**{"aa": "X", "a": "Y", "the": "1", "the quick": "2"})) == ["XY", "2 brown fox"]
    assert both(spark, ["ab^]-x"], m.parallel(**{"^]": "1", "-": "2", "ab": "^]"})) == ["^]12x"]


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.text("abcé^]\\-", min_size=1, max_size=3), st.text("abcxé$\\", max_size=2), min_size=1, max_size=6), st.lists(st.text("abcxé^]\\-\n", max_size=12), min_size=1, max_size=6))
def test_tables_agree(spark, pairs, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    expected = list(map(python_steps([Table(pairs)]), texts))
    for how in ("native", "arrow"):
        assert [r["o"] for r in df.select("i", table_column(F.col("text"), pairs, how).alias("o")).orderBy("i").collect()] == expected


def test_fusion_and_native():
    steps = Compiler().stage(m.script_map("t", m.sub("a"), m.sub("b"), m.parallel(c="")), "main")
    assert steps == [Delete("abc")]
    (s,) = Compiler().stage(m.script_map("t", m.sub(m.captured("a"), m.group("$", m.reference(1)))), "main")
    assert is_native(s) and java_template(s) == "\\$$1"
    assert Compiler().stage(m.script_map("t"), "other") == []


def test_functions(spark):
    one = lambda c, *a: spark.range(1).select(c(F.lit(a[0]), *a[1:]).alias("x")).first()["x"]
    assert one(fn.title_case, "hello wORLD") == "Hello World"
    assert one(fn.title_case, "a_b", {"wordSeparator": "_"}) == "A_B"
    assert one(fn.title_case, "hELLO w", {"wordSeparator": ""}) == "Hello w"
    assert one(fn.separate, "abc", {"separator": "-"}) == "a-b-c"
    assert one(fn.regexp_escape, "a.b*c+d") == "a\\.b\\*c\\+d"
    assert one(fn.decompose, "\u00e9") == "e\u0301" and one(fn.compose, "e\u0301") == "\u00e9"
    assert one(fn.levenshtein, "Антон", F.lit("Anton")) == 5
    assert spark.range(1).select(fn.levenshtein(F.lit("😀"), F.lit("a"), utf16=True)).first()[0] == 2
    assert spark.range(1).select(fn.parallel_single_pass(F.lit("andin"), {"a": "1", "in": "2"}, [("an(?=d)", "3"), ("in", "4")])).first()[0] == "3d2"
    assert spark.range(1).select(fn.glob_matches(F.lit("a.b"), "a.*"), fn.glob_matches(F.lit("axb"), "a.*")).first()[:] == (True, False)


def test_errors(tmp_path):
    with pytest.raises(MapNotFoundError, match="Map not found: x"):
        Engine().load_map("x")
    with pytest.raises(DependencyMissingError, match="Map dependency missing: d"):
        engine(m.script_map("t", dependencies=("d",))).load_map("t")
    for bad in ({"kind": "sub"}, m.sub(m.reference(3), "x"), m.call("nope"), m.run("nope"), m.sub("a", m.inline("nope")), m.sub(m.repeated("a", 3, 1))):
        with pytest.raises(MapLogicError):
            engine(m.script_map("t", bad)).steps("t")
    with pytest.raises(SystemConversionError):
        engine(m.script_map("t", m.run("main"))).transliterate(F, "t")


def test_loader(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps(SPEC))
    (tmp_path / "bad.json").write_text("{")
    seen = []
    loader = MapLoader([folder_strategy(tmp_path)], lambda c, x: seen.append(c))
    assert loader.load("own").aliases == {"x": m.text("y")} and not loader.load("own").functions and seen == ["own"]
    with pytest.raises(MapNotFoundError):
        loader.load("bad")
    loader.clear()
    loader.strategies.clear()
    assert loader.load("own") and loader.loaded_maps() == ["own"]
    assert bundled_strategy({"key": SPEC})("key").system_code == "own"
    assert relative_folder_strategy(f"file://{tmp_path}/sub.py", ".")("own")
    with pytest.raises(KeyError):
        bundled_strategy({"k": {}})


def test_detect(spark):
    e = engine(*m.ukrainian(), m.script_map("none"), m.script_map("broken", m.call("nope")))
    df = spark.createDataFrame([("Антон", "Anton")], "a string, b string")
    codes = ["none", "broken", "ua-ukr-Cyrl-Latn-1996"]
    assert [tuple(x) for x in df.select(e.detect("a", "b", candidates=codes)).first()[0]] == [("ua-ukr-Cyrl-Latn-1996", 0), ("none", 5)]
    assert df.select(e.detect("a", "b", candidates=codes, map_pattern="n*")).first()[0][0]["map_name"] == "none"
    assert df.select(e.detect("a", "b", candidates=[])).first()[0] == []


def test_cli(tmp_path, capsys):
    (tmp_path / "own.json").write_text(json.dumps(SPEC))
    (tmp_path / "in").write_text("aba")
    assert cli.main([]) == 1 and cli.main(["--help"]) == 0 and cli.main(["--nope"]) == 1
    assert cli.main(["-s", "own", "--maps-dir", str(tmp_path / "no")]) == 2
    assert cli.main(["-s", "own", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--maps-dir", str(tmp_path)]) == 0
    assert (tmp_path / "out").read_text() == "bbb\n"
    assert cli.main(["-s", "none", "-i", str(tmp_path / "in"), "--maps-dir", str(tmp_path)]) == 1


def test_stream(spark, tmp_path):
    from glyphflow.streaming.convert import convert_stream, write_parquet

    spark.createDataFrame([("Київ",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = convert_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), engine(*m.ukrainian()), "bgnpcgn-ukr-Cyrl-Latn-2019")
    write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["converted"] == "Kyiv"


def test_sources(spark, tmp_path):
    from glyphflow.sources.catalog import aliases_table, dependencies_table, maps_table, rules_table
    from glyphflow.sources.text import read_text, write_text

    (tmp_path / "x.txt").write_text("a\nb")
    assert [r["text"] for r in read_text(spark, str(tmp_path / "x.txt")).collect()] == ["a\nb"]
    write_text(read_text(spark, str(tmp_path / "x.txt")), str(tmp_path / "out"))
    assert sorted(r["text"] for r in read_text(spark, str(tmp_path / "out"), whole=False).collect()) == ["a", "b"]
    known = m.bundled().values()
    assert maps_table(spark, known).count() == 6 and dependencies_table(spark, known).count() == 3 and aliases_table(spark, known).count() == 1
    assert rules_table(spark, m.bundled().values()).groupBy("system_code", "kind").count().count() == 14
    engine(*m.ukrainian()).register_sql(spark, "romanised", "bgnpcgn-ukr-Cyrl-Latn-2019")
    assert spark.sql("SELECT romanised('Київ')").first()[0] == "Kyiv"
    e = engine(*m.ukrainian(), m.script_map("none"), m.script_map("broken", m.call("nope")))
    e.register_detect_sql(spark, "systems", candidates=["none", "broken", "ua-ukr-Cyrl-Latn-1996"])
    assert [tuple(x) for x in spark.sql("SELECT systems('Антон', 'Anton')").first()[0]] == [("ua-ukr-Cyrl-Latn-1996", 0), ("none", 5)]
