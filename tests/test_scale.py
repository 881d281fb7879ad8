"""Tables of many keys, loops without recursion, fused rules and conversion by words: each against the plain form."""

import json
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from glyphflow import maps as m
from glyphflow.engine import Engine
from glyphflow.functions import text as fn
from glyphflow.operators import rewrite
from glyphflow.operators.rewrite import apply_steps, by_words, is_native, python_steps, table_column
from glyphflow.operators.trie import CompiledTable
from glyphflow.plans import fusion
from glyphflow.plans.compiler import Compiler, fused
from glyphflow.plans.cuts import separators
from glyphflow.plans.patterns import regexp_escape
from glyphflow.queries import MANY, engine
from glyphflow.sources import catalog
from glyphflow.sources.maps import shared_folder_strategy


def column(spark, texts, build):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in df.select("i", build(F.col("text")).alias("out")).orderBy("i").collect()]


def longest_first(pairs):
    find = regex.compile("|".join(map(regexp_escape, sorted(pairs, key=len, reverse=True)))).sub
    return lambda x: find(lambda k: pairs[k[0]], x)


def some(rnd, letters, n):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_trie():
    rnd = random.Random(1)
    for _ in range(1000):
        letters = rnd.choice(["ab", "abc", "ab]^-\\", "aé日😀"])
        pairs = {some(rnd, letters, rnd.randint(1, rnd.choice([1, 5]))): rnd.choice(["", "x", "a", "yy"]) for _ in range(rnd.randint(1, 12))}
        text = some(rnd, letters + "zq", rnd.randint(0, 40))
        assert CompiledTable(pairs).convert(text) == longest_first(pairs)(text)
    deep = CompiledTable({"ab" * 20_000 + "c": "1", "ab" * 20_000 + "d": "2", "ab": "3"})
    assert deep.convert("ab" * 20_000 + "d" + "abab") == "233" and deep.convert("ab" * 3) == "333"
    assert CompiledTable([("", "x"), ("a", "1"), ("a", "2")]).convert("aba") == "2b2" and CompiledTable({}).convert("ab") == "ab" and len(CompiledTable([("", "x"), ("a", "b")])) == 1


def test_table_forms(spark):
    """Native and Arrow forms agree, and the automatic choice with them, on both sides of each threshold."""
    rnd = random.Random(2)
    texts = ["", None, *[some(rnd, "abcdefghijklmnopqrstuvwxyz AB", 60) for _ in range(20)]]
    for pairs in (
        {some(rnd, "abcd", k): some(rnd, "xyzab", rnd.randint(0, 3)) for k in (1, 2, 3) for _ in range(4)},
        {some(rnd, "abcdef", k): some(rnd, "xyzab", rnd.randint(0, 3)) for k in (1, 2, 3) for _ in range(20)},
        {x: x.upper() * 2 for x in "abcdefgh"}, {x: x.upper() * 2 for x in "abcdefghijklmnopqrstuvwxyz"}, {"a": "b", "b": "a", "c": "cc"}, dict(zip("abcdefghijklm", "ABCDEFGHIJKLM", strict=True)), dict.fromkeys("abc", ""),
    ):
        forms = [column(spark, texts, lambda c, f=f, p=pairs: table_column(c, p, f)) for f in ("auto", "native", "arrow")]
        walk = longest_first(pairs)
        assert forms[0] == forms[1] == forms[2] == [x if x is None else walk(x) for x in texts]
    table = CompiledTable(pairs)
    assert column(spark, texts, table.column) == column(spark, texts, lambda c: fn.parallel_replace(c, table)) == [x if x is None else table.convert(x) for x in texts]


def test_time_does_not_grow_with_keys():
    rnd = random.Random(3)
    words = list(dict.fromkeys(some(rnd, "etaoinshrdlu", rnd.randint(3, 9)) for _ in range(25_000)))[:20_000]
    text = " ".join(rnd.choice(words) for _ in range(60_000))
    took = []
    for n in (60, 20_000):
        table = CompiledTable({w: w.upper() for w in words[:n]})
        table.convert("")
        begin = time.process_time()
        table.convert(text)
        took.append(time.process_time() - begin)
    assert took[1] < 4 * took[0]


def repeat(*of, low=1, high=None):
    return m.repeated(m.any_of(*of), low, high)


REPEATS = [
    (m.sub(repeat("a", "bc"), "X"), "(?:a|bc)+", True, True), (m.sub(repeat("a", "ab"), "X"), "(?:a|ab)+", True, True), (m.sub(m.group(repeat("a", "bc"), "d"), "X"), "(?:a|bc)+d", True, True),
    (m.sub(m.group(repeat("a", "bc"), "b"), "X"), "(?:a|bc)+b", False, False), (m.sub(repeat("a", "bc", low=0), "X"), "(?:a|bc)*", True, True), (m.sub(repeat("a", "bc"), "X", after="d"), "(?:a|bc)+(?=d)", True, False),
    (m.sub(repeat("a", "bc"), "X", after="b"), "(?:a|bc)+(?=b)", False, False), (m.sub(repeat("a", "bc"), "X", notAfter="d"), "(?:a|bc)+(?!d)", False, False), (m.sub(repeat("a", "bc", low=3, high=5000), "X"), "(?:a|bc){3,5000}", True, False),
    (m.sub(repeat("a", "ab", low=2, high=5000), "X"), "(?:a|ab){2,5000}", False, False), (m.sub(repeat("a", "b", "c"), "X"), "(?:a|b|c)+", True, True), (m.sub(m.group(repeat("a", "b"), "b"), "X"), "(?:a|b)+b", True, False),
    (m.sub(m.group(repeat("a", "bc"), m.any_of("d", "")), "X"), "(?:a|bc)+(?:d|)", True, True), (m.sub(m.repeated(m.group(repeat("a", "bc"), "d"), 1, None), "X"), "(?:(?:a|bc)+d)+", False, False),
    (m.sub(m.group(repeat("a", m.alias("digit")), "d"), "X"), r"(?:a|\p{N})+d", False, False), (m.sub(repeat("a", "bc", low=2, high=4), "X"), "(?:a|bc){2,4}", True, True),
]


@pytest.mark.parametrize(("rule", "pattern", "native", "linear"), REPEATS)
def test_repeats(spark, rule, pattern, native, linear):
    """As a Column and as a string, also on texts that recursion as deep as they are long would end."""
    rnd = random.Random(5)
    n = 33_000 if linear else 600
    texts = [*[some(rnd, "abcd1", rnd.randint(0, 25)) for _ in range(150)], "abc" * n + "d", "a" * 3 * n, "bc" * n + "b"]
    expected = [regex.sub(pattern, "X", x) for x in texts]
    e = engine(m.script_map("t", rule))
    assert is_native(e.steps("t")[0]) == native
    assert [e.convert(x, "t") for x in texts] == expected == column(spark, texts, lambda c: e.transliterate(c, "t"))


def rules_of(rnd):
    letters = rnd.choice(["abAB", "abcdefXYZ", "abcdefghijklmnop"])
    item = lambda: m.any_of(*{some(rnd, letters, rnd.randint(1, 2)) for _ in range(rnd.randint(1, 3))}) if rnd.random() < 0.4 else some(rnd, letters, rnd.randint(1, 2))
    value = lambda: rnd.choice(["", some(rnd, letters, 1), some(rnd, letters, 2).upper(), "#"])
    return letters, [m.sub(item(), value(), **{k: item() for k in ("before", "after", "notBefore", "notAfter") if rnd.random() < 0.25}) for _ in range(rnd.randint(2, 12))]


def unfused(e):
    found = e.load_map("t")
    return fused(Compiler(e.loader).rules(found, found.rules("main"), ()))


def test_fused_rules(monkeypatch):
    """Fused and unfused agree on random rules, by patterns, by plain replacements and by words."""
    rnd, n = random.Random(6), 0
    for _ in range(1500):
        letters, rules = rules_of(rnd)
        e = engine(m.script_map("t", *rules))
        steps = e.steps("t")
        n += any(isinstance(s, fusion.Fused) for s in steps)
        quick, words = python_steps(steps), by_words(python_steps(steps), separators(steps))
        with monkeypatch.context() as patch:
            patch.setattr(rewrite, "plain_pairs", lambda rule: None)
            plain, one_pass = python_steps(unfused(e)), python_steps(steps)
        for _ in range(10):
            x = some(rnd, letters + " .1", rnd.randint(0, 40))
            assert plain(x) == one_pass(x) == quick(x) and words([x, None, "", x]) == [plain(x), None, "", plain(x)], (rules, x)
    assert n > 150


def test_fused_columns(spark):
    rnd = random.Random(7)
    found = 0
    while found < 4:
        letters, rules = rules_of(rnd)
        e = engine(m.script_map("t", *rules))
        if any(isinstance(s, fusion.Fused) for s in e.steps("t")):
            found += 1
            texts = ["", None, *[some(rnd, letters + " ", 50) for _ in range(30)]]
            plain = python_steps(unfused(e))
            for form in ("auto", "native"):
                assert column(spark, texts, lambda c, e=e, f=form: apply_steps(c, e.steps("t"), f)) == [x if x is None else plain(x) for x in texts]
    many = engine(m.script_map("t", *[m.sub(b, b.upper(), before=a) for a, b in MANY]))
    assert len(many.steps("t")) == 14  # one step for each letter that others stand behind


def test_feeding():
    own = lambda source, value, **around: fusion.Facts((source,), value, tuple((k, (v,)) for k, v in around.items()))
    rules = [own("a", "b"), own("b", "c"), own("x", "y", before="a"), own("q", ""), own("rs", "t"), own("a", "z", after="k")]
    assert fusion.feeding(rules) == [[], [0], [0], [], [3], [3]]


def test_cuts():
    free = lambda *rules, **aliases: separators(engine(m.script_map("t", *rules, aliases=aliases)).steps("t"))
    assert " " in free(m.sub("a", "b")) and "." not in free(m.sub("a", ".")) and "'" not in free(m.parallel(**{"'": "x", "ab": "y"}))
    # What may look at blanks or at the ends of a text, or take and make them, leaves no place.
    for rule in (m.sub("a", " "), m.sub(" ", "a"), m.sub(m.alias("line_start"), ">"), m.sub("a", "b", before=m.alias("not_alpha")), m.sub(m.alias("any_character"), "x"), m.sub(m.alias("boundary"), "|"), m.call("downcase"), m.sub("a", "b", notAfter=m.alias("string_end")), m.sub("a", m.inline("separate")), m.sub(m.captured("a"), m.group(m.reference(2)))):
        assert free(rule) is None
    e = engine(*m.ukrainian())
    steps = e.steps("bgnpcgn-ukr-Cyrl-Latn-2019")
    plain, words = python_steps(steps), by_words(python_steps(steps), separators(steps))
    rnd = random.Random(8)
    for _ in range(500):
        x = some(rnd, "зЗгГ’'ЩьЄєїЯяюа. -\n1x", 40)
        assert words([x]) == [plain(x)]


def test_words_in_parts(monkeypatch):
    monkeypatch.setattr(rewrite, "KEPT_WORDS", 3)
    monkeypatch.setattr(rewrite, "KEPT_LENGTH", 2)
    monkeypatch.setattr(rewrite, "TOGETHER", 20)
    e = engine(m.script_map("t", m.sub("a", "b"), m.sub("b", "cc", before="x")))
    steps, rnd = e.steps("t"), random.Random(9)
    words, plain = by_words(python_steps(steps), separators(steps)), python_steps(steps)
    texts = [None if rnd.random() < 0.1 else some(rnd, "abx  .", rnd.randint(0, 30)) for _ in range(500)]
    assert words(texts) == [x if x is None else plain(x) for x in texts]


def test_shared_steps(spark):
    """Rows with shared steps against a Column for each candidate, and the best against all, on random maps that begin or end alike."""
    rnd = random.Random(10)
    for _ in range(4):
        begin, end = ([m.sub(some(rnd, "abcd", 1), some(rnd, "wxyz", 2), before=some(rnd, "ab", 1)) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        own = lambda: [m.sub(some(rnd, "abcd", 2), some(rnd, "vw", 1)) for _ in range(rnd.randint(0, 2))]  # noqa: B023, E731
        maps = [m.script_map(f"m{i}", *x) for i, x in enumerate([[*begin, *own()], [*begin, *own()], begin, [*own(), *end], [*own(), *end], end, [], [m.call("upcase"), *end], [*begin, *begin], begin])]
        e = engine(*maps)
        codes = [x.system_code for x in maps]
        rows = [(i, some(rnd, "abcd ", rnd.randint(0, 30)), some(rnd, "abcdwxyz 😀", rnd.randint(0, 30))) for i in range(40)] + [(40, None, "a"), (41, "a", None), (42, "", "")]
        df = spark.createDataFrame(rows, "i int, a string, b string")
        for utf16 in (False, True):
            each = df.select("i", e.detect("a", "b", candidates=codes, utf16=utf16).alias("x"), e.detect("a", "b", candidates=codes, utf16=utf16, best=3).alias("y")).collect()
            assert all(r["y"] == r["x"][:3] for r in each)
            got = e.detect_rows(df, "a", "b", "i", candidates=codes, utf16=utf16).collect()
            assert sorted((r["i"], r["rank"], r["map_name"], r["distance"]) for r in got if r["distance"] is not None) == sorted((r["i"], k, x["map_name"], x["distance"]) for r in each for k, x in enumerate(r["x"], 1) if x["distance"] is not None)
            assert e.detect_rows(df, "a", "b", "i", candidates=codes, utf16=utf16, best=2).count() == 2 * len(rows)


def test_shared_plan(spark, capsys):
    """Four maps that run each other need one Arrow step."""
    e = engine(*m.ukrainian())
    df = spark.createDataFrame([("Згорани", "Zghorany")], "a string, b string")
    out = e.detect_rows(df, "a", "b", candidates=[x.system_code for x in m.ukrainian()])
    assert [(r["rank"], r["distance"]) for r in out.collect()] == [(1, 0), (2, 0), (3, 0), (4, 0)]
    out.explain("formatted")
    assert capsys.readouterr().out.count(") ArrowEvalPython") <= 2  # named once in the tree, once in the list


def test_utf16_distance(spark):
    rnd = random.Random(11)
    rows = [(i, some(rnd, "ab😀🚀é\U00020061日\U000f0000", rnd.randint(0, 12)), some(rnd, "ab😀🚀é\U00020061日\U000f0000", rnd.randint(0, 12))) for i in range(300)] + [(300, None, "a"), (301, "", "")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = [r["d"] for r in df.orderBy("i").select(fn.levenshtein(F.col("a"), F.col("b"), utf16=True).alias("d")).collect()]
    assert got == [None if a is None else fn.distance(a, b, utf16=True) for _, a, b in rows]


def test_long_texts(spark):
    rnd = random.Random(12)
    e = engine(*m.ukrainian(), m.script_map("whole", m.sub(m.alias("line_start"), ">")))
    code = "bgnpcgn-ukr-Cyrl-Latn-2019"
    texts = [None, "", " ", "Щука", *[some(rnd, "зЗгГ’'ЩьЄєїЯяюа. -\n1x", rnd.randint(0, 400)) for _ in range(20)], "а" * 500, ("Згорани, " * 30_000)]
    df = spark.createDataFrame([(i % 7, "x", t) for i, t in enumerate(texts)], "k int, text string, t string")
    for piece in (1, 10, 4096):
        got = e.convert_long(df, "t", code, "k", "text", piece=piece).collect()
        assert sorted((r["k"], r["converted"]) for r in got if r["converted"] is not None) == sorted((i % 7, e.convert(t, code)) for i, t in enumerate(texts) if t is not None) and len(got) == len(texts)
    assert {r["converted"] for r in e.convert_long(df.filter("k = 3"), "t", "whole", "k").collect()} >= {">Щука"}


def test_map_files(spark, tmp_path):
    """Maps of a folder as tables, errors as rows, and the loader on any path that Spark reads."""
    spec = {"schemaVersion": 1, "systemCode": "one", "dependencies": ["two"], "stages": [{"name": "main", "rules": [m.sub("a", "b"), m.parallel(m.sub("c", "d"))]}], "aliases": {"v": m.text("o")}}
    for name, x in {"one": json.dumps(spec), "two": json.dumps(spec | {"systemCode": "two", "dependencies": []}), "bad": "{", "list": "[]", "short": '{"systemCode": "x"}', "odd": json.dumps(spec | {"stages": [{"name": "main", "rules": [{}]}]})}.items():
        (tmp_path / f"{name}.json").write_text(x)
    files = catalog.map_files(spark, f"file://{tmp_path}")
    assert sorted((r["system_code"], r["path"], r["kind"]) for r in catalog.parsed(files, "rules").collect()) == [(c, p, k) for c in ("one", "two") for p, k in (([0], "sub"), ([1], "parallel"), ([1, 0], "sub"))]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in catalog.errors(files).collect()) == ["bad.json", "list.json", "odd.json", "short.json"]
    own = [Engine([shared_folder_strategy(spark, f"file://{tmp_path}/")]).load_map("one")]
    for name in ("maps", "rules", "aliases", "dependencies"):
        here = getattr(catalog, f"{name}_table")(spark, own)
        assert here.schema == catalog.parsed(files, name).schema and [r for r in catalog.parsed(files, name).collect() if r["system_code"] == "one" and (name != "maps" or r["dependencies"])] [: here.count()] == here.collect()
    find = shared_folder_strategy(spark, f"file://{tmp_path}")
    assert find("bad") is None and find("none") is None and find("two").system_code == "two"
