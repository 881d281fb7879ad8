"""Secret scan: a random forest that tells secrets from look-alikes.

Candidates are runs of MIN_LENGTH or more characters of keys and digests, and every value
assigned to or following a secret word: what stands in its quotes, else all up to the next
blank (or the next name=) without closing punctuation. A value may overlap a run; both are
candidates. Their features are length, character transitions and classes, the part covered
by dictionary words, whether they stand in a path, address or number, look like a word, an
identifier or a placeholder, and the words next to them. A forest trained on labelled
findings removes the false positives.

All of it is DataFrame functions and MLlib: extraction and features need no shuffle.

Null and empty texts have no candidates. Null doc_ids are kept, and their texts redacted;
each of repeated rows is scanned, and each text redacted by its own findings. Very long
texts are scanned whole; their candidates' places are summed in blocks. Extra columns are
ignored by findings() and kept by redacted(). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, salted_join, table

MIN_LENGTH, THRESHOLD = 16, 0.5
CANDIDATE = rf"(?<![A-Za-z0-9_+/=.\-])(?=[_+/=.\-]*+[A-Za-z0-9])[A-Za-z0-9_+/=.\-]{{{MIN_LENGTH},}}"
BEFORE, AFTER = 48, 32
#: Words and word parts that secrets seldom hold by chance.
DICTIONARY = "the and ing ion ent for that with this from have not are was but all can her one our out has him his how man new now old see two way who did get let put say she too use test example sample demo user admin prod dev stage local host server client config default value name file path data base version release build update package module class function method index table column image icon style script page view model controller service manager handler factory http https www com org net mail doc text your here change replace enter insert key token secret password api access login auth xxxx aaaa 1234 0000".split()
#: For training: words of prose, of passwords, and parts of long words.
PROSE = "of and is was for to in on by with must should can will may from that which a the has as or when if its into used required optional expired invalid missing generated stored sent returned signed based management service server code page user account question story agent keeper reading policy field value string des les est une pour avec dans der die das und ist wird mit los una por con para que invalide geheim nuevo"
PHRASES = "hunter monkey dragon sunshine tr0ub4dor passw0rd p4ss summer winter welcome football letme1n qwerty purple s3cur3 correct horse battery staple tiger blue"
SYLLABLES = "the tion ing ent lich keit ver schaft eur ment que ación dad re con inter nation al iz er ein sch ung heit on an is er tz au ou her that with bel pre dis able ness"
SECRET_WORDS = r"(?i)(?:api[_ -]?key|access[_ -]?key|secret|token|passwd|password|pwd|bearer|authorization|credential|private[_ -]?key|auth)"
OTHER_WORDS = r"(?i)(?:commit|revision|sha-?1|sha-?256|md5|checksum|digest|hash|etag|version|build|uuid|guid|phone|card|order|invoice|isbn|example|blob|tree|merge)"
#: Between a secret word and its value; the value may stand on the next line.
ASSIGNED = r"(?:[ \t]*+(?:[=:]++>?|->)\s*+|\s++(?:(?:is|was)(?:[ \t]*+:)?+\s++)?)(?:(?:basic|bearer|digest)\s++)?"
#: Values in quotes, else to the next blank or the next name= after one of &;, .
VALUE = r"""(?<=")[^"\\\n]*+(?:\\.[^"\\\n]*+)*+(?=")|(?<=')[^'\\\n]*+(?:\\.[^'\\\n]*+)*+(?=')|(?<=`)[^`\n]++(?=`)|(?!["'`])(?:(?![&;,]["']?[a-z_][\w.\-]*+["']?[=:])\S)++"""
#: 1: a name with a secret word; 2: what stands before the value; 3: the value. A name is tried from its start alone, however many secret words it
#: holds, and only a value right after = or : is passed over, so that one run with many names is read once.
KEYWORD = rf"""(?<![a-z0-9_\-])((?>[a-z0-9_\-]*?(?=[astpbc]){SECRET_WORDS})[a-z0-9_\-]*+["'`)\]]{{0,2}}+)(?=({ASSIGNED}["'`]?+)({VALUE}))(?:(?=[=:]++>?+\S)\2\3)?+""".replace("(?i)", "")
KEYWORD = f"(?i){KEYWORD}"
#: Closing punctuation is no part of a value without quotes.
CLOSING = ",;.\"'`)]}>"
TREES, DEPTH, SEED = 32, 10, 11
#: Labelled texts made for training, of each kind.
FINDINGS = 120
BLOCK = 256

#: Groups are repeated possessively: Java runs other repeated groups of varying length by recursion, which long values end.
FEATURES = {
    "f_length": "ln(length(value))",
    "f_digits": "regexp_count(value, '[0-9]') / length(value)",
    "f_uppers": "regexp_count(value, '[A-Z]') / length(value)",
    "f_symbols": "regexp_count(value, '[^A-Za-z0-9]') / length(value)",
    "f_hex": "regexp_count(value, '[0-9a-fA-F]') / length(value)",
    "f_vowels": "regexp_count(value, '[aeiouAEIOU]') / length(value)",
    "f_distinct": "size(array_distinct(split(value, ''))) / length(value)",
    "f_transitions": "regexp_count(value, '(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])') / length(value)",
    "f_dictionary": f"1 - length(regexp_replace(lower(value), '{'|'.join(sorted(DICTIONARY, key=lambda x: (-len(x), x)))}', '')) / length(value)",
    "f_path": "cast(value rlike '/.*/|^/|[.](?:com|org|net|js|css|png|html|py|txt)$|^[0-9.]+$' or before rlike '(?:://|[/.@])[^ ]*$' or after rlike '^[@/.\\\\\\\\]' as int)",
    "f_secret_word": f"cast(before rlike '{SECRET_WORDS}[A-Za-z_]*[^A-Za-z0-9]{{0,6}}$' as int)",
    "f_near_secret_word": f"cast(before rlike '{SECRET_WORDS}' or after rlike '{SECRET_WORDS}' as int)",
    "f_other_word": f"cast(before rlike '{OTHER_WORDS}' or after rlike '{OTHER_WORDS}' as int)",
    "f_assigned": "cast(before rlike '(?:=|:|=>)[ ]*[\"\\']?$' as int)",
    "f_classes": "cast(value rlike '[a-z]' as int) + cast(value rlike '[A-Z]' as int) + cast(value rlike '[0-9]' as int) + cast(value rlike '[^A-Za-z0-9]' as int)",
    "f_punctuation": "regexp_count(value, '[^A-Za-z0-9_+/=. -]') / length(value)",
    "f_prefix": "cast(value rlike '^(?:AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|[sr]k[_-]|npm_|hf_|pypi-)' as int)",
    "f_word": "cast(value rlike '^[A-Za-z]?[a-zà-ÿ]+[^A-Za-z0-9]*$' or value rlike '^[A-ZÀ-Þ]+[^A-Za-z0-9]*$' as int)",
    "f_identifier": "cast(value rlike '^[A-Za-z]++(?:[^A-Za-z0-9]++[A-Za-z]++)++[^A-Za-z0-9]*+$' or value rlike '^[a-z]++(?:[A-Z][a-z]{2,}+)++$' or value rlike '^(?:[A-Z][a-z]{2,}+)++$' as int)",
    "f_placeholder": "cast(value rlike '^[$<{%*(\\\\[]|[A-Za-z0-9][(\\\\[]|[*]{3}|^(?i)(?:x+|null|none|nil|true|false|undefined|string|str|int|required|optional|empty|changeme)$' as int)",
    "f_blanks": "regexp_count(value, '[ \t]') / length(value)",
    "f_stated": f"cast(before rlike '{SECRET_WORDS}[A-Za-z_]*[ ]+(?:is|was)[ ]*:?[ ]+$' as int)",
    "f_quoted": "cast(before rlike '[\"\\'`]$' and after rlike '^[\"\\'`]' as int)",
}


def starts(sizes: str) -> str:
    """Blocks of an array of lengths, each with the sum of all before it: a text may hold very many candidates."""
    return f"transform(sequence(0, size({sizes}) div {BLOCK}), k -> aggregate(slice({sizes}, 1, cast(k * {BLOCK} as int)), 0L, (a, y) -> a + y))"


def start_of(blocks: str, sizes: str) -> str:
    return f"{blocks}[i div {BLOCK}] + aggregate(slice({sizes}, cast(i div {BLOCK} * {BLOCK} + 1 as int), i % {BLOCK}), 0L, (a, y) -> a + y)"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, start (characters), value, before and after of each candidate of docs(doc_id, text)."""
    of_name = lambda k, where: F.when(where, F.regexp_extract_all("t", F.lit(KEYWORD), F.lit(k))).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", F.col("text").alias("t")).select("doc_id", "t", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("c"), of_name(0, F.col("t").rlike(SECRET_WORDS)).alias("w")).filter("size(c) > 0 or size(w) > 0")
    some = F.size("w") > 0
    parts = found.select(
        "doc_id", "c", "w", F.split("t", CANDIDATE, -1).alias("p"), of_name(1, some).alias("h"), of_name(2, some).alias("s"), of_name(3, some).alias("v"),
        F.when(some, F.split("t", KEYWORD, -1)).otherwise(F.array(F.lit(""))).alias("q"),
    )
    sizes = parts.withColumns({"g": F.expr("transform(c, (x, i) -> cast(length(p[i]) + length(x) as bigint))"), "e": F.expr("transform(w, (x, i) -> cast(length(q[i]) + length(x) as bigint))")})
    sums = sizes.withColumns({"b": F.expr(starts("g")), "d": F.expr(starts("e"))})
    runs = f"transform(c, (x, i) -> named_struct('start', {start_of('b', 'g')} + length(p[i]), 'value', x, 'before', right(p[i], {BEFORE}), 'after', left(p[i + 1], {AFTER})))"
    closing = CLOSING.replace("'", "\\'")
    value = f"if(right(s[i], 1) in ('\"', '\\'', '`'), v[i], rtrim('{closing}', v[i]))"
    rest = "if(length(x) > length(h[i]), q[i + 1], substr(q[i + 1], length(s[i]) + length(v[i]) + 1))"
    values = (
        f"transform(w, (x, i) -> named_struct('start', {start_of('d', 'e')} + length(q[i]) + length(h[i]) + length(s[i]), 'value', {value},"
        f" 'before', right(concat(q[i], h[i], s[i]), {BEFORE}), 'after', left(concat(substr(v[i], length({value}) + 1), {rest}), {AFTER})))"
    )
    both = sums.select("doc_id", F.expr(f"array_sort(concat({runs}, filter({values}, x -> x.value <> '')))").alias("a"))
    once = F.expr("filter(a, (x, i) -> i = 0 or x.start <> a[i - 1].start or x.value <> a[i - 1].value)")
    return both.select("doc_id", F.posexplode(once).alias("ordinal", "x")).select("doc_id", "ordinal", "x.*")


def with_features(found: DataFrame) -> DataFrame:
    return found.withColumns({k: F.expr(x).cast("double") for k, x in FEATURES.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """text and label of made-up findings: n of each kind, from digests of the numbers from `first` on. Reviewed findings of one's own have the same form."""
    digests = {"sha1": "sha1(cast(id as string))", "sha2": "sha2(cast(id as string), 256)", "md5": "md5(cast(id as string))"}
    b64 = f"translate(left(base64(unhex(sha2)), 32), '+/=', 'xYz')"
    words = "concat_ws('_', element_at(array('user','release','config','server','module','update'), cast(id % 6 + 1 as int)), element_at(array('default','version','manager','template','example','sample'), cast(id % 5 + 1 as int)), cast(id as string), 'value')"
    name = "element_at(array('token','api_key','secret','password','auth_token','access_key','passwd','client_secret'), cast(id % 8 + 1 as int))"
    upper = "element_at(array('lorem ipsum', 'and then the', 'see below', 'of nothing', '!!'), cast(id % 5 + 1 as int))"
    pick = lambda x, k: f"element_at(split('{x}', ' '), cast(conv(substr(md5, {k}, 4), 16, 10) % {len(x.split())} + 1 as int))"
    prose, prose2 = pick(PROSE, 1), pick(PROSE, 5)
    phrase = f"{pick(PHRASES, 9)} || id % 97 || if(id % 3 = 0, '', {pick(PHRASES, 13)})"
    marked = f"initcap({pick(PHRASES, 9)}) || {pick('! @ # $ % & * ? + ~ ^', 17)} || id % 89 || if(id % 2 = 0, '', {pick('! # % & xyz x$ Q7', 21)})"
    symbols = f"translate(left(base64(unhex(sha2)), cast(8 + id % 13 as int)), 'aeiouAEIOU/+', '!@#$%^&*?~{{|')"
    letters = f"left(regexp_replace(base64(unhex(concat(sha2, md5))), '[^A-Za-z]', ''), cast(20 + id % 17 as int))"
    low = f"translate(left(md5, cast(10 + id % 12 as int)), '0123456789', 'qwzkxjpvmh')"
    holder = f"element_at(array('<your {{name}}>', '${{SECRET}}', '********', 'xxxxxxxx', 'null', 'None', 'required', 'string', 'os.environ[\\'X\\']', 'get_value()', 'config.value', 'changeme', 'true', '{{{{ value }}}}', 'example', '$(cat file)', '%s', 'self.value', '[hidden]', '***'), cast(id % 20 + 1 as int))"
    long = f"left(concat({pick(SYLLABLES, 1)}, {pick(SYLLABLES, 5)}, {pick(SYLLABLES, 9)}, {pick(SYLLABLES, 13)}, {pick(SYLLABLES, 17)}, {pick(SYLLABLES, 21)}, {pick(SYLLABLES, 25)}), cast(16 + id % 14 as int))"
    parts = {"b64": b64, "words": words, "name": name, "upper": upper, "prose": prose, "prose2": prose2, "phrase": phrase, "marked": marked, "symbols": symbols, "letters": letters, "low": low, "holder": holder, "long": long}
    # From here on, the names of their columns.
    sha1, sha2, md5, b64, words, name, upper, prose, prose2, phrase, marked, symbols, letters, low, holder, long = [*digests, *parts]
    kinds = [
        (f"{upper} || ' ' || {name} || ' = \"' || {sha1} || '\" ' || {upper}", 1),
        (f"upper({upper} || ' ' || {name} || ' = \"' || {sha1} || '\"!! ' || {upper})", 1),
        (f"{upper} || ' ' || {name} || ': ' || {md5} || ' ' || {upper}", 1),
        (f"{name} || '=' || {b64} || ' ' || {upper}", 1),
        (f"{upper} || ' \"' || {name} || '\": \"' || {b64} || '\", ' || {upper}", 1),
        (f"{upper} || ' Authorization: Bearer ' || {b64} || ' ' || {upper}", 1),
        (f"{upper} || ' AKIA' || upper(left({md5}, 16)) || ' ' || {upper}", 1),
        (f"{upper} || ' ghp_' || left({b64}, 30) || '0a ' || {upper}", 1),
        (f"{upper} || ' ' || lpad(conv(left({md5}, 13), 16, 10), 16, '4') || ' ' || {upper}", 0),
        (f"{name} || ' ' || lpad(conv(left({md5}, 13), 16, 10), 16, '4') || ' ' || {upper}", 0),
        (f"{upper} || ' commit ' || {sha1} || ' ' || {upper}", 0),
        (f"{upper} || ' md5 checksum: ' || {md5} || ' ' || {upper}", 0),
        (f"{upper} || ' https://example.com/assets/' || {md5} || '/index.html ' || {upper}", 0),
        (f"{upper} || ' /usr/lib/cache/' || left({sha1}, 12) || '/data.txt ' || {upper}", 0),
        (f"{upper} || ' ' || id || '@mail' || id % 10 || '.example.com ' || {upper}", 0),
        (f"{upper} || '.' || id % 100 || '@mail7.example-domain' || id || '.com ' || {upper}", 0),
        (f"{name} || ' = \"' || {words} || '\" ' || {upper}", 0),
        (f"{name} || ' = \"your_' || {name} || '_here_1234\" ' || {upper}", 0),
        (f"{upper} || ' ' || {words} || ' ' || {upper}", 0),
        (f"{upper} || ' ' || concat_ws('.', id % 250, id % 240 + 10, 100 + id % 99, 100 + id % 87) || '.1 ' || {upper}", 0),
        (f"{upper} || ' uuid ' || left({md5}, 8) || '-' || substr({md5}, 9, 4) || '-' || substr({md5}, 13, 4) || '-' || substr({md5}, 17, 16) || ' ' || {upper}", 0),
        (f"{upper} || ' ' || repeat('abcdefgh', 2) || id || ' ' || {upper}", 0),
        # Values of any length and punctuation, and without digits.
        *[(f"{before} || {name} || {joint} || {x} || {end}", 1) for x in (phrase, marked, symbols, letters, low) for before, joint, end in (("'db_'", "': '", "' ' || " + upper), (f"{upper} || ' '", "' = \"'", "'\" '"), (f"{upper} || '\n'", "'='", "'\n' || " + upper))],
        *[(f"{upper} || ' the ' || {name} || ' ' || {joint} || {x} || ' ' || {upper}", 1) for x in (phrase, marked, symbols) for joint in ("''", "'is '")],
        (f"{upper} || ' AKIA' || upper(left({letters}, 16)) || ' ' || {upper}", 1),
        (f"{upper} || ' ghp_' || {letters} || ' ' || {upper}", 1),
        (f"{upper} || ' {{\"' || {name} || '\":\"' || {letters} || '\"}} ' || {upper}", 1),
        # Prose, code and placeholders.
        *[(f"{upper} || ' the ' || {name} || ' ' || {prose} || ' {more} ' || {upper}", 0) for more in ("and", "of it,", "is here.")],
        (f"{upper} || ' ' || {name} || ', ' || {prose} || ': ' || {prose2} || ' ' || {upper}", 0),
        (f"{upper} || ' ' || {name} || ': ' || {prose} || ' ' || {prose2} || '. ' || {upper}", 0),
        (f"{upper} || ' ' || {name} || ' is ' || {prose} || '. ' || {upper}", 0),
        (f"{upper} || ' the ' || {name} || ' was ' || {prose} || ' ' || {prose2} || ' ' || {upper}", 0),
        (f"{upper} || ' ' || {name} || ' ' || id % 100 || ' ' || {prose} || ' ' || {upper}", 0),
        (f"{upper} || ' ' || {name} || ' = ' || {holder} || ' ' || {upper}", 0),
        (f"{name} || '=\"' || {holder} || '\" ' || {upper}", 0),
        (f"{upper} || ' ' || {name} || ': ' || {holder} || '\n' || {upper}", 0),
        (f"{upper} || ' ' || {long} || ' ' || {upper}", 0),
        (f"{upper} || ' ' || initcap({long}) || '. ' || {upper}", 0),
        *[(f"{upper} || ' ' || {case}(left({x}, 20)) || ' ' || {upper}", 0) for case in ("lower", "initcap", "upper") for x in (letters, long)],
        (f"upper({upper} || ' ' || {long} || '. ' || {upper})", 0),
        (f"{upper} || ' ' || concat_ws('-', {prose}, {prose2}, {prose}, {prose2}) || ' ' || {upper}", 0),
        (f"{upper} || ' ' || concat_ws('/', {prose}, {prose2}, 'main', {prose}) || '.java ' || {upper}", 0),
        (f"{upper} || ' get' || initcap({prose}) || initcap({prose2}) || 'Manager' || initcap({prose}) || '() ' || {upper}", 0),
        (f"{upper} || ' ' || upper(concat_ws('_', {prose}, {prose2}, {prose}, 'default')) || ' ' || {upper}", 0),
        (f"{upper} || ' www.' || {prose} || {prose2} || '.example.com/' || {prose} || ' ' || {upper}", 0),
    ]
    one = F.explode(F.array(*[F.struct(F.expr(x).alias("text"), F.lit(float(y)).alias("label")) for x, y in kinds])).alias("x")
    made = spark.range(first, first + n, 1, 1).select("id", *[F.expr(x).alias(k) for k, x in digests.items()]).select("*", *[F.expr(x).alias(k) for k, x in parts.items()])
    return made.select(one).select("x.*")


def assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(found))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest from labelled findings: texts that hold a candidate each, and whether it is a secret."""
    found = candidates(labelled.select(F.struct("label").alias("doc_id"), "text"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=2).fit(assembled(found).select("features", F.col("doc_id.label").alias("label")))


def findings(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with its probability of being a secret and the verdict."""
    p: Column = F.round(vector_to_array("probability")[1], 9)
    return model.transform(assembled(candidates(docs))).select("doc_id", "ordinal", "start", "value", "before", "after", p.alias("probability"), (p >= threshold).alias("is_secret"))


#: Broadcast the places of secrets up to so many bytes, else join by a shuffle.
BROADCAST_BYTES = 32 << 20


def places(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """__key (a digest of the text, as rows may have no doc_id or one with other texts) and __places (start and end of each secret) of the texts with secrets, stored."""
    found = findings(docs.select(F.md5("text").alias("doc_id"), "text"), model, threshold).filter("is_secret")
    place = F.struct("start", (F.col("start") + F.length("value")).cast("long").alias("end"))
    # One text's own places meet here; those of its copies are the same.
    return checkpointed(found.groupBy(F.col("doc_id").alias("__key")).agg(F.collect_set(place).alias("__places")))


def redacted(docs: DataFrame, model: RandomForestClassificationModel, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with each secret replaced by a mark at its place; n_chars, where there is one, follows. The same string elsewhere stays if the model judges it no secret there."""
    return marked(docs, places(docs, model, threshold), mark)


def marked(docs: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    """docs with a mark in place of found places(); `found` is stored."""
    keyed = docs.withColumn("__key", F.md5("text"))
    size = found.agg(F.sum(64 + 32 * F.size("__places"))).first()[0] or 0
    joined = keyed.join(F.broadcast(found), "__key", "left") if size <= BROADCAST_BYTES else salted_join(keyed, found, "__key", "doc_id", "left")

    # Findings may overlap; what overlaps gets one mark.
    def cut(acc: Column, x: Column) -> Column:
        before = F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when((acc["at"] > 0) & (x["start"] < acc["at"]), acc["kept"]).otherwise(F.concat(acc["kept"], before)).alias("kept"))

    def whole(acc: Column) -> Column:
        return F.array_join(F.concat(acc["kept"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))), mark)

    clean = F.col("__places").isNull()
    text = F.when(clean, F.col("text")).otherwise(F.aggregate(F.array_sort("__places"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("kept")), cut, whole))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), train(labelled_findings(spark))).drop("before", "after")
