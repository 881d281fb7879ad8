"""Builders of maps in code, and maps that come with the package."""

from __future__ import annotations

from typing import Any

from .plans.model import ScriptMap

Item = dict[str, Any]


def text(value: str) -> Item:
    return {"kind": "string", "value": value}


def item(x: str | Item) -> Item:
    return text(x) if isinstance(x, str) else x


def alias(name: str) -> Item:
    return {"kind": "alias", "name": name}


def any_of(*xs: str | Item) -> Item:
    return {"kind": "any", "of": [item(x) for x in xs]}


def group(*xs: str | Item) -> Item:
    return {"kind": "group", "items": [item(x) for x in xs]}


def captured(x: str | Item) -> Item:
    return {"kind": "capture_group", "data": item(x)}


def reference(n: int) -> Item:
    return {"kind": "capture_ref", "id": n}


def repeated(x: str | Item, low: int, high: int | None) -> Item:
    return {"kind": "repeat", "item": item(x), "min": low, "max": high}


def inline(name: str) -> Item:
    return {"kind": "funcall_inline", "name": name}


def sub(source: str | Item, to: str | Item | None = None, **around: str | Item) -> dict:
    """around: before, after, notBefore, notAfter."""
    return {"kind": "sub", "from": item(source), **({} if to is None else {"to": item(to)}), **{k: item(x) for k, x in around.items()}}


def run(stage: str = "main", code: str | None = None) -> dict:
    return {"kind": "run", "stage": stage, **({"docName": code} if code else {})}


def call(name: str, **options: Any) -> dict:
    return {"kind": "funcall", "name": name, "kwargs": options}


def parallel(*rules: dict, **pairs: str) -> dict:
    return {"kind": "parallel", "rules": [*rules, *[sub(k, v) for k, v in pairs.items()]]}


def sequential(*rules: dict) -> dict:
    return {"kind": "sequential", "rules": list(rules)}


def script_map(code: str, *rules: dict, dependencies: tuple[str, ...] = (), aliases: dict | None = None, functions: dict | None = None, **stages: list[dict]) -> ScriptMap:
    """A map whose stage main has these rules; further stages by name."""
    all_stages = [{"kind": "stage", "name": "main", "rules": list(rules)}, *[{"kind": "stage", "name": k, "rules": x} for k, x in stages.items()]]
    return ScriptMap(code, list(dependencies), all_stages, aliases or {}, functions or {})


# The Ukrainian national romanisation of 1996, letter by letter, lower case.
UKRAINIAN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sch", "ю": "iu", "я": "ia", "ь": "’",
}
# At the start of a word; й in lower case isn't among them.
UKRAINIAN_INITIAL = {"Є": "Ye", "є": "ye", "Ї": "Yi", "ї": "yi", "Й": "Y", "Ю": "Yu", "ю": "yu", "Я": "Ya", "я": "ya"}
# German umlauts, as in the romanisation of 2000.
GERMAN = {"Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ä": "ae", "ö": "oe", "ü": "ue"}
# Tamil by the UN system of 1972: consonants (without a vowel sign they have the vowel a), vowels and vowel signs.
TAMIL_CONSONANTS = {
    "க": "k", "ங": "ṅ", "ச": "ch", "ஞ": "ñ", "ட": "ṭ", "ண": "ṇ", "த": "t", "ந": "n", "ப": "p", "ம": "m", "ய": "y", "ர": "r", "ல": "l", "வ": "v",
    "ழ": "l̮", "ள": "ḷ", "ற": "ṟ", "ன": "ṉ", "ஜ": "j", "ஶ": "sh", "ஷ": "ṣh", "ஸ": "s", "ஹ": "h",
}
TAMIL_VOWELS = {"அ": "a", "ஆ": "ā", "இ": "i", "ஈ": "ī", "உ": "u", "ஊ": "ū", "எ": "ĕ", "ஏ": "e", "ஐ": "ai", "ஒ": "ŏ", "ஓ": "o", "ஔ": "au", "ஃ": "ḥ"}
TAMIL_SIGNS = {"ா": "ā", "ி": "i", "ீ": "ī", "ு": "u", "ூ": "ū", "ெ": "ĕ", "ே": "e", "ை": "ai", "ொ": "ŏ", "ோ": "o", "ௌ": "au", "்": ""}
TAMIL_OTHERS = {
    "க்ஷ": "kṣha", "ற்ற": "ṟṟa", "ன்ற": "ṉṟa",
    "௦": "0", "௧": "1", "௨": "2", "௩": "3", "௪": "4", "௫": "5", "௬": "6", "௭": "7", "௮": "8", "௯": "9", "௰": "10", "௱": "100", "௲": "1000",
    "\u200c": "", "\u200d": "",
}
# End of fixed values.


def ukrainian() -> list[ScriptMap]:
    """Ukrainian by the systems of 1996, 2010, 2012 (UN) and 2019 (BGN/PCGN), each by way of the one before."""
    apostrophe, first = "’", alias("boundary")
    table = {k.upper(): v[:1].upper() + v[1:] for k, v in UKRAINIAN.items()} | UKRAINIAN
    initial = [sub(group(first, k), v, notBefore=group(first, apostrophe)) for k, v in UKRAINIAN_INITIAL.items()]
    old = script_map(
        "ua-ukr-Cyrl-Latn-1996",
        *[sub(k, v, before=any_of("З", "з")) for k, v in (("Г", "Gh"), ("г", "gh"))],
        *initial,
        sub(group(first, apostrophe, first), "”"),
        parallel(**table),
    )
    new = script_map(
        "ua-ukr-Cyrl-Latn-2010",
        sub("'", ""),
        sub(apostrophe, ""),
        parallel(**{"Ґ": "G", "ґ": "g", "Щ": "Shch", "щ": "shch", "ь": "", "Ь": "", "'": "", apostrophe: ""}),
        run(code=old.system_code),
        dependencies=(old.system_code,),
    )
    un = script_map("un-ukr-Cyrl-Latn-2012", run(code=new.system_code), dependencies=(new.system_code,))
    bgn = script_map("bgnpcgn-ukr-Cyrl-Latn-2019", run(code=un.system_code), parallel(**{"'": ""}), dependencies=(un.system_code,))
    return [old, new, un, bgn]


def tamil() -> ScriptMap:
    """Tamil by the UN system of 1972: a consonant before a vowel sign loses its vowel, all others keep it."""
    signed = [sub(k, v, after=alias("sign")) for k, v in TAMIL_CONSONANTS.items()]
    alone = {k: v + "a" for k, v in TAMIL_CONSONANTS.items()}
    return script_map("un-tam-Taml-Latn-1972", *signed, parallel(**alone, **TAMIL_VOWELS, **TAMIL_SIGNS, **TAMIL_OTHERS), call("compose"), aliases={"sign": any_of(*TAMIL_SIGNS, "◌")})


def bundled() -> dict[str, ScriptMap]:
    return {m.system_code: m for m in (*ukrainian(), tamil(), script_map("deu-Latn-Latn-2000", parallel(**GERMAN)))}
