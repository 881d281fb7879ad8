"""Steps as Columns.

Native forms come first: translate and replace for tables whose keys and values don't
meet, tokens and a map literal for other small tables, regexp_replace for patterns, tokens between
their matches for fused rules. Larger tables are walked as a trie in an Arrow UDF. Arrow UDFs also
take the rest: templates that refer to groups which may be unset or absent, look-behind
without bounds, back references to unset groups, and functions given in Python. Maps of
very many rules take one Arrow UDF for all their steps, as an expression that nests
hundreds of times can't be analysed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import text_lists, texts
from ..functions.text import BUILT_IN
from ..plans.compiler import Call, Delete, Fused, Replace, Step, Table
from ..plans.cuts import separators
from ..plans.fusion import Facts
from ..plans.patterns import char_class, prefix_free, regexp_escape, utf16_length
from .trie import CompiledTable, walker

REFERENCE = regex.compile(r"\$(\d+)")
STRATEGIES = ("auto", "native", "arrow")


#: Guarded steps and steps that one expression may nest. Analysis fails somewhat above 40 guarded steps and above 300 others.
GUARDED, NESTED = 24, 150


#: Keys from which on a trie is faster than tokens found by alternatives, and values of several characters than a replacement each: about where
#: both took the same time on 25 MB, 8 cores.
TOKENS, REPLACEMENTS = 16, 20
#: Characters up to which a replacement each is faster than translate, which takes about as long as ten replacements.
FEW = 8


#: About what a step costs, in passes of a replacement (5 CPU seconds a GB), as measured; and what converting each word once in an Arrow UDF costs.
REGEX, TRANSLATE, TOKENIZE, IN_ARROW, WORDS = 4, 8, 14, 25, 45
#: Words that a task keeps, and the characters up to which it keeps one.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64
#: Characters of texts whose new words are converted together.
TOGETHER = 1 << 20


def cost(step: Step) -> int:
    if isinstance(step, Delete):
        return min(len(step.characters), TRANSLATE)
    if isinstance(step, Table):
        # Values of several characters are put in where they are frequent: such a pass takes twice as long.
        many = sum(len(v) > 1 for v in step.pairs.values())
        return min(min(len(step.pairs) - many, TRANSLATE) + 2 * many if disjoint(step.pairs) else TOKENIZE + len(step.pairs) // 2, IN_ARROW)
    if isinstance(step, Fused):
        return TOKENIZE
    if not is_native(step):
        return IN_ARROW
    # Most texts skip a rule that needs a string they don't hold.
    return 1 if step.plain or step.shape.required else REGEX


def is_guarded(step: Step) -> bool:
    """Whether the step's Column holds a lambda: a test for a required string, or a value for each match of fused rules."""
    return isinstance(step, Fused) or isinstance(step, Replace) and step.function is None and bool(step.shape.required) and is_native(step) and not (step.plain and not REFERENCE.search(step.template))


def in_python(step: Step) -> bool:
    """Whether python_step() can do the step; functions that build Columns are known to it only if built in."""
    fn, name = (step.function, step.name) if isinstance(step, Call) else (step.function, step.function_name) if isinstance(step, Replace) else (None, "")
    return fn is None or not getattr(fn, "builds_column", False) or BUILT_IN.get(name) is fn


def apply_steps(c: Column, steps: list[Step], strategy: str = "auto") -> Column:
    if strategy == "auto":
        # Runs of steps that know words apart from each other: costly ones convert each word once.
        for local, own in groupby(steps, lambda s: separators([s]) is not None):
            own = list(own)
            between = separators(own) if local and sum(map(cost, own)) >= WORDS else None
            c = word_steps(c, own, between) if between else nested_steps(c, own, strategy)
        return c
    return nested_steps(c, steps, strategy)


def nested_steps(c: Column, steps: list[Step], strategy: str) -> Column:
    """A Column a step, as long as one expression can nest them."""
    if sum(map(is_guarded, steps)) <= GUARDED and len(steps) <= NESTED:
        for s in steps:
            c = apply_step(c, s, strategy)
        return c
    for python, own in groupby(steps, in_python):
        if python:
            c = arrow_steps(c, list(own))
        else:
            for s in own:
                c = apply_step(c, s, strategy)
    return c


def by_words(convert: Callable[[str], str], between: str) -> Callable[[list[str | None]], list[str | None]]:
    """convert() of texts by their words, each new one once and the new ones of many texts together; `between`: the characters that part words, the blank among them."""
    # What separates is kept, at odd places.
    split, known = re.compile(f"({between}+)").split, {}

    def some(texts: list[str | None]) -> Iterator[str | None]:
        parts = [None if x is None else split(x) for x in texts]
        words = {w for p in parts if p for w in p[::2]}
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(words)
        if new:
            known.update(zip(new, convert(" ".join(new)).split(" "), strict=True))
        for p in parts:
            if p:
                p[::2] = map(known.__getitem__, p[::2])
            yield None if p is None else "".join(p)
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]

    def own(texts: list[str | None]) -> list[str | None]:
        out, at, size = [], 0, 0
        for i, x in enumerate(texts, 1):
            size += len(x or "")
            if size > TOGETHER or i == len(texts):
                out += some(texts[at:i])
                at, size = i, 0
        return out

    return own


def word_steps(c: Column, steps: list[Step], between: str) -> Column:
    """All steps in one Arrow UDF that converts each word once a task."""

    return text_lists(c, lambda: by_words(python_steps(steps), between))


def arrow_steps(c: Column, steps: list[Step]) -> Column:
    """All steps in one Arrow UDF: a text crosses to Python once, however many rules there are."""
    return texts(c, lambda: python_steps(steps))


def apply_step(c: Column, step: Step, strategy: str = "auto") -> Column:
    if isinstance(step, Delete):
        return translated(c, dict.fromkeys(step.characters, ""))
    if isinstance(step, Table):
        return table_column(c, step.pairs, strategy)
    if isinstance(step, Call):
        return call_column(c, step.function, step.options)
    if isinstance(step, Fused):
        return fused_column(c, step)
    return replace_column(c, step)


def translated(c: Column, pairs: dict[str, str]) -> Column:
    """Single characters by one or none, where no value is a key."""
    if len(pairs) > FEW:
        # What translate has no partner for, it deletes.
        ones = {k: v for k, v in pairs.items() if v}
        return F.translate(c, "".join(ones) + "".join(k for k, v in pairs.items() if not v), "".join(ones.values()))
    for k, v in pairs.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def fused_column(c: Column, step: Fused) -> Column:
    """The parts between matches and the matches' values, joined. Texts without a match stay as they are."""
    if all(len(k) == len(v) == 1 for k, v in step.values.items()):
        value = lambda m: F.translate(m, "".join(step.values), "".join(step.values.values()))
    else:
        value = lambda m: F.try_element_at(literal_map(step.values), m)

    def replaced(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(step.pattern), F.lit(0))
        return F.array_join(F.zip_with(F.split(x, step.pattern, -1), found, lambda b, m: F.concat(b, F.coalesce(value(m), F.lit("")))), "")

    return F.transform(F.array(c), replaced)[0]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def call_column(c: Column, fn: Callable, options: dict | None = None) -> Column:
    if getattr(fn, "builds_column", False):
        return fn(c, options or {})

    return texts(c, lambda: lambda x: fn(x, options or {}))


def disjoint(pairs: dict[str, str]) -> bool:
    """Whether keys are single characters that no value holds: then their order doesn't matter."""
    values = set("".join(pairs.values()))
    return all(len(k) == 1 and k not in values for k in pairs)


def table_column(c: Column, pairs: dict[str, str], strategy: str = "auto") -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if not pairs:
        return c
    single = disjoint(pairs)
    if strategy == "auto":
        # A pass a value of several characters, or one alternative after another, grows with the table.
        strategy = "native" if sum(len(v) > 1 for v in pairs.values()) <= REPLACEMENTS and single or len(pairs) <= TOKENS else "arrow"
    if strategy == "arrow":
        return CompiledTable(pairs).column(c)
    if single:
        c = translated(c, {k: v for k, v in pairs.items() if len(v) <= 1})
        for k, v in pairs.items():
            if len(v) > 1:
                c = F.replace(c, F.lit(k), F.lit(v))
        return c
    keys = sorted(pairs, key=len, reverse=True)
    first = char_class(sorted({k[0] for k in pairs}))
    # Runs of characters that start no key are one token.
    tokens = F.regexp_extract_all(c, F.lit(f"(?s)(?:{'|'.join(map(regexp_escape, keys))}|[^{first[1:]}+|.)"), F.lit(0))
    table = literal_map(pairs)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def java_template(step: Replace) -> str | None:
    """The template in Java's form, or None if only the UDF gives what it means."""
    out, at = "", 0
    quote = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    for m in REFERENCE.finditer(step.template):
        n = int(m[1])
        if n and n not in step.shape.certain:
            return None
        out += quote(step.template[at : m.start()]) + f"${n}"
        at = m.end()
    return out + quote(step.template[at:])


def is_native(step: Replace) -> bool:
    known = step.shape.back_references <= step.shape.certain
    return known and not step.look_behind_unbounded and not step.shape.recursive and (step.function is not None or java_template(step) is not None)


def replace_column(c: Column, step: Replace) -> Column:
    if step.function is not None:
        builds = getattr(step.function, "builds_column", False)
        if builds and is_native(step) and not step.shape.can_be_empty:
            between, found = F.split(c, step.pattern, -1), F.regexp_extract_all(c, F.lit(step.pattern), F.lit(0))
            return F.array_join(F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(step.function(m, {}), F.lit("")))), "")
        return _replace_arrow(c, step)
    if step.plain and not REFERENCE.search(step.template):
        return F.replace(c, F.lit(step.plain), F.lit(step.template))
    if is_native(step):
        replaced = lambda x: F.regexp_replace(x, step.pattern, java_template(step))
        if not step.shape.required:
            return replaced(c)
        # Texts without a string that every match holds skip the pattern; the lambda keeps the expression from doubling with each step.
        return F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(step.shape.required)), replaced(x)).otherwise(x))[0]
    return _replace_arrow(c, step)


#: Python forms of the built-in functions, for matches inside an Arrow UDF.
def _python_form(name: str) -> Callable[[str], str]:
    import unicodedata

    return {
        "downcase": str.lower,
        "upcase": str.upper,
        "title_case": lambda s: " ".join(w[:1].upper() + w[1:].lower() for w in s.split(" ")),
        "separate": " ".join,
        "compose": lambda s: unicodedata.normalize("NFC", s),
        "decompose": lambda s: unicodedata.normalize("NFD", s),
    }[name]


def python_steps(steps: list[Step]) -> Callable[[str], str]:
    """The steps as a function of one string."""
    own = [python_step(s) for s in steps]

    def convert(text: str) -> str:
        for f in own:
            text = f(text)
        return text

    return convert


def python_step(step: Step) -> Callable[[str], str]:
    if isinstance(step, Delete):
        gone = str.maketrans("", "", step.characters)
        return lambda x: x.translate(gone)
    if isinstance(step, Table):
        return walker(step.pairs)
    if isinstance(step, Fused):
        each = [plain_pairs(r) for r in step.rules]
        if None not in each:
            return replacements([x for pairs in each for x in pairs])
        find, values = regex.compile(step.pattern).sub, step.values
        return lambda x: find(lambda m: values[m[0]], x)
    if isinstance(step, Call):
        if not getattr(step.function, "builds_column", False):
            return lambda x: step.function(x, step.options)
        if step.name == "title_case":
            sep = step.options.get("wordSeparator", " ")
            word = lambda w: w[:1].upper() + w[1:].lower()
            return lambda x: sep.join(map(word, x.split(sep))) if sep else word(x)
        return (lambda x: step.options.get("separator", " ").join(x)) if step.name == "separate" else _python_form(step.name)
    if isinstance(step, Replace) and step.facts is not None and (pairs := plain_pairs(step.facts)) is not None:
        return replacements(pairs)
    return _python_replace(step)


def replacements(pairs: list[tuple[str, str]]) -> Callable[[str], str]:
    def replaced(x: str) -> str:
        for a, b in pairs:
            x = x.replace(a, b)
        return x

    return replaced


def plain_pairs(rule: Facts) -> list[tuple[str, str]] | None:
    """A rule as plain replacements, context and all, if it means the same: its matches can't share their contexts, and nothing it makes is looked at again."""
    if len(rule.around) > 1 or rule.taken & rule.seen or set(rule.value) & (rule.taken | rule.seen) or not prefix_free(rule.sources):
        return None
    if not rule.around:
        return [(x, rule.value) for x in rule.sources] if len(rule.sources) == 1 or rule.single else None
    (key, strings), = rule.around
    if key not in ("before", "after") or not rule.value or not rule.single or len(strings) * len(rule.sources) > TOKENS:
        return None
    # A context that ends (or starts) another is the same place twice, but what it holds is replaced by then.
    return [(y + x, y + rule.value) if key == "before" else (x + y, rule.value + y) for x in rule.sources for y in strings]


def _python_replace(step: Replace) -> Callable[[str], str]:
    pattern, template, groups = step.pattern, step.template, step.shape.groups
    fn = None
    if step.function is not None:
        fn = _python_form(step.function_name) if getattr(step.function, "builds_column", False) else lambda x, f=step.function: f(x, {})

    def filled(m: regex.Match) -> str:
        def value(r: regex.Match) -> str:
            # Past the groups come the place of the match, in UTF-16 units, and the whole text.
            n = int(r[1])
            if 1 <= n <= groups:
                return m[0] if m[n] is None else m[n]
            return str(utf16_length(m.string[: m.start()])) if n == groups + 1 else m.string if n == groups + 2 else m[0]

        return REFERENCE.sub(value, template)

    # A reference to an unset group matches the empty string.
    for n in step.shape.back_references - step.shape.certain:
        pattern = pattern.replace(f"(?:\\{n})", f"(?({n})\\{n}|)")
    find, required = regex.compile(pattern).sub, step.shape.required
    put = (lambda m: fn(m[0])) if fn else template.replace("\\", "\\\\") if not REFERENCE.search(template) else filled
    # Texts without a string that every match holds skip the pattern.
    return lambda x: find(put, x) if required in x else x


def _replace_arrow(c: Column, step: Replace) -> Column:
    return texts(c, lambda: _python_replace(step))
