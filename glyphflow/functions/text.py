"""String functions as Columns. Each takes a Column and options and returns a Column."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from typing import TYPE_CHECKING

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import texts

if TYPE_CHECKING:
    from ..operators.trie import CompiledTable


def column_function(fn: Callable) -> Callable:
    """Marks a function of (Column, options) that returns a Column, for use in maps made in memory."""
    fn.builds_column = True
    return fn


@column_function
def downcase(c: Column, options: Mapping | None = None) -> Column:
    return F.lower(c)


@column_function
def upcase(c: Column, options: Mapping | None = None) -> Column:
    return F.upper(c)


@column_function
def title_case(c: Column, options: Mapping | None = None) -> Column:
    """First character of each word in upper case, the rest in lower case; words are parted by the option wordSeparator."""
    sep = (options or {}).get("wordSeparator", " ")
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    if sep == "":
        return word(c)
    return F.array_join(F.transform(F.split(c, regex_quote(sep), -1), word), sep)


@column_function
def separate(c: Column, options: Mapping | None = None) -> Column:
    """The characters with the option separator between them."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), (options or {}).get("separator", " "))


def _normaliser(form: str) -> Callable:
    def normal(c: Column) -> Column:
        return texts(c, lambda: lambda x: unicodedata.normalize(form, x))

    return normal


@column_function
def compose(c: Column, options: Mapping | None = None) -> Column:
    return _normaliser("NFC")(c)


@column_function
def decompose(c: Column, options: Mapping | None = None) -> Column:
    return _normaliser("NFD")(c)


BUILT_IN: dict[str, Callable] = {"downcase": downcase, "upcase": upcase, "title_case": title_case, "separate": separate, "compose": compose, "decompose": decompose}


def regex_quote(text: str) -> str:
    from ..plans.patterns import regexp_escape

    return regexp_escape(text)


def regexp_escape(c: Column) -> Column:
    """Backslashes before the characters that are special in patterns."""
    return F.regexp_replace(c, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def levenshtein(a: Column, b: Column, *, utf16: bool = False) -> Column:
    """Edit distance in characters; with utf16 in UTF-16 units, which differ for characters beyond U+FFFF."""
    return F.levenshtein(utf16_units(a), utf16_units(b)) if utf16 else F.levenshtein(a, b)


def utf16_units(c: Column) -> Column:
    """A text with a character for each of its UTF-16 units: unit u is U+20000 + u. Texts up to U+FFFF alone are spelled so, too, as both sides of a distance must be."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    return F.decode(F.unhex(F.regexp_replace(units, "(....)", "0002$1")), "UTF-32")


def distance(a: str, b: str, *, utf16: bool = False) -> int:
    """levenshtein() of two strings, without Spark."""
    return edit_distance(_units(a), _units(b)) if utf16 else edit_distance(a, b)


def _units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def edit_distance(a: Sequence, b: Sequence) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def glob_matches(c: Column, pattern: str) -> Column:
    """Whether a whole text fits a pattern in which * stands for any characters of one line."""
    return c.rlike(glob_regex(pattern).replace(r"\Z", r"\z"))


def glob_regex(pattern: str) -> str:
    return "^" + ".*".join(regex_quote(x) for x in pattern.split("*")) + r"\Z"


def parallel_replace(c: Column, pairs: Sequence[tuple[str, str]] | Mapping[str, str] | CompiledTable, strategy: str = "auto") -> Column:
    """The longest key at each place by its value; of equal keys the last counts, empty ones are ignored. A compiled table is walked as it is."""
    from ..operators.rewrite import table_column
    from ..operators.trie import CompiledTable

    if isinstance(pairs, CompiledTable):
        return pairs.column(c)

    return table_column(c, {k: v for k, v in dict(pairs).items() if k}, strategy)


def parallel_single_pass(c: Column, pairs: Mapping[str, str], matchers: Sequence[tuple[str, str]] = ()) -> Column:
    """One pass with a table and patterns side by side: the longest match at each place, the table first on ties, then the first pattern.

    matchers: (pattern with any look-around, replacement). Ties by length are more than one alternation can say: an Arrow UDF.
    """
    return texts(c, lambda: single_pass(pairs, matchers))


#: What makes a match depend on where the search began, or start elsewhere than the search says: such patterns are tried place by place.
_PLACED = regex.compile(r"\\[GK]|\(\*|(?<!\\[pPNx])\{[^}]*[<a-z]")
_FLAGS = regex.REVERSE | regex.BESTMATCH | regex.ENHANCEMATCH | regex.POSIX
#: Keys up to which one alternation finds the next; of more, their first characters are looked for.
ALTERNATIVES = 64


def single_pass(pairs: Mapping[str, str], matchers: Sequence[tuple[str, str]] = ()) -> Callable[[str], str]:
    """parallel_single_pass() of one string. Each pattern's next match is searched for, and again only when the pass is beyond its start."""
    keys = {k: v for k, v in pairs.items() if k}
    # Functions of (text, place) that give the next match from there on, as start, end and value; the table's comes first.
    finders = ([_next_key(keys)] if keys else []) + [_next_match(regex.compile(p), r) for p, r in matchers]
    n = range(len(finders))

    def convert(text: str) -> str:
        out, i, end = [], 0, len(text)
        none = (end, end, "")
        found = [f(text, 0) or none for f in finders]
        while found:
            best = found[0]
            for x in found:
                if x[0] < best[0] or x[0] == best[0] and x[1] > best[1]:
                    best = x
            if best[0] >= end:
                break
            out.append(text[i : best[0]])
            out.append(best[2])
            i = best[1]
            for k in n:
                if found[k][0] < i:
                    found[k] = finders[k](text, i) or none
        out.append(text[i:])
        return "".join(out)

    return convert


def _next_key(keys: dict[str, str]) -> Callable[[str, int], tuple[int, int, str] | None]:
    if len(keys) <= ALTERNATIVES:
        search = re.compile("|".join(map(re.escape, sorted(keys, key=len, reverse=True)))).search

        def find(text: str, at: int) -> tuple[int, int, str] | None:
            m = search(text, at)
            return m and (m.start(), m.end(), keys[m[0]])

        return find
    sizes = sorted(set(map(len, keys)), reverse=True)
    start = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in keys}))) + "]").search

    def look(text: str, at: int) -> tuple[int, int, str] | None:
        while m := start(text, at):
            at = m.start()
            for n in sizes:
                # A slice that the text's end cuts short is a shorter key, which is found by its own size.
                if (value := keys.get(text[at : at + n])) is not None and at + n <= len(text):
                    return at, at + n, value
            at += 1
        return None

    return look


def _next_match(pattern: regex.Pattern, value: str) -> Callable[[str, int], tuple[int, int, str] | None]:
    if _PLACED.search(pattern.pattern) or pattern.flags & _FLAGS:

        def step(text: str, at: int) -> tuple[int, int, str] | None:
            while at < len(text):
                m = pattern.match(text, at)
                if m and m.end() > at:
                    return at, m.end(), value
                at += 1
            return None

        return step

    def find(text: str, at: int) -> tuple[int, int, str] | None:
        # An empty match is none.
        while (m := pattern.search(text, at)) and m.end() == m.start():
            at = m.end() + 1
            if at > len(text):
                return None
        return m and (m.start(), m.end(), value)

    return find
