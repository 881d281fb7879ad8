"""Items of rules as regular expressions and literals.

Patterns are written so that Java (Spark's functions) and Python's `regex` read them as
the map format means them: `.`, line edges and white space are spelled out, because the
engines differ there.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..errors import MapLogicError

Item = dict[str, Any]

LINE_ENDS = "\\n\\r\u2028\u2029"
WORD = r"\p{L}\p{M}"
LINE_START, LINE_END = f"(?<![^{LINE_ENDS}])", f"(?![^{LINE_ENDS}])"
SPACES = "[\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# The standard aliases as (pattern, literal).
ALIASES: dict[str, tuple[str, str]] = {
    "any_character": (f"[^{LINE_ENDS}]", ""),
    "none": ("", ""),
    "space": (" ", " "),
    "whitespace": (f"{SPACES}+", " "),
    "boundary": (rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))", ""),
    "non_word_boundary": (rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))", ""),
    "word": (r"\p{L}\p{N}_", ""),
    "not_word": (r"[^\p{L}\p{N}_]", ""),
    "alpha": (r"\p{L}", ""),
    "not_alpha": (r"\P{L}", ""),
    "digit": (r"\p{N}", ""),
    "not_digit": (r"\P{N}", ""),
    "line_start": (LINE_START, ""),
    "line_end": (LINE_END, ""),
    "string_start": (LINE_START, ""),
    "string_end": (LINE_END, ""),
}
# End of fixed values.

#: Aliases that match no character.
EMPTY_ALIASES = {"none", "boundary", "non_word_boundary", "line_start", "line_end", "string_start", "string_end"}


def regexp_escape(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text)


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def char_class(characters: Iterable[str]) -> str:
    """A class of single characters, for Java and Python."""
    return "[" + "".join("\\" + x if x in "\\[]^-&" else x for x in characters) + "]"


@dataclass
class Shape:
    """What a pattern holds, to decide which engine can run it."""

    groups: int = 0
    #: Groups that take part in every match.
    certain: set[int] = field(default_factory=set)
    unbounded: bool = False
    back_references: set[int] = field(default_factory=set)
    can_be_empty: bool = True
    #: A string that a text with any match holds.
    required: str = ""
    #: Whether Java would run a loop of it by recursion, as deep as the text is long.
    recursive: bool = False
    #: Characters and standard aliases that it names.
    characters: set[str] = field(default_factory=set)
    aliases: set[str] = field(default_factory=set)


#: Strings that an item may stand for are listed up to this number, to look for loops that need no way back.
LISTED = 1000
#: Java may recurse as often as this.
DEEP = 200


@dataclass(frozen=True)
class Follow:
    """What comes after an item: first characters of which one must follow (None: unknown), and whether nothing need follow."""

    first: frozenset[str] | None = frozenset()
    end: bool = True

    def before(self, strings: list[str] | None) -> Follow:
        """What comes after the item in front of one that stands for these strings."""
        if strings is None or self.first is None:
            return ANYTHING
        own = frozenset(x[0] for x in strings if x)
        return Follow(own | self.first, self.end) if "" in strings else Follow(own, False)


#: Nothing is known of what comes after.
ANYTHING = Follow(None, False)


def prefix_free(strings: list[str]) -> bool:
    """Whether a text can start with at most one of the strings, none of them empty."""
    order = sorted(set(strings))
    return "" not in order and not any(b.startswith(a) for a, b in itertools.pairwise(order))


def _characters(item: Item) -> list[str] | None:
    """The characters of alternatives that are single, different characters."""
    of = [x["value"] if x["kind"] == "string" and len(x["value"]) == 1 else None for x in item["of"]]
    return of if len(of) > 1 and None not in of and len(set(of)) == len(of) else None


class Items:
    """Compiles the items of one map. resolve: an alias's item, or None."""

    def __init__(self, resolve: Callable[[str], Item | None]):
        self.resolve = resolve
        self.open: list[str] = []

    def alias(self, name: str) -> Item | None:
        found = self.resolve(name)
        if found is not None and name in self.open:
            raise MapLogicError(f"Alias refers to itself: {name}")
        return found

    def _within(self, name: str, use: Callable[[Item], Any], item: Item) -> Any:
        self.open.append(name)
        try:
            return use(item)
        finally:
            self.open.pop()

    def strings(self, item: Item) -> list[str] | None:
        """All strings that an item matches, if they are few and plain; else None."""
        kind = item["kind"]
        if kind == "string":
            return [item["value"]]
        if kind == "stage_ref" or kind == "alias" and item["name"] == "none":
            return [""]
        if kind == "alias":
            if item["name"] in ALIASES:
                return [" "] if item["name"] == "space" else None
            found = self.alias(item["name"])
            return [""] if found is None else self._within(item["name"], self.strings, found)
        if kind in ("any", "group"):
            out = [] if kind == "any" else [""]
            for x in item["of" if kind == "any" else "items"]:
                own = self.strings(x)
                if own is None or (len(own) + len(out) if kind == "any" else len(own) * len(out)) > LISTED:
                    return None
                out = out + own if kind == "any" else [a + b for a in out for b in own]
            return out
        return None

    def loops(self, item: Item) -> bool:
        """Whether Java repeats the item without recursion: what it matches always has the same length, by one way."""
        kind = item["kind"]
        if kind == "alias" and item["name"] not in ALIASES:
            found = self.alias(item["name"])
            return found is None or self._within(item["name"], self.loops, found)
        if kind == "alias":
            return item["name"] not in ("whitespace", "boundary", "non_word_boundary")
        if kind == "any":
            return _characters(item) is not None or len(item["of"]) == 1 and self.loops(item["of"][0])
        if kind == "group":
            return all(map(self.loops, item["items"]))
        if kind == "capture_group":
            return self.loops(item["data"])
        if kind == "repeat":
            return item["min"] == item["max"] and self.loops(item["item"])
        return kind in ("string", "stage_ref")

    def repeated(self, item: Item, inner: str, shape: Shape, follow: Follow) -> str:
        """A repeated item. Java runs a loop over a group of varying length by recursion, unless it is possessive; it is made so where giving back can't help."""
        low, high = item["min"], item["max"]
        # Without an upper end, only "any number" and "one or more" exist.
        low, count = (low, f"{{{low},{high}}}") if high is not None else (0, "*") if low == 0 else (1, "+")
        if self.loops(item["item"]) or high is not None and high <= DEEP:
            return f"(?:{inner}){count}"
        strings = self.strings(item["item"])
        sure = strings is not None and prefix_free(strings)
        apart = sure and follow.first is not None and not follow.first & {x[0] for x in strings}
        # Where nothing need follow, a loop that needs one round at most is never gone back on.
        if strings is not None and "" not in strings and (follow.end and (low <= 1 or sure) or apart):
            return f"(?:{inner}){count}+"
        shape.recursive = True
        return f"(?:{inner}){count}"

    def pattern(self, item: Item, shape: Shape, certain: bool = True, follow: Follow = ANYTHING) -> str:
        kind = item["kind"]
        if kind == "string":
            shape.can_be_empty &= not item["value"]
            shape.characters.update(item["value"])
            if certain and len(item["value"]) > len(shape.required):
                shape.required = item["value"]
            return regexp_escape(item["value"])
        if kind == "capture_group":
            shape.groups += 1
            if certain:
                shape.certain.add(shape.groups)
            return f"({self.pattern(item['data'], shape, certain, follow)})"
        if kind == "capture_ref":
            shape.back_references.add(item["id"])
            return f"(?:\\{item['id']})"
        if kind == "alias":
            name = item["name"]
            if name in ALIASES:
                shape.can_be_empty &= name in EMPTY_ALIASES
                shape.unbounded |= name == "whitespace"
                shape.aliases.add(name)
                return ALIASES[name][0]
            found = self.alias(name)
            return "" if found is None else self._within(name, lambda x: self.pattern(x, shape, certain, follow), found)
        if kind == "any":
            parts, empty = [], not item["of"]
            before = shape.can_be_empty
            for x in item["of"]:
                shape.can_be_empty = True
                parts.append(self.pattern(x, shape, False, follow))
                empty |= shape.can_be_empty
            shape.can_be_empty = before and empty
            own = _characters(item)
            return f"(?:{'|'.join(parts)})" if own is None else char_class(own)
        if kind == "group":
            after = [follow]
            for x in item["items"][:0:-1]:
                after.append(after[-1].before(self.strings(x)))
            return f"(?:{''.join([self.pattern(x, shape, certain, f) for x, f in zip(item['items'], after[::-1], strict=False)])})"
        if kind == "repeat":
            before = shape.can_be_empty
            # Another round may come after what is in the loop.
            inner = self.pattern(item["item"], shape, certain and item["min"] > 0, ANYTHING)
            if item["min"] == 0:
                shape.can_be_empty = before
            shape.unbounded |= item["max"] is None
            return self.repeated(item, inner, shape, follow)
        if kind == "stage_ref":
            return ""
        raise MapLogicError(f"Unknown item kind: {kind}")

    def replacement(self, item: Item) -> str:
        """What stands for an item in the replacement of a rule that runs on its own; $n are references."""
        kind = item["kind"]
        if kind == "string":
            return item["value"]
        if kind == "capture_group":
            return self.replacement(item["data"])
        if kind == "capture_ref":
            return f"${item['id']}"
        if kind == "alias":
            if item["name"] in ALIASES:
                return ALIASES[item["name"]][1]
            found = self.alias(item["name"])
            return "" if found is None else self._within(item["name"], self.replacement, found)
        if kind == "group":
            return "".join(map(self.replacement, item["items"]))
        if kind in ("any", "repeat", "stage_ref"):
            return ""
        raise MapLogicError(f"Unknown item kind: {kind}")

    def literal(self, item: Item) -> str | None:
        """The one string that an item stands for in a table, or None."""
        kind = item["kind"]
        if kind == "string":
            return item["value"]
        if kind == "alias":
            if item["name"] in ALIASES:
                return ALIASES[item["name"]][1] or None
            found = self.alias(item["name"])
            return None if found is None else self._within(item["name"], self.literal, found)
        if kind == "any":
            return self.literal(item["of"][0]) if item["of"] else None
        if kind == "group":
            parts = [self.literal(x) for x in item["items"]]
            return None if None in parts else "".join(parts)
        return None

    def alternatives(self, item: Item) -> list[str] | None:
        """All strings that an item stands for in a table, or None."""
        kind = item["kind"]
        if kind == "string":
            return [item["value"]]
        if kind == "alias":
            found = None if item["name"] in ALIASES else self.alias(item["name"])
            return None if found is None else self._within(item["name"], self.alternatives, found)
        if kind in ("any", "group"):
            parts = [self.alternatives(x) for x in item["of" if kind == "any" else "items"]]
            if None in parts:
                return None
            return list(itertools.chain(*parts)) if kind == "any" else ["".join(x) for x in itertools.product(*parts)]
        return None
