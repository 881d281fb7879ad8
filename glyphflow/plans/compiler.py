"""From a map's stage to a flat list of steps: runs are inlined, dead rules dropped, neighbouring deletions fused."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import regex

from ..errors import MapLogicError, ScriptError
from ..sources.maps import MapLoader
from .fusion import Facts, Fused, fuse
from .model import ScriptMap
from .patterns import ANYTHING, Follow, Items, Shape, utf16_length


@dataclass
class Replace:
    """Every match of a pattern by a template ($n: groups), or by a function of the match."""

    pattern: str
    template: str
    shape: Shape
    #: The plain string that is all of the pattern, if it is one.
    plain: str | None = None
    look_behind_unbounded: bool = False
    function: Callable | None = None
    function_name: str = ""
    #: What the rule is made of, if that is plain strings.
    facts: Facts | None = None


@dataclass
class Table:
    """The longest key at each place by its value, from left to right, without looking at values again."""

    pairs: dict[str, str]


@dataclass
class Delete:
    """All of these characters away."""

    characters: str


@dataclass
class Call:
    """A function of the whole text."""

    name: str
    options: dict[str, Any] = field(default_factory=dict)
    function: Callable | None = None


Step = Replace | Table | Delete | Call | Fused


class Compiler:
    def __init__(self, loader: MapLoader | None = None):
        self.loader = loader

    def stage(self, found: ScriptMap, name: str) -> list[Step]:
        """The steps of a stage; a stage that isn't there has none."""
        rules = found.rules(name)
        return [] if rules is None else fuse(fused(self.rules(found, rules, ((found.system_code, name),))))

    def rules(self, found: ScriptMap, rules: list[dict], path: tuple) -> list[Step]:
        items = Items(self.aliases(found))
        out: list[Step] = []
        for rule in rules:
            kind = rule["kind"]
            if kind == "sub":
                out.append(self.sub(found, rule, items))
            elif kind == "run":
                out += self.run(found, rule, path)
            elif kind == "funcall":
                out.append(self.call(found, rule))
            elif kind == "parallel":
                out += self.parallel(found, rule, items)
            elif kind == "sequential":
                out += self.rules(found, rule["rules"], path)
            else:
                raise MapLogicError(f"Unknown rule kind: {kind}")
        return out

    def aliases(self, found: ScriptMap) -> Callable[[str], dict | None]:
        """Own aliases, then those of direct dependencies, in order; dependencies that can't be loaded are passed over."""

        def resolve(name: str) -> dict | None:
            if name in found.aliases:
                return found.aliases[name]
            for code in found.dependencies if self.loader else ():
                try:
                    own = self.loader.load(code).aliases
                except ScriptError:
                    continue
                if name in own:
                    return own[name]
            return None

        return resolve

    def run(self, found: ScriptMap, rule: dict, path: tuple) -> list[Step]:
        target = found
        if rule.get("docName"):
            if self.loader is None:
                raise RuntimeError(f"No loader to resolve {rule['docName']}")
            target = self.loader.load(rule["docName"])
        rules, at = target.rules(rule["stage"]), (target.system_code, rule["stage"])
        if rules is None:
            raise MapLogicError(f"Stage not found: {rule['stage']}")
        if at in path:
            raise RecursionError(f"Stage runs itself: {at[0]}/{at[1]}")
        return self.rules(target, rules, (*path, at))

    def function(self, found: ScriptMap, name: str) -> Callable | None:
        from ..functions.text import BUILT_IN

        own = found.functions.get(name)
        return own if own is not None else BUILT_IN.get(name)

    def call(self, found: ScriptMap, rule: dict) -> Call:
        fn = self.function(found, rule["name"])
        if fn is None:
            raise MapLogicError(f"Unknown function: {rule['name']}")
        return Call(rule["name"], dict(rule.get("kwargs") or {}), fn)

    def sub(self, found: ScriptMap, rule: dict, items: Items) -> Replace:
        if not rule.get("from"):
            raise MapLogicError("Sub rule missing 'from'")
        shape, around = Shape(), Shape()
        parts, behind = [], False
        follow = Follow()
        if rule.get("notAfter"):
            follow = ANYTHING
        elif rule.get("after"):
            follow = Follow().before(items.strings(rule["after"]))
        for key, form, sure in (("before", "(?<={})", True), ("notBefore", "(?<!{})", False), ("from", "{}", True), ("after", "(?={})", True), ("notAfter", "(?!{})", False)):
            if not rule.get(key):
                continue
            empty, shape.unbounded = shape.can_be_empty, False
            if key == "from":
                shape.can_be_empty = True
            x = items.pattern(rule[key], shape, sure, follow if key == "from" else Follow())
            around.unbounded |= shape.unbounded and key in ("before", "notBefore")
            if key != "from":
                shape.can_be_empty = empty
            # A constraint without any pattern constrains nothing.
            parts += [form.format(x)] if x or key == "from" else []
            behind |= key in ("before", "notBefore")
        pattern = "".join(parts)
        try:
            regex.compile(pattern)
            if shape.back_references and max(shape.back_references) > shape.groups:
                raise regex.error("invalid group reference")
        except regex.error as e:
            raise MapLogicError(f"Invalid pattern compiled from rule: {pattern}", cause=e) from e
        to = rule.get("to")
        out = Replace(pattern, "", shape, look_behind_unbounded=around.unbounded)
        if to and to["kind"] == "funcall_inline":
            out.function, out.function_name = self.function(found, to["name"]), to["name"]
            if out.function is None:
                raise MapLogicError(f"Unknown inline function: {to['name']}")
        elif to:
            out.template = items.replacement(to)
        if not behind and not any(rule.get(k) for k in ("after", "notAfter")) and rule["from"]["kind"] == "string":
            out.plain = rule["from"]["value"]
        out.facts = self.facts(rule, items, out)
        return out

    def facts(self, rule: dict, items: Items, made: Replace) -> Facts | None:
        if made.function is not None or made.shape.groups or made.shape.back_references or re.search(r"\$\d", made.template):
            return None
        strings = {k: items.strings(rule[k]) for k in ("from", "before", "notBefore", "after", "notAfter") if rule.get(k)}
        if any(not x or "" in x or len(x) > 100 for x in strings.values()):
            return None
        return Facts(tuple(dict.fromkeys(strings.pop("from"))), made.template, tuple((k, tuple(dict.fromkeys(x))) for k, x in strings.items()))

    def parallel(self, found: ScriptMap, rule: dict, items: Items) -> list[Step]:
        pairs: dict[str, str] = {}
        bound, dropped = [], 0
        for inner in rule["rules"]:
            if inner["kind"] != "sub" or not inner.get("from"):
                dropped += 1
                continue
            if any(inner.get(k) for k in ("before", "after", "notBefore", "notAfter")):
                bound.append(inner)
                continue
            to = inner.get("to")
            value = "" if not to else None if to["kind"] == "funcall_inline" else items.literal(to)
            keys = None if value is None else items.alternatives(inner["from"])
            if keys is None:
                dropped += 1
                continue
            pairs.update((k, value) for k in keys if k)
        if dropped:
            warnings.warn(f"{found.system_code}: {dropped} rules of a parallel group have no effect", stacklevel=2)
        bound.sort(key=lambda r: -utf16_length(items.literal(r["from"]) or ""))
        return [*([Table(pairs)] if pairs else []), *[self.sub(found, r, items) for r in bound]]


def fused(steps: list[Step]) -> list[Step]:
    """Deletions of single characters in a row become one."""
    out: list[Step] = []
    for s in steps:
        if isinstance(s, Replace) and s.plain and len(s.plain) == 1 and not s.template and s.function is None:
            s = Delete(s.plain)
        if isinstance(s, Table) and all(len(k) == 1 and not v for k, v in s.pairs.items()):
            s = Delete("".join(s.pairs))
        if isinstance(s, Delete) and out and isinstance(out[-1], Delete):
            out[-1] = Delete("".join(dict.fromkeys(out[-1].characters + s.characters)))
        else:
            out.append(s)
    return out
