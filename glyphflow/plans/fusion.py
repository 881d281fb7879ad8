"""Which rules feed which, and neighbouring rules without any such bond as one step.

Rules run one after another over the whole text. A later rule sees what earlier ones made
or took away: where an earlier rule's matches and values share no character with what
the later one looks for or looks at, the two don't know of each other, and one pass with both as
alternatives gives what two passes do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from .patterns import char_class, regexp_escape

if TYPE_CHECKING:
    from .compiler import Step

#: Fewer rules aren't fused: a pass of each costs less. Rules without context run as plain replacements, several times as fast.
LEAST, LEAST_PLAIN = 3, 16
AROUND = {"before": "(?<={})", "notBefore": "(?<!{})", "after": "(?={})", "notAfter": "(?!{})"}


@dataclass(frozen=True)
class Facts:
    """All that a rule looks for, looks at and puts, where these are plain strings."""

    sources: tuple[str, ...]
    value: str
    around: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def taken(self) -> frozenset[str]:
        return frozenset("".join(self.sources))

    @property
    def seen(self) -> frozenset[str]:
        return frozenset("".join("".join(x) for _, x in self.around))

    @property
    def single(self) -> bool:
        return all(len(x) == 1 for x in self.sources)


@dataclass
class Fused:
    """Rules that don't feed each other, in one pass: each match by the value of its string."""

    pattern: str
    values: dict[str, str]
    rules: list[Facts] = field(default_factory=list)


def feeds(first: Facts, then: Facts) -> bool:
    """Whether what `first` does may make, break or move a match of `then`."""
    made = frozenset(first.value)
    if made & (then.taken | then.seen) or first.taken & then.seen:
        return True
    # Both may start at one character: the first has it, as in one pass. Longer matches could overlap.
    if first.taken & then.taken and not (first.single and then.single):
        return True
    # What is deleted brings together what stood around it.
    return not first.value and not (then.single and not then.around)


def feeding(rules: list[Facts]) -> list[list[int]]:
    """Of each rule, the earlier ones that feed it."""
    return [[i for i in range(k) if feeds(rules[i], x)] for k, x in enumerate(rules)]


def one_step(rules: list[Facts]) -> Fused:
    """The rules as alternatives; those in a row with the same context share it."""
    parts: list[tuple[tuple, list[str]]] = []
    for r in rules:
        if parts and parts[-1][0] == r.around:
            parts[-1][1].extend(x for x in r.sources if x not in parts[-1][1])
        else:
            parts.append((r.around, list(r.sources)))

    def alternatives(strings) -> str:
        return (char_class(strings) if len(strings) > 1 else regexp_escape(strings[0])) if all(len(x) == 1 for x in strings) else f"(?:{'|'.join(map(regexp_escape, strings))})"

    pattern = []
    for around, sources in parts:
        form = {k: AROUND[k].format(alternatives(x)) for k, x in around}
        pattern.append(form.get("before", "") + form.get("notBefore", "") + alternatives(sources) + form.get("after", "") + form.get("notAfter", ""))
    return Fused("|".join(pattern), {x: r.value for r in reversed(rules) for x in r.sources}, rules)


def fuse(steps: list[Step]) -> list[Step]:
    """Neighbouring rules that don't feed each other as one step, where that saves passes."""
    out: list[Step] = []
    run: list[Step] = []

    def flush() -> None:
        facts = [s.facts for s in run]
        plain = not any(x.around for x in facts)
        out.extend(run if len(run) < (LEAST_PLAIN if plain else LEAST) else [one_step(facts)])
        run.clear()

    values: dict[str, str] = {}
    for s in steps:
        own = getattr(s, "facts", None)
        if own is None:
            flush()
            values = {}
            out.append(s)
            continue
        # A match is looked up by its string: one string, one value.
        if any(feeds(x.facts, own) for x in run) or any(values.get(x, own.value) != own.value for x in own.sources):
            flush()
            values = {}
        run.append(s)
        values |= dict.fromkeys(own.sources, own.value)
    flush()
    return out
