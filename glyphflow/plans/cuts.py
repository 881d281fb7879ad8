"""Where a text may be cut without changing what a map makes of it.

A character that no rule takes, makes or looks for, and that is no letter or mark, is to every
rule what the end of a text is: at its sides nothing matches that wouldn't match there
anyway. So what stands between two such characters can be converted on its own: words,
of which a corpus holds the same ones again and again, or pieces of a text that
is too long for one task.
"""

from __future__ import annotations

import re

from .compiler import Delete, Replace, Step, Table
from .fusion import Fused
from .patterns import char_class

#: What may separate: characters of ASCII that are no letters.
SEPARATORS = [chr(c) for c in range(128) if not chr(c).isalpha()]
#: Aliases that are the same beside a separator and at the end of a text.
LOCAL_ALIASES = {"none", "alpha", "boundary", "non_word_boundary"}
LOCAL_FUNCTIONS = {"downcase", "upcase"}


def mentioned(step: Step) -> set[str] | None:
    """The characters that a step may take, make or look for; None if it may see others, or an end of the text."""
    if isinstance(step, Delete):
        return set(step.characters)
    if isinstance(step, Table):
        return set("".join(step.pairs)) | set("".join(step.pairs.values()))
    if isinstance(step, Fused):
        return set().union(*[x.taken | x.seen | set(x.value) for x in step.rules])
    if not isinstance(step, Replace):
        return None
    local = not step.shape.can_be_empty and step.shape.aliases <= LOCAL_ALIASES and (step.function is None or step.function_name in LOCAL_FUNCTIONS)
    # References past the groups are the place and the text.
    if not local or any(int(n) > step.shape.groups for n in re.findall(r"\$(\d+)", step.template)):
        return None
    return step.shape.characters | set(step.template)


def separators(steps: list[Step]) -> str | None:
    """A class of characters at whose sides a text may be cut for these steps, the blank among them; None if there is none."""
    known = [mentioned(s) for s in steps]
    if None in known:
        return None
    free = [c for c in SEPARATORS if not any(c in x for x in known)]
    return char_class(free) if " " in free else None
