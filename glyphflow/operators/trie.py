"""Tables of any number of keys as a trie: compiled once, used in any number of Columns and for single strings.

A walk reads a text once, whatever the number of keys. Keys of one character are looked up
one by one. Else characters that start no key are
skipped in runs by a character class, and at others the trie is followed to the
longest key. Tails that belong to one key alone aren't spread over nodes: a leaf
holds its key, which is compared as a whole, so the trie has about as many nodes as keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column

from ..functions.arrow import texts

#: A node: characters to nodes or leaves (key, value), and "" to the leaf of the key that ends here.
Node = dict[str, "Node | tuple[str, str]"]


def build(pairs: Mapping[str, str]) -> Node:
    root: Node = {}
    for key, value in pairs.items():
        node, leaf = root, (key, value)
        for depth in range(len(key) + 1):
            at = key[depth : depth + 1]
            found = node.get(at)
            if found is None or at == "":
                node[at] = leaf
                break
            if isinstance(found, tuple):
                # A key stood alone here: it moves one node down.
                node[at] = below = {found[0][depth + 1 : depth + 2]: found}
                found = below
            node = found
    return root


def walker(pairs: Mapping[str, str]) -> Callable[[str], str]:
    """The longest key at each place by its value, as a function of one string."""
    if all(len(k) == 1 for k in pairs):
        each = str.maketrans(dict(pairs))
        return lambda text: text.translate(each)
    root = build(pairs)
    start = re.compile("[" + "".join(map(re.escape, sorted(root))) + "]").search

    def walk(text: str) -> str:
        out, at, size = [], 0, len(text)
        m = start(text)
        while m is not None:
            begin = m.start()
            if begin > at:
                out.append(text[at:begin])
            at = begin
            # Keys often stand in a row: the class is searched for only after a place without one.
            while at < size and (found := root.get(text[at])) is not None:
                best, i = None, at
                while found is not None:
                    if isinstance(found, tuple):
                        if text.startswith(found[0], at):
                            best = found
                        break
                    if (own := found.get("")) is not None:
                        best = own
                    i += 1
                    found = found.get(text[i]) if i < size else None
                if best is None:
                    out.append(text[at])
                    at += 1
                else:
                    out.append(best[1])
                    at += len(best[0])
            m = start(text, at)
        out.append(text[at:])
        return "".join(out)

    return walk


class CompiledTable:
    """A table of keys and values, compiled once: of equal keys the last counts, empty ones are ignored.

    convert() replaces in one string, column() in a Column, where the table is sent to each executor
    once and its trie is built once a task.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]] | Mapping[str, str]):
        self.pairs = {k: v for k, v in dict(pairs).items() if k}
        self._walk: Callable[[str], str] | None = None

    def __len__(self) -> int:
        return len(self.pairs)

    def convert(self, text: str) -> str:
        if self._walk is None:
            self._walk = walker(self.pairs)
        return self._walk(text)

    def column(self, c: Column) -> Column:
        pairs = self.pairs
        return texts(c, lambda: walker(pairs))
