"""Byte-pair encoding by words: splitting into words, and two coders of single words.

The vocabulary file's own steps are followed: special strings are cut out of the raw
text, the rest is normalised (NFC, white space to blanks, lower case), split by the
file's pattern, and each word is merged on its own, its last byte marked as a word end.
So the ids of a text are those of its words in a row, and a word needs encoding once.

Texts of characters whose treatment is the same in every Unicode version are split
here; other texts go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

from .common import kept

#: Units kept by a coder, lately met and before; words kept by the trie's, where new ones cost more: it starts anew beyond.
KEPT_WORDS, TRIE_WORDS = 250_000, 600_000
#: Characters up to which what stands between blanks is kept.
KEPT_LENGTH = 64
END = "</w>"
Unit = str | tuple[str] | int


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr({**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(others)}}[b]) for b in range(256)]


def _steady(c: int) -> bool:
    """Whether a character is the same in Unicode 3.2 and now, is NFC alone and stays one such character in lower case."""
    x = chr(c)
    old, low = unicodedata.ucd_3_2_0, x.lower()
    if c in (0x3A3, 0x130) or 0x1C <= c <= 0x1F or c == 0x85 or len(low) != 1:
        return False
    return all(old.category(y) == unicodedata.category(y) and unicodedata.category(y)[0] not in "CM" and unicodedata.normalize("NFC", y) == y for y in (x, low)) or c in (9, 10, 11, 12, 13)


def _class(chars: list[int]) -> str:
    out, i = "", 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out += f"\\u{chars[i]:04x}-\\u{chars[j]:04x}"
        i = j + 1
    return out


class Words:
    """Splits texts into the words that the vocabulary's merges see."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        if spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("only word-end BPE vocabularies are supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = sorted({x[:2] for x in self.special})
        ranges = [*range(9, 14), *range(0x20, 0x250), *range(0x391, 0x3CA), *range(0x400, 0x460), *range(0x2010, 0x2028), *range(0x20A0, 0x20AD), *range(0x3041, 0x3095), *range(0x30A1, 0x30FB), *range(0x4E00, 0x9FA6)]
        steady = [c for c in ranges if _steady(c)]
        self.odd = re.compile(f"[^{_class(steady)}]")
        low = sorted({ord(chr(c).lower()) for c in steady} | set(steady))
        kind = {c: unicodedata.category(chr(c)) for c in low}
        letters, digits = [c for c in low if kind[c][0] == "L"], [c for c in low if kind[c][0] == "N"]
        blanks = [c for c in low if kind[c][0] == "Z" or 9 <= c <= 13]
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class(letters)}]+|[{_class(digits)}]|[^{_class(sorted(letters + digits + blanks))}]+")
        self.bytes = {x: b for b, x in enumerate(byte_letters())}

    def _parts(self, text: str, cut: Callable[[str], list[str]], whole: Callable[[str], str | tuple[str]]) -> list:
        """A text's parts by cut(), if its treatment is the same in every Unicode version, else the library's words, as whole() gives them; and the ids of special strings in it."""
        if self.cut is not None and any(x in text for x in self.marks):
            parts = self.cut.split(text)
        else:
            parts = [text]
        out: list[Unit] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif not self.odd.search(part):
                out += cut(part.lower())
            else:
                t = self.tokenizer
                pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))
                out += [whole(bytes(map(self.bytes.__getitem__, x)).decode("utf-8")) for x, _ in pieces]
        return out

    def split(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of special strings in it."""
        return self._parts(text, self.word.findall, str)

    def units(self, text: str) -> list[Unit]:
        """Fewer parts that a text's ids are put together from: what stands between blanks (no word holds one), single words of texts that the library split, ids of special strings."""
        return self._parts(text, str.split, lambda w: (w,))

    def of(self, unit: str | tuple[str]) -> list[str]:
        """The words of a unit."""
        return self.word.findall(unit) if isinstance(unit, str) else list(unit)


class Known(dict):
    """What units stand for; that of a new unit is made when it is first asked for. Long units aren't kept."""

    def __init__(self, make: Callable, fixed: dict):
        super().__init__(fixed)
        self.make = make

    def __missing__(self, unit: str | tuple[str]):
        made = self.make(unit)
        if len(unit if isinstance(unit, str) else unit[0]) <= KEPT_LENGTH:
            self[unit] = made
        return made


class LibraryCoder:
    """Ids of units. The library's model encodes new words; normalising and splitting them is done."""

    def __init__(self, words: Words):
        self.words, self.model = words, words.tokenizer.model
        self.letters = byte_letters()
        self.special = {i: self.value([i]) for i in words.special.values()}
        # What was met lately, and before that: frequent units move on to the new ones.
        self.known, self.old = Known(self.learn, self.special), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        get = self.lookup()
        return [b"".join(map(get, self.words.units(x))) for x in texts]

    def lookup(self) -> Callable:
        """What a unit stands for, by the unit."""
        if len(self.known) > KEPT_WORDS:
            self.old, self.known = self.known, Known(self.learn, self.special)
        return self.known.__getitem__

    def learn(self, unit: str | tuple[str]):
        met = dict.get(self.old, unit)
        if met is not None:
            return met
        own = self.words.of(unit)
        return self.value(self.ids(own[0])) if len(own) == 1 else self.joined(map(self.known.__getitem__, own))

    def ids(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        return [t.id for t in self.model.tokenize(word)]

    def value(self, ids: list[int]):
        return struct.pack(f"<{len(ids)}I", *ids)

    def joined(self, values: Iterable):
        return b"".join(values)


class TrieCoder:
    """Ids and decoded forms of words, by a trie in which words share their prefixes.

    The merges of a prefix never depend on what follows beyond a token border, so each
    prefix has one encoding, given by its last token and the encoding of what stands
    before that. A token may follow another if the two, merged on their own, stay apart.
    A depth-first walk over the distinct words finds each prefix's last token once.
    """

    def __init__(self, words: Words, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.words, self.vocab = words, model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(tuple(x.split(" ")) if isinstance(x, str) else x for x in model["merges"]):
            i, j, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if made in self.parts:
                raise ValueError("a token made by two merges is not supported")
            self.rank[i, j] = r
            self.parts[made] = (r, i, j)
        self.names = {i: x for x, i in self.vocab.items()}
        self.longest = max(len(x.removesuffix(END)) for x in self.vocab)
        self.letters = byte_letters()
        # A vocabulary entry counts as a token if it is one byte or what merges make.
        self.tokens = {x: i for x, i in self.vocab.items() if i in self.parts or len(x.removesuffix(END)) == 1}
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str | int, tuple[bytes, str]] = {}
        self.reset()

    def reset(self) -> None:
        self.apart.clear()
        self.known = {i: (np.array([i], dtype="<u4").tobytes(), x) for x, i in self.words.special.items()}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins two neighbouring tokens: their merges are undone from the last on, and at no time may the border's pair come next."""
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        none = (-1, -1, -1)
        before = len(self.rank)  # the pair at the border must not merge before this rank
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < before:
                out = False
                break
            a, b = self.parts.get(left, none), self.parts.get(right, none)
            if a[0] < 0 and b[0] < 0:
                out = True
                break
            if a[0] > b[0]:  # the left token's merge is the later one; on a tie the left one came first
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]
        self.apart[key] = out
        return out

    def learn(self, new: list[str]) -> None:
        letters, tokens, longest, apart = self.letters, self.tokens, self.longest, self.stays_apart
        root: dict = {}
        for w in new:
            node = root
            raw = w.encode("utf-8")
            for b in raw[:-1]:
                node = node.setdefault(letters[b], {})
            node.setdefault(letters[raw[-1]] + END, w)
        # last[d]: the last token of the prefix of d letters on the current path, and where it starts
        path, last, stack = [""] * 1, [(-1, 0)], [(root, 0, "")]
        while stack:
            node, depth, letter = stack.pop()
            if depth:
                del path[depth:], last[depth:]
                path.append(letter)
                for start in range(max(0, depth - longest), depth):
                    if (t := tokens.get("".join(path[start + 1 : depth + 1]))) is not None and (not start or apart(last[start][0], t)):
                        last.append((t, start))
                        break
            if isinstance(node, str):
                ids, at = [], depth
                while at:
                    ids.append(last[at][0])
                    at = last[at][1]
                ids.reverse()
                self.known[node] = (np.array(ids, dtype="<u4").tobytes(), " ".join(map(self.names.__getitem__, ids)))
            else:
                stack += [(child, depth + 1, x) for x, child in node.items()]

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Each text's ids as little-endian unsigned 32-bit integers, and what they decode to."""
        if len(self.known) > TRIE_WORDS:
            self.reset()
        split = [self.words.split(x) for x in texts]
        if new := list(set().union(*split) - self.known.keys()):
            self.learn(new)
        get = self.known.__getitem__
        out = []
        for x in split:
            pairs = list(map(get, x))
            out.append((b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        return out


def library_coder(path: str) -> LibraryCoder:
    return kept(("library coder", path), lambda: LibraryCoder(Words(path)))


def trie_coder(path: str) -> TrieCoder:
    return kept(("trie coder", path), lambda: TrieCoder(Words(path), path))
