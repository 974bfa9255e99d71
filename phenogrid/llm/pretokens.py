"""Exact byte-level BPE through pre-tokens: a text's ids are those of its pre-tokens, one after another.

Byte-level BPE never merges across pre-tokens, so what a pre-token encodes to can be looked up. No
pre-token reaches from a word into the space after it either, so words between single spaces can be
looked up first. Both caches are bounded and live as long as their Python worker; what they miss, the
tokenizers library encodes.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable

from phenogrid.llm.common import resident

#: Entries that a worker's cache of words holds at most, and that of pre-tokens half of it; a full one starts again from its first entries.
CACHE_ENTRIES = 500_000

# Of the characters up to here, this module and the library agree on what is a letter, a number or a space whatever Unicode version either uses.
_LAST_PLAIN = 0x24F
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-‾€]*")

# Marks a text's first word, which no space precedes; it can't occur in a text.
_START = "\udc00"


class _Uneven(Exception):
    """A word has white space about it that isn't one space or one line end."""


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(_LAST_PLAIN + 1)) if unicodedata.category(c)[0] == kind)


def _pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's published pattern, for plain characters."""
    letter, number = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\\s{letter}{number}]+|\\s+(?!\\S)|\\s+")


class _Cache(dict):
    def __init__(self, make: Callable[[str], object], first: dict, limit: int):
        super().__init__(first)
        self.make, self.first, self.limit = make, first, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
            self.update(self.first)
        self[key] = value
        return value


class PretokenCoder:
    """Encodes texts with the tokenizer at `path`.

    keep(ids) makes what is kept of a pre-token's ids, and combine(values) what a text's pre-tokens come to.
    """

    def __init__(self, path: str, keep: Callable[[list[int]], object], combine: Callable[[Iterable], object], first: dict | None = None, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.combine = keep, combine
        kind = json.loads(self.tokenizer.to_str())
        step, added = kind.get("pre_tokenizer") or {}, kind.get("added_tokens") or []
        plain_steps = kind.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        plain_added = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in added)
        self.by_pretoken = bool(plain_steps and plain_added)
        self.added = {a["content"]: a["id"] for a in added}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.findall = _pattern().findall
        self.tokenize = self.tokenizer.model.tokenize
        alphabet = [c for c in range(256) if chr(c).isprintable() and c not in (0x20, 0xA0, 0xAD)]
        others = [c for c in range(256) if c not in set(alphabet)]
        self.byte_names = {c: chr(c) for c in alphabet} | {c: chr(256 + k) for k, c in enumerate(others)}
        self.space = self.byte_names[0x20]
        self.pieces = _Cache(self._encode, first or {}, entries // 2)
        self.words = _Cache(self._word, {}, entries)

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens and special tokens in order."""
        if not any(name in text for name in self.added):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _encode(self, piece: str):
        if piece in self.added:
            return self.keep([self.added[piece]])
        if piece.isascii() and piece.isprintable():
            named = piece.replace(" ", self.byte_names[0x20])
        else:
            named = piece.encode().decode("latin-1").translate(self.byte_names)
        return self.keep([t.id for t in self.tokenize(named)])

    def _word(self, word: str):
        if word.isascii():
            if word.isalpha():  # a pre-token by itself
                return self.keep([t.id for t in self.tokenize(self.space + word)])
            if word[-1] in ",.;:!?" and word[:-1].isalpha():
                return self.combine((self.pieces[" " + word[:-1]], self.pieces[word[-1]]))
            if word.isprintable():  # neither white space nor an added token is in it
                return self.combine(map(self.pieces.__getitem__, self.findall(" " + word)))
        elif word.isalpha() and _PLAIN.fullmatch(word):
            return self._encode(" " + word)
        if word[0] == _START:
            text = bare = word[1:]
        elif word[0] == "\n":
            text, bare = word, word[1:]
        else:
            text, bare = " " + word, word
        if len(bare.split()) != 1 or bare[0].isspace() or bare[-1].isspace():
            raise _Uneven
        return self.combine(map(self.pieces.__getitem__, self.pretokens(text)))

    def __call__(self, text: str | None):
        if not text:
            return self.combine(())
        if not self.by_pretoken:
            return self.keep(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.replace("\n", " \n").split(" ")
        words[0] = _START + words[0]
        # A word with an added token in it is no pre-token by itself.
        if "" not in words and not any(name in text for name in self.added):
            try:
                return self.combine(map(self.words.__getitem__, words))
            except _Uneven:
                pass
        return self.combine(map(self.pieces.__getitem__, self.pretokens(text)))


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def byte_coder(path: str) -> PretokenCoder:
    """This worker's coder from texts to the bytes of their ids."""
    return resident(("bytes", path), lambda: PretokenCoder(path, id_bytes, b"".join))
