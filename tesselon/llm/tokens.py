"""Exact tokenizer front end with bounded caches, shared by token output and packing.

Encoding a whole text costs microseconds a word, as random-looking words miss the
library's small cache.  Both supported vocabularies split a text before merging and
never merge across a space that stands between two visible characters, so a text can
be encoded part by part: parts come from a cache, and only parts never seen before are
passed to the tokenizers library.  A comma or full stop between a letter or digit and a
blank, and a single line feed between visible characters, are parts of their own, so most
parts are plain words.  Texts with characters outside Basic Latin letters, digits,
punctuation, spaces, line feeds and the precomposed Latin letters (U+00C0 to U+024F, but
U+0130, whose lower case is two characters, and U+017F, which split rules take for an s),
or with the opening of a special token, are encoded whole by the library.
"""

from __future__ import annotations

import re
from struct import Struct, pack

from .common import tidy

#: Characters for which the split rules below hold.
_OTHER = re.compile("[^\n -~À-įı-žƀ-ɏ]|<\\|")
_BREAK = re.compile("(?<=[^ \n]) (?=[^ \n])")
#: A comma or stop that may belong to a longer run of punctuation, or to a space.
_RUN = re.compile("[ -/:-@\\[-`{-~×÷][,.](?:[ \n]|\\Z)")
_PIECE_SPACE = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\\s+(?!\\S)|\\s+")
_PIECE_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^\\sA-Za-z0-9À-ÖØ-öø-ɏ]+", re.I)


_PACK = [Struct(f"<{n}I").pack for n in range(40)]


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies have for each byte (public rule)."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """Ids by part; a part not met before is taken from the older generation or learned."""

    def __init__(self, learn, older: dict[str, bytes]):
        self.learn, self.older = learn, older
        self[""] = b""

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.learn(part)
        self[part] = ids
        return ids


class PartEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    ``spaces`` tells whether a space belongs to the part after it (byte-level
    vocabularies) or is dropped (word vocabularies).  The cache has two generations: a
    part found in the older one moves to the newer, which takes its place when it holds
    ``cache / 2`` entries at the start of a text.  So memory is bounded by the cache and
    the words of one text, and words in use stay.  Tasks ``forget`` it as they end, so that
    idle workers hold none.
    """

    def __init__(self, path: str, spaces: bool, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces, self.limit = spaces, cache
        self.rule = _PIECE_SPACE if spaces else _PIECE_WORD
        self.tokenize, self.alphabet = self.tokenizer.model.tokenize, _byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.parts = _Parts(self._learn, {})
        tidy()

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, part: str) -> bytes:
        if part.isalpha() or part[0] == " " and part[1:].isalpha():
            # a word goes to the library's merge model at once: split rules and lower case are known for it
            x = part if self.spaces else part.lower()
            if self.spaces or not x.isascii():
                x = x.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenize(x)]
            return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else pack(f"<{len(ids)}I", *ids)
        pieces = self.rule.findall(part)
        if len(pieces) == 1:
            return self.whole(part)
        return b"".join([self.parts[x] for x in pieces])

    def _cut(self, t: str | None) -> list[str] | None:
        if not t:
            return []
        if _OTHER.search(t):
            return None
        plain = not _RUN.search(t)
        if not self.spaces:
            return (t.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ") if plain else t).split()
        if "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n":
            a = _BREAK.split(t)
            return [a[0], *[" " + x for x in a[1:]]]
        t = t.replace(" ", "\0 ")
        if plain:
            t = t.replace(",\0", "\0,\0").replace(".\0", "\0.\0").replace(".\n", "\0.\n")
        return t.replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str | None) -> bytes:
        cut = self._cut(text)
        if cut is None:
            return self.whole(text)
        if len(self.parts) > self.limit // 2:
            self.parts.older = {}
            self.parts = _Parts(self._learn, self.parts)
        return b"".join(map(self.parts.__getitem__, cut))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """One bytes value a text; null counts as empty."""
        return [self.encode(t) for t in texts]


_ENCODERS: dict[tuple, PartEncoder] = {}


def encoder(path: str, spaces: bool) -> PartEncoder:
    """The encoder of this Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = PartEncoder(path, spaces)
    return _ENCODERS[path, spaces]
