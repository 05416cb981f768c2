"""Ids of whole texts from a public tokenizer file, with a cache over the pieces that it treats apart.

Both kinds of vocabulary cut a text before merging bytes, and never across a space that follows a
character other than white space. The pieces between such spaces are thus encoded one by one, each
distinct piece once while the cache holds it; the ids are those of the whole text. Files of another
kind are given whole texts. The string of a special token in a text is that token, as the library has it, and
the texts before and after it are encoded each for itself.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa

#: Pieces that a worker keeps, about 180 bytes each.
KEPT = 600_000
_after_word = re.compile(r"(?<=\S) ")
#: White space beside the space and the line end, and where those two stand together.
_unusual = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", "\n\n", " \n", "\n "]
#: A word and marks after it; letters below U+0250, where composition and case don't change bytes' order (U+0130 apart).
MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
LATIN = re.compile(r"[^\W\d_\u0130\u0250-\U0010FFFF]+")
#: How byte-level vocabularies write the bytes of characters above ASCII: those without a visible character get the next from U+0100.
_hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(_hidden)}
#: So written, each character below U+0250; none is missing, as a look-up that fails is slow.
CHARS = {c: "".join(chr(BYTE_CHARS.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}
_encoders: dict[str, Encoder] = {}


class Pieces(dict):
    """Ids by piece; a piece that is not held is encoded when it is asked for."""

    def __init__(self, learn, most: int):
        super().__init__()
        self.learn, self.most = learn, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described.get("pre_tokenizer") or {}
        spaced = described.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        parts = pre.get("pretokenizers") or [{}]
        worded = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in (parts[0].get("pattern") or {}).get("Regex", "")
        added = {a["content"]: a for a in described.get("added_tokens") or []}
        # an added token with conditions of its own can't be told from the text alone
        plain = not any(a[k] for a in added.values() for k in ("normalized", "lstrip", "rstrip", "single_word"))
        self.kind = "whole" if not plain else "spaced" if spaced else "worded" if worded else "whole"
        self.added = {c: array("I", [a["id"]]).tobytes() for c, a in added.items()}
        self.around = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.tokenize = self.model.model.tokenize
        self.line = self._ids("\n")
        self.first = Pieces(lambda p: self._learn(p, ""), kept)
        self.later = Pieces(lambda p: self._learn(p, " " if spaced else ""), kept)

    def _ids(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes | None:
        """Ids of a run of letters by the library's model alone, which is what remains of the work for one; None
        for other letters than those that lower-casing and composition leave as they are.

        Where case makes no difference, words that differ in it share what is learned of one."""
        if not word.isascii() and not LATIN.fullmatch(word):
            return None
        if self.kind == "worded" and not word.islower() and (low := word.lower()) != word:
            return self.later[low]
        if not word.isascii():
            word = word.translate(CHARS)
        return array("I", [t.id for t in self.tokenize("\u0120" + word if lead else word)]).tobytes()

    def _learn(self, piece: str, lead: str) -> bytes:
        """A word, a word and marks after it, a line end before a word, or else any piece by the whole of the work."""
        if piece.isalpha():
            ids = self._word(piece, lead)
            if ids is not None:
                return ids
        elif self.kind == "spaced" and piece[:1] == "\n" and lead:
            # see encode: it stands for itself, with no space before it
            return self.line + self.first[piece[1:]]
        elif marked := MARKED.fullmatch(piece):
            # not all that MARKED takes for letters are: a superscript digit is a number to the library
            word, marks = marked.groups()
            if word.isascii() or word.isalpha() and LATIN.fullmatch(word):
                ids = (self.later if lead or self.kind == "worded" else self.first).get(word) or self._word(word, lead)
                return ids + (self.later if self.kind == "worded" else self.first)[marks]
        return self._ids(lead + piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.kind == "whole":
            return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return [b"".join(self._around(t)) if any(a in t for a in self.added) else self._text(t) for t in texts]

    def _around(self, text: str) -> Iterator[bytes]:
        """Ids of a text that holds added tokens: of what lies between them, and of each of them."""
        at = 0
        for m in self.around.finditer(text):
            yield self._text(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield self._text(text[at:])

    def _text(self, t: str) -> bytes:
        get, join = self.later.__getitem__, b"".join
        if self.kind == "worded":
            return join(map(get, t.replace("\n", " ").split(" ")))
        if t[:1].isspace() or t[-1:].isspace() or any(c in t for c in _unusual):
            # without the pieces that begin with a line end, which stand for that alone
            head, *rest = _after_word.split(t)
            return self._ids(head) + join([get(p) if p[:1] != "\n" else self._ids(" " + p) for p in rest])
        head, *rest = t.replace("\n", " \n").split(" ")
        return (self.first[head] if head else b"") + join(map(get, rest))


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The worker's encoder of a file; workers are reused, so most tasks find it filled."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, kept)
    return _encoders[path]


def forget() -> None:
    """Drop the worker's encoders, which a stage that encodes nothing would carry along, and give back what they held."""
    if not _encoders:
        return
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
