"""Tokenizer ids for whole texts, with a bounded per-worker memo of repeated words.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. For a
byte-level BPE without a normalizer, a text may be cut before every single space
that a non-space follows, and around single line ends, without changing any id, so each
word is split by the published pattern, encoded by the library's model and then looked up.
Texts in which spaces meet other white space take the library's ordinary path.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

#: Words a worker remembers, and the longest of them in characters.
_ENTRIES = 600_000
_LONGEST = 64
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ASCII_SPACES = "\t\r\v\f\x1c\x1d\x1e\x1f"
#: Marks that end many words; no part of the split pattern begins inside a run of them.
_MARKS = ".,;:!?\")]}*#$%&"
# Fixed value: the published split pattern of byte-level BPE.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def _split(text: str) -> list[str]:
    """The parts of a word; letters alone or before marks need no pattern."""
    head = text.rstrip(_MARKS)
    if (head[1:] if head[:1] == " " else head).isalpha():
        return [head, text[len(head) :]] if len(head) < len(text) else [text]
    return _SPLIT.findall(text)


class _Memo(dict):
    """Remembers ids by word: two generations, so that frequent words stay when it is full."""

    def __init__(self, make, entries: int):
        self.make, self.entries, self.old = make, max(1, entries // 2), {}

    def __missing__(self, word: str) -> bytes:
        ids, keep = self.old.get(word), True
        if ids is None:
            ids, keep = self.make(word)
        if keep and len(word) <= _LONGEST:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes lists of texts to little-endian id bytes of ``dtype``."""

    def __init__(self, path: str, cache_entries: int = _ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and bool(pre.get("use_regex", True))
            and spec["model"]["type"] == "BPE"
        )
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        #: Ids of words after a space, or after a line end when they begin with it; ids of other parts of words.
        self.spaced = _Memo(self._spaced, cache_entries)
        self.bare = _Memo(lambda part: (self._part(part), True), cache_entries // 4)
        # Special strings must stay ordinary text, which the word path cannot promise.
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(letters)])

    def _join(self, parts: list[str]) -> bytes:
        return b"".join([self.spaced[p[1:]] if p[0] == " " and len(p) > 1 else self.bare[p] for p in parts])

    def _spaced(self, word: str) -> tuple[bytes, bool]:
        """A word's ids, and whether to remember them: of several parts only if the first was known."""
        if word[:1] == "\n":
            parts = _split(word[1:])
            known = not parts or parts[0] in self.bare
            return self._join(["\n", *parts]), known
        parts = _split(" " + word)
        if len(parts) == 1:
            return self._part(parts[0]), True
        known = parts[0][1:] in self.spaced
        return self._join(parts), known

    def _plain(self, text: str) -> bool:
        return not (
            "  " in text
            or "\n " in text
            or " \n" in text
            or (any(c in text for c in _ASCII_SPACES) if text.isascii() else _OTHER_SPACE.search(text))
            or any(s in text for s in self.special)
        )

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or not self._plain(text):
            return self._pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        # Line ends are parts of their own unless three meet or two end the text.
        if "\n" in text and "\n\n\n" not in text and not text.endswith("\n\n"):
            text = text.replace("\n", " \n")
        first, *words = text.split(" ")
        return self._join(_split(first)) + b"".join(map(self.spaced.__getitem__, words))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t or "") for t in texts]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_entries: int = _ENTRIES) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    key = (path, cache_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache_entries)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_of(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(data, dtype=dtype)


def widen(data: bytes, dtype: str) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, dtype=dtype).astype("<u4").tobytes()
