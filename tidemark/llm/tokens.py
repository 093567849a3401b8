"""Fast, exact encoding with a public tokenizer: the library encodes each distinct word once.

Both byte-pair tokenizers that we use split a text at white space before they merge anything, so the ids of a text
are the ids of its words in a row. A worker keeps the ids of words that it has met; the library's model is asked
for the others. Whatever does not follow the plain rules (special tokens in a text, unusual white space, letters
beyond the Latin blocks) is encoded by the library as a whole. Tests compare both ways.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import regex

#: The split patterns of the two tokenizer files.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Strings kept by a worker before it starts anew; about 150 MB.
MOST_WORDS = 1_200_000
_ODD = re.compile("[\x00-\x08\x0e-\x1f]")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids by string; what is asked for the first time is made and kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = out = self.make(key)
        return out


class Encoder:
    """Encodes texts to little-endian 16-bit ids (vocabularies under 65,536)."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if self.lib.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary take more than 16 bits")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenize, self.letters = self.lib.model.tokenize, _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        before, norm = spec["pre_tokenizer"], spec["normalizer"]
        self.kind, self.most = None, most
        if before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and norm is None:
            self.kind, self.split = "bytes", regex.compile(BYTE_SPLIT)
        elif before.get("pretokenizers", [{}])[0].get("pattern") == {"Regex": WORD_SPLIT} and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.kind, self.split = "words", regex.compile(WORD_SPLIT)
        self.forget()
        self.newline = self._whole("\n") if self.kind == "bytes" else b""

    def forget(self) -> None:
        """Lets go of all strings kept so far."""
        self.parts = _Known(self._part)  # what the model merges as one
        self.words = _Known(self._word)  # between white space
        self.spaced = _Known(lambda w: self._word(" " + w))  # the same with the space before

    def _whole(self, text: str) -> bytes:
        return array("H", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii() or part[0] == " ":
            part = part.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word or, in the byte-level kind, of a space and a word."""
        if not word.isascii() and (max(word) >= "\u0250" or "\u0130" in word):
            return self._whole(word)
        if self.kind == "words":
            word = word.lower()
        bare = word.removeprefix(" ")
        if bare.isalpha():
            return self._part(word)
        if bare[:-1].isalpha():
            return self.parts[word[:-1]] + self.parts[word[-1]]
        return b"".join(map(self.parts.__getitem__, self.split.findall(word)))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as bytes; null is empty."""
        if not text:
            return b""
        if self.kind is None or any(s in text for s in self.special) or _ODD.search(text):
            return self._whole(text)
        if len(self.parts) + len(self.words) + len(self.spaced) > self.most:
            self.forget()
        known = self.words.__getitem__
        words = text.split()
        if self.kind == "words":
            return b"".join(map(known, words))
        if " ".join(words) != text.replace("\n", " "):
            return self._whole(text)  # runs of white space, or white space at an end
        spaced = self.spaced.__getitem__
        lines = [line.split(" ") for line in text.split("\n")]
        return self.newline.join([known(line[0]) + b"".join(map(spaced, line[1:])) for line in lines])


@lru_cache(maxsize=2)
def encoder(path: str, most: int = MOST_WORDS) -> Encoder:
    """The worker's encoder for a tokenizer file, with at most so many strings kept; it lives as long as the worker does."""
    return Encoder(path, most)


@contextmanager
def encoding(path: str) -> Iterator[Callable[[str | None], bytes]]:
    """The worker's ``encode`` for one task; the strings kept go with the task, as the worker goes on to other stages."""
    kept = encoder(path)
    try:
        yield kept.encode
    finally:
        kept.forget()
