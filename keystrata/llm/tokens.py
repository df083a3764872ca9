"""Fast exact encoding with tokenizer files of the ``tokenizers`` library.

A word after a space is encoded alike wherever it stands, because neither vocabulary's pre-tokenizer joins a visible
character to a space after it. So each distinct word is encoded once per worker (as long as its cache remembers it)
and documents are put together from the words' ids. Words of plain Latin characters are pre-tokenized here and go to the
library's BPE model, which spares its alignment work; all others, texts with runs of spaces and texts with one of
the file's added tokens go to its full encoder.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from . import workers

END_ID = 1
#: Words kept by a worker, in two generations of half as many, and the longest that it keeps.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64
#: Characters for which Python and the library agree on classes and lower case.
_PLAIN = regex.compile(r"[\x21-\x7e\n\t ¡-¬®-ſ]*")
_SIGNS = ".,!?;:"


def _byte_letters() -> dict[int, str]:
    """Latin-1 code point of a byte -> the letter that stands for it in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Cache(dict):
    """Ids of strings, computed when they are first asked for. A full cache becomes the old one, which is still asked."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        self.compute, self.most, self.old = compute, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class PieceEncoder:
    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.model = self.plain.model
        # The library's own cache of words costs more than encoding a new word; what repeats is kept here.
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        #: The public pattern that byte-level pre-tokenizers use unless the file names its own.
        self.split = regex.compile(own or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.lower = bool(spec["normalizer"])
        self.letters = _byte_letters()
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
        #: Ids of words after a space; of words at the start of a text or line; of parts of these.
        self.words = _Cache(self._quick(), most)
        self.firsts = self.words if self.lower else _Cache(lambda word: self._piece(word, ""), most // 8)
        self.parts = _Cache(self._part, most // 4)
        self.line_end = b"" if self.lower else self._part("\n")

    def _quick(self) -> Callable[[str], bytes]:
        """Ids of a word after a space; most new words are plain letters and are handled here."""
        tokenize, packers, lower, whole = self.model.tokenize, self.packers, self.lower, self._piece
        space = "" if lower else self.letters[32]

        def ids_of(word: str) -> bytes:
            if len(word) < 60 and word.isascii() and word.isalpha():
                ids = [t.id for t in tokenize(word.lower() if lower else space + word)]
                return packers[len(ids)](*ids)
            return whole(word, " ")

        return ids_of

    def _encode(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token."""
        if not part.isascii() or not part.isalnum():
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(part)]
        return self.packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def _piece(self, word: str, before: str) -> bytes:
        """Ids of a word with what stands before it, a space or nothing."""
        ascii_ = word.isascii()
        if not ascii_ and not _PLAIN.fullmatch(word):
            return self._encode(before + word)
        if word.isalpha():
            part = before + word if not self.lower else word.lower() if ascii_ else unicodedata.normalize("NFC", word).lower()
            if part[bool(part[:1] == " ") :].isalpha():  # lower case of one letter may be two characters
                return self._part(part)
        own = self.words if before else self.firsts
        if "\n" in word:
            first, _, rest = word.partition("\n")
            if first and rest and not any(map(str.isspace, (first[-1], rest[0]))):
                return own[first] + self.line_end + self.firsts[rest]
        core = word.rstrip(_SIGNS)
        if len(core) < len(word) and core.isalpha():
            return own[core] + self.parts[word[len(core) :]]
        piece = before + word
        if self.lower:
            piece = unicodedata.normalize("NFC", piece).lower().strip(" ")
        return b"".join([self.parts[x] for x in self.split(piece)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        ids_of, out = self.words.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif "  " in text or "<" in text and any(t in text for t in self.added):
                out.append(self._encode(text))
            else:
                words = text.split(" ")
                first = self.firsts[words[0]] if words[0] else b""
                words[0] = first
                words[1:] = map(ids_of, words[1:])
                out.append(b"".join(words))
        return out


_encoders: dict[str, PieceEncoder] = {}
workers.keeps(_encoders.clear)


def encoder(path: str, most: int = CACHE_WORDS) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, most)
    return _encoders[path]


def default_path(name: str) -> str:
    """Path of a public tokenizer file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
