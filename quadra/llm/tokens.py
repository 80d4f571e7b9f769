"""Token ids of whole texts with the tokenizers library, for a word-level byte BPE vocabulary file.

Such a tokenizer never merges across white space, so a text's ids are its words' ids, end to end. Words repeat, so
each worker keeps the ids of the words it has met (bounded, two generations). A new word of plain letters goes
straight to the library's BPE model; any other goes through the library's whole chain.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quadra.llm.text import slices

#: Words kept in each of two generations of a worker's cache: about 100 MB at most.
CACHE_WORDS = 250_000
#: Lower-case letters and signs whose normal form, lower case and class are the same in every Unicode version.
_PLAIN = re.compile("[!-~ß-öø-ÿ]+")
_LETTERS = "a-zß-öø-ÿ"
#: The split pattern of the file, on plain characters (fixed value).
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself if printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"] == {"Regex": _SPLIT}
            and not before[1]["add_prefix_space"]
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.chars = self.tokenizer.model, _byte_chars()
        self.cache = _Cache(self._word)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = _PIECES.findall(text)
        if len(pieces) > 1:  # a piece by itself is a word too, and is met far more often than this one
            known = self.cache
            return b"".join([known[p.encode()] for p in pieces])
        if not text.isascii():
            text = "".join([self.chars[b] for b in word])
        return self._pack([t.id for t in self.model.tokenize(text)])

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text, without special tokens added."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
        low = text.lower()  # A-Z only
        if b"<|" in low and any(s.encode().lower() in low for s in self.specials):
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, low.split())), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each slice of the batches with the ids of its rows' texts."""
    own = encoder(path)
    for batch in slices(batches):
        column = batch.column("text")
        if column.null_count:
            column = column.fill_null("")
        yield batch, [own.encode(t) for t in column.cast(pa.large_binary()).to_pylist()]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
