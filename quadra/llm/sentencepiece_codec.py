"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a BPE model's, whose result is defined by merges, not by a sum of scores. It is still a best path over a lattice
of pieces: a sequence of pieces is the model's encoding exactly if every two neighbours are (merging their joined text gives them back), so each
boundary of a text has one surviving arc, and the Viterbi recursion runs over boundaries with that pair test as its transition.
Its ids are those of the sentencepiece library (tested).

Streaming. Arcs are no longer than the longest piece, so only that many boundaries ahead of the current one are open. Whenever the
backpointer paths of all open boundaries meet in one boundary, the ids up to it are final: they are committed and the window
before it is dropped, so memory does not grow with a text.

A space begins a piece or stands in a run of spaces, so text falls apart before each space that follows another character; workers keep
the ids of the stretches they have met (bounded, two generations), and new ones run through the Viterbi window. Runs of several spaces,
whose pieces have equal scores, are merged as the library does, leftmost first, in one pass over a stack.

Defined cases: null and empty texts have no ids and decode to empty; a character outside the vocabulary gives its UTF-8 bytes' ids; U+2581
decodes to a space, as the library's does; rows that repeat a doc_id are encoded each by itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.text import slices
from quadra.llm.tokens import crc

SPACE = "▁"
CACHE = 250_000
PAIRS = 400_000
_STRETCH = re.compile(" +[^ ]*|[^ ]+")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = own.get_piece_size()
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not own.is_control(i) and not own.is_unknown(i) and not own.is_unused(i):
                self.ids[piece], self.rank[piece] = i, -own.get_score(i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        self.pieces = {i: p for p, i in self.ids.items()}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            if SPACE not in piece[1:]:  # runs of spaces go through merges()
                node = self.trie
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[""] = i
        self._pairs: dict[int, bool] = {}

    def merges(self, text: str) -> list[str]:
        """The parts of a short text after all merges: the best-scored pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: int, piece: int) -> bool:
        """Whether `piece` may stand after `last` (-1: at the beginning)."""
        key = last * self.size + piece
        found = self._pairs.get(key)
        if found is None:
            b = self.pieces[piece]
            found = self.merges(b) == [b] if last < 0 else self.merges(self.pieces[last] + b) == [self.pieces[last], b]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def spell(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode("utf-8", "replace")]


class Viterbi:
    """Encodes one stretch of characters, in parts; feed() and finish() return the ids that have become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # characters from the committed boundary on
        self.at = 0  # the current boundary
        self.last: dict[int, int] = {0: -1}
        self.back: dict[int, int] = {}
        self.open = 0  # widest window held, for tests

    def feed(self, part: str) -> list[int]:
        self.text += part
        return self._run(len(self.text) - self.v.longest)

    def finish(self) -> list[int]:
        out = self._run(len(self.text))
        return out + self._commit(len(self.text))

    def _run(self, stop: int) -> list[int]:
        out: list[int] = []
        text, last, back, trie, size = self.text, self.last, self.back, self.v.trie, self.v.size
        pairs, follows = self.v._pairs, self.v.follows
        while self.at < stop:
            j = self.at
            before = last.get(j)
            if before is not None:
                before = max(before, -1)  # nothing merges with an unknown character
                node, i, n = trie, j, len(text)
                while i < n:
                    node = node.get(text[i])
                    if node is None:
                        break
                    i += 1
                    piece = node.get("")
                    if piece is not None and i not in last:
                        ok = pairs.get(before * size + piece)
                        if ok if ok is not None else follows(before, piece):
                            last[i], back[i] = piece, j
                if i == j:  # outside the vocabulary: stands by itself, and nothing merges across it
                    last[j + 1], back[j + 1] = -2 - ord(text[j]), j
            self.at = j + 1
            if self.at % 64 == 0:
                out += self._converge()
                text, last, back = self.text, self.last, self.back
                stop -= self._moved
        return out

    _moved = 0

    def _converge(self) -> list[int]:
        """Commit up to the boundary that the paths of all open boundaries share."""
        self._moved = 0
        paths = [b for b in self.last if b >= self.at]
        self.open = max(self.open, len(self.text))
        while len(set(paths)) > 1:
            top = max(paths)
            paths = [self.back[b] if b == top else b for b in paths]
        meet = paths[0] if paths else 0
        if meet <= 0:
            return []
        out = self._commit(meet)
        self.text = self.text[meet:]
        self.at -= meet
        self._moved = meet
        self.last = {b - meet: t for b, t in self.last.items() if b >= meet}
        self.back = {b - meet: a - meet for b, a in self.back.items() if b > meet}
        return out

    def _commit(self, end: int) -> list[int]:
        ids, b = [], end
        while b > 0:
            t = self.last[b]
            ids.append([t] if t >= 0 else self.v.spell(chr(-2 - t)))
            b = self.back[b]
        return [i for part in reversed(ids) for i in part]


class Codec:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.runs = {len(p) for p in self.v.ids if set(p) == {SPACE}}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _stretch(self, text: str) -> list[int]:
        """ids of spaces (given as U+2581) and what follows up to the next space."""
        v = self.v
        spaces = len(text) - len(text.lstrip(SPACE))
        if spaces > 1:  # equal scores among runs of spaces: merge plainly, in stretches that no piece crosses
            return [i for p in self._run_of_spaces(text, spaces) for i in p]
        out: list[int] = []
        walk = Viterbi(v)
        for begin in range(0, len(text), 4096):
            out += walk.feed(text[begin : begin + 4096])
        return out + walk.finish()

    def _run_of_spaces(self, text: str, spaces: int) -> Iterator[list[int]]:
        """The run's last space may merge into the word; if it does the rest of the run is merged by itself."""
        word = self._stretch(text[spaces - 1 :])
        joined = text[spaces:] and word and self.v.pieces.get(word[0], SPACE) != SPACE
        run = spaces - 1 if joined else spaces
        yield [self.v.ids[p] for p in self._merge_run(run)]
        yield word if joined else word[1:]

    def _merge_run(self, n: int) -> list[str]:
        """Merges of n spaces: all pairs have one score, so the leftmost goes first, again and again.

        `done` holds parts of which no two neighbours merge, so with the next space the only pair that can merge, and then the leftmost
        one, is the last: each space is pushed once and each merge takes one part away, which is linear in n.
        """
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                last = done.pop()
                done[-1] += last
        return [SPACE * length for length in done]

    def _known(self, key: str) -> bytes:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = np.array(self._stretch(key.replace(" ", SPACE)), "<u2" if self.v.size <= 1 << 16 else "<u4").tobytes()
            if len(key) <= 64:
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
                self.new[key] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        dtype = "<u2" if self.v.size <= 1 << 16 else "<u4"
        if not text:
            return np.empty(0, dtype)
        if SPACE in text:
            text = text.replace(SPACE, " ")
        get, known = self.new.get, self._known
        return np.frombuffer(b"".join([get(s) or known(s) for s in _STRETCH.findall(" " + text)]), dtype)

    def decode(self, ids: np.ndarray) -> str:
        table = self.v.text
        return b"".join([table[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        ids = [own.encode(t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for each row of docs. path: the sentencepiece model, at the same place on every executor."""
    runtime.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = [own.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        crcs = [crc(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(texts), pa.array(digests)], names=["doc_id", "n_ids", "ids_crc32", "text", "decoded_sha256"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, text, decoded_sha256 for each row of encoded (doc_id, ids)."""
    runtime.ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, n_ids long, ids_crc32 long, text string, decoded_sha256 string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and decoded_sha256 (of the decoded ids' text) for each row of docs."""
    return decode(encode(docs, path), path).select("doc_id", "n_ids", "ids_crc32", "decoded_sha256")
