"""SimHash near-duplicate groups, compared by bit-sliced Hamming distances.

Fingerprint. Texts are lower-cased (A-Z) and cut into words; each run of three words, joined by one space and
counted as often as it occurs, votes with its XXH64 (seed 42). A bit is 1 if it is set in over half the hashes.
One or two words make one shingle; a text without words has fingerprint zero.

Comparison. Two fingerprints within `radius` bits agree on all but `radius` of any `radius + 4` disjoint segments, so they share
the key made of the other four segments in some choice of them; distinct fingerprints meet under each such key. Under a key they are laid
out as vertical bit planes in blocks; a query is compared with a whole block at once: one exclusive-or for each plane, counted by
carry-save bitwise counters, and a block is abandoned as soon as every counter has passed the radius. A key of more than `LARGE`
fingerprints is cut into parts, and each pair of parts is compared in a task of its own: no task holds more than two parts.

Copies collapse to one fingerprint before any comparison; a group sends a spanning forest, not its pairs.

Defined cases: null text is empty; empty texts link to one another through fingerprint zero; rows with null
doc_id get a fingerprint and link like any other, and their component is the smallest doc_id reachable (null without one); repeated rows are returned
as often as they occur; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.operators.components import components
from quadra.llm.text import Words, slices

BITS = 64
#: Members of a block of bit planes; members of a part of a large key.
BLOCK, LARGE = 1024, 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    votes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return _majority(np.array(votes, np.uint64))


_NIBBLE = np.array([[(v >> (7 - b)) & 1 for b in range(8)] for v in range(256)], np.uint32)


def _majority(votes: np.ndarray) -> int:
    if len(votes) < 256:
        ones = np.unpackbits(votes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    else:  # count byte values, then bits
        raw = votes.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _NIBBLE for k in range(8)])
    bits = (2 * ones > len(votes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True)
        # `joined` has one space between any two words of the batch: a shingle is then a slice of it
        sizes = words.ends - words.starts
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        flat = words.data.tobytes()
        rows = zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)
        joined = b" ".join([b" ".join(flat[a:b].split()) for (a, b), n in zip(rows, words.counts.tolist(), strict=True) if n])
        out = np.zeros(batch.num_rows, np.uint64)
        for r in range(batch.num_rows):
            a, b = int(words.rows[r]), int(words.rows[r + 1])
            if a == b:
                continue
            k = min(shingle, b - a)
            votes = [digest(joined[i:j], 42) for i, j in zip(begins[a : b - k + 1].tolist(), ends[a + k - 1 : b].tolist(), strict=True)]
            out[r] = _majority(np.array(votes, np.uint64))
        yield pa.record_batch([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""
    runtime.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def segments(radius: int, kept: int = 4) -> list[int]:
    """The key masks: 64 bits cut into radius + kept segments, each choice of `kept` of them."""
    n = radius + kept
    edges = [round(BITS * i / n) for i in range(n + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, kept)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Planes:
    """Vertical bit planes of a block: plane b holds bit b of every member, as one integer."""

    def __init__(self, values: list[int]):
        self.all = (1 << len(values)) - 1
        free = 0
        for v in values:
            free |= v ^ values[0]
        self.first, self.planes = values[0], []
        raw = np.array(values, np.uint64)
        for b in range(BITS):
            if free >> b & 1:
                bits = np.packbits((raw >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
                self.planes.append((b, int.from_bytes(bits.tobytes(), "little")))
        self.fixed = ~free & ((1 << BITS) - 1)

    def near(self, value: int, radius: int) -> int:
        """The members within `radius` bits, as a bit set."""
        left = radius - ((value ^ self.first) & self.fixed).bit_count()
        if left < 0:
            return 0
        width = (left + 1).bit_length()
        digits = [0] * width  # carry-save counters of left + 1 at most, one bit of each counter in each digit
        for k in range(width):  # start so that a counter overflows when it passes `left`
            if ((1 << width) - 1 - left) >> k & 1:
                digits[k] = self.all
        over = 0
        for b, plane in self.planes:
            carry = plane ^ self.all if value >> b & 1 else plane
            for k in range(width):
                digits[k], carry = digits[k] ^ carry, digits[k] & carry
            over |= carry
            if over == self.all:
                return 0
        return self.all & ~over


def linked(values: list[int], radius: int, others: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the values within `radius` bits of one another; with `others`, of
    the pairs of a value and one of those (their positions go on from those of the values)."""
    n = len(values)
    forest, out = _Forest(n + len(others or ())), []
    asking = list(enumerate(values)) if others is None else list(enumerate(others, n))
    for begin in range(0, n, BLOCK):
        block = Planes(values[begin : begin + BLOCK])
        for q, value in asking[begin:] if others is None else asking:
            found = block.near(value, radius)
            while found:
                low = found & -found
                found ^= low
                other = begin + low.bit_length() - 1
                if other < q and forest.join(other, q):
                    out.append((other, q))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of equal keys of sorted batches, one by one; a group may go on over several batches."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            own = {k: c[a:b] for k, c in columns.items()}
            if held and any(held[0][k][0] != own[k][0] for k in keys):
                yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held = []
            held.append(own)
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _keys(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for t, mask in enumerate(masks):
            yield pa.record_batch([pa.array((fp & np.uint64(mask)).view(np.int64)), pa.array(np.full(len(fp), t, np.int8)), pa.array(fp.view(np.int64))], names=["key", "choice", "fp"])


_FOUND = "src long, dst long, choice byte, key long, part int, members binary"
_FOUND_ARROW = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("choice", pa.int8()), ("key", pa.int64()), ("part", pa.int32()), ("members", pa.binary())])


def _compare(batches: Iterator[pa.RecordBatch], radius: int, large: int) -> Iterator[pa.RecordBatch]:
    """Edges within each key of a partition sorted by (choice, key); a key of more than `large` members comes out as its parts instead."""
    rows: list[tuple] = []
    for group in runs(batches, ("choice", "key")):
        fp = group["fp"]
        if len(fp) > large:
            rows += [(None, None, int(group["choice"][0]), int(group["key"][0]), k, fp[a : a + large].tobytes()) for k, a in enumerate(range(0, len(fp), large))]
        elif len(fp) > 1:
            rows += [(int(fp[x]), int(fp[y]), None, None, None, None) for x, y in linked(fp.view(np.uint64).tolist(), radius)]
        if len(rows) >= 4096 or len(fp) > large:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW) if rows else pa.RecordBatch.from_pylist([], _FOUND_ARROW)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def _compare_parts(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges between the two parts of each row (within it, if both are one)."""
    for batch in batches:
        for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
            own, other = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            pairs = linked(own.view(np.uint64).tolist(), radius, None if i == j else other.view(np.uint64).tolist())
            both = own if i == j else np.concatenate([own, other])
            yield pa.record_batch([pa.array([both[x] for x, _ in pairs], pa.int64()), pa.array([both[y] for _, y in pairs], pa.int64())], names=["src", "dst"])


def links(fps: DataFrame, radius: int = 2, large: int = LARGE) -> DataFrame:
    """fps: distinct fp. Edges src, dst between fingerprints within `radius` bits: a spanning forest of each comparison
    group (or pair of parts of one), repeats possible."""
    n = runtime.shuffle_partitions(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(partial(_keys, masks=segments(radius)), "key long, choice byte, fp long")
    ranked = keyed.repartition(n, "choice", "key").sortWithinPartitions("choice", "key")
    found = runtime.save(ranked.mapInArrow(partial(_compare, radius=radius, large=large), _FOUND), "simhash-links")
    parts = found.where("members is not null").select("choice", "key", F.col("part").alias("i"), F.col("members").alias("a"))
    pairs = parts.join(parts.select("choice", "key", F.col("i").alias("j"), F.col("a").alias("b")), ["choice", "key"]).where("i <= j")
    more = pairs.select("i", "j", "a", "b").repartition(n, "i", "j", F.xxhash64("a")).mapInArrow(partial(_compare_parts, radius=radius), "src long, dst long")
    return found.where("members is null").select("src", "dst").unionAll(more)


def _classes(prints: DataFrame, radius: int, large: int) -> DataFrame:
    """fp, component (the smallest fingerprint reachable) of each distinct fingerprint of prints."""
    nodes = prints.select("fp").distinct()
    return nodes.join(components(links(nodes, radius, large)), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for each row of docs."""
    prints = runtime.save(fingerprints(docs, shingle), "simhash")
    classes = runtime.save(_classes(prints, radius, large), "simhash-classes")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(classes, "fp").groupBy("component").agg(F.min("low").alias("component_id"))
    labels = classes.join(least, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
