"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Model. The restaurant of a context is that of the word before, whole (its hash), or of the start of a text. Contexts whose words end in the same
two byte classes share a parent (1,024 and the start of a text), those of one last byte class theirs (33); these share the root, whose base is uniform over the V known words and one unknown.
Customers of a parent are the tables of its children.

Inference. Blocked Gibbs: a sweep seats, for every word and restaurant, all its customers anew by the Chinese restaurant process,
given the rest (its parent's predictive probability, the restaurants' totals of the sweep before). Seating is exact for any number of customers: the next
customer who opens a table is drawn from the process's survival function, a quotient of gamma functions. Draws come from the word's hash, the restaurant and
the sweep, so a result does not depend on how the work is dealt out. After `burn` sweeps, `samples` sweeps are kept and the probability of a token is the
mean of their predictive probabilities.

Execution. A word's cells in all restaurants are in one hash bucket, and a sweep goes over the buckets. A cell of one customer has one table in every sweep, so sweeps
move only the others. The totals of the restaurants of words are summed in fewer buckets, of those words: before a sweep each bucket offers its shares and gets back
the sums of just the contexts of its cells that change; tables of the cells that stay are summed once. Only the totals of the
1,059 restaurants above go through the driver. Map tasks count before they send: a chunk sends each distinct (word, context) once, in packed rows. To score, frequent
words before go by number, with their restaurants' totals in every task, others are listed once for each chunk and bucket and their totals asked for; a
chunk's tokens go to their words' buckets, and partial sums for each document come back; words above a `head`-th of all tokens (at most `head` of them) are
dealt by word and context to several buckets, with their cells. Each token's logarithm is rounded by itself to a multiple of 2**-32 and
sums are whole numbers, so that neither order nor partitions change a result.

Defined cases: null text is empty (its end token alone); every row is a document of its own, also rows that share a doc_id or have none
(such tables are scored under a hash of doc_id and text); a row with null doc_id is not held out; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm import packed
from quadra.llm.text import U, Words, mix, release, slices

CONTEXTS, PARENTS = 1025, 33
_PARENT = np.concatenate([[0], 1 + np.arange(1024) // 32])
#: The hashes of the end token and of the start as a context (fixed values).
END, START = U(0x51ED270B9F3B5A17), U(0x2545F4914F6CDD1D)
#: Tokens that a map task gathers before it sends them on.
CHUNK = 500_000
#: Bytes of text that a bucket stands for on average.
BUCKET_BYTES = 6 << 20
#: Bytes that it stands for at least where there are partitions for more buckets, and buckets for whose words one bucket sums totals: the rows
#: that buckets send each other grow with the square of the buckets, divided by that.
LEAST_BYTES, SUMMED = 2 << 20, 8
#: Words whose restaurants' totals all scoring tasks get, and how many of them a row holds.
HEAD, HEAD_PART = (1 << 16) - 2, 1024
_FIX = float(1 << 32)
_ROWS = "bucket int, kind byte, payload binary"
_ROWS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])


@dataclass
class Settings:
    discounts: tuple[float, float, float] = (0.75, 0.75, 0.8)  # root, parents, contexts
    strengths: tuple[float, float, float] = (10.0, 10.0, 10.0)
    word_discount: float = 0.8  # of the restaurants of words
    word_strength: float = 1.0
    burn: int = 1
    samples: int = 3
    head: int = 1000
    seed: int = 11


@dataclass
class Totals:
    """Customers and tables of the restaurants in one sweep, but for those of words. context: two byte classes."""

    context_customers: np.ndarray
    context_tables: np.ndarray
    parent_customers: np.ndarray
    parent_tables: np.ndarray
    root_customers: float
    root_tables: float


@dataclass
class Model:
    settings: Settings
    words: int
    tokens: int
    state: DataFrame | None = None
    samples: list[Totals] = field(default_factory=list)
    buckets: int = 0


# --- tokens ---------------------------------------------------------------------------------------------------------


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context class, hash of the word before, row) of every token of a batch, in order, each row's end token included."""
    words = Words(batch.column("text"), lower=True)
    n, rows = len(words), batch.num_rows
    hashes = words.hashes()
    last = words.data[words.ends - 1].astype(np.int64) & 31
    second = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64) & 31
    own = 1 + last * 32 + second
    at = np.arange(n) + np.repeat(np.arange(rows), words.counts)  # a word's place once end tokens are in
    total = n + rows
    h, row = np.full(total, END, np.uint64), np.repeat(np.arange(rows), words.counts + 1)
    h[at] = hashes
    context = np.zeros(total, np.int64)
    after = at + 1  # the token after a word, in the same row: its end token at the latest
    context[after] = own
    before = np.full(total, START, np.uint64)
    before[after] = hashes
    first = np.concatenate([[0], np.cumsum(words.counts + 1)[:-1]]) if rows else np.empty(0, np.int64)
    context[first] = 0
    return h, context, before, row


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; sorted hashes have sorted buckets."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _press(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _unpress(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


@dataclass
class Head:
    """Frequent contexts, which tokens name by a number: hashes, most customers first, their classes, customers, and tables in each kept sweep."""

    contexts: np.ndarray
    kind: np.ndarray
    customers: np.ndarray
    tables: list[np.ndarray]


class Chunk:
    """Tokens of some batches, each as one number of (word, word before, row), by places in the words of the chunk."""

    def __init__(self, held: list[tuple], rows: int):
        h, context, before, row = (np.concatenate(x) for x in zip(*held, strict=True))
        self.words, at = np.unique(np.concatenate([h, [START]]), return_inverse=True)
        first = before == START
        after = np.concatenate([at[:1], at[:-2]])  # a word before is the token before, but at a start
        after[first] = at[-1]
        self.kind = np.zeros(len(self.words), np.int64)
        self.kind[after] = context
        if len(self.words) ** 2 * rows < 1 << 62:
            key = (at[:-1] * len(self.words) + after) * rows + row
            key.sort()
            new = packed.groups(key)
            key, self.n = key[new], np.diff(new, append=len(key))
            pair, self.row = np.divmod(key, rows)
            self.at, self.before = np.divmod(pair, len(self.words))
        else:
            order = np.lexsort((row, after, at[:-1]))
            at, after, row = at[:-1][order], after[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(after) != 0) | (np.diff(row) != 0)]))
            self.at, self.before, self.row, self.n = at[new], after[new], row[new], np.diff(new, append=len(at))

    def blobs(self, buckets: int, head: np.ndarray | None = None, extra: tuple[bytes, ...] = (), to: np.ndarray | None = None, rows: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """One packed row for each bucket. Words before in `head` are numbers; others are listed with their classes. to: buckets, if not by word."""
        at, before, n, row = self.at, self.before, self.n, self.row
        if to is None:
            to = _bucket(self.words, buckets)[at]
        else:
            order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
            at, before, n, row, to = (x[order] for x in (at, before, n, row, to))
        size = 0 if head is None else len(head)
        code = np.full(len(self.words), -1)
        if size:
            order = np.argsort(head)
            place = order[np.minimum(np.searchsorted(head, self.words, sorter=order), size - 1)]
            code = np.where(head[place] == self.words, place, -1)
        own = np.zeros(len(self.words), np.int64)
        for a, b in packed.runs(to):
            first = packed.groups(at[a:b])
            rest = np.zeros(len(self.words), bool)
            rest[before[a:b]] = True
            rest = np.flatnonzero(rest & (code < 0))
            own[:] = code
            own[rest] = size + np.arange(len(rest))
            parts = [_steps(self.words[at[a:b][first]]), packed.planes(np.diff(first, append=b - a)), _steps(self.words[rest]), packed.planes(self.kind[rest]), packed.planes(own[before[a:b]]), packed.planes(n[a:b])]
            yield int(to[a]), 0, _press(packed.join([*parts, *([packed.planes(row[a:b])] if rows else []), *extra]))


def _steps(x: np.ndarray) -> bytes:
    """Ascending values as differences."""
    return packed.planes(np.diff(x, prepend=x.dtype.type(0)))


def _whole(b: bytes) -> np.ndarray:
    return packed.unplanes(b).view(np.int64)


def _unblob(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(distinct words, entries of each, listed words before, their classes, each entry's word before, its tokens, the other parts)."""
    parts = packed.split(_unpress(payload))
    return np.cumsum(packed.unplanes(parts[0])), _whole(parts[1]), np.cumsum(packed.unplanes(parts[2])), _whole(parts[3]), _whole(parts[4]), _whole(parts[5]), parts[6:]


def _batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    for r in rows:
        held.append(r)
        if len(held) == 256:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS_ARROW, strict=True)], schema=_ROWS_ARROW)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS_ARROW, strict=True)], schema=_ROWS_ARROW)


# --- counting -------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], extra: bool = False) -> Iterator[tuple[list[tuple], list[np.ndarray], int]]:
    """(tokens, ids, rows) of about CHUNK tokens at a time."""
    held, ids, size, seen = [], [], 0, 0
    for batch in slices(batches):
        h, context, before, row = _tokens(batch)
        held.append((h, context, before, row + seen if extra else np.zeros(len(row), np.int64)))
        if extra:
            ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        seen += batch.num_rows
        size += len(h)
        if size >= CHUNK:
            yield held, ids, seen
            held, ids, size, seen = [], [], 0, 0
    if held:
        yield held, ids, seen


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    yield from _batches(row for held, _, _ in _chunks(batches) for row in Chunk(held, 1).blobs(buckets))


def _sums(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=size).astype(np.int64)


class State:
    """A bucket's words: their customers and tables in each restaurant.

    words: sorted hashes; count: their tokens. key: word * CONTEXTS + class of each cell of a class, sorted. contexts: sorted hashes of words before; kind: their classes.
    Cells of words before are sorted by (word, before), both as places; n: their customers.
    kept: (tables of those cells; customers, tables of the cells of classes; tables of the parents' cells; tables in the root), of each kept sweep.
    """

    def __init__(self, words, count, key, contexts, kind, at, before, n, kept=()):
        self.words, self.count, self.key, self.contexts, self.kind, self.at, self.before, self.n = words, count, key, contexts, kind, at, before, n
        self.word = key // CONTEXTS
        self.pkey, self.up = _above(key)
        self.pword = self.pkey // PARENTS
        self.kept = list(kept)

    def pack(self) -> bytes:
        """Cells of one customer have one table, which is left out."""
        parts = [_steps(self.words), packed.planes(self.count), _steps(self.key), _steps(self.contexts), packed.planes(self.kind), _steps(self.at * len(self.contexts) + self.before), packed.planes(self.n)]
        many = self.n > 1
        return _press(packed.join(parts + [packed.planes(x) for own, *above in self.kept for x in (own[many], *above)]))

    @staticmethod
    def unpack(b: bytes) -> State:
        parts = [packed.unplanes(p) for p in packed.split(_unpress(b))]
        whole = [p.view(np.int64) for p in parts]
        contexts, n = np.cumsum(parts[3]), whole[6]
        at, before = np.divmod(np.cumsum(whole[5]), max(1, len(contexts)))
        many, kept = np.flatnonzero(n > 1), []
        for i in range(7, len(whole), 5):
            own = np.ones(len(n), np.int64)
            own[many] = whole[i]
            kept.append((own, *whole[i + 1 : i + 5]))
        return State(np.cumsum(parts[0]), whole[1], np.cumsum(whole[2]), contexts, whole[4], at, before, n, kept)

    def take(self, words: np.ndarray, cells: np.ndarray) -> State:
        """Some words (a mask), with some of their cells of words before (a mask), as kept."""
        rank, cells = np.cumsum(words) - 1, cells & words[self.at]
        used, before = np.unique(self.before[cells], return_inverse=True)
        own, above = words[self.word], words[self.pword]
        key = rank[self.word[own]] * CONTEXTS + self.key[own] % CONTEXTS
        kept = [(a[cells], c[own], t[own], pt[above], rt[words]) for a, c, t, pt, rt in self.kept]
        return State(self.words[words], self.count[words], key, self.contexts[used], self.kind[used], rank[self.at[cells]], before, self.n[cells], kept)

    @staticmethod
    def merged(some: list[State]) -> State | None:
        """States without common words, as one."""
        if len(some) < 2:
            return some[0] if some else None
        words = np.concatenate([x.words for x in some])
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks = np.split(rank, np.cumsum([len(x.words) for x in some])[:-1])
        contexts, first = np.unique(np.concatenate([x.contexts for x in some]), return_index=True)
        kind = np.concatenate([x.kind for x in some])[first]
        key = np.concatenate([r[x.word] * CONTEXTS + x.key % CONTEXTS for r, x in zip(ranks, some, strict=True)])
        pkey = np.concatenate([r[x.pword] * PARENTS + x.pkey % PARENTS for r, x in zip(ranks, some, strict=True)])
        at = np.concatenate([r[x.at] for r, x in zip(ranks, some, strict=True)])
        before = np.concatenate([np.searchsorted(contexts, x.contexts)[x.before] for x in some])
        cells, own, above = (np.argsort(k, kind="stable") for k in (at, key, pkey))  # runs that are sorted
        orders = (cells, own, own, above, order)
        kept = [tuple(np.concatenate(c)[o] for c, o in zip(zip(*tables, strict=True), orders, strict=True)) for tables in zip(*(x.kept for x in some), strict=True)]
        count, n = (np.concatenate([getattr(x, k) for x in some]) for k in ("count", "n"))
        return State(words[order], count[order], key[own], contexts, kind, at[cells], before[cells], n[cells], kept)

    def below(self, t: np.ndarray) -> np.ndarray:
        """Customers of the parents: tables of their contexts."""
        return _sums(self.up, t, len(self.pkey))

    def root(self, pt: np.ndarray) -> np.ndarray:
        return _sums(self.pword, pt, len(self.words))


def _above(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parents' cells, that of each cell of a class); both are sorted."""
    above = key // CONTEXTS * PARENTS + _PARENT[key % CONTEXTS]
    first = packed.groups(above)
    return above[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(above)))


class Seats:
    """What sweeps change in a bucket. A cell of one customer has one table in every sweep: only cells of more are here, of the others their numbers.

    words, key: as in State; alone: cells of one customer in each cell of a class. contexts: sorted hashes of the words before of the cells of more;
    cell, before, n: of each of those, its cell of a class, its word before, its customers. rest: tables of cells of one customer in those contexts' restaurants,
    over all buckets (known from the first sweep on). now, kept: as State's, without the customers of the cells of classes, which follow.
    """

    def __init__(self, words, key, alone, contexts, cell, before, n, rest, now, kept=()):
        self.words, self.key, self.alone, self.contexts, self.cell, self.before, self.n, self.rest = words, key, alone, contexts, cell, before, n, rest
        self.word = key // CONTEXTS
        self.pkey, self.up = _above(key)
        self.pword = self.pkey // PARENTS
        self.now, self.kept = now, list(kept)

    @staticmethod
    def first(x: State) -> Seats:
        """Each cell with one table."""
        cell = np.searchsorted(x.key, x.at * CONTEXTS + x.kind[x.before])
        many = x.n > 1
        used, before = np.unique(x.before[many], return_inverse=True)
        ones = lambda size: np.ones(size, np.int64)
        now = (ones(len(before)), ones(len(x.key)), ones(len(x.pkey)), ones(len(x.words)))
        return Seats(x.words, x.key, _sums(cell[~many], None, len(x.key)), x.contexts[used], cell[many], before, x.n[many], np.zeros(len(used), np.int64), now)

    def pack(self) -> bytes:
        parts = [_steps(self.words), _steps(self.key), packed.planes(self.alone), _steps(self.contexts), _steps(self.cell), packed.planes(self.before), packed.planes(self.n), packed.planes(self.rest)]
        return _press(packed.join(parts + [packed.planes(x) for tables in (self.now, *self.kept) for x in tables]))

    @staticmethod
    def unpack(b: bytes) -> Seats:
        parts = packed.split(_unpress(b))
        words, contexts = (np.cumsum(packed.unplanes(parts[k])) for k in (0, 3))
        key, cell = (np.cumsum(_whole(parts[k])) for k in (1, 4))
        alone, before, n, rest, *tables = (_whole(parts[k]) for k in (2, 5, 6, 7, *range(8, len(parts))))
        tables = [tuple(tables[i : i + 4]) for i in range(0, len(tables), 4)]
        return Seats(words, key, alone, contexts, cell, before, n, rest, tables[0], tables[1:])

    def customers(self, own: np.ndarray) -> np.ndarray:
        """Customers of the cells of classes: tables of their words before."""
        return self.alone + _sums(self.cell, own, len(self.key))

    def below(self, t: np.ndarray) -> np.ndarray:
        return _sums(self.up, t, len(self.pkey))

    def root(self, pt: np.ndarray) -> np.ndarray:
        return _sums(self.pword, pt, len(self.words))

    def stats(self) -> np.ndarray:
        """words and tokens, then customers and tables: of classes, of parents, of the root."""
        context, parent = self.key % CONTEXTS, self.pkey % PARENTS
        own, t, pt, rt = self.now
        return np.concatenate([[len(self.words), self.n.sum() + self.alone.sum()], _sums(context, self.customers(own), CONTEXTS), _sums(context, t, CONTEXTS), _sums(parent, self.below(t), PARENTS), _sums(parent, pt, PARENTS), [pt.sum(), rt.sum()]]).astype(np.int64)

    def into(self, x: State) -> State:
        """The whole state, with the kept sweeps."""
        many = np.flatnonzero(x.n > 1)
        for own, t, pt, rt in self.kept:
            whole = np.ones(len(x.n), np.int64)
            whole[many] = own
            x.kept.append((whole, self.customers(own), t, pt, rt))
        return x


_SEATS = "bucket int, seats binary, stats array<long>"
_BOTH = "bucket int, state binary, seats binary, stats array<long>"
_STATE = "bucket int, state binary"


def _seats_table(bucket: int, seats: Seats, state: State | None = None) -> pa.Table:
    columns = {"bucket": pa.array([bucket], pa.int32())}
    if state is not None:
        columns["state"] = pa.array([state.pack()], pa.binary())
    return pa.table(columns | {"seats": pa.array([seats.pack()], pa.binary()), "stats": pa.array([seats.stats()], pa.list_(pa.int64()))})


def _gather(key, table: pa.Table) -> pa.Table:
    got = [_unblob(p) for p in table.column("payload").to_pylist()]
    words, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    contexts, first, back = np.unique(np.concatenate([g[2] for g in got]), return_index=True, return_inverse=True)
    kind = np.concatenate([g[3] for g in got])[first]
    begin = np.cumsum([0, *(len(g[2]) for g in got)])
    at = np.repeat(place, np.concatenate([g[1] for g in got]))
    before = back[np.concatenate([g[4] + b for g, b in zip(got, begin, strict=False)])]
    n = np.concatenate([g[5] for g in got])
    cell = at * len(contexts) + before
    order = np.argsort(cell)
    cell = cell[order]
    new = packed.groups(cell)
    n = np.add.reduceat(n[order], new)
    at, before = np.divmod(cell[new], len(contexts))
    key_of = np.unique(at * CONTEXTS + kind[before])
    x = State(words, _sums(at, n, len(words)), key_of, contexts, kind, at, before, n)
    out = _seats_table(key[0].as_py(), Seats.first(x), x)
    release()
    return out


# --- totals of the restaurants of words -------------------------------------------------------------------------------


def _offer(bucket: int, contexts: np.ndarray, columns: list[np.ndarray], buckets: int, kind: int = 3) -> Iterator[tuple[int, int, bytes]]:
    """A bucket's shares of the totals of some contexts, a row for each of the contexts' buckets. kind 3 asks for the sums, kind 5 does not."""
    to = _bucket(contexts, -(-buckets // SUMMED))
    for a, b in packed.runs(to):
        yield int(to[a]), kind, _press(packed.join([packed.planes(np.array([bucket])), _steps(contexts[a:b]), *(packed.planes(c[a:b]) for c in columns)]))


def _offers(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Tables of the cells of more than one customer; in the first sweep (with the states) also of the others, which stay."""

    def rows():
        for batch in batches:
            first = "state" in batch.schema.names
            states = batch.column("state").to_pylist() if first else [None] * batch.num_rows
            for bucket, blob, state in zip(batch.column("bucket").to_pylist(), batch.column("seats").to_pylist(), states, strict=True):
                x = Seats.unpack(blob)
                columns = [_sums(x.before, x.now[0], len(x.contexts))]
                if first:
                    whole = State.unpack(state)
                    alone = _sums(whole.before[whole.n == 1], None, len(whole.contexts))
                    here = np.isin(whole.contexts, x.contexts, assume_unique=True)
                    columns.append(alone[here])
                    yield from _offer(bucket, whole.contexts[~here], [np.zeros(int((~here).sum()), np.int64), alone[~here]], buckets, 5)
                yield from _offer(bucket, x.contexts, columns, buckets)

    yield from _batches(rows())


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS_ARROW)], schema=_ROWS_ARROW)


def _total(key, table: pa.Table) -> pa.Table:
    """The sums of the offers to one bucket, to each bucket that asked, of its contexts in its order."""
    kinds = table.column("kind").to_pylist()
    offers = [packed.split(_unpress(p)) for p in table.column("payload").to_pylist()]
    hashes = [np.cumsum(packed.unplanes(o[1])) for o in offers]
    contexts, at = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    places = [at[b - len(h) : b] for h, b in zip(hashes, ends, strict=True)]
    sums = [np.zeros(len(contexts), np.int64) for _ in range(2, max(map(len, offers)))]
    for o, place in zip(offers, places, strict=True):
        for total, part in zip(sums, o[2:], strict=False):  # those that only ask have no shares
            total[place] += _whole(part)
    out = _table([(int(packed.unplanes(o[0])[0]), 3, _press(packed.join([packed.planes(np.array([key[0].as_py()])), *(packed.planes(c[place]) for c in sums)]))) for kind, o, place in zip(kinds, offers, places, strict=True) if kind == 3])
    release()
    return out


def _received(contexts: np.ndarray, payloads: list[bytes], columns: int, buckets: int) -> list[np.ndarray]:
    """What came back for all contexts that were asked for."""
    to = _bucket(contexts, -(-buckets // SUMMED))
    out = np.zeros((columns, len(contexts)), np.int64)
    for payload in payloads:
        parts = packed.split(_unpress(payload))
        a, b = np.searchsorted(to, [int(x) + int(packed.unplanes(parts[0])[0]) for x in (0, 1)])
        for column, part in zip(out, parts[1:], strict=False):
            column[a:b] = packed.unplanes(part)
    return list(out)


def _summed_stats(key, table: pa.Table) -> pa.Table:
    column = table.column("stats").combine_chunks()
    total = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table([pa.array([total], pa.list_(pa.int64()))], names=["stats"])


def _totals(state: DataFrame, buckets: int) -> tuple[int, int, Totals]:
    """Sums over the buckets, first in about sqrt(buckets) groups, then on the driver (17 KB from each group)."""
    groups = math.isqrt(max(1, buckets))
    rows = state.select((F.col("bucket") % groups).alias("g"), "stats").groupBy("g").applyInArrow(lambda key, table: _summed_stats(key, table), "stats array<long>").collect()
    size = 2 + 2 * CONTEXTS + 2 * PARENTS + 2
    total = np.sum([np.array(r["stats"], float) for r in rows], axis=0) if rows else np.zeros(size)
    cut = np.split(total, np.cumsum([2, CONTEXTS, CONTEXTS, PARENTS, PARENTS, 1]))
    return int(cut[0][0]), int(cut[0][1]), Totals(cut[1], cut[2], cut[3], cut[4], float(cut[5][0]), float(cut[6][0]))


# --- predictive probabilities and seating -----------------------------------------------------------------------------


def _root(c, t, totals: Totals, words: int, s: Settings):
    d, a = s.discounts[0], s.strengths[0]
    return (c - d * t + (a + d * totals.root_tables) / (words + 1)) / (a + totals.root_customers)


def _step(c, t, customers, tables, above, level: int, s: Settings):
    """Predictive probability of a word in a restaurant, from its customers and tables there and the parent's probability."""
    d, a = s.discounts[level], s.strengths[level]
    return (c - d * t + (a + d * tables) * above) / (a + customers)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, divided down."""
    below = x.copy()
    for k in range(1, 8):
        below *= x + k
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(below)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) from each key, for one salt."""
    return ((mix(mix(key + U(salt)) + U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(c: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of c customers who all have one dish, seated by the Chinese restaurant process; weight: that of a new table; key: 64 bits that name each cell.

    The first customers come one by one. After them, with t tables, customer i + 1 opens one with probability w / (i - dt + w); so m customers after
    the nth open none with probability G(n + m) / G(n), where G(x) = gamma(x - dt) / gamma(x - dt + w). A uniform draw is set against that, for the
    next opening customer: the same process, in as many steps as tables, searched from a guess. Cells with very many tables finish by themselves.
    """
    t, at = np.minimum(c, 1), np.flatnonzero(c > 1)
    salt = sweep * 1_000_003
    for j in range(1, _SINGLY):
        if not len(at):
            return t
        w = weight[at]
        t[at] += _uniform(key[at], salt + j) * (j - discount * t[at] + w) < w
        at = at[c[at] > j + 1]
    n, total, w, own = np.full(len(at), _SINGLY), c[at], weight[at], key[at]
    for turn in range(_SINGLY, 2 * _SINGLY):
        if not len(at):
            return t
        low = discount * t[at]
        draw = np.log(_uniform(own, salt + turn))
        want = draw + _stays(n, low, w)
        opens = _stays(total, low, w) < want
        at, n, total, w, own, low, want, draw = (x[opens] for x in (at, n, total, w, own, low, want, draw))
        below, above = n.copy(), total.copy()  # the opening customer is in (below, above]
        middle = np.clip(_guess(n - low, w, draw, total) + low, n, total).astype(np.int64)
        wide, step = np.flatnonzero(above - below > 1), 1
        middle = middle[wide]
        while len(wide):
            low_, w_, under, over = low[wide], w[wide], below[wide], above[wide]
            middle = np.clip(middle, under + 1, over - 1) if step <= _NEAR else (under + over) // 2
            past = _stays(middle, low_, w_) < want[wide]
            above[wide], below[wide] = np.where(past, middle, over), np.where(past, under, middle)
            still = above[wide] - below[wide] > 1
            wide, middle = wide[still], np.where(past, middle - step, middle + step)[still]
            step *= 4
        t[at] += 1
        more = above < total
        at, n, total, w, own = at[more], above[more], total[more], w[more], own[more]
    for cell, first, last, weigh, name in zip(at.tolist(), n.tolist(), total.tolist(), w.tolist(), own, strict=True):
        t[cell] = _alone(int(t[cell]), first, last, weigh, discount, np.random.default_rng([int(name), sweep]))
    return t


#: Customers seated one by one, and turns that all cells take together.
_SINGLY = 32
#: Customers who are asked one by one for the next opening, and the width of the search around a guess.
_NEAR = 16


def _guess(x: np.ndarray, w: np.ndarray, draw: np.ndarray, most: np.ndarray) -> np.ndarray:
    """About where gamma(x) / gamma(x + w) has fallen by exp(draw): it is nearly a power, (x + (w - 1) / 2) ** -w."""
    middle = x + (w - 1) / 2
    return middle * np.exp(np.minimum(-draw / w, np.log1p(most / middle) + 1)) - (w - 1) / 2


def _stays(x: np.ndarray, low: np.ndarray, w: np.ndarray) -> np.ndarray:
    below = x - low
    return log_gamma(below) - log_gamma(below + w)


def _alone(t: int, n: int, total: int, w: float, discount: float, rng: np.random.Generator) -> int:
    """One cell to its end; the same draws, number by number."""
    gamma, draws = math.lgamma, iter(())
    while n < total:
        u = next(draws, None)
        if u is None:
            draws = iter(np.log(rng.random(256)).tolist())
            u = next(draws)
        low = discount * t
        near, stays = math.exp(u), 1.0
        for m in range(n, min(total, n + _NEAR)):  # the next opening is most likely near
            stays *= (m - low) / (m - low + w)
            if stays < near:
                break
        if stays < near:
            n, t = m + 1, t + 1
            continue
        if n + _NEAR >= total:
            return t
        want = u + gamma(n - low) - gamma(n - low + w)
        if gamma(total - low) - gamma(total - low + w) >= want:
            return t
        below, above, step = n + _NEAR, total, max(1, int((n + w) / w))
        while below + step < above:  # widen from there
            if gamma(below + step - low) - gamma(below + step - low + w) < want:
                above = below + step
                break
            below += step
            step *= 2
        while above - below > 1:
            middle = (below + above) // 2
            if gamma(middle - low) - gamma(middle - low + w) < want:
                above = middle
            else:
                below = middle
        n, t = above, t + 1
    return t


def _sweep(key, stated: pa.Table, received: pa.Table, totals: Totals, words: int, s: Settings, sweep: int, buckets: int) -> pa.Table:
    x = Seats.unpack(stated.column("seats")[0].as_py())
    tables, *rest = _received(x.contexts, received.column("payload").to_pylist(), 1 if sweep else 2, buckets)
    if rest:
        x.rest = rest[0]
    tables = tables + x.rest
    salt = s.seed + 1000 * sweep
    parent, context = x.pkey % PARENTS, x.key % CONTEXTS
    mixed = mix(x.words)
    keys = [x.words, mix(x.words[x.pword] + (parent + 1).astype(U)), mix(x.words[x.word] + (context + 1 + PARENTS).astype(U)), mix(mixed[x.word[x.cell]] + x.contexts[x.before])]
    own, t, pt, rt = x.now
    root = _root(x.root(pt), rt, totals, words, s)
    p = _step(x.below(t), pt, totals.parent_customers[parent], totals.parent_tables[parent], root[x.pword], 1, s)
    d, a = s.discounts, s.strengths
    close = _step(x.customers(own), t, totals.context_customers[context], totals.context_tables[context], p[x.up], 2, s)
    own = seat(x.n, (s.word_strength + s.word_discount * tables[x.before]) * close[x.cell], s.word_discount, keys[3], salt)
    t = seat(x.customers(own), (a[2] + d[2] * totals.context_tables[context]) * p[x.up], d[2], keys[2], salt)
    pt = seat(x.below(t), (a[1] + d[1] * totals.parent_tables[parent]) * root[x.pword], d[1], keys[1], salt)
    base = np.full(len(x.words), (a[0] + d[0] * totals.root_tables) / (words + 1))
    rt = seat(x.root(pt), base, d[0], keys[0], salt)
    x.now = (own, t, pt, rt)
    if sweep >= s.burn:
        x.kept.append(x.now)
    out = _seats_table(key[0].as_py(), x)
    release()
    return out


def _complete(key, stated: pa.Table, seated: pa.Table) -> pa.Table:
    x = Seats.unpack(seated.column("seats")[0].as_py()).into(State.unpack(stated.column("state")[0].as_py()))
    out = pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([x.pack()], pa.binary())], names=["bucket", "state"])
    release()
    return out


def _save(df: DataFrame) -> DataFrame:
    """A scratch table; the files of the exchanges that made it go at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return runtime.save(df, "lm-state")
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from all rows of docs (doc_id, text)."""
    s = settings or Settings()
    spark = docs.sparkSession
    runtime.ship(spark)
    measured = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-measured // BUCKET_BYTES), min(runtime.shuffle_partitions(spark), -(-measured // LEAST_BYTES)))
    rows = docs.select("text").mapInArrow(partial(_count, buckets=buckets), _ROWS)
    whole = seats = _save(rows.groupBy("bucket").applyInArrow(lambda key, table: _gather(key, table), _BOTH))
    words, tokens, totals = _totals(seats, buckets)
    model = Model(s, words, tokens, buckets=buckets)
    for sweep in range(s.burn + s.samples):
        offers = seats.select("bucket", "seats", *([] if sweep else ["state"])).mapInArrow(partial(_offers, buckets=buckets), _ROWS)
        sums = offers.groupBy("bucket").applyInArrow(lambda key, table: _total(key, table), _ROWS)
        turn = partial(_sweep, totals=totals, words=words, s=s, sweep=sweep, buckets=buckets)
        after = _save(seats.select("bucket", "seats").groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(lambda key, left, right: turn(key, left, right), _SEATS))
        if seats is not whole:
            runtime.drop(seats)
        seats = after
        _, _, totals = _totals(seats, buckets)
        if sweep >= s.burn:
            model.samples.append(totals)
    model.state = _save(whole.select("bucket", "state").groupBy("bucket").cogroup(seats.select("bucket", "seats").groupBy("bucket")).applyInArrow(lambda key, left, right: _complete(key, left, right), _STATE))
    runtime.drop(whole)
    runtime.drop(seats)
    return model


# --- scoring ----------------------------------------------------------------------------------------------------------


def probabilities(x: State | None, word: np.ndarray, context: np.ndarray, samples: list[Totals], words: int, s: Settings, before: tuple | None = None) -> np.ndarray:
    """Mean predictive probability of each (word, class of the context); word: a place in x.words, or -1 if unknown. With before, that after a
    whole word: (places in x.contexts or -1, customers there, tables there in each sample)."""
    out = np.zeros(len(word))
    known = word >= 0
    parent = _PARENT[context]

    def find(keys, want, able):
        if not len(keys):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return at, able & (keys[at] == want)

    if x is not None:
        if not hasattr(x, "levels"):
            x.levels = [(own, c, t, x.below(t), pt, x.root(pt), rt) for own, c, t, pt, rt in x.kept]
            x.cells = x.at * max(1, len(x.contexts)) + x.before
        at, has = find(x.key, word * CONTEXTS + context, known)
        pat, phas = find(x.pkey, word * PARENTS + parent, known)
        if before is not None:
            cell, own_has = find(x.cells, word * max(1, len(x.contexts)) + before[0], known & (before[0] >= 0))
    for k, totals in enumerate(samples):
        c = t = pc = pt = rc = rt = own_c = own_t = 0.0
        if x is not None and len(x.words):
            own, kc, kt, below, kpt, root, krt = x.levels[k]
            safe = np.where(known, word, 0)
            c, t = np.where(has, kc[at], 0), np.where(has, kt[at], 0)
            pc, pt = np.where(phas, below[pat], 0), np.where(phas, kpt[pat], 0)
            rc, rt = np.where(known, root[safe], 0), np.where(known, krt[safe], 0)
            if before is not None and len(x.n):
                own_c, own_t = np.where(own_has, x.n[cell], 0), np.where(own_has, own[cell], 0)
        p = _root(rc, rt, totals, words, s)
        p = _step(pc, pt, totals.parent_customers[parent], totals.parent_tables[parent], p, 1, s)
        p = _step(c, t, totals.context_customers[context], totals.context_tables[context], p, 2, s)
        if before is not None:
            p = (own_c - s.word_discount * own_t + (s.word_strength + s.word_discount * before[2][k]) * p) / (s.word_strength + before[1])
        out += p
    return out / max(1, len(samples))


def _frequent(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("state").to_pylist():
            x = State.unpack(blob)
            top = x.count >= least
            yield pa.record_batch([pa.array(x.words[top].view(np.int64)), pa.array(x.count[top])], names=["word", "c"])


def _common(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The `most` most frequent words of each bucket."""
    for batch in batches:
        for blob in batch.column("state").to_pylist():
            x = State.unpack(blob)
            top = np.argsort(-x.count, kind="stable")[:most]
            yield pa.record_batch([pa.array(x.words[top].view(np.int64)), pa.array(x.count[top])], names=["word", "c"])


def _shares(batches: Iterator[pa.RecordBatch], contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket's customers and tables in the restaurants of frequent words, and their classes, HEAD_PART words to a row."""

    def rows():
        for batch in batches:
            for blob in batch.column("state").to_pylist():
                x = State.unpack(blob)
                columns = [_sums(x.before, w, len(x.contexts)) for w in (x.n, *(own for own, *_ in x.kept))] + [x.kind]
                place = np.minimum(np.searchsorted(contexts, x.contexts), len(contexts) - 1)
                here = np.flatnonzero(contexts[place] == x.contexts)
                place = place[here]
                for a, b in packed.runs(place // HEAD_PART):
                    yield int(place[a]) // HEAD_PART, 0, _press(packed.join([packed.planes(place[a:b] % HEAD_PART), *(packed.planes(c[here[a:b]]) for c in columns)]))

    yield from _batches(rows())


def _shared(key, table: pa.Table) -> pa.Table:
    columns = None
    for payload in table.column("payload").to_pylist():
        at, *got = (_whole(p) for p in packed.split(_unpress(payload)))
        columns = [np.zeros(HEAD_PART, np.int64) for _ in got] if columns is None else columns
        for total, part in zip(columns[:-1], got[:-1], strict=True):
            total[at] += part
        columns[-1][at] = got[-1]
    return _table([(key[0].as_py(), 0, packed.join([packed.planes(c) for c in columns]))])


def _head(model: Model) -> Head:
    """HEAD frequent words as contexts: customers, tables and classes on the driver (2 MB at most)."""
    most = 64 + 4 * HEAD // model.buckets
    found = model.state.select("state").mapInArrow(partial(_common, most=most), "word long, c long").orderBy(F.desc("c"), "word").limit(HEAD).select("word").collect()
    contexts = np.unique(np.concatenate([np.array([r["word"] for r in found], np.int64).view(U), [START]]))
    rows = model.state.select("state").mapInArrow(partial(_shares, contexts=contexts), _ROWS).groupBy("bucket").applyInArrow(lambda key, table: _shared(key, table), _ROWS).select("bucket", "payload").collect()
    columns = np.zeros((len(model.samples) + 2, -(-len(contexts) // HEAD_PART) * HEAD_PART), np.int64)
    for r in rows:
        columns[:, r["bucket"] * HEAD_PART : (r["bucket"] + 1) * HEAD_PART] = [_whole(p) for p in packed.split(bytes(r["payload"]))]
    columns = columns[:, : len(contexts)]
    order = np.argsort(-columns[0], kind="stable")
    order = order[columns[0][order] > 0]
    customers, *tables, kind = columns[:, order]
    return Head(contexts[order], kind, customers, tables)


def _rest(batches: Iterator[pa.RecordBatch], head: Head, buckets: int) -> Iterator[pa.RecordBatch]:
    """The buckets' customers and tables in the restaurants of all other words."""

    def rows():
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("state").to_pylist(), strict=True):
                x = State.unpack(blob)
                other = ~np.isin(x.contexts, head.contexts, assume_unique=True)
                columns = [_sums(x.before, w, len(x.contexts))[other] for w in (x.n, *(own for own, *_ in x.kept))]
                yield from _offer(bucket, x.contexts[other], columns, buckets, 5)

    yield from _batches(rows())


def _part(before: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix(before + U(0x632BE59BD9B4E019)) % parts.astype(U)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], split: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The states (kind 4), without the words that are dealt by context, and pieces of those."""
    words, parts = split

    def rows():
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("state").to_pylist(), strict=True):
                x = State.unpack(blob)
                dealt = np.isin(x.words, words)
                yield bucket, 4, x.take(~dealt, np.ones(len(x.n), bool)).pack()
                for w in np.flatnonzero(dealt).tolist():
                    n = int(parts[np.searchsorted(words, x.words[w])])
                    part = _part(x.contexts, np.full(len(x.contexts), n))[x.before]
                    for k in range(n):
                        yield (bucket + k) % buckets, 4, x.take(np.arange(len(x.words)) == w, part == k).pack()

    yield from _batches(rows())


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * -_FIX).astype(np.int64)


def _whole_sums(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, w)
    return out


def _partial(ids: np.ndarray, n: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> bytes:
    order = np.argsort(ids, kind="stable")
    return packed.join([packed.deltas(ids[order]), *(packed.planes(packed.zigzag(c[order])) for c in (n, known, base, score))])


def _ask(batches: Iterator[pa.RecordBatch], split: tuple[np.ndarray, np.ndarray], head: Head, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each document's number of tokens (kind 1), and its tokens for their words' buckets (kind 0)."""
    words, parts = split

    def rows():
        for turn, (held, ids, size) in enumerate(_chunks(batches, True)):
            doc, row = np.unique(np.concatenate(ids), return_inverse=True)
            held = [(h, context, before, row[r]) for h, context, before, r in held]
            none = np.zeros(len(doc), np.int64)
            yield turn % buckets, 1, _partial(doc, sum(np.bincount(h[3], minlength=len(doc)) for h in held), none, none, none)
            x = Chunk(held, len(doc))
            to = _bucket(x.words, buckets)[x.at]
            if len(words):
                at = np.minimum(np.searchsorted(words, x.words), len(words) - 1)
                dealt = np.flatnonzero((words[at] == x.words)[x.at])
                to[dealt] = (to[dealt] + _part(x.words[x.before[dealt]], parts[at[x.at[dealt]]])) % buckets
            yield from x.blobs(buckets, head.contexts, (packed.deltas(doc),), to, rows=True)

    yield from _batches(rows())


def _want(key, asked: pa.Table, buckets: int) -> pa.Table:
    """The words before that a bucket's tokens ask with, beside the frequent ones."""
    found = [np.cumsum(packed.unplanes(packed.split(_unpress(p))[2])) for kind, p in zip(asked.column("kind").to_pylist(), asked.column("payload").to_pylist(), strict=True) if kind == 0]
    out = _table(list(_offer(key[0].as_py(), np.unique(np.concatenate(found)), [], buckets)) if found else [])
    release()
    return out


def _answer(key, asked: pa.Table, pieces: pa.Table, model: tuple, head: Head, denominator: float, parts: int, buckets: int) -> pa.Table:
    """Partial sums of the documents that asked, for their own buckets. Each distinct (word, word before) of the bucket is looked up once."""
    samples, words, s = model
    rows = list(zip(pieces.column("kind").to_pylist(), pieces.column("payload").to_pylist(), strict=True))
    x = State.merged([State.unpack(p) for kind, p in rows if kind == 4])
    got, tokens = [], []
    for kind, payload in zip(asked.column("kind").to_pylist(), asked.column("payload").to_pylist(), strict=True):
        if kind == 1:
            cut = packed.split(payload)
            got.append((packed.undeltas(cut[0]), *(packed.unzigzag(packed.unplanes(b)) for b in cut[1:])))
        else:
            tokens.append(_unblob(payload))
    if tokens:
        rest, first, back = np.unique(np.concatenate([g[2] for g in tokens]), return_index=True, return_inverse=True)
        received = _received(rest, [p for kind, p in rows if kind == 3], len(samples) + 1, buckets)
        contexts = np.concatenate([head.contexts, rest])
        kind = np.concatenate([head.kind, np.concatenate([g[3] for g in tokens])[first]])
        customers, *tables = (np.concatenate(c) for c in zip([head.customers, *head.tables], received, strict=True))
        asking, place = np.unique(np.concatenate([g[0] for g in tokens]), return_inverse=True)
        known, count, own = np.full(len(asking), -1), np.zeros(len(asking), np.int64), np.full(len(contexts), -1)
        if x is not None and len(x.words):
            at = np.minimum(np.searchsorted(x.words, asking), len(x.words) - 1)
            known = np.where(x.words[at] == asking, at, -1)
            count = np.where(known >= 0, x.count[at], 0)
            if len(x.contexts):
                at = np.minimum(np.searchsorted(x.contexts, contexts), len(x.contexts) - 1)
                own = np.where(x.contexts[at] == contexts, at, -1)
        base = _fixed(np.log10((count + 1) / denominator))
        keys, begin, size = [], np.cumsum([0, *(len(g[2]) for g in tokens)]), len(head.contexts)
        turns = np.cumsum([0, *(len(g[0]) for g in tokens)])
        for k, (h, sizes, _, _, code, _, _) in enumerate(tokens):
            code = code.copy()
            listed = code >= size
            code[listed] = size + back[begin[k] + code[listed] - size]
            keys.append(np.repeat(place[turns[k] : turns[k] + len(h)], sizes) * len(contexts) + code)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([0, *map(len, keys)])
        del keys
        found = np.empty(len(distinct), np.int64)
        for a in range(0, len(distinct), 1 << 16):
            word, before = np.divmod(distinct[a : a + (1 << 16)], len(contexts))
            found[a : a + len(word)] = _fixed(np.log10(probabilities(x, known[word], kind[before], samples, words, s, (own[before], customers[before], [t[before] for t in tables]))))
        for k, (h, sizes, _, _, _, n, rest_parts) in enumerate(tokens):
            row, doc = _whole(rest_parts[0]), packed.undeltas(rest_parts[1])
            word = np.repeat(place[turns[k] : turns[k] + len(h)], sizes)
            sums = partial(_whole_sums, row, n=len(doc))
            got.append((doc, np.zeros(len(doc), np.int64), sums(w=n * (known[word] >= 0)), sums(w=n * base[word]), sums(w=n * found[at[ends[k] : ends[k + 1]]])))
    ids, *columns = (np.concatenate(c) for c in zip(*got, strict=True)) if got else [np.empty(0, np.int64)] * 5
    doc, columns = _summed(ids, columns)
    to = (doc.view(np.uint64) * U(0x9E3779B97F4A7C15) >> U(32)).astype(np.int64) % parts
    order = np.argsort(to, kind="stable")
    doc, to, columns = doc[order], to[order], [c[order] for c in columns]
    release()
    return _table([(int(to[a]), 2, _partial(doc[a:b], *(c[a:b] for c in columns))) for a, b in packed.runs(to)])


def _summed(ids: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(ids, kind="stable")
    first = packed.groups(ids[order])
    return ids[order][first], [np.add.reduceat(c[order], first) if len(first) else c for c in columns]


def _finish(key, table: pa.Table, tokens: int) -> pa.Table:
    got = []
    for payload in table.column("payload").to_pylist():
        cut = packed.split(payload)
        got.append((packed.undeltas(cut[0]), *(packed.unzigzag(packed.unplanes(b)) for b in cut[1:])))
    ids, *columns = (np.concatenate(c) for c in zip(*got, strict=True))
    doc, (n, known, base, score) = _summed(ids, columns)
    return pa.table([pa.array(doc), pa.array(n), pa.array(known), pa.array(np.full(len(doc), tokens, np.int64)), pa.array(base / -_FIX), pa.array(score / -_FIX)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability) for each document."""
    spark = docs.sparkSession
    runtime.ship(spark)
    s, denominator = model.settings, float(model.tokens + model.words + 1)
    small, buckets = (model.samples, model.words, s), model.buckets
    top = model.state.select("state").mapInArrow(partial(_frequent, least=max(1.0, model.tokens / s.head)), "word long, c long").collect()  # s.head rows at most
    words, count = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(words)
    # a piece stands for a quarter of a bucket's tokens
    split = (words[order], np.clip(-(-4 * count[order] * buckets // max(1, model.tokens)), 1, buckets))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() > 0
    key = F.xxhash64("doc_id", "text") if repeats else F.col("doc_id")
    named = plain.select(key.alias("doc_id"), "text")
    head = _head(model)
    asked = named.mapInArrow(partial(_ask, split=split, head=head, buckets=buckets), _ROWS).repartition(runtime.shuffle_partitions(spark), "bucket")  # read twice
    pieces = model.state.select("bucket", "state").mapInArrow(partial(_pieces, split=split, buckets=buckets), _ROWS)
    rest = model.state.select("bucket", "state").mapInArrow(partial(_rest, head=head, buckets=buckets), _ROWS)
    want, answer = partial(_want, buckets=buckets), partial(_answer, model=small, head=head, denominator=denominator, parts=buckets, buckets=buckets)
    sums = asked.groupBy("bucket").applyInArrow(lambda key, table: want(key, table), _ROWS).unionAll(rest).groupBy("bucket").applyInArrow(lambda key, table: _total(key, table), _ROWS)
    answers = asked.groupBy("bucket").cogroup(pieces.unionAll(sums).groupBy("bucket")).applyInArrow(lambda key, left, right: answer(key, left, right), _ROWS)
    finish = partial(_finish, tokens=model.tokens)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = answers.groupBy("bucket").applyInArrow(lambda key, table: finish(key, table), schema)
    if not repeats:
        return out
    # equal rows asked under one key: its sums are theirs together
    rows = plain.select("doc_id", key.alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    each = out.withColumnRenamed("doc_id", "key").join(copies, "key")
    part = lambda c, kind: (F.col(c) / F.col("copies")).cast(kind).alias(c)
    each = each.select("key", part("n_tokens", "long"), part("n_known", "long"), "train_tokens", part("base_score", "double"), part("score", "double"))
    return rows.join(each, "key").select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


HELD_OUT = "crc32(cast(cast(doc_id as bigint) as string)) % 7 = 2"


def digest(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model = fit(docs.where(~held), settings)
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity over all tokens of scored documents."""
    per = lambda c: F.pow(10.0, -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
