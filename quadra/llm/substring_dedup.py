"""Exact substring deduplication by fixed-block anchors.

Method. Each document is cut into non-overlapping reference blocks of `size // 2` words; any window of `size`
words holds a whole block. The blocks are the index; every rolling window of a block's length probes it. Hits
are extended to the `size`-word windows around them, which are compared by two independent hashes of their words (96 bits
and the bucket); runs of equal windows are the maximal exact repeats. Of equal windows the first (smallest doc_id, then smallest start) stays;
the words of all others are removed.

Execution. Probes travel as packed rows, one for each (map chunk, hash bucket): about six bytes a word. A
chunk sends one entry for each distinct hash, so that a passage in a third of all documents adds at most one
entry a chunk to its bucket. Answers come back packed for each bucket of documents. Text moves once, by a hash of doc_id;
both times that answers meet their documents use that exchange. Buckets and groups of documents are as many as the measured
bytes of text need (`GROUP_BYTES` each), and at least the shuffle partitions, which may hold many of them.

Defined cases: a null text has no words; rows that repeat doc_id and text are the same document (no copy of one
another, all rows returned); rows that share a doc_id with other text count as equally early; a row with null
doc_id is returned unchanged and is compared with nothing; an empty table gives no rows; extra columns, whatever their names, are
ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm import packed
from quadra.llm.text import U, Words, bucket_of, fresh, release, slices

#: Probes or windows that a map task gathers before it sends them on.
CHUNK = 500_000
#: Bytes of text that a group of documents, or the probes in a hash bucket, stand for on average.
GROUP_BYTES = 8 << 20
#: Bytes sent of a probe's hash, besides the bucket: equal probes are candidates only, and a bucket's share of the
#: corpus is the same at every size, so a false candidate stays rare.
PROBE_BYTES = 4
#: Bytes sent of a window's two hashes, besides the bucket.
WINDOW_BYTES = (6, 6)
_SENT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("payload", pa.binary())])
_FOUND = pa.schema([("__group", pa.int32()), ("payload", pa.binary())])


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, [(bucket, begin, end)]), keeping the order within a bucket."""
    to = (h % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(to, kind="stable")
    ranked = to[order]
    return order, [(int(ranked[a]), a, b) for a, b in packed.runs(ranked)]


def _rows(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 256):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 256], strict=True), _SENT, strict=True)], schema=_SENT)


def _send_probes(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows for the exchange. Equal probes of one chunk are hits already (settled); one of them is sent on, to stand for all."""
    rank = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[rank[1:]] != h[rank[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(first, append=len(h))
    flag = np.zeros(len(h), np.uint8)
    flag[rank[first]] = np.bitwise_or.reduceat((pos[rank] % block == 0).astype(np.uint8), first) | ((sizes > 1).astype(np.uint8) << 1)
    several = np.repeat(sizes > 1, sizes)
    rows = []
    if several.any():
        s = np.sort(rank[several])
        rows.append((int(h[s[0]] % U(buckets)), True, packed.join(packed.places(doc[s], pos[s]))))
    sent = np.sort(rank[first])  # as they were read
    h, doc, pos, flag = h[sent], doc[sent], pos[sent], flag[sent]
    order, cuts = _by_bucket(h, buckets)
    for bucket, a, b in cuts:
        at = order[a:b]
        rest = (h[at] // U(buckets)) & U((1 << 8 * PROBE_BYTES) - 1)
        rows.append((bucket, False, packed.join([*packed.places(doc[at], pos[at]), packed.planes(rest, PROBE_BYTES), packed.planes(flag[at])])))
    yield from _rows(rows)


def _send_windows(h: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the exchange. All but the first of equal windows of one chunk are repeats already, unless they are that same place again."""
    order = np.lexsort((pos, doc, check, h))
    h, check, doc, pos = h[order], check[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    settled = np.flatnonzero(~new & ((doc != doc[first][group]) | (pos != pos[first][group])))
    rows = []
    if len(settled):
        s = settled[np.lexsort((pos[settled], doc[settled]))]
        rows.append((int(h[0] % U(buckets)), True, packed.join([*packed.places(doc[s], pos[s]), packed.planes(check[s] & U(0xFFFFFFFF), 4)])))
    first = first[np.lexsort((pos[first], doc[first]))]
    h, check, doc, pos = h[first], check[first], doc[first], pos[first]
    order, cuts = _by_bucket(h, buckets)
    for bucket, a, b in cuts:
        at = order[a:b]
        sums = [packed.planes(x & U((1 << 8 * n) - 1), n) for x, n in zip((h[at] // U(buckets), check[at]), WINDOW_BYTES, strict=True)]
        rows.append((bucket, False, packed.join([*packed.places(doc[at], pos[at]), *sums])))
    yield from _rows(rows)


def _chunked(pieces: Iterator[tuple], send, chunk: int) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0

    def flush():
        return send(*(np.concatenate(x) for x in zip(*parts, strict=True))) if held else ()

    for piece in pieces:
        parts.append(piece)
        held += len(piece[0])
        if held >= chunk:
            yield from flush()
            parts, held = [], 0
    yield from flush()


def _probes(batches: Iterator[pa.RecordBatch], size: int, buckets: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Every rolling window of a block's length, of documents that have a whole `size`-word window."""

    def pieces():
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h, row, start = words.windows(size // 2)
            keep = words.counts[row] >= size
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield h[keep], ids[row[keep]], start[keep].astype(np.uint32)

    yield from _chunked(pieces(), partial(_send_probes, buckets=buckets, block=size // 2), chunk)


def _unpacked(table: pa.Table) -> Iterator[tuple[bool, list[bytes]]]:
    for settled, payload in zip(table.column("settled"), table.column("payload"), strict=True):
        yield settled.as_py(), packed.split(payload.as_py())


def _answered(parts: list[tuple], groups: int) -> pa.Table:
    """(doc, pos, check) columns as a row for each group of documents."""
    if not parts:
        return _FOUND.empty_table()
    doc, pos, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    to = bucket_of(doc, groups)
    order = np.lexsort((pos, doc, to))
    doc, pos, check, to = doc[order], pos[order], check[order], to[order]
    rows = [(int(to[a]), packed.join([*packed.places(doc[a:b], pos[a:b]), packed.planes(check[a:b], 4)])) for a, b in packed.runs(to)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_FOUND)


def _match_probes(table: pa.Table, groups: int) -> pa.Table:
    """One bucket: the hits, that is, the probes that equal another one while one of them is a reference block."""
    hs, flags, raw, out = [], [], [], []
    for settled, parts in _unpacked(table):
        if settled:
            doc, pos = packed.unplaces(parts[:3])
            out.append((doc, pos, np.zeros(len(doc), U)))
            continue
        hs.append(packed.unplanes(parts[3]).astype(np.uint32))
        flags.append(packed.unplanes(parts[4]).astype(np.uint8))
        raw.append(parts[:3])
    if hs:
        h, flag = np.concatenate(hs), np.concatenate(flags)
        ranked = np.sort((h.astype(U) << U(32)) | np.arange(len(h), dtype=U))  # a bucket has far fewer than 2**32 probes
        order, first = (ranked & U(0xFFFFFFFF)).astype(np.uint32), packed.groups((ranked >> U(32)).astype(np.uint32))
        sizes = np.diff(first, append=len(h))
        live = (sizes > 1) & (np.bitwise_or.reduceat(flag[order], first) & 1 > 0)
        hit = np.zeros(len(h), bool)
        hit[order[np.repeat(live, sizes)]] = True
        hit &= flag < 2  # those with more in their chunk are settled
        at = 0
        for parts, own in zip(raw, hs, strict=True):
            mine = hit[at : at + len(own)]
            at += len(own)
            if mine.any():
                doc, pos = packed.unplaces(parts)
                out.append((doc[mine], pos[mine], np.zeros(int(mine.sum()), U)))
    return _answered(out, groups)


def _match_windows(table: pa.Table, groups: int) -> pa.Table:
    """One bucket: the windows that are not the first of their kind."""
    held, out = [], []
    for settled, parts in _unpacked(table):
        doc, pos = packed.unplaces(parts[:3])
        if settled:
            out.append((doc, pos, packed.unplanes(parts[3])))
        else:
            held.append((doc, pos, packed.unplanes(parts[3]), packed.unplanes(parts[4])))
    if held:
        doc, pos, h, check = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((pos, doc, check, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = order[(doc[order] != doc[first]) | (pos[order] != pos[first])]
        out.append((doc[later], pos[later], check[later] & U(0xFFFFFFFF)))
    return _answered(out, groups)


class Answers:
    """What the buckets found for a group of documents."""

    def __init__(self, found: pa.Table):
        parts = [packed.split(p) for p in found.column("payload").to_pylist()]
        places = [packed.unplaces(p[:3]) for p in parts]
        doc = np.concatenate([x[0] for x in places]) if places else np.empty(0, np.int64)
        pos = np.concatenate([x[1] for x in places]) if places else np.empty(0, np.int64)
        check = np.concatenate([packed.unplanes(p[3]) for p in parts]) if parts else np.empty(0, U)
        order = np.lexsort((pos, doc))
        self.doc, self.pos, self.check = doc[order], pos[order], check[order]

    def of(self, ids: pa.Array) -> list[tuple[int, int]]:
        """Each row's range of answers; none for null ids."""
        wanted = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.searchsorted(self.doc, wanted, "left"), np.searchsorted(self.doc, wanted, "right")
        high = np.where(ids.is_null().to_numpy(zero_copy_only=False), low, high)
        return list(zip(low.tolist(), high.tolist(), strict=True))


def _grouped(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    return slices(iter(docs.combine_chunks().to_batches()))


def _extend(docs: pa.Table, found: pa.Table, size: int, buckets: int, chunk: int) -> pa.Table:
    """The `size`-word windows of a group of documents that may repeat, given the hits."""
    block, answers = size // 2, Answers(found)

    def pieces():
        for batch in _grouped(docs) if len(answers.doc) else ():
            mine = answers.of(batch.column("doc_id"))
            words = Words(batch.column("text"))
            counts, begins = words.counts, words.rows[:-1]
            hit = np.zeros(len(words) + size, bool)
            for r, (a, b) in enumerate(mine):
                pos = answers.pos[a:b]
                hit[begins[r] + pos[pos <= counts[r] - block]] = True  # rows of other text may share the doc_id
            h, row, start = words.windows(size)
            # a repeated window's own reference blocks are hits, all of them
            own = -start % block
            at = begins[row] + start + own
            keep = hit[at] & (hit[at + block] | (own + 2 * block > size))
            check = words.windows(size, 1)[0]
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            yield h[keep], check[keep], ids[row[keep]], start[keep].astype(np.uint32)

    out = pa.Table.from_batches(list(_chunked(pieces(), partial(_send_windows, buckets=buckets), chunk)), schema=_SENT)
    release()
    return out


def removed_words(words: Words, answers: Answers, mine: list[tuple[int, int]], size: int) -> np.ndarray:
    """For each word of a batch whether it is removed; mine: each row's range of answers."""
    counts, begins = words.counts, words.rows[:-1]
    mark = np.zeros(len(words) + 1, np.int64)
    check = None
    for r, (a, b) in enumerate(mine):
        if a == b:
            continue
        pos, want = answers.pos[a:b], answers.check[a:b]
        if check is None:
            h, row, start = words.windows(size, 1)
            check = np.zeros(len(words) + 1, np.uint64)
            check[begins[row] + start] = h & U(0xFFFFFFFF)
        ok = (pos + size <= counts[r]) & (pos >= 0)
        pos, want = pos[ok], want[ok]
        pos = begins[r] + pos[check[begins[r] + pos] == want]
        np.add.at(mark, pos, 1)
        np.add.at(mark, pos + size, -1)
    return np.cumsum(mark)[:-1] > 0


def _process(docs: DataFrame, size: int, finish, schema, chunk: int, group_bytes: int) -> DataFrame:
    """finish(documents, answers) over groups of documents, with the starts of their windows that repeat an earlier one. The
    documents come with one more column, the last one."""
    spark = docs.sparkSession
    runtime.ship(spark)
    n = runtime.shuffle_partitions(spark)
    measured = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = groups = max(n, -(-measured // group_bytes))
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.select("doc_id", "text").where("doc_id is not null")
    sent = "bucket int, settled boolean, payload binary"
    found = "__group int, payload binary"
    probes = named.mapInArrow(partial(_probes, size=size, buckets=buckets, chunk=chunk), sent)
    hits = probes.groupBy("bucket").applyInArrow(lambda table: _match_probes(table, groups), found)
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).cast("int")
    name = fresh("__group", docs.columns)
    moved = docs.withColumn(name, group).repartition(n, name)  # both uses below read this one exchange
    windows = moved.groupBy(name).cogroup(hits.groupBy("__group")).applyInArrow(lambda left, right: _extend(left, right, size, buckets, chunk), sent)
    later = windows.groupBy("bucket").applyInArrow(lambda table: _match_windows(table, groups), found)
    return moved.groupBy(name).cogroup(later.groupBy("__group")).applyInArrow(lambda left, right: finish(left, right), schema)


def _digest(docs: pa.Table, found: pa.Table, size: int) -> pa.Table:
    answers, out = Answers(found), []
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for batch in _grouped(docs):
        words = Words(batch.column("text"))
        gone = removed_words(words, answers, answers.of(batch.column("doc_id")), size)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[words.rows[1:]] - sums[words.rows[:-1]]
        digests = [hashlib.sha256(kept_text(words, r, gone)).hexdigest() for r in range(batch.num_rows)]
        out.append(pa.table([batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=names))
    release()
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=names)


def kept_text(words: Words, r: int, gone: np.ndarray) -> bytes:
    """The words of row r that stay, joined by one space."""
    a, b = words.rows[r], words.rows[r + 1]
    row = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes().split()
    return b" ".join([w for w, g in zip(row, gone[a:b].tolist(), strict=True) if not g] if gone[a:b].any() else row)


def digest(docs: DataFrame, size: int = 20, chunk: int = CHUNK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    return _process(docs.select("doc_id", "text"), size, partial(_digest, size=size), "doc_id long, n_words long, n_removed long, kept_sha256 string", chunk, group_bytes)


def _rewrite(docs: pa.Table, found: pa.Table, size: int) -> pa.Table:
    answers, out = Answers(found), []
    docs = docs.select(docs.column_names[:-1])
    for batch in _grouped(docs):
        words = Words(batch.column("text"))
        gone = removed_words(words, answers, answers.of(batch.column("doc_id")), size)
        texts = batch.column("text").to_pylist()
        sums = np.concatenate([[0], np.cumsum(gone)])
        for r in np.flatnonzero(sums[words.rows[1:]] > sums[words.rows[:-1]]).tolist():
            texts[r] = kept_text(words, r, gone).decode("utf-8", "replace")
        columns = [pa.array(texts, f.type) if f.name == "text" else batch.column(i) for i, f in enumerate(batch.schema)]
        out.append(pa.Table.from_batches([pa.record_batch(columns, schema=batch.schema)]))
    release()
    return pa.concat_tables(out) if out else docs


def rewrite(docs: DataFrame, size: int = 20, chunk: int = CHUNK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with the repeated words taken out of `text`: a changed text is its kept words joined by one space."""
    schema = docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema
    return _process(docs, size, partial(_rewrite, size=size), schema, chunk, group_bytes).select(*docs.columns)
