"""Near copies by five-word shingles: SimHash fingerprints compared by bit planes, links verified exactly at a Jaccard similarity.

Shingles. Texts are lower-cased (A-Z) and cut into words; each run of five words is a shingle, kept as a 64-bit hash; a text of fewer words is
one shingle. Texts with equal sets of shingles are one node. A node's fingerprint has a bit set where over half of its
shingles' hashes have it. At a similarity of 0.8 a bit differs with probability acos(0.889) / pi = 0.151 (0.19 at most, for sets of four and five), so 64
bits differ in 9.7 (12) places on average, deviation 2.9 (3.1): within RADIUS = 24 a pair is found with probability 0.9999 and more, while of
unrelated texts (32 places, deviation 4) a few in a hundred are.

Groups. No choice of segments of 64 bits indexes a radius of 24, so the groups that are compared come from shared minima instead: each of BANDS keys
joins the minima of ROWS hash functions; a pair of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Under each
key, of two nodes or of many, fingerprints are laid out as bit planes and compared within the radius. Such a group sends a spanning forest of
what is near, not its pairs, so near pairs of all keys are within the components of the forests.

Verification. Sets of shingles move once, to their component. There the planes compare all nodes, and near ones are linked if their sets have a
similarity of `similarity` or more, counted from the sets themselves; nodes that are connected already are not counted. What comes out is
a spanning forest of the links. A key or a component that is large (in members or in bytes) is cut into parts, which meet pairwise in tasks of
their own. Only texts that a Bloom filter of fixed size lets through are cut into shingles again; what it lets through in error is dropped by a join.
Another one spares the rows that stay the join that takes the others out.

Defined cases: null text is empty; empty texts are one node; rows with null doc_id stay; an empty table gives no rows; extra columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.simhash import BLOCK, LARGE, Planes, runs
from quadra.llm.text import U, Words, fresh, mix, slices, spread
from quadra.operators.components import components

BANDS, ROWS, SIZE = 20, 5, 5
RADIUS = 24
#: Bytes of sets of shingles in a part of a component, and shingles that are counted at a time.
PART_BYTES, COUNTED = 16 << 20, 1 << 20
#: The Bloom filter has 2**BLOOM bits, SPOTS of them for each text.
BLOOM, SPOTS = 24, 4
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins): the distinct shingles of row r, ascending, are hashes[begins[r]:begins[r + 1]]."""
    words = Words(column, lower=True)
    found, row, _ = words.windows(size)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        flat = words.data
        one = [xxhash.xxh64_intdigest(b" ".join(flat[words.offsets[r] : words.offsets[r + 1]].tobytes().split()), 42) for r in short.tolist()]
        found, row = np.concatenate([found, np.array(one, U)]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(counts) + 1))


def _prints(found: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each row's set (zero if empty), and the rows that have shingles."""
    full = np.flatnonzero(np.diff(begins))
    out = np.zeros(len(begins) - 1, U)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(found + U(0xA0761D6478BD642F)), begins[full]) + U(1))
    return out, full


def _bits(found: np.ndarray, begins: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each row that has shingles."""
    out, sizes = np.zeros(len(full), U), np.diff(begins)[full]
    for b in range(64 if len(full) else 0):
        ones = np.add.reduceat((found >> U(b)) & U(1), begins[full])
        out |= (2 * ones > sizes.astype(U)).astype(U) << U(b)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found, begins = _shingles(batch.column("text"), size)
        fp, full = _prints(found, begins)
        keys = np.empty((len(full), BANDS), U)
        if len(full):
            for band in range(BANDS):
                key = np.full(len(full), U(band + 1))
                for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                    key = mix(key * U(0xD6E8FEB86659FD93) + np.minimum.reduceat(found * f, begins[full]))
                keys[:, band] = key
        bits = np.zeros(batch.num_rows, U)
        bits[full] = _bits(found, begins, full)
        sizes = np.zeros(batch.num_rows + 1, np.int32)
        sizes[full + 1] = BANDS
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view(np.int64)), pa.array(np.diff(begins).astype(np.int64)), pa.array(bits.view(np.int64)), listed], names=["doc_id", "text_hash", "fp", "n", "bits", "keys"])


def _spots(h: np.ndarray) -> np.ndarray:
    """The places of each hash in the Bloom filter, a row for each hash."""
    return (mix(h[:, None] + np.arange(1, SPOTS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(64 - BLOOM)).astype(np.int64)


def _bloom_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _spots(batch.column("text_hash").to_numpy().view(U)).ravel()
        yield pa.record_batch([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], names=["word", "bits"])


def _bloom(hashes: DataFrame) -> np.ndarray:
    """The Bloom filter of text_hash, as 64-bit words: 2 MB, whatever the number of texts."""
    found = hashes.select("text_hash").mapInArrow(_bloom_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BLOOM - 6, U)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U)
    return out


def _through(bloom: np.ndarray, h: pa.Array) -> pa.Array:
    """Which hashes pass the filter: all that it was made of, and a few others."""
    at = _spots(h.to_numpy(zero_copy_only=False).view(U))
    return pa.array(((bloom[at >> 6] >> (at & 63).astype(U)) & U(1)).all(axis=1))


def _sets(batches: Iterator[pa.RecordBatch], size: int, bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """fp, shingles of the texts that pass the filter, once for each slice."""

    def passing():
        for batch in batches:
            yield batch.filter(_through(bloom, batch.column("text_hash")))

    for batch in slices(passing()):
        found, begins = _shingles(batch.column("text"), size)
        fp, _ = _prints(found, begins)
        fp, first = np.unique(fp, return_index=True)
        raw = [found[begins[r] : begins[r + 1]].tobytes() for r in first.tolist()]
        yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(raw, pa.binary())], names=["fp", "shingles"])


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, fp (of the set of shingles), n (shingles), bits (the SimHash fingerprint), keys for each row."""
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(partial(_sketches, size=size), "doc_id long, text_hash long, fp long, n long, bits long, keys array<long>")


class Sets:
    """The sets of shingles of a group of nodes."""

    def __init__(self, raw: list[bytes], similarity: float):
        self.similarity = similarity
        self.counts = np.array([len(x) // 8 for x in raw], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        distinct, self.ids = np.unique(np.frombuffer(b"".join(raw), U), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def similar(self, q: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are as similar to q as is asked."""
        own = self.ids[self.begins[q] : self.begins[q] + self.counts[q]]
        both = np.zeros(len(others), np.int64)
        self.mark[own] = True
        turns = np.cumsum(self.counts[others]) // COUNTED
        for turn in np.unique(turns).tolist():
            some = np.flatnonzero(turns == turn)
            at, row, _ = spread(self.counts[others[some]], self.begins[others[some]])
            both[some] = np.bincount(row, weights=self.mark[self.ids[at]], minlength=len(some))
        self.mark[own] = False
        return both >= self.similarity * (len(own) + self.counts[others] - both) - 1e-9


def _forest(mine: dict[str, np.ndarray], theirs: dict[str, np.ndarray] | None, similarity: float, sets: Sets | None = None) -> pa.RecordBatch:
    """src, dst: a spanning forest of the pairs of mine (with theirs: of one of each) that are within RADIUS bits, not ruled out by
    their sizes and, with sets, similar. sets: of mine, then of theirs."""
    fp, n, bits = (mine[k] if theirs is None else np.concatenate([mine[k], theirs[k]]) for k in ("fp", "n", "bits"))
    values, sizes, label = bits.view(U).tolist(), n.tolist(), np.arange(len(fp))
    src, dst = [], []
    for begin in range(0, len(mine["fp"]), BLOCK):
        end = min(begin + BLOCK, len(mine["fp"]))
        block = Planes(values[begin:end])
        for q in range(begin + 1 if theirs is None else len(mine["fp"]), len(fp)):
            near = block.near(values[q], RADIUS)
            if not near:
                continue
            hit = begin + np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(-(-(end - begin) // 8), "little"), np.uint8), bitorder="little"))
            hit = hit[(label[hit] != label[q]) & (hit < q) & (np.minimum(n[hit], sizes[q]) >= similarity * np.maximum(n[hit], sizes[q]) - 1e-9)]
            if sets is not None and len(hit):
                hit = hit[sets.similar(q, hit)]
            if not len(hit):
                continue
            joined, one = np.unique(label[hit], return_index=True)
            src += fp[hit[one]].tolist()
            dst += [int(fp[q])] * len(one)
            joined = np.append(joined, label[q])
            label[np.isin(label, joined)] = joined.min()
    return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


_NEAR = "src long, dst long, key long, part int, members binary"
_NEAR_ARROW = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("members", pa.binary())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key without the rows that are alone under theirs (as far as one batch shows)."""
    for batch in batches:
        key = batch.column("key").to_numpy()
        equal = key[1:] == key[:-1]
        yield batch.filter(pa.array(np.concatenate([[True], equal]) | np.concatenate([equal, [True]]))) if len(key) else batch


def _near(batches: Iterator[pa.RecordBatch], similarity: float, large: int) -> Iterator[pa.RecordBatch]:
    """The near pairs' forest of each key of a sorted partition; a key of more than `large` members comes out as its parts instead."""
    held, size = [], 0
    for group in runs(_shared(batches), ("key",)):
        members = len(group["fp"])
        if members > large:
            packed = [np.stack([group[k][a : a + large] for k in ("fp", "n", "bits")]).tobytes() for a in range(0, members, large)]
            none = [None] * len(packed)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((none, none, [int(group["key"][0])] * len(packed), range(len(packed)), packed), _NEAR_ARROW, strict=True)], schema=_NEAR_ARROW)
        elif members > 1:
            held.append(_forest(group, None, similarity))
            size += held[-1].num_rows
        if size >= 4096:
            yield _edges(held)
            held, size = [], 0
    if size:
        yield _edges(held)


def _edges(found: list[pa.RecordBatch]) -> pa.RecordBatch:
    pairs = pa.Table.from_batches(found).combine_chunks()
    none = [pa.nulls(len(pairs), f.type) for f in list(_NEAR_ARROW)[2:]]
    return pa.record_batch([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pairs.columns), *none], schema=_NEAR_ARROW)


def _near_parts(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
            own, other = (dict(zip(("fp", "n", "bits"), np.frombuffer(x, np.int64).reshape(3, -1), strict=True)) for x in (a, b))
            yield _forest(own, None if i == j else other, similarity)


def _candidates(nodes: DataFrame, similarity: float, large: int) -> DataFrame:
    """src, dst: forests of the nodes that share a key, are within RADIUS bits and not ruled out by their sizes; repeats possible."""
    n = runtime.shuffle_partitions(nodes.sparkSession)
    keyed = nodes.select("fp", "n", "bits", F.explode("keys").alias("key")).repartition(n, "key").sortWithinPartitions("key")
    found = runtime.save(keyed.mapInArrow(partial(_near, similarity=similarity, large=large), _NEAR), "near-pairs")
    parts = found.where("members is not null").select("key", F.col("part").alias("i"), F.col("members").alias("a"))
    pairs = parts.join(parts.select("key", F.col("i").alias("j"), F.col("a").alias("b")), "key").where("i <= j")
    more = pairs.select("i", "j", "a", "b").repartition(n, "i", "j", F.xxhash64("a")).mapInArrow(partial(_near_parts, similarity=similarity), "src long, dst long")
    return found.where("members is null").select("src", "dst").unionAll(more)


def _parts(members: DataFrame, large: int) -> DataFrame:
    """members (fp, n, bits, c) with i, j, side: a row for each pair of parts of its component that a member takes part in (side 0 is in part i)."""
    share = F.greatest(F.count("*") / F.lit(large), F.sum("n") * 8 / F.lit(PART_BYTES))
    parts = members.groupBy("c").agg(F.ceil(share).cast("int").alias("parts"))
    dealt = members.join(parts, "c").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") <= F.col("other"), 0).otherwise(1).cast("byte")
    return other.select("c", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), side.alias("side"), "fp", "n", "bits")


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links' forest of each pair of parts of a component, of a partition sorted by them."""
    for group in runs(batches, ("c", "i", "j")):
        order = np.argsort(group["side"], kind="stable")
        cut = len(order) - int(group["side"].sum())
        group = {k: c[order] for k, c in group.items()}
        mine, theirs = ({k: group[k][at] for k in ("fp", "n", "bits")} for at in (slice(None, cut), slice(cut, None)))
        same = group["i"][0] == group["j"][0]
        if len(order) > 1 and (same or 0 < cut < len(order)):
            yield _forest(mine, None if same else theirs, similarity, Sets(group["shingles"].tolist(), similarity))


def classes(docs: DataFrame, prints: DataFrame, similarity: float = 0.8, size: int = SIZE, large: int = LARGE) -> DataFrame:
    """node, component: the fp of each set that has a link to another, and the smallest fp it is connected with."""
    n = runtime.shuffle_partitions(docs.sparkSession)
    nodes = prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    groups = components(_candidates(nodes, similarity, large))
    # the smallest text_hash of a node stands for its texts
    near = prints.join(groups, F.col("fp") == F.col("node")).groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash"), F.first("component").alias("c"))
    members = runtime.save(near, "near-members")
    hashed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    sets = hashed.mapInArrow(partial(_sets, size=size, bloom=_bloom(members)), "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sent = _parts(members, large).join(sets, "fp").select("c", "i", "j", "side", "fp", "n", "bits", "shingles")
    links = sent.repartition(n, "c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(partial(_verified, similarity=similarity), "src long, dst long")
    return components(links)


def first_of_group(docs: DataFrame, similarity: float = 0.8, size: int = SIZE) -> DataFrame:
    """docs with one row of each group of near copies: one of its smallest doc_id. Rows that share a doc_id are judged each
    by its own text; rows with null doc_id stay."""
    prints = runtime.save(sketches(docs, size), "near-prints")
    found = classes(docs, prints, similarity, size)
    rows = prints.where("doc_id is not null").join(found, F.col("fp") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "fp").alias("c"))
    least = rows.groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    other = (F.col("doc_id") != F.col("least.doc_id")) | (F.col("text_hash") != F.col("least.text_hash"))
    near_id, near_text = fresh("near_id", docs.columns), fresh("near_text", docs.columns)
    gone = runtime.save(rows.join(least, "c").where(other).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct(), "near-gone")
    hashed = docs.withColumns({near_id: F.col("doc_id").cast("long"), near_text: F.xxhash64(F.coalesce("text", F.lit("")))})
    bloom = _bloom(gone.select(F.col("gone_text").alias("text_hash")))

    @F.arrow_udf("boolean")
    def may_go(h: pa.Array) -> pa.Array:
        return _through(bloom, h)

    # only rows that may go meet the list of those that do; the others' texts stay where they are
    apart = hashed.where(may_go(near_text)).join(gone.toDF(f"{near_id}_", f"{near_text}_"), (F.col(near_id) == F.col(f"{near_id}_")) & (F.col(near_text) == F.col(f"{near_text}_")), "left_anti")
    out = hashed.where(~may_go(near_text)).unionByName(apart)
    if rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        out = out.where(F.col(near_id).isNotNull()).dropDuplicates([near_id, near_text]).unionByName(out.where(F.col(near_id).isNull()))
    return out.select(*docs.columns)
