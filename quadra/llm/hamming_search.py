"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes. A vector's code has one bit for each of its first 64 components: 1 where the component is above zero.

Search. A code is cut into four segments of 16 bits; an index holds, for each segment, the codes under each of its values. A query looks up
all values within radius r = 0, 1, 2, ... of its own segments and verifies the Hamming distance of what it meets, each code once (at the radius and
segment where it is first met). After radius r every code within 4r + 3 bits has been met, so a query stops when its kth
verified distance is 4r + 3 or less: the result is exact.

Execution. Equal codes are one entry with their smallest ids, equal queries one probe, so copies cost nothing. An entry goes to one block for each segment: the
leading bits of its value there, as many as leave `ROWS` entries to a block. In each round a query that is still open goes only to the blocks
that values within the round's radii can lie in, so with growing tables, whose kth distances fall, a query meets ever smaller a part of the rows. A block of very many
entries (a frequent segment value) is cut into parts. Tasks and rounds keep the best k + 1 of each query. Ties go to the smaller id.

Defined cases: null or empty vectors have no code: they neither ask nor are found; null components and components past the 64th count as
zero bits; a query never finds its own row's id; rows that repeat an id are found once each; rows with null id are
left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadra import runtime

SEGMENTS, WIDTH = 4, 16
#: Entries of an index block, on average; a block of over twice as many is cut.
ROWS = 16384
#: The radii searched in each round: its last one decides which queries are covered.
ROUNDS = ((0, 1), (2, 3), (4, 5), (6, 7, 8), tuple(range(9, WIDTH + 1)))
_FOUND = "qid long, code long, distance long, tie long, weight long"


@lru_cache(maxsize=64)
def masks(width: int, radius: int) -> np.ndarray:
    """All differences of exactly `radius` bits among `width`."""
    every = np.arange(1 << width)
    return every[np.bitwise_count(every) == radius]


def code(vector: str = "embedding"):
    """The code of an array column, as a long."""
    bits = F.transform(F.slice(F.col(vector), 1, 64), lambda x, i: F.when(F.coalesce(x, F.lit(0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _best(q, c, d, tie, k: int):
    """The places of the first k of each query by (distance, tie)."""
    order = np.lexsort((tie, d, q))
    first = np.flatnonzero(np.diff(q[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[place < k]


def _meet(key, rows: pa.Table, queries: pa.Table, radii: tuple, bits: int, k: int) -> pa.Table:
    """The best k + 1 entries of a block that each query meets there first, at one of `radii`."""
    names = ["qid", "code", "distance", "tie", "weight"]
    if not rows.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    segment, block, width = key[0].as_py(), key[1].as_py(), WIDTH - bits
    codes = np.ascontiguousarray(rows.column("code").to_numpy()).view(np.uint64)
    asked = np.ascontiguousarray(queries.column("code").to_numpy()).view(np.uint64)
    part = lambda x: (x >> np.uint64(WIDTH * segment)).astype(np.int64) & 0xFFFF
    order = np.argsort(part(codes), kind="stable")
    codes, value = codes[order], part(codes)[order]
    a, b, m = (rows.column(name).to_numpy()[order] for name in ("a", "b", "m"))
    qid, skip, has = queries.column("qid").to_numpy(), queries.column("skip").to_numpy(), queries.column("has_skip").to_numpy()
    own = part(asked)
    outside = np.bitwise_count((own >> width) ^ block)  # bits that differ by the block alone
    base = (block << width) | (own & ((1 << width) - 1))
    found = []
    for radius in radii:
        for apart in np.unique(outside).tolist():
            if not 0 <= radius - apart <= width:
                continue
            low, ask = masks(width, radius - apart), np.flatnonzero(outside == apart)
            step = max(1, min(400_000 // len(low), 2_000_000 // len(codes)))
            for these in (ask[i : i + step] for i in range(0, len(ask), step)):
                want = base[these][:, None] ^ low[None, :]
                begin = np.searchsorted(value, want, "left").ravel()
                count = np.searchsorted(value, want, "right").ravel() - begin
                q = np.repeat(np.repeat(these, len(low)), count)
                c = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
                differ = asked[q] ^ codes[c]
                fresh = ~(has[q] & (a[c] == skip[q]) & (b[c] == a[c]))  # an entry of the query's own id only
                for s in range(SEGMENTS):
                    if s != segment:
                        bits_there = np.bitwise_count(part_of(differ, s))
                        fresh &= bits_there > radius if s < segment else bits_there >= radius
                q, c, d = q[fresh], c[fresh], np.bitwise_count(differ[fresh]).astype(np.int64)
                tie = np.where(has[q] & (a[c] == skip[q]), b[c], a[c])
                keep = _best(q, c, d, tie, k + 1)
                found.append((q[keep], c[keep], d[keep], tie[keep]))
    if not found:
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    q, c, d, tie = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _best(q, c, d, tie, k + 1)
    q, c, d, tie = q[keep], c[keep], d[keep], tie[keep]
    weight = np.where(has[q], 1, m[c])
    return pa.table([pa.array(qid[q]), pa.array(codes[c].view(np.int64)), pa.array(d), pa.array(tie), pa.array(weight)], names=names)


def _meeting(radii: tuple, bits: int, k: int):
    return lambda key, left, right: _meet(key, left, right, radii, bits, k)


def part_of(codes: np.ndarray, segment: int) -> np.ndarray:
    return codes >> np.uint64(WIDTH * segment) & np.uint64(0xFFFF)


def _placed(df: DataFrame, bits: int, blocks=None) -> DataFrame:
    """One row for each segment (and block, if `blocks` gives the differences of blocks to go to)."""
    value = lambda s: F.shiftrightunsigned("code", WIDTH * s).bitwiseAND(F.lit(0xFFFF)).cast("int")
    segments = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftright(value(s), WIDTH - bits).alias("block")) for s in range(SEGMENTS)])
    out = df.select("*", F.inline(segments))
    return out if blocks is None else out.withColumn("other", F.explode(blocks)).withColumn("block", F.col("block").bitwiseXOR(F.col("other"))).drop("other")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = ROWS) -> DataFrame:
    """rows, queries: id, code (longs). vec_id, rank (from 1), neighbor_id, distance: the k nearest rows of each query by (distance, id)."""
    spark = rows.sparkSession
    runtime.ship(spark)
    rows, queries = (df.select("id", "code").where("id is not null and code is not null") for df in (rows, queries))
    members = rows.groupBy("code", "id").agg(F.count("*").alias("n"))
    nearest = Window.partitionBy("code").orderBy("id")
    members = runtime.save(members.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1), "hamming-members")
    second = F.max(F.when(F.col("place") == 2, F.col("id")))
    index = members.groupBy("code").agg(F.min("id").alias("a"), F.coalesce(second, F.min("id")).alias("b"), F.count("*").alias("m"))
    index = runtime.save(index, "hamming-index")
    several = rows.groupBy("id").agg((F.min("code") != F.max("code")).alias("several")).where("several")
    asked = queries.distinct().join(several, "id", "left").withColumn("skip", F.when(F.col("several"), F.col("id")))
    asked = asked.select("id", "code", "skip")
    probes = asked.select("code", "skip").distinct().select(F.monotonically_increasing_id().alias("qid"), "code", F.coalesce("skip", F.lit(0)).alias("skip"), F.col("skip").isNotNull().alias("has_skip"))
    probes = waiting = runtime.save(probes, "hamming-probes")  # written at once, so the numbers stay

    bits = min(WIDTH, max(0, round(math.log2(max(1, index.count()) / block_rows))))
    dealt = _placed(index, bits)
    place = ["segment", "block"]
    # blocks with more entries than meant: at most 4 * 2**16 rows
    parts = dealt.groupBy(*place).count().select(*place, F.ceil(F.col("count") / F.lit(2.0 * block_rows)).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(runtime.save(parts, "hamming-large-blocks"))
    split = F.coalesce("parts", F.lit(1))
    turns = F.ceil(split / F.lit(16.0)).cast("int")  # the queries of a cut block are dealt, too
    every = lambda n: F.explode(F.sequence(F.lit(0), n - F.lit(1)))
    dealt = dealt.join(large, place, "left").withColumn("part", F.pmod(F.xxhash64("code"), split).cast("int")).withColumn("turn", every(turns)).drop("parts")
    group = [*place, "part", "turn"]
    order = Window.partitionBy("qid").orderBy("distance", "tie")
    best = None
    for radii in ROUNDS:
        low, high = max(0, radii[0] - (WIDTH - bits)), radii[-1]
        blocks = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda x: F.bit_count(x).between(low, high))
        asks = _placed(waiting, bits, blocks).join(large, place, "left").withColumn("turn", F.pmod(F.xxhash64("qid"), turns).cast("int")).withColumn("part", every(split)).drop("parts")
        met = dealt.groupBy(*group).cogroup(asks.groupBy(*group)).applyInArrow(_meeting(radii, bits, k), _FOUND)
        met = met if best is None else met.unionByName(best.join(waiting, "qid", "left_semi"))
        now = runtime.save(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place"), "hamming-found")
        best = now if best is None else runtime.save(best.join(waiting, "qid", "left_anti").unionByName(now), "hamming-best")
        if radii is ROUNDS[-1]:
            break
        covered = now.where(F.col("distance") < SEGMENTS * (high + 1)).groupBy("qid").agg(F.sum("weight").alias("sure")).where(F.col("sure") > k)
        waiting = runtime.save(waiting.join(covered, "qid", "left_anti"), "hamming-waiting")
        if not waiting.limit(1).count():
            break
    numbers = probes.select("qid", F.col("code").alias("c"), F.when(F.col("has_skip"), F.col("skip")).alias("s"))
    own = asked.join(numbers, (F.col("code") == F.col("c")) & F.col("skip").eqNullSafe(F.col("s"))).select(F.col("id").alias("vec_id"), "qid")
    found = own.join(best.select("qid", "code", "distance"), "qid").join(members.select("code", F.col("id").alias("neighbor_id"), "n"), "code").where("neighbor_id <> vec_id")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k).select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance")


def codes(embeddings: DataFrame) -> DataFrame:
    """id, code of each row of embeddings (vec_id, embedding)."""
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), code().alias("code"))
