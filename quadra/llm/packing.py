"""Best-fit packing of documents into fixed-length sequences by minimum bin slack.

Only the count of pieces of each length matters for a plan, and there are at most `capacity` lengths, so the plan is
made on the driver from that histogram, whatever the size of the corpus. Each round takes the longest
length left and finds the fullest feasible sequence that holds it: a subset-sum dynamic program over the available lengths, with
the reachable sums as a bit set. The combination found is then removed, as many times as its lengths last. A round
leaves some length with fewer pieces than the round used of it in one sequence, so that there are at most
sum(capacity / length) rounds and the plan's size is bounded by the capacity alone.

Pieces get a rank among those of their length (counted for each hash bucket, then within it: no single
task sees a whole length), and a rank's sequence and offset follow from the plan by arithmetic.

Defined cases: null text is empty and gives one piece with the end id alone; rows that repeat a doc_id (or have none) are packed one by one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.tokens import crc, encoded

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, ids: bool) -> Iterator[pa.RecordBatch]:
    for batch, rows in encoded(batches, path):
        names = batch.column("doc_id").to_pylist()
        doc, piece, start, length, crcs, kept = [], [], [], [], [], []
        for name, own in zip(names, rows, strict=True):
            own = np.append(own.astype("<u4"), np.uint32(end))
            for k, begin in enumerate(range(0, len(own), capacity)):
                part = own[begin : begin + capacity]
                doc.append(name)
                piece.append(k)
                start.append(begin)
                length.append(len(part))
                crcs.append(crc(part))
                if ids:
                    kept.append(part.astype(np.int32))
        columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.record_batch(columns, names=names)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths, longest first and each at most as often as it is there, whose sum is the largest up to `room`."""
    reach, stages = 1, []
    limit = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        copies, left, step = min(counts[length], room // length), reach, 1
        before = reach
        while copies:  # powers of two cover every count up to `copies`
            step = min(step, copies)
            left |= left << (step * length) & limit
            copies -= step
            step *= 2
        reach = left
        if reach != before:
            stages.append((length, before))
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(stages):
        while not before >> total & 1:
            out.append(length)
            total -= length
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, their lengths) for a count of pieces of each length."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = [longest, *fullest([x for x in lengths if counts[x]], counts, capacity - longest)]
        counts[longest] += 1
        need = {x: chosen.count(x) for x in set(chosen)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        lengths = [x for x in lengths if counts[x]]
        out.append((times, chosen))
    return out


class Slots:
    """Where the pieces of each length go, by rank."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        length, rank, base, many, offset = [], [], [], [], []
        used: dict[int, int] = {}
        sequence = 0
        for times, chosen in bins:
            at = 0
            for x in sorted(set(chosen), reverse=True):
                n = chosen.count(x)
                length.append(x)
                rank.append(used.get(x, 0))
                base.append(sequence)
                many.append(n)
                offset.append(at)
                used[x] = used.get(x, 0) + n * times
                at += n * x
            sequence += times
        order = np.lexsort((rank, length)) if length else np.empty(0, np.int64)
        take = lambda x: np.array(x, np.int64)[order]
        self.length, self.rank, self.base, self.many, self.offset = map(take, (length, rank, base, many, offset))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.searchsorted(self.length, length, "left")
        end = np.searchsorted(self.length, length, "right")
        low, high = begin, end - 1
        while (low < high).any():  # the last slot of the length whose first rank is not above
            mid = (low + high + 1) // 2
            ok = self.rank[mid] <= rank
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        within = rank - self.rank[low]
        return self.base[low] + within // self.many[low], self.offset[low] + within % self.many[low] * length


def _place(batches: Iterator[pa.RecordBatch], slots: Slots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, offset = slots.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        out = batch.drop_columns(["rank"])
        yield pa.record_batch([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document; ids: with the ids themselves.

    path: the tokenizer's file, at the same place on every executor. end: the id after each document.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    n = runtime.shuffle_partitions(spark)
    schema = _PIECES + (", ids array<int>" if ids else "")
    pieces = runtime.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end, ids=ids), schema), "pieces")
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    sizes = runtime.save(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    slots = Slots(plan(histogram, capacity))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    # a merge join: the counts grow with the buckets, so they are not broadcast; the window has dealt the other side already
    ranked = bucketed.withColumn("own", F.row_number().over(order)).join(before.hint("merge"), ["length", "bucket"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ranked = ranked.select(*columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(partial(_place, slots=slots), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, input_ids of packed pieces that carry their ids; a sequence is at most `capacity` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("input_ids"))
