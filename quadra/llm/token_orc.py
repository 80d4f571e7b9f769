"""Token ids in ORC files, in ascending doc_id order.

ORC stores integer columns with run-length encoding (version 2), keeps a row index for every `stride` rows of a
stripe and, here, Bloom filters on doc_id; stripes are read in parallel, and a filter on doc_id skips stripes
and row groups by their statistics and filters. Files are cut by ranges of doc_id. The text moves in the one shuffle (the
ranges are drawn from doc_id), and ids go from the tokenizer into the files at once.

Defined cases: null text is empty (its end id alone); rows with null doc_id come first; rows that repeat a doc_id are kept, ordered
by text; an empty table writes no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.tokens import crc, encoded

#: place: the row's number in its file.
SCHEMA = "doc_id long, place long, ids array<int>"


def _ids(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    place = 0
    for batch, rows in encoded(batches, path):
        sizes = np.array([len(x) + 1 for x in rows], np.int64)
        flat = np.concatenate([np.append(x, x.dtype.type(end)) for x in rows]).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        places = pa.array(np.arange(place, place + len(rows)))
        place += len(rows)
        yield pa.record_batch([batch.column("doc_id"), places, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "place", "ids"])


def write(docs: DataFrame, path: str, out: str, end: int = 2, stride: int = 1000, stripe: int = 16 << 20) -> None:
    """Write docs' ids, each document's followed by `end`, to ORC files under `out`. path: the tokenizer's file."""
    spark = docs.sparkSession
    runtime.ship(spark)
    n = runtime.shuffle_partitions(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = plain.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_ids, path=path, end=end), SCHEMA).write.options(
        **{"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe)}
    ).orc(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place, ids as written; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        crcs = [crc(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("place"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64()), batch.column("file")], names=["doc_id", "place", "n_tokens", "ids_crc32", "file"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for each document in the files."""
    runtime.ship(spark)
    rows = read(spark, path).select("doc_id", "place", "ids", F.xxhash64("_metadata.file_path").alias("file"))
    each = runtime.save(rows.mapInArrow(_digest, "doc_id long, place long, n_tokens long, ids_crc32 long, file long"), "token-digest")
    # a file's documents all come before the next file's, so running sums are by file, then over the files' totals (a row for each file, in one task)
    total = each.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    before = total.select("file", (F.sum("total").over(Window.orderBy(F.col("low").asc_nulls_first(), "file")) - F.col("total")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("own", own).join(before, "file").select("doc_id", (F.col("before") + F.col("own") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
