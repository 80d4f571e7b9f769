"""Structured Streaming over the grid: row-local functions work on streams as they are; these are the windowed forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import functions as S
from quadra import runtime


def cell_counts(points: DataFrame, cell: float, window: str, late: str, time: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Points of each grid cell and time window; rows later than `late` are dropped and their windows closed."""
    keyed = points.withWatermark(time, late).withColumn("qr", S.qr_fromxy(x, y, cell))
    return keyed.groupBy(F.window(time, window).alias("window"), "qr").agg(F.count("*").alias("n"))


def session_cells(points: DataFrame, cell: float, gap: str, late: str, key: str, time: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Sessions of a key within a cell: rows less than `gap` apart."""
    keyed = points.withWatermark(time, late).withColumn("qr", S.qr_fromxy(x, y, cell))
    return keyed.groupBy(F.session_window(time, gap).alias("session"), key, "qr").agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a bounded stream until its input is used up; returns the result table."""
    spark = stream.sparkSession
    name = f"quadra_{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", runtime.scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
