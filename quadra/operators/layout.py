"""Tables clustered by grid key, and scans that read only the cells of an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra import functions as S


def write_qr_layout(df: DataFrame, path: str, qr: Column, parts: int, block_bytes: int = 8 << 20, mode: str = "errorifexists") -> None:
    """Write df range-partitioned and sorted by the key `qr`: row groups then hold narrow key ranges, which Parquet statistics prune."""
    out = df.withColumn("qr", qr).repartitionByRange(parts, "qr").sortWithinPartitions("qr")
    out.write.mode(mode).option("parquet.block.size", str(block_bytes)).option("compression", "snappy").parquet(path)


def write_pieces(df: DataFrame, path: str, geom: str, cell: float, parts: int, dist: float = 1e-9, mode: str = "errorifexists") -> None:
    """Write df with a row for each grid cell, the geometry cut to the cell: qr, xmin, ymin, xmax, ymax and the piece."""
    cut = df.withColumn("__p", F.explode(S.qr_envp_geom(geom, cell, dist)))
    kept = [c for c in df.columns if c != geom]
    cut = cut.select(*kept, *[F.col(f"__p.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("__p.geom").alias(geom), F.col("__p.qr").alias("__qr"))
    out = cut.withColumnRenamed("__qr", "qr").repartitionByRange(parts, "qr").sortWithinPartitions("qr")
    out.write.mode(mode).option("parquet.block.size", str(8 << 20)).option("compression", "snappy").parquet(path)


def prune_by_area(df: DataFrame, geom: str | bytes, cell: float, dist: float = 0.0, qr: str = "qr") -> DataFrame:
    """The rows whose key is one of the cells of one geometry (WKT or WKB): an IN filter that reaches the Parquet scan."""
    cells = S.qr_cells(geom, cell, dist)
    return df.where(F.col(qr).isin(cells)) if cells else df.where(F.lit(False))


def grid_of(spark, xmin: float, ymin: float, xmax: float, ymax: float, cell: float) -> DataFrame:
    """q, r, qr, name (16 hex digits) and cell polygon of each grid cell of an extent."""
    import math

    qs, rs = (math.floor(xmin / cell), math.floor(xmax / cell)), (math.floor(ymin / cell), math.floor(ymax / cell))
    rows = spark.range(qs[0], qs[1] + 1).toDF("q").withColumn("r", F.explode(F.sequence(F.lit(rs[0]).cast("long"), F.lit(rs[1]).cast("long"))))
    rows = rows.withColumn("qr", F.shiftleft("q", 32).bitwiseOR(F.col("r").bitwiseAND(F.lit(0xFFFFFFFF))))
    return rows.select("q", "r", "qr", F.lpad(F.hex("qr"), 16, "0").alias("name"), S.st_cell(F.col("q") * F.lit(float(cell)), F.col("r") * F.lit(float(cell)), float(cell)).alias("geom"))
