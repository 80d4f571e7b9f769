"""Parquet with WKB geometry, and a JSON note about it in the column's metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra import functions as S

_FAMILY = {"POINT": "point", "MULTIPOINT": "multipoint", "LINESTRING": "polyline", "MULTILINESTRING": "polyline", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}


def families(df: DataFrame, geom: str = "geom") -> list[str]:
    """The kinds of geometry in a column: point, multipoint, polyline, polygon, other."""
    kind = F.regexp_extract(S.st_astext(F.col(geom)), "^([A-Z]+)", 1)
    named = F.coalesce(F.get(F.array(*[F.when(kind == k, F.lit(v)) for k, v in _FAMILY.items()]), F.lit(0)), *[F.when(kind == k, F.lit(v)) for k, v in _FAMILY.items()], F.lit("other"))
    return sorted(r[0] for r in df.where(~S.st_isempty(F.col(geom))).select(named.alias("k")).distinct().collect())  # six at most


def write_geo(df: DataFrame, path: str, geom: str = "geom", srid: int = 3857, mode: str = "errorifexists") -> None:
    """Write df with a WKB column. Raises ValueError, before anything is written, if there are no rows, if a geometry is null or empty, or if kinds are mixed."""
    if geom not in df.columns:
        raise ValueError(f"no column {geom!r}")
    rows, bad = df.agg(F.count("*"), F.sum(S.st_isempty(F.col(geom)).cast("int"))).first()
    if not rows:
        raise ValueError("there are no rows")
    if bad:
        raise ValueError(f"{bad} geometries are null or empty")
    kinds = families(df, geom)
    if len(kinds) > 1:
        raise ValueError(f"mixed kinds of geometry: {', '.join(kinds)}")
    note = {"geo": json.dumps({"version": "1.1.0", "primary_column": geom, "columns": {geom: {"encoding": "WKB", "geometry_types": kinds, "srid": srid}}})}
    df.withColumn(geom, F.col(geom).alias(geom, metadata=note)).write.mode(mode).parquet(path)


def read_geo(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Read it back; columns: a regular expression of the columns to keep."""
    out = spark.read.parquet(path)
    return out.select(out.colRegex(f"`{columns}`")) if columns else out
