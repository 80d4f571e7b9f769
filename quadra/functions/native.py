"""Registration of the Java functions (quadra.jts) with a session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ENVELOPE = "xmin: double, ymin: double, xmax: double, ymax: double"

#: Internal function name -> (Java class, result type).
NATIVE: dict[str, tuple[str, str]] = {
    "quadra_point": ("Point2", "binary"),
    "quadra_line": ("Line", "binary"),
    "quadra_rect": ("Rect", "binary"),
    "quadra_multipoint": ("MultiPoint2", "binary"),
    "quadra_polyline": ("Polyline", "binary"),
    "quadra_polygon": ("Polygon1", "binary"),
    "quadra_polyline2": ("Polyline2", "binary"),
    "quadra_polygon2": ("Polygon2", "binary"),
    "quadra_astext": ("AsText", "string"),
    "quadra_asgeojson": ("AsGeoJson", "string"),
    "quadra_fromtext": ("FromText", "binary"),
    "quadra_mercator": ("Mercator", "binary"),
    "quadra_wgs84": ("Wgs84", "binary"),
    "quadra_x": ("X", "double"),
    "quadra_y": ("Y", "double"),
    "quadra_xy": ("Xy", "struct<x: double, y: double>"),
    "quadra_extent": ("Extent", f"struct<{_ENVELOPE}>"),
    "quadra_store": ("Store", "bigint"),
    "quadra_kind": ("Kind", "int"),
    "quadra_centroid": ("Centroid", "binary"),
    "quadra_centroid_xy": ("CentroidXy", "struct<x: double, y: double>"),
    "quadra_area": ("Area", "double"),
    "quadra_length": ("Length", "double"),
    "quadra_isempty": ("IsEmpty", "boolean"),
    "quadra_distance": ("Distance", "double"),
    "quadra_dwithin": ("DWithin", "boolean"),
    "quadra_intersects": ("Intersects", "boolean"),
    "quadra_disjoint": ("Disjoint", "boolean"),
    "quadra_contains": ("Contains", "boolean"),
    "quadra_within": ("Within", "boolean"),
    "quadra_touches": ("Touches", "boolean"),
    "quadra_overlaps": ("Overlaps", "boolean"),
    "quadra_crosses": ("Crosses", "boolean"),
    "quadra_equals": ("Same", "boolean"),
    "quadra_within_mask": ("WithinMask", "array<boolean>"),
    "quadra_intersection": ("Intersection", "binary"),
    "quadra_iou": ("Iou", "double"),
    "quadra_buffer": ("Buffer", "binary"),
    "quadra_convexhull": ("ConvexHull", "binary"),
    "quadra_fix": ("Fix", "binary"),
    "quadra_exterior_ring": ("ExteriorRing", "binary"),
    "quadra_translate": ("Translate", "binary"),
    "quadra_dump": ("Dump", "array<binary>"),
    "quadra_union_col": ("UnionCol", "binary"),
    "quadra_qr_list": ("QrList", "array<bigint>"),
    "quadra_qr_envp": ("QrEnvp", f"array<struct<qr: bigint, {_ENVELOPE}>>"),
    "quadra_qr_count": ("QrCount", "int"),
    "quadra_qr_geom": ("QrGeom", "array<struct<qr: bigint, geom: binary>>"),
    "quadra_qr_envp_geom": ("QrEnvpGeom", f"array<struct<qr: bigint, {_ENVELOPE}, geom: binary>>"),
    "quadra_clip_line": ("ClipLineDist", "array<struct<q: int, r: int, l: double>>"),
    "quadra_gdb_point": ("GdbPoint", "binary"),
    "quadra_gdb_multipoint": ("GdbMultiPoint", "binary"),
    "quadra_gdb_polyline": ("GdbPolyline", "binary"),
    "quadra_gdb_polygon": ("GdbPolygon", "binary"),
}

_ready: set[int] = set()


def ensure(spark: SparkSession) -> None:
    """Register the Java functions once for each session; executors get the jar from Spark."""
    key = spark._jsparkSession.hashCode()
    if key in _ready:
        return
    from quadra.jts.build import JAR, build

    if not JAR.exists():
        build()
    spark.sql(f"ADD JAR '{JAR}'")
    for name, (java, result) in NATIVE.items():
        spark.udf.registerJavaFunction(name, f"quadra.Functions${java}", result)
    _ready.add(key)


def native(name: str, *args: Column) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("geometry functions need an active SparkSession")
    ensure(spark)
    return F.call_function(name, *args)
