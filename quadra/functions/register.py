"""SQL names for the functions: typed temporary functions, so that arguments are cast, counted and defaulted by the analyzer."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from quadra.functions.native import NATIVE, ensure

_R = "6378137.0D"
_X = f"({_R} * radians(lon))"
_Y = f"({_R} * ln(tan({math.pi / 4!r}D + radians(lat) / 2)))"
_Q = "shiftright(qr, 32)"
_ROW = "shiftright(shiftleft(qr, 32), 32)"
_W = "wkid STRING DEFAULT '-1'"
_D = "dist DOUBLE DEFAULT 0.0D"
_ENV = "STRUCT<qr: BIGINT, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
_SHAPE = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, parts: ARRAY<INT>, coords: ARRAY<DOUBLE>>"


def _index(v: str) -> str:
    return f"CASE WHEN isnan({v}) THEN 0 WHEN {v} IS NOT NULL THEN CAST(floor(least(greatest({v} / cell, -2147483648.0D), 2147483647.0D)) AS INT) END"


def _key(x: str, y: str) -> str:
    return f"shiftleft(CAST(floor({x} / cell) AS BIGINT), 32) | (CAST(floor({y} / cell) AS BIGINT) & 4294967295L)"


def _definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result, body)."""
    g, pair = "geom BINARY", "lhs BINARY, rhs BINARY"
    xy2 = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    out = {
        "ST_POINT": ("x DOUBLE, y DOUBLE", "BINARY", "quadra_point(x, y)"),
        "ST_LINE": (xy2, "BINARY", "quadra_line(x1, y1, x2, y2)"),
        "ST_RECT": (xy2, "BINARY", "quadra_rect(x1, y1, x2, y2)"),
        "ST_CELL": ("x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE", "BINARY", "quadra_rect(x, y, x + w, y + h)"),
        "ST_BOX": ("x DOUBLE, y DOUBLE, h DOUBLE, v DOUBLE", "BINARY", "quadra_rect(x - h, y - v, x + h, y + v)"),
        "ST_MULTIPOINT": ("points ARRAY<BINARY>", "BINARY", "quadra_multipoint(points)"),
        "ST_POLYLINE": ("points ARRAY<BINARY>", "BINARY", "quadra_polyline(points)"),
        "ST_POLYGON": ("points ARRAY<BINARY>", "BINARY", "quadra_polygon(points)"),
        "ST_POLYLINE2": ("xy ARRAY<DOUBLE>", "BINARY", "quadra_polyline2(xy)"),
        "ST_POLYGON2": ("xy ARRAY<DOUBLE>", "BINARY", "quadra_polygon2(xy)"),
        "ST_ASTEXT": (g, "STRING", "quadra_astext(geom)"),
        "ST_ASGEOJSON": (g, "STRING", "quadra_asgeojson(geom)"),
        "ST_FROMTEXT": ("text STRING", "BINARY", "quadra_fromtext(text)"),
        "ST_LONTOX": ("lon DOUBLE", "DOUBLE", _X),
        "ST_LATTOY": ("lat DOUBLE", "DOUBLE", _Y),
        "ST_XTOLON": ("x DOUBLE", "DOUBLE", f"degrees(x / {_R})"),
        "ST_YTOLAT": ("y DOUBLE", "DOUBLE", f"degrees(2 * atan(exp(y / {_R})) - {math.pi / 2!r}D)"),
        "ST_MERCATOR": (g, "BINARY", "quadra_mercator(geom)"),
        "ST_WGS84": (g, "BINARY", "quadra_wgs84(geom)"),
        "ST_XTOQ": ("x DOUBLE, cell DOUBLE", "INT", _index("x")),
        "ST_YTOR": ("y DOUBLE, cell DOUBLE", "INT", _index("y")),
        "ST_LONTOQ": ("lon DOUBLE, cell DOUBLE", "INT", _index(_X)),
        "ST_LATTOR": ("lat DOUBLE, cell DOUBLE", "INT", _index(_Y)),
        "ST_QTOX": (f"q INT, cell DOUBLE, {_D}", "DOUBLE", "q * cell + dist"),
        "ST_RTOY": (f"r INT, cell DOUBLE, {_D}", "DOUBLE", "r * cell + dist"),
        "QR_FROMXY": ("x DOUBLE, y DOUBLE, cell DOUBLE", "BIGINT", _key("x", "y")),
        "QR_FROMGEOM": ("geom BINARY, cell DOUBLE", "BIGINT", _key("quadra_extent(geom).xmin", "quadra_extent(geom).ymin")),
        "QR_COUNT": (f"{g}, cell DOUBLE, {_D}", "INT", "quadra_qr_count(geom, cell, dist)"),
        "QR_ASGEOM": (f"qr BIGINT, cell DOUBLE, {_D}", "BINARY", f"quadra_rect({_Q} * cell - dist, {_ROW} * cell - dist, ({_Q} + 1) * cell + dist, ({_ROW} + 1) * cell + dist)"),
        "QR_CONTAINSGEOM": (f"qr BIGINT, cell DOUBLE, {g}", "BOOLEAN", f"({_key('quadra_extent(geom).xmin', 'quadra_extent(geom).ymin')}) = qr AND ({_key('quadra_extent(geom).xmax', 'quadra_extent(geom).ymax')}) = qr"),
        "QR_INTERSECT": (
            f"lhs {_ENV}, rhs {_ENV}, cell DOUBLE",
            "BOOLEAN",
            "lhs.qr = rhs.qr AND greatest(lhs.xmin, rhs.xmin) <= least(lhs.xmax, rhs.xmax) AND greatest(lhs.ymin, rhs.ymin) <= least(lhs.ymax, rhs.ymax)"
            " AND shiftright(lhs.qr, 32) = floor(greatest(lhs.xmin, rhs.xmin) / cell) AND shiftright(shiftleft(lhs.qr, 32), 32) = floor(greatest(lhs.ymin, rhs.ymin) / cell)",
        ),
        "ST_X": (f"{g}, k INT DEFAULT 0", "DOUBLE", "quadra_x(geom, k)"),
        "ST_Y": (f"{g}, k INT DEFAULT 0", "DOUBLE", "quadra_y(geom, k)"),
        "ST_XY": (f"{g}, k INT DEFAULT 0", "STRUCT<x: DOUBLE, y: DOUBLE>", "quadra_xy(geom, k)"),
        "ST_EXTENT": (g, "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>", "quadra_extent(geom)"),
        "ST_CENTROID": (g, "BINARY", "quadra_centroid(geom)"),
        "ST_CENTROIDXY": (g, "STRUCT<x: DOUBLE, y: DOUBLE>", "quadra_centroid_xy(geom)"),
        "ST_AREA": (g, "DOUBLE", "quadra_area(geom)"),
        "ST_LENGTH": (g, "DOUBLE", "quadra_length(geom)"),
        "ST_ISEMPTY": (g, "BOOLEAN", "coalesce(quadra_isempty(geom), true)"),
        "ST_EUCLID": (xy2, "DOUBLE", "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"),
        "ST_MANHATTAN": (xy2, "DOUBLE", "abs(x1 - x2) + abs(y1 - y2)"),
        "ST_HAVERSINE": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "2 * {r} * atan2(sqrt({a}), sqrt(1 - ({a})))".format(r=_R, a="pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)")),
        "ST_DISTANCE": (pair, "DOUBLE", "quadra_distance(lhs, rhs)"),
        "ST_DWITHIN": (f"{pair}, dist DOUBLE", "BOOLEAN", "quadra_dwithin(lhs, rhs, dist)"),
        "ST_INTERSECTSBOX": (f"{g}, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE", "BOOLEAN", "quadra_extent(geom).xmin <= xmax AND quadra_extent(geom).xmax >= xmin AND quadra_extent(geom).ymin <= ymax AND quadra_extent(geom).ymax >= ymin AND NOT isnan(quadra_extent(geom).xmin)"),
        "ST_WITHIN_MASK": ("points ARRAY<BINARY>, polygon BINARY, wkid STRING", "ARRAY<BOOLEAN>", "quadra_within_mask(points, polygon, wkid)"),
        "ST_INTERSECTION": (f"{pair}, {_W}", "BINARY", "quadra_intersection(lhs, rhs, wkid)"),
        "ST_IOU": (f"{pair}, {_W}", "DOUBLE", "quadra_iou(lhs, rhs, wkid)"),
        "ST_BUFFER": (f"{g}, distance DOUBLE, num_vertices INT DEFAULT 36, {_W}", "BINARY", "quadra_buffer(geom, distance, num_vertices, wkid)"),
        "ST_CONVEXHULL": (g, "BINARY", "quadra_convexhull(geom)"),
        "ST_SIMPLIFY": (f"{g}, {_W}", "BINARY", "quadra_fix(geom, wkid)"),
        "ST_REPAIR": (f"{g}, {_W}", "BINARY", "quadra_fix(geom, wkid)"),
        "ST_EXTERIORRING": (g, "BINARY", "quadra_exterior_ring(geom)"),
        "ST_TRANSLATE": (f"{g}, dx DOUBLE, dy DOUBLE", "BINARY", "quadra_translate(geom, dx, dy)"),
        "ST_UNIONCOL": (f"coll ARRAY<BINARY>, {_W}", "BINARY", "quadra_union_col(coll, wkid)"),
        "CLIP_LINE": ("line ARRAY<DOUBLE>, cell DOUBLE", "ARRAY<STRUCT<q: INT, r: INT, l: DOUBLE>>", "quadra_clip_line(line, cell, 0.0D)"),
    }
    for name in ("INTERSECTS", "CONTAINS", "WITHIN", "TOUCHES", "OVERLAPS", "DISJOINT", "CROSSES", "EQUALS"):
        out[f"ST_{name}"] = (f"{pair}, {_W}", "BOOLEAN", f"quadra_{name.lower()}(lhs, rhs, wkid)")
    for kind in ("multipoint", "polyline", "polygon"):
        for layout in "2MZ":
            out[f"GDB_{kind.upper()}{layout}"] = (f"shape {_SHAPE}", "BINARY", f"quadra_gdb_{kind}(shape, '{layout}')")
    return out


#: Functions that return arrays are registered as they are, since SQL functions cannot stand inside explode().
DIRECT = {
    "QR_LIST": "quadra_qr_list",
    "QR_ENVP": "quadra_qr_envp",
    "QR_CLIP": "quadra_qr_geom",
    "QR_GEOM": "quadra_qr_geom",
    "QR_ENVPGROM": "quadra_qr_envp_geom",
    "QR_ENVPGEOM": "quadra_qr_envp_geom",
    "ST_DUMP": "quadra_dump",
    "CLIP_LINE_DIST": "quadra_clip_line",
    "GDB_POINT": "quadra_gdb_point",
}


def st_register_functions(spark: SparkSession | None = None) -> list[str]:
    """Register every SQL name with a session; returns the names."""
    spark = spark or SparkSession.getActiveSession()
    ensure(spark)
    for name, of in DIRECT.items():
        java, result = NATIVE[of]
        spark.udf.registerJavaFunction(name, f"quadra.Functions${java}", result)
    names = list(DIRECT)
    for name, (parameters, result, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(name)
    return names
