"""Geometry, grid and projection functions: Column in, Column out.

Geometry is WKB in a binary column. Arithmetic functions are plain Column expressions that Catalyst folds, pushes down and compiles;
functions that need geometry call thin Java functions, so rows never leave the JVM. A null argument gives null
(st_isempty alone is true for null). The spatial reference argument `wkid` is checked, not used: coordinates are planar.
"""

from __future__ import annotations

import math
import re
import struct
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadra.functions.native import native

EARTH = 6378137.0


def _c(x) -> Column:
    """A column from a name, a Column or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


def _wkid(wkid) -> Column:
    return F.lit(str(wkid))


def _array(items) -> Column:
    """An array column from several columns, one list of them, or one array column."""
    if len(items) == 1 and isinstance(items[0], (list, tuple)):
        items = tuple(items[0])
        if items:
            return F.array(*map(_c, items))
    if not items:
        raise ValueError("at least one column is needed")
    return _c(items[0]) if len(items) == 1 else F.array(*map(_c, items))


# --- construction -----------------------------------------------------------------------------------------------------


def st_point(x="x", y="y") -> Column:
    """Point of two coordinates."""
    return native("quadra_point", _d(x), _d(y)).alias("geom")


def st_line(x1, y1, x2, y2) -> Column:
    """Line of two vertices."""
    return native("quadra_line", _d(x1), _d(y1), _d(x2), _d(y2)).alias("geom")


def st_rect(x1, y1, x2, y2) -> Column:
    """Rectangle from two opposite corners, clockwise where the first is the lower left."""
    return native("quadra_rect", _d(x1), _d(y1), _d(x2), _d(y2)).alias("geom")


def st_cell(x, y, w, h=None) -> Column:
    """Rectangle with its lower left corner at x, y; square without h."""
    h = w if h is None else h
    return st_rect(x, y, _d(x) + _d(w), _d(y) + _d(h))


def st_box(x, y, h, v=None) -> Column:
    """Rectangle around x, y with half sizes h and v; square without v."""
    v = h if v is None else v
    return st_rect(_d(x) - _d(h), _d(y) - _d(v), _d(x) + _d(h), _d(y) + _d(v))


def st_multipoint(*points) -> Column:
    """MultiPoint of points; other geometries are skipped."""
    return native("quadra_multipoint", _array(points)).alias("geom")


def st_polyline(*points) -> Column:
    """Line through points; other geometries are skipped."""
    return native("quadra_polyline", _array(points)).alias("geom")


def st_polygon(*points) -> Column:
    """Polygon around points, closed by itself; other geometries are skipped."""
    return native("quadra_polygon", _array(points)).alias("geom")


def st_polyline2(xy) -> Column:
    """Line from one array x0, y0, x1, y1, ...; an odd length is an error."""
    return native("quadra_polyline2", _c(xy).cast("array<double>")).alias("geom")


def st_polygon2(xy) -> Column:
    """Polygon from one array x0, y0, x1, y1, ...; an odd length is an error."""
    return native("quadra_polygon2", _c(xy).cast("array<double>")).alias("geom")


# --- conversion -------------------------------------------------------------------------------------------------------


def st_astext(geom="geom") -> Column:
    """WKT; EMPTY for zero-length bytes."""
    return native("quadra_astext", _c(geom)).alias("text")


def st_asgeojson(geom="geom") -> Column:
    return native("quadra_asgeojson", _c(geom)).alias("geojson")


def st_fromtext(text="text") -> Column:
    """Geometry of a WKT text; zero-length bytes if it cannot be read."""
    return native("quadra_fromtext", _c(text)).alias("geom")


# --- projection -------------------------------------------------------------------------------------------------------


def _x_of(lon) -> Column:
    return F.lit(EARTH) * F.radians(_d(lon))


def _y_of(lat) -> Column:
    return F.lit(EARTH) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(_d(lat)) / 2))


def st_lontox(lon="lon") -> Column:
    return _x_of(lon).alias("x")


def st_lattoy(lat="lat") -> Column:
    return _y_of(lat).alias("y")


def st_xtolon(x="x") -> Column:
    return F.degrees(_d(x) / EARTH).alias("lon")


def st_ytolat(y="y") -> Column:
    return F.degrees(2 * F.atan(F.exp(_d(y) / EARTH)) - math.pi / 2).alias("lat")


def st_mercator(geom="geom") -> Column:
    """WGS84 to Web Mercator, vertex by vertex."""
    return native("quadra_mercator", _c(geom)).alias("geom")


def st_wgs84(geom="geom") -> Column:
    """Web Mercator to WGS84, vertex by vertex."""
    return native("quadra_wgs84", _c(geom)).alias("geom")


# --- grid -------------------------------------------------------------------------------------------------------------


def _index(v: Column, cell) -> Column:
    """Cell index as an int; out of range saturates, NaN is 0."""
    q = F.floor(F.least(F.greatest(v / _d(cell), F.lit(-2147483648.0)), F.lit(2147483647.0)))
    return F.when(F.isnan(v), F.lit(0)).when(v.isNotNull(), q.cast("int"))  # least and greatest pass over nulls


def st_xtoq(x, cell) -> Column:
    return _index(_d(x), cell).alias("q")


def st_ytor(y, cell) -> Column:
    return _index(_d(y), cell).alias("r")


def st_lontoq(lon, cell) -> Column:
    return _index(_x_of(lon), cell).alias("q")


def st_lattor(lat, cell) -> Column:
    return _index(_y_of(lat), cell).alias("r")


def st_qtox(q, cell, dist=0.0) -> Column:
    """x of a column's edge, moved by dist."""
    return (_d(q) * _d(cell) + _d(dist)).alias("x")


def st_rtoy(r, cell, dist=0.0) -> Column:
    """y of a row's edge, moved by dist."""
    return (_d(r) * _d(cell) + _d(dist)).alias("y")


def _pack(q: Column, r: Column) -> Column:
    return F.shiftleft(q.cast("long"), 32).bitwiseOR(r.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _q(qr: Column) -> Column:
    return F.shiftright(qr, 32)


def _r(qr: Column) -> Column:
    return F.shiftright(F.shiftleft(qr, 32), 32)


def qr_fromxy(x, y, cell) -> Column:
    """Grid key of a place: column in the high, row in the low 32 bits."""
    return _pack(F.floor(_d(x) / _d(cell)), F.floor(_d(y) / _d(cell))).alias("qr")


def qr_point(x, y, cell) -> Column:
    """The one cell of a place with its envelope, as qr_envp lists them for a point, by arithmetic alone."""
    x, y = _d(x), _d(y)
    place = F.struct(qr_fromxy(x, y, cell).alias("qr"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    return F.when((x + y).isNotNull() & ~F.isnan(x + y), place).alias("qr")


def qr_fromgeom(geom, cell) -> Column:
    """Grid key of the lower left corner of the envelope."""
    e = native("quadra_extent", _c(geom))
    return qr_fromxy(e["xmin"], e["ymin"], cell)


def _grid(name: str, geom, cell, dist, *more: Column) -> Column:
    return native(name, _c(geom), _d(cell), _d(dist), *more)


def qr_list(geom, cell, dist=0.0) -> Column:
    """Keys of the cells that the envelope, grown by dist, touches; column by column."""
    return _grid("quadra_qr_list", geom, cell, dist)


def qr_envp(geom, cell, dist=0.0) -> Column:
    """The cells of qr_list, row by row, each with the envelope grown by dist."""
    return _grid("quadra_qr_envp", geom, cell, dist)


def qr_geom(geom, cell, dist=0.0, wkid=-1) -> Column:
    """The geometry cut by each cell grown by dist; points are dropped."""
    return _grid("quadra_qr_geom", geom, cell, dist, _wkid(wkid))


def qr_envp_geom(geom, cell, dist=0.0, wkid=-1) -> Column:
    """qr_geom with each grown cell's envelope."""
    return _grid("quadra_qr_envp_geom", geom, cell, dist, _wkid(wkid))


def qr_count(geom, cell, dist=0.0) -> Column:
    """How many cells qr_list has."""
    return _grid("quadra_qr_count", geom, cell, dist)


def qr_asgeom(qr, cell, dist=0.0) -> Column:
    """Rectangle of a cell, grown by dist."""
    q, r, c, d = _q(_c(qr)).cast("double"), _r(_c(qr)).cast("double"), _d(cell), _d(dist)
    return st_rect(q * c - d, r * c - d, (q + 1) * c + d, (r + 1) * c + d)


def qr_contains_geom(qr, cell, geom) -> Column:
    """Whether both corners of the envelope lie in the cell."""
    e = native("quadra_extent", _c(geom))
    return (qr_fromxy(e["xmin"], e["ymin"], cell) == _c(qr)) & (qr_fromxy(e["xmax"], e["ymax"], cell) == _c(qr))


def qr_intersect(lhs, rhs, cell) -> Column:
    """Whether two (qr, xmin, ymin, xmax, ymax) meet, and this cell is the one that reports the pair: that of the
    lower left corner of the envelopes' overlap. A plain expression, so it stays inside the join."""
    a, b, c = _c(lhs), _c(rhs), _d(cell)
    x, y = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"])
    checked = F.when((c > 0) & (c < float("inf")), c).otherwise(F.raise_error(F.lit("cell must be finite and above zero")).cast("double"))
    meet = (a["qr"] == b["qr"]) & (x <= F.least(a["xmax"], b["xmax"])) & (y <= F.least(a["ymax"], b["ymax"])) & ~F.isnan(x + y)
    return meet & (_q(a["qr"]) == F.floor(x / checked)) & (_r(a["qr"]) == F.floor(y / checked))


def envelope(geometry: str | bytes) -> tuple[float, float, float, float] | None:
    """Envelope of one WKT text or WKB value, on the driver; None if it is empty."""
    if isinstance(geometry, (bytes, bytearray)):
        points = list(_wkb_points(bytes(geometry)))
    else:
        if not re.fullmatch(r"\s*[A-Za-z ]+(EMPTY|\(.*\))\s*", geometry, re.S) or geometry.count("(") != geometry.count(")"):
            raise ValueError(f"not a WKT geometry: {geometry[:80]!r}")
        tuples = re.findall(r"[^(),]+", geometry[geometry.find("(") :]) if "(" in geometry else []
        points = [tuple(map(float, t.split()[:2])) for t in tuples if t.strip()]
    points = [p for p in points if p[0] == p[0] and p[1] == p[1]]
    if not points:
        return None
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _wkb_points(b: bytes):
    """Coordinates of a WKB value."""

    def geometry(at):
        order = "<" if b[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", b, at + 1)
        extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
        at += 5 + 4 * bool(kind & 0x20000000)
        kind &= 0xFFFF
        extra += (0, 1, 1, 2)[kind // 1000]
        kind %= 1000

        def read(n, at):
            for k in range(n):
                found.append(struct.unpack_from(order + "dd", b, at + 8 * (2 + extra) * k))
            return at + 8 * (2 + extra) * n

        def count(at):
            return struct.unpack_from(order + "I", b, at)[0], at + 4

        if kind == 1:
            return read(1, at)
        n, at = count(at)
        if kind == 2:
            return read(n, at)
        for _ in range(n):
            if kind == 3:
                m, at = count(at)
                at = read(m, at)
            else:
                at = geometry(at)
        return at

    found: list[tuple[float, float]] = []
    if b:
        geometry(0)
    return found


def qr_cells(geom: str | bytes, cell: float, dist: float = 0.0) -> list[int]:
    """Keys of qr_list for one geometry, on the driver: for pruning by isin."""
    if not (cell > 0 and math.isfinite(cell)) or not (dist >= 0 and math.isfinite(dist)):
        raise ValueError("cell must be finite and above zero, dist finite and not negative")
    e = envelope(geom)
    if e is None:
        return []
    qs = range(math.floor((e[0] - dist) / cell), math.floor((e[2] + dist) / cell) + 1)
    rs = range(math.floor((e[1] - dist) / cell), math.floor((e[3] + dist) / cell) + 1)
    for v in (qs[0], qs[-1], rs[0], rs[-1]):
        if not -(2**31) <= v < 2**31:
            raise ValueError(f"cell index out of 32 bits: {v}")
    if len(qs) * len(rs) > 2**31 - 1:
        raise ValueError(f"too many cells: {len(qs)} x {len(rs)}")
    return [(q << 32) | (r & 0xFFFFFFFF) for q in qs for r in rs]


# --- explode helpers --------------------------------------------------------------------------------------------------


def _exploded(items: Column, **settings) -> Column:
    return F.explode(items).alias("qr", metadata=settings)


def qr_list_explode(geom, cell, dist=0.0) -> Column:
    return _exploded(qr_list(geom, cell, dist), cell=cell, dist=dist)


def qr_envp_explode(geom, cell, dist=0.0) -> Column:
    return _exploded(qr_envp(geom, cell, dist), cell=cell, dist=dist)


def qr_geom_explode(geom, cell, dist=0.0, wkid=-1) -> Column:
    return _exploded(qr_geom(geom, cell, dist, wkid), cell=cell, dist=dist, wkid=str(wkid))


def qr_envp_geom_explode(geom, cell, dist=0.0, wkid=-1) -> Column:
    return _exploded(qr_envp_geom(geom, cell, dist, wkid), cell=cell, dist=dist, wkid=str(wkid))


def st_dump_explode(geom="geom") -> Column:
    return F.explode(st_dump(geom)).alias("geom")


# --- accessors and measures -------------------------------------------------------------------------------------------


def st_x(geom="geom", index=0) -> Column:
    """x of a vertex, from the end if index is negative; NaN of an empty geometry; an index out of range is an error."""
    return native("quadra_x", _c(geom), _c(index).cast("int")).alias("x")


def st_y(geom="geom", index=0) -> Column:
    return native("quadra_y", _c(geom), _c(index).cast("int")).alias("y")


def st_xy(geom="geom", index=0) -> Column:
    return native("quadra_xy", _c(geom), _c(index).cast("int")).alias("xy")


def st_extent(geom="geom") -> Column:
    """Envelope as a struct; NaN if empty."""
    return native("quadra_extent", _c(geom)).alias("extent")


def st_centroid(geom="geom") -> Column:
    return native("quadra_centroid", _c(geom)).alias("geom")


def st_centroid_xy(geom="geom") -> Column:
    return native("quadra_centroid_xy", _c(geom)).alias("xy")


def st_area(geom="geom") -> Column:
    return native("quadra_area", _c(geom)).alias("area")


def st_length(geom="geom") -> Column:
    return native("quadra_length", _c(geom)).alias("length")


def st_isempty(geom="geom") -> Column:
    """True for null, zero-length bytes and geometries without vertices."""
    return F.coalesce(native("quadra_isempty", _c(geom)), F.lit(True))


# --- distances --------------------------------------------------------------------------------------------------------


def st_euclid(x1, y1, x2, y2) -> Column:
    dx, dy = _d(x1) - _d(x2), _d(y1) - _d(y2)
    return F.sqrt(dx * dx + dy * dy)


def st_manhattan(x1, y1, x2, y2) -> Column:
    return F.abs(_d(x1) - _d(x2)) + F.abs(_d(y1) - _d(y2))


def st_haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres over a sphere."""
    half = lambda a, b: F.sin(F.radians(_d(b) - _d(a)) / 2)
    a = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(_d(lat1))) * F.cos(F.radians(_d(lat2))) * F.pow(half(lon1, lon2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def st_distance(lhs="lgeom", rhs="rgeom") -> Column:
    return native("quadra_distance", _c(lhs), _c(rhs))


def st_dwithin(lhs="lgeom", rhs="rgeom", dist=0.0) -> Column:
    """Whether the distance is dist or less."""
    return native("quadra_dwithin", _c(lhs), _c(rhs), _d(dist))


# --- predicates -------------------------------------------------------------------------------------------------------


def _relation(name: str, lhs, rhs, wkid) -> Column:
    return native(f"quadra_{name}", _c(lhs), _c(rhs), _wkid(wkid))


def st_intersects(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("intersects", lhs, rhs, wkid)


def st_contains(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("contains", lhs, rhs, wkid)


def st_within(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("within", lhs, rhs, wkid)


def st_touches(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("touches", lhs, rhs, wkid)


def st_overlaps(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("overlaps", lhs, rhs, wkid)


def st_disjoint(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("disjoint", lhs, rhs, wkid)


def st_crosses(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("crosses", lhs, rhs, wkid)


def st_equals(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("equals", lhs, rhs, wkid)


def st_intersects_box(geom="geom", xmin=-180.0, ymin=-90.0, xmax=180.0, ymax=90.0) -> Column:
    """Whether the envelope meets a box; the geometry itself is not tested."""
    e = native("quadra_extent", _c(geom))
    return (e["xmin"] <= _d(xmax)) & (e["xmax"] >= _d(xmin)) & (e["ymin"] <= _d(ymax)) & (e["ymax"] >= _d(ymin)) & ~F.isnan(e["xmin"])


def st_within_mask(points, polygon, wkid=-1) -> Column:
    """For each point of an array whether it is within the polygon; null stays null."""
    return native("quadra_within_mask", _c(points), _c(polygon), _wkid(wkid))


# --- geometry to geometry ---------------------------------------------------------------------------------------------


def st_intersection(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    return _relation("intersection", lhs, rhs, wkid).alias("geom")


def st_iou(lhs="lgeom", rhs="rgeom", wkid=-1) -> Column:
    """Area in common over area of both; 0 unless both are polygons."""
    return _relation("iou", lhs, rhs, wkid).alias("iou")


def st_buffer(geom, distance, num_vertices=36, wkid=-1) -> Column:
    """Planar buffer; num_vertices: vertices of a full circle."""
    return native("quadra_buffer", _c(geom), _d(distance), _c(num_vertices).cast("int"), _wkid(wkid)).alias("geom")


def st_convexhull(geom="geom") -> Column:
    return native("quadra_convexhull", _c(geom)).alias("geom")


def st_simplify(geom="geom", wkid=-1) -> Column:
    """Topologically clean form: no self-intersections or repeated vertices."""
    return native("quadra_fix", _c(geom), _wkid(wkid)).alias("geom")


def st_repair(geom="geom", wkid=-1) -> Column:
    """Valid form by the OGC rules."""
    return native("quadra_fix", _c(geom), _wkid(wkid)).alias("geom")


def st_exterior_ring(geom) -> Column:
    """The outermost rings without holes; the first path of a line; zero-length bytes of points."""
    return native("quadra_exterior_ring", _c(geom)).alias("geom")


def st_translate(geom="geom", dx=0.0, dy=0.0) -> Column:
    return native("quadra_translate", _c(geom), _d(dx), _d(dy)).alias("geom")


def st_dump(geom="geom") -> Column:
    """The parts: polygons with their holes, paths, or points."""
    return native("quadra_dump", _c(geom))


def st_union_col(coll, wkid=-1) -> Column:
    """Union of an array: zero-length bytes of none, the element itself of one."""
    return native("quadra_union_col", _c(coll), _wkid(wkid)).alias("geom")


# --- shape structs ----------------------------------------------------------------------------------------------------


def gdb_point(shape="Shape") -> Column:
    """Point of a struct with x, y and perhaps z, m, by name."""
    return native("quadra_gdb_point", _c(shape)).alias("geom")


def _shape(kind: str, layout: str, shape="Shape") -> Column:
    """Geometry of a struct xmin, ymin, xmax, ymax, parts, coords, by place."""
    return native(f"quadra_gdb_{kind}", _c(shape), F.lit(layout)).alias("geom")


gdb_multipoint2 = partial(_shape, "multipoint", "2")
gdb_multipointM = partial(_shape, "multipoint", "M")
gdb_multipointZ = partial(_shape, "multipoint", "Z")
gdb_polyline2 = gdb_polyline = partial(_shape, "polyline", "2")
gdb_polylineM = partial(_shape, "polyline", "M")
gdb_polylineZ = partial(_shape, "polyline", "Z")
gdb_polygon2 = gdb_polygon = partial(_shape, "polygon", "2")
gdb_polygonM = partial(_shape, "polygon", "M")
gdb_polygonZ = partial(_shape, "polygon", "Z")


# --- line clipping ----------------------------------------------------------------------------------------------------


def clip_line_dist(line, cell, dist=0.0) -> Column:
    """(q, r, l) for each cell, grown by dist, that a segment x1, y1, x2, y2 crosses, with the length in it."""
    return native("quadra_clip_line", _c(line).cast("array<double>"), _d(cell), _d(dist))


def clip_line(line, cell) -> Column:
    return clip_line_dist(line, cell, 0.0)


st_clipline = clip_line
st_cliplinedist = clip_line_dist


