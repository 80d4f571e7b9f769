"""Spatial joins as equi-joins on the grid key.

Both sides list the cells that their envelopes touch; rows meet in a cell; each pair is kept in one cell (that of the lower left corner of the
envelopes' overlap), so nothing has to be made distinct afterwards. The condition is one Catalyst join: Spark picks broadcast, sort-merge or hash, splits
skewed cells and spills. The exact predicate runs after the envelopes, inside the join; between shapes that their envelopes say all about (points,
rectangles and lines along the axes) it is a comparison of numbers, so that a pair costs no call and no reading of WKB.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadra import functions as S
from quadra.functions.native import native

OPERS = {
    "none": None,
    "contains": "contains",
    "crosses": "crosses",
    "equals": "equals",
    "intersects": "intersects",
    "intersection": "intersects",
    "overlaps": "overlaps",
    "touches": "touches",
    "within": "within",
}
#: A side is broadcast on request only if its rows, one for each cell that they touch, have so many bytes at most (counted).
BROADCAST_BYTES = 64 << 20
_QR_FIELDS = ("qr", "xmin", "ymin", "xmax", "ymax")
#: What quadra_kind says of a geometry: its envelope says all about it (point, rectangle, line along an axis), or not (0).
_POINT, _RECT, _LINE = 1, 2, 3


def counted_bytes(celled: DataFrame) -> int:
    """Bytes of a side's rows as they would be broadcast: counted after the cells are listed, so a large envelope on a small grid counts in full."""
    variable = [F.coalesce(F.length(c), F.lit(0)) for c, kind in celled.dtypes if kind in ("binary", "string")]
    row = sum(variable, F.lit(16 * len(celled.columns) + 80))
    return int(celled.agg(F.sum(row)).first()[0] or 0)


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows of an input with fewer splits than the cluster has cores, dealt to all of them: the streamed side of a broadcast join keeps its splits
    otherwise. Larger inputs are left as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, F.xxhash64(by)) if size < cores * (16 << 20) else df


def _check_name(df: DataFrame, name: str, kind, what: str) -> None:
    found = [f for f in df.schema.fields if f.name.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{what}: column {name!r} is there {len(found)} times, not once")
    if kind is not None and not isinstance(found[0].dataType, kind):
        raise TypeError(f"{what}: column {name!r} is {found[0].dataType.simpleString()}")


def _celled(df: DataFrame, cell: float, dist: float, qr: str, geom: str, need_geom: bool, what: str) -> DataFrame:
    if qr not in df.columns:
        _check_name(df, geom, T.BinaryType, what)
        df = df.where(F.col(geom).isNotNull()).withColumn(qr, S.qr_envp_explode(F.col(geom), cell, dist))
    _check_name(df, qr, T.StructType, what)
    fields = {f.name.lower(): f.dataType for f in df.schema[qr].dataType.fields}
    for name in _QR_FIELDS:
        want = T.LongType if name == "qr" else T.DoubleType
        if not isinstance(fields.get(name), want):
            raise TypeError(f"{what}: field {qr}.{name} must be {want.__name__}")
    usable = F.col(f"{qr}.qr").isNotNull()
    for name in _QR_FIELDS[1:]:
        usable &= F.col(f"{qr}.{name}").isNotNull() & ~F.isnan(f"{qr}.{name}")
    if need_geom:
        _check_name(df, geom, T.BinaryType, what)
        usable &= F.col(geom).isNotNull() & (F.length(geom) > 0)
    return df.where(usable)


def _meet(l: Callable[[str], Column], r: Callable[[str], Column]) -> Column:
    return (l("xmin") <= r("xmax")) & (r("xmin") <= l("xmax")) & (l("ymin") <= r("ymax")) & (r("ymin") <= l("ymax"))


def _by_envelope(relation: str, l: Callable[[str], Column], r: Callable[[str], Column]) -> Column:
    """The relation of two shapes whose envelopes meet, for kinds that their envelopes describe; null for all others, which need the geometry."""
    kinds = lambda a, b: (l("kind") == a) & (r("kind") == b)
    inner = (l("xmin") < r("xmax")) & (r("xmin") < l("xmax")) & (l("ymin") < r("ymax")) & (r("ymin") < l("ymax"))
    in_right = (l("xmin") >= r("xmin")) & (l("xmax") <= r("xmax")) & (l("ymin") >= r("ymin")) & (l("ymax") <= r("ymax"))
    in_left = (r("xmin") >= l("xmin")) & (r("xmax") <= l("xmax")) & (r("ymin") >= l("ymin")) & (r("ymax") <= l("ymax"))
    rects = {"intersects": F.lit(True), "within": in_right, "contains": in_left, "equals": in_right & in_left, "touches": ~inner, "overlaps": inner & ~in_right & ~in_left, "crosses": F.lit(False)}
    out = F.when(kinds(_RECT, _RECT), rects[relation])
    if relation == "intersects":
        return out.when(kinds(_POINT, _RECT) | kinds(_RECT, _POINT), F.lit(True))
    if relation == "within":
        return out.when(kinds(_POINT, _RECT), inner)
    if relation == "contains":
        return out.when(kinds(_RECT, _POINT), inner)
    if relation == "touches":
        return out.when(kinds(_POINT, _RECT) | kinds(_RECT, _POINT), ~inner)
    if relation == "crosses":
        return out.when(kinds(_LINE, _RECT), inner & ~in_right).when(kinds(_RECT, _LINE), inner & ~in_left)
    return out


def _shuffled(l: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neither side may be broadcast on the size of its files: its rows are more once their cells are listed."""
    return l.hint("merge"), r.hint("merge")


def join_qr(lhs: DataFrame, rhs: DataFrame, cell: float, dist: float = 0.0, qr: str = "qr", oper: str = "none", wkid=-1, lhs_geom: str = "geom", rhs_geom: str = "geom", acceleration: str = "mild", broadcast: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of rows whose envelopes (grown by dist) overlap and whose geometries satisfy `oper`.

    Output: lhs's columns, then rhs's, without `qr`. A side without the column `qr` gets it from its geometry. oper: none, contains, crosses,
    equals, intersects (intersection), overlaps, touches, within. broadcast: "lhs" or "rhs", a request that holds while the side, counted
    with its cells listed, has `broadcast_bytes` or less; beyond that the join shuffles. A side of points is cheapest with `qr` from qr_point. acceleration (mild, medium, hot) is accepted; prepared geometries are always used.
    """
    if not (cell > 0 and math.isfinite(cell)):
        raise ValueError("cell must be finite and above zero")
    if not (dist >= 0 and math.isfinite(dist)):
        raise ValueError("dist must be finite and not negative")
    if acceleration.strip().lower() not in ("mild", "medium", "hot"):
        raise ValueError("acceleration is mild, medium or hot")
    name = oper.strip().lower()
    if name not in OPERS:
        raise ValueError(f"oper {oper!r} is none of {', '.join(OPERS)}")
    if broadcast not in (None, "lhs", "rhs"):
        raise ValueError("broadcast is None, 'lhs' or 'rhs'")
    relation = OPERS[name]
    if relation and not str(wkid):
        raise ValueError("the spatial reference is empty")
    listed = qr not in lhs.columns and qr not in rhs.columns  # cells and envelopes are of our own making, on both sides
    left = _celled(lhs, cell, dist, qr, lhs_geom, relation is not None, "lhs")
    right = _celled(rhs, cell, dist, qr, rhs_geom, relation is not None, "rhs")
    # positions, since both sides may use the same names; what the condition asks for are plain columns: the envelope of qr, and whether the
    # cell is in the first column and row of those that it touches (a pair's own cell is first in both directions for one of the two)
    at = lambda df, column: next(k for k, c in enumerate(df.columns) if c.lower() == column.lower())
    sides, keep = [], []
    for side, df, geom in (("l", left, lhs_geom), ("r", right, rhs_geom)):
        own = at(df, qr)
        out = df.toDF(*[f"{side}{k}" for k in range(len(df.columns))])
        e = F.col(f"{side}{own}")
        if relation:  # of no known kind, where qr says another envelope than the geometry's own
            out = out.withColumn(f"{side} kind", native("quadra_kind", F.col(f"{side}{at(df, geom)}"), *(e[name] for name in _QR_FIELDS[1:])))
        column, row = e["qr"].bitwiseAND(F.lit(-1 << 32)), e["qr"].bitwiseAND(F.lit(0xFFFFFFFF))
        first = F.shiftleft(F.floor(e["xmin"] / float(cell)), 32), F.floor(e["ymin"] / float(cell)).bitwiseAND(F.lit(0xFFFFFFFF))
        flags = {f"{side} first column": column == first[0], f"{side} first row": row == first[1]}
        out = out.withColumns({**{f"{side} {name}": e[name] for name in _QR_FIELDS}, **flags}).drop(f"{side}{own}")
        if listed and relation == {"l": "within", "r": "contains"}[side]:  # a pair's own cell is the inner shape's first
            out = out.where(F.col(f"{side} first column") & F.col(f"{side} first row"))
        keep += [(f"{side}{k}", c) for k, c in enumerate(df.columns) if k != own]
        sides.append(out)
    l, r = sides
    of = lambda side: lambda name: F.col(f"{side} {name}")
    condition = (F.col("l qr") == F.col("r qr")) & (F.col("l first column") | F.col("r first column")) & (F.col("l first row") | F.col("r first row")) & _meet(of("l"), of("r"))
    if relation:
        exact = native(f"quadra_{relation}", F.col(f"l{at(left, lhs_geom)}"), F.col(f"r{at(right, rhs_geom)}"), F.lit(str(wkid)))
        condition &= F.coalesce(_by_envelope(relation, of("l"), of("r")), exact)
    if listed and relation == "equals":
        for name in _QR_FIELDS[1:]:  # more keys of the join: equal shapes have equal envelopes
            condition &= F.col(f"l {name}") == F.col(f"r {name}")
    if broadcast == "lhs" and counted_bytes(left) <= broadcast_bytes:
        l, r = F.broadcast(l), spread(r, "r qr")
    elif broadcast == "rhs" and counted_bytes(right) <= broadcast_bytes:
        l, r = spread(l, "l qr"), F.broadcast(r)
    else:
        l, r = _shuffled(l, r)
    return l.join(r, condition).select(*(F.col(n).alias(c) for n, c in keep))


def distance_join(points: DataFrame, geoms: DataFrame, distance: float, cell: float | None = None, point: str = "geom", geom: str = "geom", xy: tuple[str, str] | None = None, broadcast: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a point and a geometry within `distance`: the geometry is listed in every cell near it, the point in its own, so a pair meets once.

    The point must lie in the grown envelope before the exact distance is asked for. xy: columns of the points' coordinates, if there are any. broadcast: a request to
    broadcast the geometries, which holds while they, with their cells, have `broadcast_bytes` or less. Output: the points' columns, then the others of geoms.
    """
    cell = cell or max(distance * 4, 1e-9)
    x, y = (F.col(c).cast("double") for c in xy) if xy else (S.st_x(point), S.st_y(point))
    left_names, right_names = [f"l{k}" for k in range(len(points.columns))], [f"r{k}" for k in range(len(geoms.columns))]
    placed_points = points.withColumns({"quadra x": x, "quadra y": y}).toDF(*left_names, "x", "y").where("not isnan(x + y)").withColumn("cell", S.qr_fromxy("x", "y", cell))
    own, other = left_names[points.columns.index(point)], right_names[geoms.columns.index(geom)]
    right = geoms.toDF(*right_names).where(F.col(other).isNotNull()).withColumn("own", native("quadra_extent", F.col(other)))
    of = lambda name: F.col("own")[name]
    # the bounds leave room for the rounding of sums: what is near is asked by differences
    room = sum((F.abs(of(c)) for c in _QR_FIELDS[1:]), F.lit(float(distance))) * 1e-15 + float(distance)
    right = right.withColumn("q", F.explode(S.qr_envp(F.col(other), cell, F.nanvl(room, F.lit(float(distance))))))
    right = right.withColumns({**{f"r {name}": F.col("q")[name] for name in _QR_FIELDS}, **{f"own {name}": of(name) for name in _QR_FIELDS[1:]}, "kind": native("quadra_kind", F.col(other), *map(of, _QR_FIELDS[1:]))}).drop("q", "own")
    if broadcast and counted_bytes(right) <= broadcast_bytes:
        left, right = spread(placed_points.withColumn("at", F.struct("x", "y")), "at"), F.broadcast(right)
    else:
        left, right = _shuffled(placed_points, right)
    near = (F.col("x") >= F.col("r xmin")) & (F.col("x") <= F.col("r xmax")) & (F.col("y") >= F.col("r ymin")) & (F.col("y") <= F.col("r ymax"))
    dx, dy = (F.greatest(F.col(f"own {a}min") - F.col(a), F.lit(0.0), F.col(a) - F.col(f"own {a}max")) for a in "xy")
    known = F.when((F.col("kind") == _RECT) | (F.col("kind") == _POINT), F.sqrt(dx * dx + dy * dy) <= float(distance))
    out = left.join(right, (F.col("cell") == F.col("r qr")) & near & F.coalesce(known, native("quadra_dwithin", F.col(own), F.col(other), F.lit(float(distance)))))
    keep = [(n, c) for n, c in zip([*left_names, *right_names], [*points.columns, *geoms.columns], strict=True) if n != other]
    return out.select(*(F.col(n).alias(c) for n, c in keep))
