"""Joins, nearest neighbours, dissolve and sources against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quadra import functions as S
from quadra.operators import join_qr, knn_join, pairwise_dissolve
from quadra.operators.components import components


def test_join_qr_reports_a_pair_once(spark):
    rows = spark.createDataFrame([("a", 0.25, 0.25, 1.75, 0.75), ("n", None, None, None, None)], "id string, x0 double, y0 double, x1 double, y1 double").withColumn("geom", S.st_rect("x0", "y0", "x1", "y1"))
    left = rows.select(F.col("id").alias("lid"), "geom")
    right = rows.select(F.col("id").alias("rid"), "geom")
    for broadcast in (None, "lhs", "rhs"):
        out = join_qr(left, right, 1.0, oper=" INTERSECTION ", broadcast=broadcast)
        assert out.columns == ["lid", "geom", "rid", "geom"] and out.count() == 1
    cells = left.where("geom is not null").withColumn("qr", S.qr_envp_explode("geom", 1.0))
    assert join_qr(cells, right, 1.0).count() == 1
    with pytest.raises(ValueError):
        join_qr(left, right, 1.0, oper="disjoint")
    with pytest.raises(TypeError):
        join_qr(left.withColumn("qr", F.lit(1)), right, 1.0)
    with pytest.raises(ValueError):
        join_qr(left, right, 0.0)


def test_cells_of_a_point_by_arithmetic(spark):
    rows = spark.createDataFrame([(0.5, -3.25), (-5.0, 5.0), (12.5, 7.0), (float("nan"), 1.0), (None, 2.0)], "x double, y double").withColumn("geom", S.st_point())
    both = rows.select(S.qr_point("x", "y", 2.5).alias("own"), F.get(S.qr_envp("geom", 2.5), 0).alias("listed"))
    assert all(r.own == r.listed for r in both.collect())


def test_broadcast_is_decided_on_the_listed_cells(spark):
    """One large rectangle on a fine grid is small as a row, and 10,000 rows once its cells are listed."""
    points = spark.range(50).select("id", S.st_point(F.col("id") % 10, F.col("id") / 10.0), S.qr_point(F.col("id") % 10, F.col("id") / 10.0, 0.1))
    one = spark.range(1).select(F.col("id").alias("rid"), S.st_rect(F.lit(-0.5), F.lit(-0.5), F.lit(9.45), F.lit(9.45)).alias("geom"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = {most: join_qr(points, one, 0.1, oper="within", broadcast="rhs", broadcast_bytes=most) for most in (1 << 30, 1 << 18)}
        assert "BroadcastHashJoin" in plan(joined[1 << 30]) and "BroadcastHashJoin" not in plan(joined[1 << 18])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {df.count() for df in joined.values()} == {50}


def test_knn_join_without_broadcast(spark, monkeypatch):
    from quadra.operators import knn

    rng = random.Random(3)
    l = spark.createDataFrame([(k, rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(80)], "a long, x double, y double").select("a", S.st_point().alias("p"))
    r = spark.createDataFrame([(k, rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(70)], "b long, x double, y double").select("b", S.st_point().alias("q"))
    want = sorted(map(tuple, knn_join(l, r, 4, "p", "q").select("a", "b").collect()))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, knn_join(l, r, 4, "p", "q").select("a", "b").collect())) == want and len(want) == 320


def test_knn_join_against_brute_force(spark):
    rng = random.Random(11)
    points = [(k, rng.uniform(-1, 11), rng.uniform(-1, 11)) for k in range(60)] + [(100, -120.0, -45.0), (101, 179.0, 89.0)]
    points += [(200 + k, *points[k][1:]) for k in range(3)] + [(300, None, None)]
    squares = [(k, x, y, rng.uniform(0.05, 0.25)) for k in range(50) for x, y in [(rng.uniform(0, 10), rng.uniform(0, 10))]] + [(90, 60.0, 60.0, 1.0), (91, -60.0, 10.0, 1.0)]
    l = spark.createDataFrame(points, "pid long, x double, y double").select("pid", S.st_point().alias("pgeom"))
    r = spark.createDataFrame(squares, "bid long, x double, y double, s double").select("bid", S.st_cell("x", "y", "s").alias("bgeom"))
    for k in (1, 5, 400):
        got: dict = {}
        for row in knn_join(l, r, k, "pgeom", "bgeom").select("pid", "bid", "distance").collect():
            got.setdefault(row.pid, []).append(row.distance)
        assert set(got) == {p for p, x, _ in points if x is not None}
        for p, x, y in points:
            if x is None:
                continue
            want = sorted(math.hypot(max(bx - x, 0, x - bx - s), max(by - y, 0, y - by - s)) for _, bx, by, s in squares)[:k]
            assert len(got[p]) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(sorted(got[p]), want, strict=True))
    assert knn_join(l.limit(0), r, 3, "pgeom", "bgeom").count() == 0
    with pytest.raises(ValueError):
        knn_join(l, r, 0, "pgeom", "bgeom")


def square(x, y, s):
    return f"POLYGON (({x} {y}, {x} {y + s}, {x + s} {y + s}, {x + s} {y}, {x} {y}))"


@pytest.mark.parametrize(
    "shapes, areas",
    [
        ([square(0, 0, 100), square(50, 50, 100)], [17500]),
        ([square(0, 0, 100), square(500, 0, 100), square(550, 0, 100)], [10000, 15000]),
        ([square(-50, -50, 100)], [10000]),
        ([square(0, 0, 10), square(1000, 1000, 10), square(0, 0, 10)], [100, 100]),
        ([], []),
    ],
)
def test_dissolve(spark, shapes, areas):
    df = spark.createDataFrame([(s,) for s in shapes], "text string").select(S.st_fromtext())
    got = [r[0] for r in pairwise_dissolve(df, cell=70.0, dist=0.0).select(S.st_area()).collect()]
    assert sorted(round(a, 6) for a in got) == areas


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sources(spark, tmp_path):
    from quadra.sources.geoparquet import write_geo
    from quadra.sources.shapefile import read_shapefile, write_shapefile

    donut = "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    rows = spark.createDataFrame([(1, "é", donut, 1.5), (2, None, square(5, 5, 1), None)], "id long, name string, text string, v double").select("id", "name", "v", S.st_fromtext())
    write_shapefile(rows, f"file://{tmp_path}/shp")
    out = {r.id: r for r in read_shapefile(spark, f"file://{tmp_path}/shp").select("id", "name", "v", S.st_area()).collect()}
    assert out[1].area == 96 and out[1].name == "é" and out[1].v == 1.5 and out[2].area == 1 and out[2].v is None
    with pytest.raises(ValueError, match="no rows"):
        write_geo(rows.limit(0), f"{tmp_path}/a")
    with pytest.raises(ValueError, match="mixed"):
        write_geo(rows.select("geom").unionAll(spark.range(1).select(S.st_point(F.lit(1.0), F.lit(1.0)))), f"{tmp_path}/b")


def test_grid_filter_reaches_the_scan(spark, tmp_path):
    from quadra.operators import prune_by_area, write_qr_layout

    points = spark.range(2000).select("id", (F.col("id") % 100 * 1.0).alias("x"), (F.col("id") / 20).alias("y"))
    write_qr_layout(points, f"{tmp_path}/t", S.qr_fromxy("x", "y", 10.0), 4)
    near = prune_by_area(spark.read.parquet(f"{tmp_path}/t"), square(12, 12, 5), 10.0)
    assert near.count() == points.where("floor(x / 10) = 1 and floor(y / 10) = 1").count()
    assert "PushedFilters: [In(qr" in near._jdf.queryExecution().toString() or "EqualTo(qr" in near._jdf.queryExecution().toString()
