"""Functions against closed forms and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quadra import functions as S


def one(spark, *columns, **values):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else row


def wkt(text):
    return S.st_fromtext(F.lit(text))


def rect(*c):
    return S.st_rect(*map(F.lit, map(float, c)))


def test_null_gives_null(spark):
    nothing, number = F.lit(None).cast("binary"), F.lit(None).cast("double")
    g = rect(0, 0, 1, 1)
    columns = [
        S.st_point(number, F.lit(1.0)), S.st_area(nothing), S.st_length(nothing), S.st_x(nothing), S.st_extent(nothing), S.st_centroid(nothing), S.st_astext(nothing),
        S.st_asgeojson(nothing), S.st_distance(nothing, g), S.st_dwithin(g, nothing, 1.0), S.st_intersects(g, nothing), S.st_disjoint(nothing, g), S.st_buffer(nothing, F.lit(1.0)),
        S.st_convexhull(nothing), S.st_dump(nothing), S.st_union_col(F.lit(None).cast("array<binary>")), S.qr_list(nothing, 1.0), S.qr_envp(nothing, 1.0), S.qr_count(nothing, 1.0),
        S.qr_geom(nothing, 1.0), S.qr_fromxy(number, F.lit(1.0), 1.0), S.st_lontox(number), S.st_xtoq(number, 1.0), S.st_translate(nothing, 1.0, 1.0), S.st_within_mask(F.lit(None).cast("array<binary>"), g),
        S.st_intersection(g, nothing), S.st_iou(nothing, g), S.st_exterior_ring(nothing), S.st_mercator(nothing), S.st_wgs84(nothing), S.clip_line(F.lit(None).cast("array<double>"), 1.0), S.st_euclid(number, 0.0, 0.0, 0.0),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    assert [k for k, v in enumerate(row) if v is not None] == []
    assert one(spark, S.st_isempty(nothing)) is True


def test_donut_and_islands(spark):
    donut = "POLYGON ((10 10, 90 10, 90 90, 10 90, 10 10), (40 40, 40 60, 60 60, 60 40, 40 40))"
    multi = "MULTIPOLYGON (((10 10, 90 10, 90 90, 10 90, 10 10), (40 40, 40 60, 60 60, 60 40, 40 40)), ((100 0, 110 0, 110 10, 100 10, 100 0)))"
    assert one(spark, S.st_area(wkt(donut))) == 6000
    parts = one(spark, F.transform(S.st_dump(wkt(multi)), lambda g: S.st_area(g)))
    assert sorted(parts) == [100, 6000]
    assert one(spark, S.st_area(S.st_exterior_ring(wkt(multi)))) == 6500
    island = "MULTIPOLYGON (((0 0, 100 0, 100 100, 0 100, 0 0), (20 20, 80 20, 80 80, 20 80, 20 20)), ((40 40, 60 40, 60 60, 40 60, 40 40)))"
    assert one(spark, S.st_area(S.st_exterior_ring(wkt(island)))) == 10000


def test_mercator(spark):
    assert one(spark, S.st_lontox(F.lit(180.0))) == 20037508.342789244
    for lon, lat in ((23.6543, 71.6109), (20.1895, 71.3101), (-179.9, -85.0)):
        p = S.st_wgs84(S.st_mercator(S.st_point(F.lit(lon), F.lit(lat))))
        x, y = one(spark, S.st_x(p), S.st_y(p))
        assert abs(x - lon) < 1e-9 and abs(y - lat) < 1e-9


def test_grid_cells_agree(spark):
    g = rect(-3.2, 1.4, 11.9, 8.6)
    for cell in (0.5, 1.0, 7.3):
        for dist in (0.0, 0.05, 0.4 * cell):
            cells, count, envp, pieces = one(spark, S.qr_list(g, cell, dist), S.qr_count(g, cell, dist), S.qr_envp(g, cell, dist)["qr"], S.qr_geom(g, cell, dist)["qr"])
            assert count == len(cells) == len(envp) and set(cells) == set(envp) and set(pieces) <= set(cells)
            assert cells == S.qr_cells("POLYGON ((-3.2 1.4, -3.2 8.6, 11.9 8.6, 11.9 1.4, -3.2 1.4))", cell, dist)
    area = one(spark, F.aggregate(S.qr_geom(g, 1.0)["geom"], F.lit(0.0), lambda a, p: a + S.st_area(p)))
    assert abs(area - 15.1 * 7.2) < 1e-9
    assert {q >> 32 for q in one(spark, S.qr_list(rect(80, 10, 95, 20), 100.0, 10.0))} == {0, 1}
    assert {q >> 32 for q in one(spark, S.qr_list(rect(80, 10, 95, 20), 100.0))} == {0}
    assert one(spark, F.size(S.qr_geom(S.st_point(F.lit(1.0), F.lit(1.0)), 1.0))) == 0
    assert one(spark, S.qr_count(wkt("POLYGON EMPTY"), 1.0)) == 0


@pytest.mark.parametrize("cell, dist", [(0.0, 0.0), (-1.0, 0.0), (float("nan"), 0.0), (float("inf"), 0.0), (1.0, -1.0), (1.0, float("nan"))])
def test_grid_arguments_are_checked(spark, cell, dist):
    with pytest.raises(Exception, match="cell|dist"):
        one(spark, S.qr_list(rect(0, 0, 1, 1), cell, dist))
    with pytest.raises(ValueError):
        S.qr_cells("POINT (1 1)", cell, dist)


def test_canonical_cell_of_random_pairs(spark):
    rng = random.Random(0x51A7)
    rows = []
    for _ in range(500):
        cell = rng.uniform(0.1, 50.1)
        a = [rng.uniform(-1000, 1000) for _ in range(2)]
        b = [v + rng.uniform(-3, 3) * cell for v in a]
        boxes = [(x, y, x + rng.uniform(0, 2) * cell, y + rng.uniform(0, 2) * cell) for x, y in (a, b)]
        rows.append((cell, *boxes[0], *boxes[1]))
    names = ["cell", "a0", "a1", "a2", "a3", "b0", "b1", "b2", "b3"]
    df = spark.createDataFrame(rows, names)
    box = lambda p: S.st_rect(*[F.col(f"{p}{k}") for k in range(4)])
    pairs = df.withColumn("l", F.explode(S.qr_envp(box("a"), F.col("cell")))).withColumn("r", F.explode(S.qr_envp(box("b"), F.col("cell"))))
    hits = pairs.where(S.qr_intersect("l", "r", F.col("cell"))).groupBy(*names).agg(F.count("*").alias("n"), F.first("l.qr").alias("qr")).collect()
    want = {}
    for cell, *v in rows:
        x, y = max(v[0], v[4]), max(v[1], v[5])
        if x <= min(v[2], v[6]) and y <= min(v[3], v[7]):
            want[(cell, *v)] = (math.floor(x / cell) << 32) | (math.floor(y / cell) & 0xFFFFFFFF)
    assert {tuple(h)[:9]: h.qr for h in hits} == want and all(h.n == 1 for h in hits)


def test_clip_line_against_brute_force(spark):
    rng = random.Random(42)
    for cell in (0.5, 1.0, 7.3):
        for dist in (0.0, 0.05, 0.4 * cell):
            lines = [[rng.uniform(-20, 20) for _ in range(4)] for _ in range(40)] + [[-3.7, 2.1, 11.4, -6.8]]
            df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, line array<double>")
            got = {(r.k, r.c.q, r.c.r): r.c.l for r in df.select("k", F.explode(S.clip_line_dist("line", cell, dist)).alias("c")).collect()}
            want = {}
            for k, (x1, y1, x2, y2) in enumerate(lines):
                for q in range(math.floor((min(x1, x2) - dist) / cell), math.floor((max(x1, x2) + dist) / cell) + 1):
                    for r in range(math.floor((min(y1, y2) - dist) / cell), math.floor((max(y1, y2) + dist) / cell) + 1):
                        low, high = 0.0, 1.0
                        for s, d, a, b in ((x1, x2 - x1, q * cell - dist, (q + 1) * cell + dist), (y1, y2 - y1, r * cell - dist, (r + 1) * cell + dist)):
                            u, v = sorted(((a - s) / d, (b - s) / d))
                            low, high = max(low, u), min(high, v)
                        length = (high - low) * math.hypot(x2 - x1, y2 - y1)
                        if length > 1e-9:
                            want[k, q, r] = length
            assert {k for k, v in got.items() if v > 1e-9} == set(want)
            assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_predicates_on_a_star(spark):
    corners = [(r * math.cos(t), r * math.sin(t)) for k in range(400) for t, r in [(2 * math.pi * k / 400, 10 if k % 2 else 4)]]
    star = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*corners, corners[0]]) + "))"
    grid = [(-12 + 0.37 * i, -12 + 0.41 * j) for i in range(65) for j in range(59)] + [(0.0, 0.0), (9.0, 9.0)]
    df = spark.createDataFrame(grid, "x double, y double").withColumn("p", S.st_point()).withColumn("g", wkt(star))
    mask = F.element_at(S.st_within_mask(F.array("p"), "g"), 1)
    out = df.select("x", "y", S.st_within("p", "g").alias("w"), S.st_contains("g", "p").alias("c"), S.st_intersects("g", "p").alias("i"), S.st_disjoint("p", "g").alias("d"), S.st_dwithin("p", "g", 0.0).alias("z"), mask.alias("m")).collect()

    def inside(x, y):
        odd = False
        for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
        return odd

    for r in out:
        want = inside(r.x, r.y)
        assert (r.w, r.c, r.m) == (want, want, want) and r.i == (not r.d) and r.z == r.i
    assert next(r.w for r in out if (r.x, r.y) == (0, 0)) and not next(r.w for r in out if (r.x, r.y) == (9, 9))


def test_shape_structs(spark):
    ring = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    rings = [ring(0, 0, 100), ring(40, 40, 20), ring(200, 0, 100)]
    for order in ((0, 1, 2), (1, 0, 2), (2, 1, 0)):
        own = [rings[k] for k in order]
        for more in (0, 1, 2):
            coords = [v for r in own for p in r for v in (*map(float, p), *([7.0] * more))]
            df = spark.createDataFrame([((0.0, 0.0, 1.0, 1.0, [5, 5, 5], coords),)], "Shape struct<xmin:double,ymin:double,xmax:double,ymax:double,parts:array<int>,coords:array<double>>")
            for f in (S.gdb_polygon2, S.gdb_polygonM, S.gdb_polygonZ):
                areas = df.select(F.transform(S.st_dump(f()), lambda g: S.st_area(g))).first()[0]
                assert sorted(areas) == [9600, 10000]
            assert df.select(S.st_length(S.gdb_polyline2())).first()[0] == 880
    bad = spark.createDataFrame([((0.0, 0.0, 1.0, 1.0, [5], [1.0, 2.0, 3.0]),)], "Shape struct<xmin:double,ymin:double,xmax:double,ymax:double,parts:array<int>,coords:array<double>>")
    with pytest.raises(Exception, match="values for"):
        bad.select(S.gdb_polygon2()).first()


def test_bad_input(spark):
    assert one(spark, S.st_astext(wkt("POLYGON ((0 0"))) == "EMPTY"
    with pytest.raises(Exception, match="vertex"):
        one(spark, S.st_x(rect(0, 0, 1, 1), 9))
    with pytest.raises(Exception, match="alternate"):
        one(spark, S.st_polygon2(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    with pytest.raises(ValueError):
        S.st_multipoint()


def test_registered_names(spark):
    from quadra.functions.register import st_register_functions

    names = st_register_functions(spark)
    assert len(names) > 75 and len(set(names)) == len(names)
    row = spark.sql("SELECT ST_INTERSECTS(ST_FROMTEXT('POINT (1 1)'), ST_FROMTEXT('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))')) AS a, ST_WITHIN_MASK(array(ST_POINT(1, 1), ST_POINT(9, 9)), ST_RECT(0, 0, 2, 2), '-1') AS m").first()
    assert row.a is True and row.m == [True, False]
    with pytest.raises(Exception, match="requires|parameters"):
        spark.sql("SELECT ST_INTERSECTS(ST_POINT(1, 1), ST_POINT(1, 1), '-1', 'x')").first()
