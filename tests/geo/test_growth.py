"""Work that must not grow with the square of the input, and results that must hold at size."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quadra import functions as S


def test_dissolve_joins_united_parts_only(spark, monkeypatch):
    """900 squares of two blocks, each there 20 times: what is joined pairwise are a few parts, not copies or neighbours."""
    from quadra.operators import dissolve

    seen = []
    real = dissolve.join_qr
    monkeypatch.setattr(dissolve, "join_qr", lambda l, r, *a, **k: (seen.append(l.count()), real(l, r, *a, **k))[1])
    monkeypatch.setattr(dissolve, "PART", 50)
    squares = spark.range(18000).select((F.col("id") % 900).alias("k")).select((F.col("k") % 30 + F.when(F.col("k") % 30 >= 15, 100).otherwise(0)).alias("x"), F.floor(F.col("k") / 30).alias("y"))
    got = dissolve.pairwise_dissolve(squares.select(S.st_cell("x", "y", 1.0).alias("geom")), cell=10.0, dist=0.0).select(S.st_area()).collect()
    assert sorted(r[0] for r in got) == [450, 450] and seen[0] <= 30


def test_listed_cells_are_not_broadcast_by_file_size(spark, data):
    from quadra import plans

    for name in ("qr_intersect", "join_qr_intersects", "distance_join", "sql_surface"):
        assert "BroadcastExchange" not in plans.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["qr_geom", "qr_geom_explode", "qr_envp_geom", "qr_envp_geom_explode"])
def test_pieces_of_boxes_that_end_on_an_edge_of_the_grid(spark, tmp_path, name):
    """Cells that a box only touches are listed, as in the SQL; these three boxes end on edges."""
    from quadra import plans

    path = f"{tmp_path}/customer.parquet"
    duckdb.connect().execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/customer.parquet' WHERE c_custkey IN (3000, 5000, 8000, 8001)) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(plans.oracle_sql()[name]).fetchall())


def test_counter_is_brute_force():
    import numpy as np

    from quadra.operators import containing

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 60, 400) / 4, rng.integers(0, 60, 400) / 4
    w, h = rng.choice([0.5, 2.0, 7.5], 400), rng.choice([1.0, 3.0], 400)
    w[:9], h[:9] = rng.random(9) * 5, rng.random(9) * 5
    a, b = rng.integers(0, 60, 500) / 4, rng.integers(0, 60, 500) / 4
    c, d = a + rng.integers(0, 9, 500) / 4, b + rng.integers(0, 9, 500) / 4
    want = [int(((x < i) & (x + w > k) & (y < j) & (y + h > m)).sum()) for i, j, k, m in zip(a, b, c, d, strict=True)]
    for few, table in ((24, 1024), (2, 16)):
        containing.FEW, containing.TABLE = few, table
        assert containing.counter(x, y, x + w, y + h)(a, b, c, d).tolist() == want
    containing.FEW, containing.TABLE = 24, 1024


def test_cross_box_pairs_list_no_hits(spark, monkeypatch):
    """Ids of one, several and many rows against their SQL; only ids of more than MOST rows are joined with the boxes."""
    from quadra import plans
    from quadra.operators import containing

    rng = random.Random(4)
    rows = []
    for k in range(300):
        start = rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4
        for _ in range(9 if k < 3 else rng.choice((1, 1, 2, 3, 6))):
            if k % 5 == 0:
                start = rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4
            rows.append((k, *map(float, start), start[0] + rng.randint(-16, 16) / 4, start[1] + rng.randint(-16, 16) / 4))
    boxes = [(k, x - h, y - h, x + h, y + h) for k in range(200) for x, y, h in [(rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4, rng.choice((0.5, 1.25, 4.0)))]]
    con = duckdb.connect()
    con.execute("CREATE TABLE geo_segments (id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)")
    con.execute("CREATE TABLE geo_boxes (id BIGINT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE)")
    con.executemany("INSERT INTO geo_segments VALUES (?, ?, ?, ?, ?)", rows)
    con.executemany("INSERT INTO geo_boxes VALUES (?, ?, ?, ?, ?)", boxes)
    text = plans.oracle_sql()["q11_cross_box_segments"]
    want = con.execute("WITH hit AS" + text.split("hit AS", 1)[1]).fetchone()[0]
    sent = []
    real = containing.join_qr
    monkeypatch.setattr(containing, "join_qr", lambda l, *a, **k: (sent.append(l.count()), real(l, *a, **k))[1])
    monkeypatch.setattr(containing, "ROWS", 100)
    s = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(boxes, "box long, xmin double, ymin double, xmax double, ymax double")
    assert containing.cross_box_pairs(s, b, 5.0).collect()[0].n == want > 1000 and sent == [2 * 9 * 3]
    assert containing.cross_box_pairs(s.where("id > 2"), b, 5.0).count() == 1 and len(sent) == 1


def test_relations_by_envelope_are_the_geometries_own(spark):
    """Points, boxes, level and slanted lines and triangles of a lattice: every relation is what JTS says of the pair, and settled by numbers where it can be."""
    from quadra.functions.native import native
    from quadra.operators import join_qr

    rng = random.Random(7)
    at = lambda: rng.randint(0, 16) / 4
    texts = []
    for _ in range(30):
        x, y, w, h = at(), at(), rng.choice((0.5, 1.5)), rng.choice((0.5, 1.5))
        texts += [f"POINT ({x} {y})", f"POLYGON (({x} {y}, {x} {y + h}, {x + w} {y + h}, {x + w} {y}, {x} {y}))", f"LINESTRING ({x} {y}, {x + w} {y})", f"LINESTRING ({x} {y}, {x + w} {y + h})", f"POLYGON (({x} {y}, {x} {y + h}, {x + w} {y}, {x} {y}))"]
    shapes = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", S.st_fromtext().alias("geom")).cache()
    l, r = shapes.withColumnRenamed("id", "a"), shapes.withColumnRenamed("id", "b")
    for oper in ("contains", "crosses", "equals", "intersects", "overlaps", "touches", "within"):
        want = sorted(map(tuple, l.crossJoin(r.toDF("b", "other")).where(native(f"quadra_{oper}", F.col("geom"), F.col("other"), F.lit("-1"))).select("a", "b").collect()))
        for dist in (0.0, 0.3):
            assert sorted(map(tuple, join_qr(l, r, 1.0, dist, oper=oper).select("a", "b").collect())) == want and want, oper
    plan = join_qr(l, r, 1.0, oper="touches")._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan.split("SortMergeJoin")[1]


def test_equal_shapes_meet_by_their_bounds(spark, data):
    from quadra import plans

    keys = plans.queries()["join_qr_equals"](spark, data)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].split("]")[0]
    assert "xmin" in keys and "ymax" in keys


def test_shapefiles_are_stored_by_tasks(spark, tmp_path, monkeypatch):
    from quadra.sources.shapefile import read_shapefile, write_shapefile

    rows = spark.range(500).select("id", S.st_cell(F.col("id") * 2, F.lit(0), 1.0).alias("geom")).cache()
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    write_shapefile(rows, f"file://{tmp_path}/shp", rows_per_file=100)
    assert read_shapefile(spark, f"file://{tmp_path}/shp").count() == 500 and len(list((tmp_path / "shp").glob("*.shp"))) > 1
