"""Queries that run over all boxes, against their SQL in DuckDB."""

import random

import duckdb
import pytest

from quadra import plans


def by_sql(name, data):
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return sorted(con.execute(plans.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["shapefile_round_trip"])
def test_query_is_its_sql(spark, data, name):
    got = sorted(map(tuple, plans.queries()[name](spark, data).collect()))
    want = by_sql(name, data)
    assert len(got) == len(want) and all(a[:2] == b[:2] and all(abs(x - y) < 2e-6 for x, y in zip(a[2:], b[2:], strict=True)) for a, b in zip(got, want, strict=True))


def test_shapefile_round_trip_has_all_boxes(spark):
    """0.01 has more than 300 boxes."""
    rows = plans.queries()["shapefile_round_trip"](spark, "/root/testdata/sf0.01").count()
    assert rows == duckdb.connect().execute("SELECT count(*) FROM '/root/testdata/sf0.01/customer.parquet'").fetchall()[0][0] > 300


@pytest.mark.parametrize("name", ["join_qr_touches", "join_qr_crosses", "join_qr_equals"])
def test_join_is_its_sql(spark, name):
    data = "/root/testdata/sf0.01"
    got = sorted(map(tuple, plans.queries()[name](spark, data).collect()))
    assert got == by_sql(name, data)


def test_joins_of_a_lattice(spark, monkeypatch):
    """Boxes that share edges, corners and bounds: every pair, by hand."""
    from quadra import functions as S
    from quadra.plans import composite

    rng = random.Random(2)
    rows = []
    for k in range(80):
        h, x, y = rng.choice((0.5, 0.75, 1.0)), rng.randint(0, 16) / 4, rng.randint(0, 16) / 4
        rows.append((k, x, y, x - h, y - h, x + h, y + h))
    boxes = spark.createDataFrame(rows, "id long, cx double, cy double, xmin double, ymin double, xmax double, ymax double")
    monkeypatch.setattr(composite, "_boxes", lambda *_: boxes.withColumn("geom", S.st_rect("xmin", "ymin", "xmax", "ymax")))
    monkeypatch.setattr(composite, "view", lambda *_: boxes)
    meet = lambda a, b: min(a[2], b[2]) - max(a[0], b[0]), lambda a, b: min(a[3], b[3]) - max(a[1], b[1])
    box = {r[0]: r[3:] for r in rows}
    strip = {r[0]: (r[5], r[4], r[5] + 0.25, r[6]) for r in rows}
    line = {r[0]: (r[3] - 0.1, r[2], r[5] + 0.1) for r in rows}
    touch = lambda a, b: min(f(a, b) for f in meet) == 0
    cross = lambda m, b: b[1] < m[1] < b[3] and m[0] < b[2] and m[2] > b[0] and not (m[0] >= b[0] and m[2] <= b[2])
    want = {
        "join_qr_touches": [(a, b) for a in box for b in box if touch(box[a], strip[b])],
        "join_qr_crosses": [(a, b) for a in box for b in box if cross(line[a], box[b])],
        "join_qr_equals": [(a, b) for a in box for b in box if box[a] == box[b]],
    }
    for name, pairs in want.items():
        assert any(a != b for a, b in pairs) and sorted(map(tuple, plans.queries()[name](spark, None).collect())) == sorted(pairs)
