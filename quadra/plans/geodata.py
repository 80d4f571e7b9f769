"""Geometry derived from the driver's tables by arithmetic that Spark and DuckDB compute alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View name -> (table, SQL text that both engines run).
VIEWS: dict[str, tuple[str, str]] = {
    "geo_points": (
        "orders",
        "SELECT o_orderkey AS id, o_custkey AS custkey, o_orderdate AS ts, o_totalprice AS price, (o_orderkey * 7919 % 3600000) / 1e4 - 180 AS x, (o_orderkey * 104729 % 1600000) / 1e4 - 80 AS y FROM orders",
    ),
    "geo_boxes": (
        "customer",
        "SELECT id, name, cx, cy, h, cx - h AS xmin, cy - h AS ymin, cx + h AS xmax, cy + h AS ymax FROM (SELECT c_custkey AS id, c_name AS name, (c_custkey * 15485863 % 3600000) / 1e4 - 180 AS cx, (c_custkey * 32452843 % 1600000) / 1e4 - 80 AS cy, 0.5e0 + (c_custkey % 17) / 4e0 AS h FROM customer) AS b",
    ),
    "geo_segments": (
        "lineitem",
        "SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 7919 % 3600000) / 1e4 - 180 AS x1, (l_orderkey * 104729 % 1600000) / 1e4 - 80 AS y1, (l_orderkey * 7919 % 3600000) / 1e4 - 180 + (l_partkey % 97) / 1e1 - 4.83e0 AS x2, (l_orderkey * 104729 % 1600000) / 1e4 - 80 + (l_suppkey % 89) / 1e1 - 4.41e0 AS y2 FROM lineitem",
    ),
    "geo_triangles": (
        "part",
        "SELECT p_partkey AS id, (p_partkey * 15485863 % 3600000) / 1e4 - 180 AS x, (p_partkey * 32452843 % 1600000) / 1e4 - 80 AS y, p_size % 7 + 1e0 AS a, p_size % 5 + 2e0 AS b FROM part",
    ),
    "geo_sites": (
        "supplier",
        "SELECT s_suppkey AS sid, (s_suppkey * 15485863 % 3600000) / 1e4 - 180 AS sx, (s_suppkey * 32452843 % 1600000) / 1e4 - 80 AS sy FROM supplier",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    source, text = VIEWS[name]
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def sql(body: str) -> str:
    """`body` with the views that it names as common table expressions."""
    used = [f"{name} AS ({text})" for name, (_, text) in VIEWS.items() if name in body]
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("RECURSIVE ") else "WITH "
    body = body.lstrip()
    if body.upper().startswith("WITH "):
        return head + ", ".join(used) + (", " if used else "") + body[5:]
    return (head + ", ".join(used) + " " if used else "") + body
