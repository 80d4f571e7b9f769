"""Dissolve: unions of polygons that overlap or touch.

Polygons that are there again go first. The others are united within the grid cell of their lower left corner, where many lie in a cell by parts of it, so
what is left is a few connected parts for each cell, however many polygons there were. Parts that meet are found by the grid join; connected groups get a
label; each group is united in two steps, first for each larger cell of the group, then over those cells, so a large group's first unions run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import functions as S
from quadra import runtime
from quadra.operators.components import components
from quadra.operators.joins import join_qr


#: About so many polygons of a cell are united at once.
PART = 2000
#: A group's parts are united first within cells so many times as wide.
WIDER = 8


def pairwise_dissolve(buf: DataFrame, cell: float = 100000.0, dist: float = 100.0, wkid=3857, cell_mul: float = 10.0, breaker: int = 10, geom_name: str = "geom") -> DataFrame:
    """One geometry column: the parts of the union of all polygons. dist, cell_mul and breaker shape no result here and are only checked."""
    if not cell > 0 or dist < 0 or not cell_mul > 1 or breaker < 1:
        raise ValueError("cell must be above zero, dist not negative, cell_mul above one, breaker one or more")
    own = buf.select(F.col(geom_name).alias("geom")).where(~S.st_isempty("geom")).distinct().withColumn("home", S.qr_fromgeom("geom", cell))
    own = runtime.save(own, "dissolve")
    sizes = own.groupBy("home").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = own.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("geom"), "parts"))
    joined = lambda rows, *by: rows.groupBy(*by).agg(S.st_union_col(F.collect_list("geom"), wkid).alias("geom"))
    near = joined(joined(dealt, "home", "part"), "home").select(F.explode(S.st_dump("geom")).alias("geom"))
    near = runtime.save(near.withColumn("id", F.monotonically_increasing_id()), "dissolve")
    pairs = join_qr(near.select("id", "geom"), near.select(F.col("id").alias("other"), "geom"), cell, oper="intersects", wkid=wkid)
    groups = components(pairs.where("id < other").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    labelled = near.join(groups, F.col("id") == F.col("node"), "left").select(F.coalesce("component", "id").alias("label"), "geom")
    whole = joined(joined(labelled, "label", S.qr_fromgeom("geom", cell * WIDER)), "label")
    return whole.select(F.explode(S.st_dump("geom")).alias(geom_name))
