"""Exact nearest neighbours by rings of the grid.

Round i looks at all right rows within reach R = R0 * 2**i of a left envelope: the left row lists the cells around it, the right row those it touches,
and they meet by an equi-join; only pairs within R are kept. A left row is done when it has k of them; the others go on with
twice the reach. Nothing is collected; R0 comes from the right side's extent and count. The right side is broadcast while its counted rows are few (then the left rows
are dealt once, and the pairs are ranked where they are made); beyond that both shuffle, and each task cuts its pairs to k before they travel.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadra import functions as S
from quadra import runtime
from quadra.functions.native import native

#: The right side is broadcast while its counted rows have so many bytes at most.
BROADCAST_BYTES = 32 << 20
_ENVELOPE = ("xmin", "ymin", "xmax", "ymax")


def _placed(df: DataFrame, key: str, geom: str, side: str) -> DataFrame:
    """key, the geometry and its envelope, of rows that have one."""
    e = S.st_extent("g")
    rows = df.select(key, F.col(geom).alias("g")).where("g is not null").withColumn("e", e).where(~S.st_isempty("g"))
    return rows.select(key, F.col("g").alias(f"{side}geom"), *(F.col(f"e.{c}").alias(f"{side}{c}") for c in _ENVELOPE))


def knn_join(lhs: DataFrame, rhs: DataFrame, k: int, lhs_geom: str = "geom", rhs_geom: str = "geom", distance: str = "distance") -> DataFrame:
    """The k nearest rhs rows of each lhs row, planar and exact: lhs's columns, rhs's, `distance`; one row for each pair.

    Null or empty lhs geometries give no rows, null or empty rhs geometries are not found; ties keep the rhs row that comes first.
    """
    if int(k) != k or k < 1:
        raise ValueError("k must be a whole number above zero")
    for df, name in ((lhs, lhs_geom), (rhs, rhs_geom)):
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
    ids = F.monotonically_increasing_id()  # written at once, so they stay
    left_names, right_names = [f"l{i}" for i in range(len(lhs.columns))], [f"r{i}" for i in range(len(rhs.columns))]
    left = runtime.save(lhs.toDF(*left_names).withColumn("lid", ids), "knn-left")
    right = runtime.save(rhs.toDF(*right_names).withColumn("rid", ids), "knn-right")
    lgeom, rgeom = left_names[lhs.columns.index(lhs_geom)], right_names[rhs.columns.index(rhs_geom)]
    parts = runtime.shuffle_partitions(left.sparkSession)
    l, r = _placed(left, "lid", lgeom, "l"), _placed(right, "rid", rgeom, "r")
    l = runtime.save(l.repartition(parts, "lid"), "knn-asking")
    boxes = {}
    for side, df in ((0, l), (1, r)):
        box = df.agg(F.count("*").alias("n"), *[(F.min if c.endswith("min") else F.max)(f"{'lr'[side]}{c}").alias(c) for c in _ENVELOPE]).first()
        if box["n"]:
            boxes[side] = box
    found = None
    if 1 in boxes and 0 in boxes:
        n = boxes[1]["n"]
        k = min(int(k), n)
        width, height = boxes[1]["xmax"] - boxes[1]["xmin"], boxes[1]["ymax"] - boxes[1]["ymin"]
        reach = math.sqrt(width * height * k / n) or max(width, height) * k / n or 1.0
        far = 2 * max(max(b["xmax"] for b in boxes.values()) - min(b["xmin"] for b in boxes.values()), max(b["ymax"] for b in boxes.values()) - min(b["ymin"] for b in boxes.values()), reach)
        waiting, order = l, Window.partitionBy("lid").orderBy("d", "rid")
        while True:
            last = reach >= far
            told = r.withColumn("cell", F.explode(S.qr_list("rgeom", reach, 0.0)))
            cells = told.agg(F.count("*"), F.sum(F.length("rgeom"))).first()  # one row
            small = (cells[1] or 0) + 80 * cells[0] <= BROADCAST_BYTES
            dealt = waiting.repartition(parts, "lid") if small else waiting
            asks = dealt.withColumn("cell", F.explode(S.qr_list("lgeom", reach, reach)))
            gap = [F.greatest(F.col(f"r{c}min") - F.col(f"l{c}max"), F.col(f"l{c}min") - F.col(f"r{c}max"), F.lit(0.0)) for c in "xy"]
            near = gap[0] * gap[0] + gap[1] * gap[1] <= reach * reach * (1 + 1e-9)
            pairs = asks.join(F.broadcast(told) if small else told, "cell").where(near)
            pairs = pairs.select("lid", "rid", native("quadra_distance", F.col("lgeom"), F.col("rgeom")).alias("d")).where(F.col("d") <= reach)
            if cells[0] > n:  # a right row in several cells may meet a left row in more than one
                pairs = pairs.dropDuplicates(["lid", "rid"])
            best = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
            best = best.withColumn("sure", F.lit(last) | (F.max("place").over(Window.partitionBy("lid")) == k))
            best = runtime.save(best.where("sure").select("lid", "rid", "d"), "knn-found")
            found = best if found is None else found.unionByName(best)
            if last:
                break
            waiting = runtime.save(waiting.join(best.select("lid").distinct(), "lid", "left_anti"), "knn-waiting")
            if not waiting.limit(1).count():
                break
            reach *= 2
    if found is None:
        found = left.sparkSession.createDataFrame([], "lid long, rid long, d double")
    out = found.join(left, "lid").join(right, "rid")
    names = [*lhs.columns, *rhs.columns, distance]
    return out.select(*left_names, *right_names, "d").toDF(*names)
