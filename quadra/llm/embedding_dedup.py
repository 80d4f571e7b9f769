"""Embedding near-duplicates by collision-counting projections.

Vectors of equal label are compared by cosine. Unit vectors are projected on `lists` random directions; in each sorted list a query
takes the window of values within a reach of its own, the members of its windows are counted, and pairs that collide in `needed` lists or more are
verified by their exact cosine in double precision. Two unit vectors of cosine c differ along a random direction by |difference| times a
component of a random unit vector, whose distribution is known for each dimension, so the count is calibrated for a recall of `recall` at the threshold.

Cells. A label of more than `cell` vectors is cut at the medians of its first projections, as often as that needs; a vector within
`border` of a cut is also sent to the other side, so that a pair meets in the home cell of its smaller node. A cell still too
large (vectors that lie close together) is cut into tiles that meet pairwise, so no task holds an unbounded group.

Equal vectors of a label are one node with a count before anything is compared; a task sends counts of links and a spanning forest, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label, link with
nothing and are returned; vectors of another dimension link only with their like; labels are compared as strings; rows that repeat a vec_id count as vectors
of their own, also where their vectors or labels differ; a row without vec_id counts as a link of others and joins them, its component is null if no row
with an id is reached, and it is kept only then; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.operators.components import components

LISTS = 48
CELL = 1024
#: Projections that may be cut, each in two.
CUTS = 16
#: Half a window's width, in standard deviations of the difference of two vectors at the threshold along a direction.
REACH = 0.8
_SEED = 97


def directions(dim: int, lists: int = LISTS) -> np.ndarray:
    """Fixed random unit directions, one in each column."""
    a = np.random.default_rng([_SEED, dim]).standard_normal((dim, lists))
    return a / np.linalg.norm(a, axis=0)


def calibrate(dim: int, threshold: float, recall: float, lists: int) -> tuple[float, int]:
    """(reach, needed): half a window's width, and the collisions that a pair at the threshold has with probability `recall` or more."""
    reach = REACH * math.sqrt((2 - 2 * threshold) / dim)
    hit = 1.0
    if dim > 1:  # a component of a random unit vector is the sine of an angle of density cos ** (dim - 2)
        angle = np.linspace(-math.pi / 2, math.pi / 2, 40001)[1:-1]
        density = np.cos(angle) ** (dim - 2)
        hit = float(density[np.abs(np.sin(angle)) <= REACH / math.sqrt(dim)].sum() / density.sum())
    left, needed = 1.0, 0
    for k in range(lists + 1):  # the largest count whose lower tail stays under 1 - recall
        tail = math.comb(lists, k) * hit**k * (1 - hit) ** (lists - k)
        if left - tail < recall:
            needed = k
            break
        left -= tail
    return reach + 1e-12, needed


def _prepare(batches, lists: int):
    """Unit vectors, their first projections, of the nodes that can link."""
    for batch in batches:
        column = batch.column("embedding")
        flat, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(begin), 0)
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            step = max(1, (4 << 20) // dim)
            for part in np.array_split(at, -(-len(at) // step)):
                m = flat[begin[part][:, None] + np.arange(dim)]  # null components are NaN here
                top = np.abs(m).max(axis=1)
                able = np.isfinite(top) & (top > 0)
                if not able.any():
                    continue
                part, m = part[able], m[able] / top[able, None]
                m /= np.linalg.norm(m, axis=1)[:, None]
                p = m @ directions_cached(dim, lists)[:, :CUTS]
                n = len(part)
                columns = [batch.column(c).take(pa.array(part)) for c in ("node", "rep", "label", "key", "n")]
                columns += [pa.array(np.full(n, dim, np.int32)), pa.array([row.tobytes() for row in m], pa.binary()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * p.shape[1], p.ravel())]
                yield pa.record_batch(columns, names=["node", "rep", "label", "key", "n", "dim", "unit", "p"])


_made: dict = {}


def directions_cached(dim: int, lists: int) -> np.ndarray:
    if (dim, lists) not in _made:
        _made[dim, lists] = directions(dim, lists)
    return _made[dim, lists]


def _pairs(query_p, query_u, target_p, target_u, threshold: float, reach: float, needed: int, held: int = 1 << 19):
    """(query, target) places of the pairs that pass the collision count and the cosine. At most about `held` counters are held at once."""
    m, lists = target_p.shape
    order = np.argsort(target_p, axis=0, kind="stable")
    low, high = np.empty((2, lists, len(query_p)), np.int64)
    for j in range(lists):
        column = target_p[order[:, j], j]
        low[j] = np.searchsorted(column, query_p[:, j] - reach, "left")
        high[j] = np.searchsorted(column, query_p[:, j] + reach, "right")
    chunk, step = max(1, held // m), max(1, (4 << 20) // query_u.shape[1])
    for a in range(0, len(query_p), chunk):
        n = min(chunk, len(query_p) - a)
        hits = np.zeros(n * m, np.int16)
        for j in range(lists):  # the members of each query's window, each once in a list
            begin, count = low[j, a : a + n], high[j, a : a + n] - low[j, a : a + n]
            place = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
            hits[np.repeat(np.arange(n) * m, count) + order[place, j]] += 1
        found = np.flatnonzero(hits >= needed)
        for b in range(0, len(found), step):
            qi, ti = np.divmod(found[b : b + step], m)
            ok = np.einsum("ij,ij->i", query_u[a + qi], target_u[ti]) >= threshold
            yield a + qi[ok], ti[ok]


def _compare(key, table: pa.Table, threshold: float, recall: float, lists: int) -> pa.Table:
    """Links of the queries of one tile pair with its targets; each pair once, where its smaller node is a query."""
    dim = table.column("dim")[0].as_py()
    reach, needed = calibrate(dim, threshold, recall, lists)
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    nodes, own = np.unique(table.column("node").to_numpy(), return_inverse=True)
    # a vector's projections are cheaper to make again than to send
    u = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
    p = u @ directions_cached(dim, lists)
    qs, ts = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    links, up = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    src, dst = [], []
    if len(qs) and len(ts):
        for qi, ti in _pairs(p[qs], u[qs], p[ts], u[ts], threshold, reach, needed):
            qi, ti = qs[qi], ts[ti]
            ok = own[qi] < own[ti]  # targets at home in the cell are queries too; a pair counts where the smaller node asks from home
            qi, ti = qi[ok], ti[ok]
            np.add.at(links, own[qi], n[ti])
            np.add.at(links, own[ti], n[qi])
            while not np.array_equal(up, up[up]):
                up = up[up]
            roots = np.stack([up[own[qi]], up[own[ti]]])
            for x, y in np.unique(roots[:, roots[0] != roots[1]], axis=1).T.tolist():  # trees that these pairs may join
                first, second = x, y
                while up[x] != x:
                    x = int(up[x])
                while up[y] != y:
                    y = int(up[y])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    src.append(first)
                    dst.append(second)
    found = np.flatnonzero(links)
    start, end = nodes[np.array([*src, *found.tolist()], np.int64)], nodes[np.array(dst, np.int64)]
    return pa.table([pa.array(start), pa.concat_arrays([pa.array(end), pa.nulls(len(found), pa.int64())]), pa.array(np.concatenate([np.zeros(len(src), np.int64), links[found]]))], names=["src", "dst", "links"])


def _cells(vectors: DataFrame, cell: int, border: float, lists: int) -> DataFrame:
    """One row for each cell that a vector is sent to, with `home`: whether it is the vector's own."""
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("m"), *[F.percentile_approx(F.get("p", F.lit(j)), 0.5, 1000).alias(f"c{j}") for j in range(CUTS)])
    cuts = F.array(*[F.col(f"c{j}") for j in range(CUTS)])
    depth = F.greatest(F.lit(0), F.least(F.lit(CUTS), F.ceil(F.log2(F.col("m") / F.lit(float(cell)))))).cast("int")
    sized = vectors.join(sizes.select("label", "dim", depth.alias("depth"), cuts.alias("cuts")), ["label", "dim"])
    near = border / F.sqrt("dim")
    first = F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("home")))

    def branch(paths, j):
        own = (F.get("p", j) >= F.get("cuts", j)).cast("int")
        close = F.abs(F.get("p", j) - F.get("cuts", j)) <= near
        go = lambda side, home: lambda s: F.struct((s["cell"] * 2 + side).alias("cell"), (s["home"] & F.lit(home)).alias("home"))
        return F.when(close, F.concat(F.transform(paths, go(own, True)), F.transform(paths, go(1 - own, False)))).otherwise(F.transform(paths, go(own, True)))

    paths = F.aggregate(F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>")), first, branch)
    return sized.select("label", "dim", "node", "n", "unit", F.explode(paths).alias("at")).select("label", "dim", "node", "n", "unit", "at.cell", "at.home")


def linked(vectors: DataFrame, threshold: float, recall: float, lists: int, cell: int) -> DataFrame:
    """src, dst: a spanning forest of links between nodes; src, null, links: how many rows a node is linked with."""
    sent = _cells(vectors, cell, 3.5 * math.sqrt(2 - 2 * threshold), lists)
    place = ["label", "dim", "cell"]
    counts = sent.groupBy(*place).agg(F.count("*").alias("m"))
    tiles = F.ceil(F.col("m") / F.lit(float(2 * cell))).cast("int")
    tiled = sent.join(counts.select(*place, tiles.alias("tiles")), place).withColumn("tile", F.pmod(F.hash("node"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    asks = tiled.where("home").withColumn("other", other).select(*place, F.col("tile").alias("q"), F.col("other").alias("t"), F.lit(0).alias("role"), "node", "n", "unit")
    told = tiled.withColumn("other", other).select(*place, F.col("other").alias("q"), F.col("tile").alias("t"), F.lit(1).alias("role"), "node", "n", "unit")
    compare = partial(_compare, threshold=threshold, recall=recall, lists=lists)
    return asks.unionAll(told).groupBy(*place, "q", "t").applyInArrow(lambda key, table: compare(key, table), "src long, dst long, links long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, recall: float = 0.999, lists: int = LISTS, cell: int = CELL) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept for each row of embeddings (vec_id, embedding, label)."""
    runtime.ship(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    # equal vectors of a label are one node; the key is the vector's numbers
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull() & F.col("label").isNotNull(), F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.coalesce((x + F.lit(0.0)).cast("string"), F.lit("null")))), 256)))
    distinct = rows.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    made = distinct.withColumn("node", F.monotonically_increasing_id())  # written at once, so they stay
    vectors = runtime.save(made.mapInArrow(partial(_prepare, lists=lists), "node long, rep long, label string, key string, n long, dim int, unit binary, p array<double>"), "vectors")
    found = runtime.save(linked(vectors, threshold, recall, lists, cell), "vector-links")
    classes = components(found.where("dst is not null").select("src", "dst"))
    links = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links"))
    own = vectors.select("node", "rep", "n", "label", "key")
    able = own.join(links, F.col("node") == F.col("src"), "left").join(classes.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    able = able.select("rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("class"), "label", "key")
    least = able.groupBy("class").agg(F.min("rep").alias("component"))
    info = able.join(least, "class").select("label", "key", "n_links", "component")
    out = rows.select("vec_id", "label", "key").join(info.withColumn("able", F.lit(True)), ["label", "key"], "left")
    component = F.when(F.col("able"), F.col("component")).otherwise(F.col("vec_id"))
    kept = F.when(F.col("vec_id").isNull(), component.isNull()).otherwise(F.col("vec_id") == component)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
