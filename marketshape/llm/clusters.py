"""Parallel pivot correlation clustering of records described by a few numbers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.matrix import components
from ..session import BROADCAST_ROWS, bounded, cut, finite


def sound_windows(h0: DataFrame, graph: DataFrame) -> DataFrame:
    """window_id and the four fields of every window that has them all, in possible values.

    Repeated rows count once. Impossible are: nulls, NaN, infinities, a persistence
    outside (0, 2] (distances are at most 2) or a mean above its maximum, a spectral gap
    outside [0, 2] (the normalised Laplacian's range), a density outside [0, 1].
    """
    a = h0.where("window_id is not null").select("window_id", finite("max_persistence").alias("max_persistence"), finite("mean_persistence").alias("mean_persistence")).groupBy("window_id").agg(F.max("max_persistence").alias("max_persistence"), F.max("mean_persistence").alias("mean_persistence"))
    b = graph.where("window_id is not null").select("window_id", finite("spectral_gap").alias("spectral_gap"), finite("density").alias("density")).groupBy("window_id").agg(F.max("spectral_gap").alias("spectral_gap"), F.max("density").alias("density"))
    return a.join(b, "window_id").where("max_persistence > 0 and max_persistence <= 2 and mean_persistence > 0 and mean_persistence <= max_persistence and spectral_gap between 0 and 2 and density between 0 and 1")


def _squares(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x + y, [(a - b) * (a - b) for a, b in pairs])


def _spread(d: DataFrame, dims: int, reach: int) -> DataFrame:
    """Every row once for each cell within ``reach`` cells of its own in every direction, with that cell's text."""
    for i in range(dims):
        d = d.withColumn(f"k{i}", F.explode(F.sequence(F.col(f"k{i}") - reach, F.col(f"k{i}") + reach)))
    return d.withColumn("cell", F.concat_ws(",", *(F.col(f"k{i}") for i in range(dims))))


def _map_of(pivots: DataFrame, dims: int, reach: int = 1) -> DataFrame:
    """(cell, pivots): for every cell the pivots in it and around it; they lie apart, so they are few however many records there are.

    A table, to be joined: a pivot stands in it once for each of (2 reach + 1)^dims cells,
    which a file shrinks away but the memory of a broadcast doesn't. So it is broadcast
    only if these are at most BROADCAST_ROWS, whatever its file's size.
    """
    one = F.struct("pivot", F.array(*(F.col(f"z{i}") for i in range(dims))).alias("z"))
    most = BROADCAST_ROWS // (2 * reach + 1) ** dims
    few = pivots.limit(most + 1).count() <= most
    m = cut(_spread(pivots, dims, reach).groupBy("cell").agg(F.collect_list(one).alias("pivots")))
    return F.broadcast(m) if few else m.hint("merge")


def _distances(dims: int) -> Column:
    """Array of (d, pivot) of the row's pivots; null where none is around."""
    return F.transform("pivots", lambda p: F.struct(F.sqrt(_squares([(F.col(f"z{i}"), p["z"][i]) for i in range(dims)])).alias("d"), p["pivot"].alias("pivot")))


def pivot_rounds(points: DataFrame, dims: int, radius: float) -> DataFrame:
    """(pivot, z0, z1, ...): the pivots of correlation clustering in parallel rounds.

    ``points``: row, z0, z1, ..., k0, k1, ... (their cells of side ``radius``), cell.
    Two records are similar if they lie within ``radius``. In every round the record of
    the lowest hash in each cell is its candidate; candidates without a similar
    candidate of a lower hash become pivots, all at once and for good; every record
    similar to a pivot is absorbed, and the next round works on the rest. It ends when
    none is left, so every record is similar to a pivot, and no two pivots of a round
    are similar. A round is one partial aggregation and one join with the table of
    pivots by cell (a row per cell, so a hot cell doesn't multiply); what is left
    shrinks by at least a pivot a round, in practice geometrically.
    """
    zs, ks = [f"z{i}" for i in range(dims)], [f"k{i}" for i in range(dims)]
    left, found = points, None
    while not left.isEmpty():
        lowest = F.min(F.struct(F.xxhash64("row").alias("h"), "row", *zs, *ks)).alias("m")
        candidates = cut(left.groupBy("cell").agg(lowest).select("cell", "m.*"))
        lower = _spread(candidates.drop("cell"), dims, 1).select("cell", "h", "row", *zs)
        other = candidates.select("cell", F.col("h").alias("h2"), F.col("row").alias("row2"), *(F.col(z).alias(f"{z}_2") for z in zs))
        beaten = lower.join(bounded(other), "cell").where((F.struct("h2", "row2") < F.struct("h", "row")) & (_squares([(F.col(z), F.col(f"{z}_2")) for z in zs]) <= radius * radius)).select("row").distinct()
        pivots = cut(candidates.join(beaten, "row", "left_anti").select(F.col("row").alias("pivot"), *zs, *ks))
        found = pivots if found is None else found.unionByName(pivots)
        near = left.join(_map_of(pivots, dims), "cell", "left")
        left = cut(near.where(F.coalesce(F.array_min(_distances(dims))["d"] > radius, F.lit(True))).drop("pivots"))
    return cut(found) if found is not None else points.select(F.col("row").alias("pivot"), *zs, *ks)


def _crowded(sizes: DataFrame, radius: float, box: list[float], least: int) -> float:
    """The least size of a pivot's group that chance doesn't explain.

    Records in no crowded group are background. Spread evenly over the box of all
    records, they put so many within a radius; a group is crowded beyond that number by
    five of its standard deviations (its root), and with ``least`` records at least.
    Repeated from all records as background down to the fixed point: nothing depends on
    the number of records as such.
    """
    n = len(box)
    share = min(1.0, math.pi ** (n / 2) / math.gamma(n / 2 + 1) * radius**n / math.prod(max(b, radius) for b in box))
    total, bound = float(sizes.agg(F.sum("size")).first()[0] or 0), float("inf")
    background = total * share
    while True:
        new = max(float(least), background + 5 * math.sqrt(background))
        if new >= bound:
            return bound
        bound = new
        background = float(sizes.where(F.col("size") < bound).agg(F.sum("size")).first()[0] or 0) * share


def scaled_points(records: DataFrame, key: str, fields: list[str], radius: float) -> tuple[DataFrame, list[float]]:
    """The records in spreads (5 % to 95 % quantiles over 3.29) with their cells and a row number, and the extent of each field."""
    r = records.where(" and ".join(f"{f} is not null" for f in fields)).select(key, *fields)
    q = r.agg(*(F.percentile_approx(f, F.array(*map(F.lit, (0.01, 0.05, 0.95, 0.99))), 2000).alias(f) for f in fields)).first()
    spread = [max((q[f][2] - q[f][1]) / 3.29, 1e-9) if q[f] else 1.0 for f in fields]
    box = [(q[f][3] - q[f][0]) / s if q[f] else 1.0 for f, s in zip(fields, spread, strict=True)]
    z = r.select(key, *fields, F.monotonically_increasing_id().alias("row"), *((F.col(f) / F.lit(s)).alias(f"z{i}") for i, (f, s) in enumerate(zip(fields, spread, strict=True))))
    z = z.withColumns({f"k{i}": F.floor(F.col(f"z{i}") / radius).cast("int") for i in range(len(fields))})
    return cut(z.withColumn("cell", F.concat_ws(",", *(F.col(f"k{i}") for i in range(len(fields)))))), box


def pivot_clusters(records: DataFrame, key: str, fields: list[str], radius: float = 0.15) -> DataFrame:
    """(key, pivot_cluster, distance): correlation clustering by parallel pivots, every record in one cluster.

    ``pivot_rounds``, then every record is reassigned to its closest pivot, the medoid of
    each cluster (the member closest to its mean) is recomputed, and pivot_cluster is
    the medoid's key. Members lie within ``radius`` spreads of their pivot, so any two
    within twice that: mutually similar. Records with a null field are left out;
    repeated keys stay rows; no records give no rows.
    """
    z, _ = scaled_points(records, key, fields, radius)
    dims = len(fields)
    own = cut(z.join(_map_of(pivot_rounds(z, dims, radius), dims), "cell").withColumn("_p", F.array_min(_distances(dims))).select(key, "row", *(f"z{i}" for i in range(dims)), F.col("_p.pivot").alias("pivot"), F.col("_p.d").alias("distance")))
    return own.join(_medoids(own, "pivot", key, dims), "pivot").select(key, F.col("medoid").alias("pivot_cluster"), "distance")


def _medoids(own: DataFrame, by: str, key: str, dims: int) -> DataFrame:
    """(by, medoid): the key of the member closest to the mean of all members, the lowest if several are."""
    mean = bounded(cut(own.groupBy(by).agg(*(F.avg(f"z{i}").alias(f"c{i}") for i in range(dims)))))
    off = _squares([(F.col(f"z{i}"), F.col(f"c{i}")) for i in range(dims)])
    return bounded(cut(own.join(mean, by).groupBy(by).agg(F.min_by(key, F.struct(off, key)).alias("medoid"))))


def cluster_windows(records: DataFrame, key: str, fields: list[str], radius: float = 0.15, least: int = 5, bridge: float = 0.05) -> DataFrame:
    """(key, cluster_id, <fields>): clusters of similar records with gaps between them, null outside any.

    1. Parallel pivot correlation clustering (``pivot_rounds``) gives pivots within
       ``radius`` of every record; records are reassigned to the closest one.
    2. Clusters differ in spread, and a pivot reaches only ``radius``, so a wide cluster
       has many pivots. A second stage, not part of that method, joins them: two pivots
       whose groups are crowded (``_crowded``) belong together if no gap parts them,
       that is if records of the one are similar to the other's pivot too, at least
       ``bridge`` of the smaller group and two. Joined pivots are one cluster, through
       any chain of them.
    3. Records of other groups go to the closest crowded pivot within 1.5 radii; those
       without one belong to no cluster. Medoids are recomputed over all members;
       cluster_id is the medoid's key.

    No pairs of records are made; the pivots are as many as the space has room for, not
    as there are records. Records with a null field are left out; repeated keys stay
    rows; equal records cost one pivot; no records give no rows.
    """
    z, box = scaled_points(records, key, fields, radius)
    dims = len(fields)
    zs = [f"z{i}" for i in range(dims)]
    pivots = pivot_rounds(z, dims, radius)
    near = cut(z.join(_map_of(pivots, dims), "cell").select("row", F.array_sort(F.filter(_distances(dims), lambda p: p["d"] <= radius)).alias("near")))
    own = F.col("near")[0]["pivot"]
    sizes = cut(near.groupBy(own.alias("pivot")).agg(F.count(F.lit(1)).alias("size")))
    crowded = cut(sizes.where(F.col("size") >= _crowded(sizes, radius, box, least)))
    shared = near.where(F.size("near") > 1).select(own.alias("a"), F.explode(F.transform(F.slice("near", F.lit(2), F.size("near")), lambda p: p["pivot"])).alias("b"))
    shared = shared.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    for x in "ab":
        shared = shared.join(bounded(crowded).select(F.col("pivot").alias(x), F.col("size").alias(f"n{x}")), x)
    links = shared.where(F.col("n") >= F.greatest(F.lit(2.0), bridge * F.least("na", "nb")))
    name = lambda c: F.format_string("%020d", c)
    nodes = crowded.select(F.lit(0).cast("bigint").alias("window_id"), name("pivot").alias("node"))
    parts = components(links.select(F.lit(0).cast("bigint").alias("window_id"), name("a").alias("i"), name("b").alias("j")), nodes)
    label = cut(parts.select(F.col("node").cast("bigint").alias("pivot"), "component"))
    of = _map_of(cut(pivots.join(bounded(label), "pivot").drop("pivot").withColumnRenamed("component", "pivot")), dims, 2)
    out = cut(z.join(of, "cell", "left").withColumn("_p", F.array_min(_distances(dims))).select(key, *fields, *zs, F.when(F.col("_p.d") <= 1.5 * radius, F.col("_p.pivot")).alias("component")))
    medoid = _medoids(out.where("component is not null"), "component", key, dims)
    return out.join(medoid, "component", "left").select(key, F.col("medoid").alias("cluster_id"), *fields)


def describe_clusters(members: DataFrame, key: str, fields: list[str], typical: int = 3) -> DataFrame:
    """(cluster_id, size, mean_<field>..., typical_rank, <key>): each cluster's size, means and most typical members.

    Typical are the members closest to the cluster's means, in the clusters' own spreads.
    The best of every slice of a cluster are found first, so no task holds a large one.
    """
    m = members.where("cluster_id is not null")
    about = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *(F.avg(f).alias(f"mean_{f}") for f in fields), *(F.greatest(F.coalesce(F.stddev_pop(f), F.lit(0.0)), F.lit(1e-9)).alias(f"sd_{f}") for f in fields))
    d = m.join(cut(about), "cluster_id").withColumn("off", _squares([(F.col(f) / F.col(f"sd_{f}"), F.col(f"mean_{f}") / F.col(f"sd_{f}")) for f in fields]))
    d = d.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(64)))
    for part in (["cluster_id", "slice"], ["cluster_id"]):
        d = d.withColumn("typical_rank", F.row_number().over(W.partitionBy(*part).orderBy("off", key))).where(F.col("typical_rank") <= typical)
    return d.select("cluster_id", "size", *(f"mean_{f}" for f in fields), "typical_rank", key)
