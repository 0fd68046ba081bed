"""Correlation, graph and diffusion operators on edge lists (window_id, i, j, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut, spread

#: The numbers in a block of windows, and the most correlations in a group of blocks.
BLOCK, CELLS, INF = 1 << 20, 1_000_000, float("inf")


def pairs_of(panel: DataFrame, value: str = "ret", same: bool = False) -> DataFrame:
    """(seq, i, j, x, y) of every two assets i < j (i <= j if ``same``) of a period: one equi-join on it."""
    p = spread(panel.where(F.col(value).isNotNull()).select("seq", "asset", F.col(value).alias("v")), "seq")
    a, b = (p.select("seq", F.col("asset").alias(k), F.col("v").alias(v)) for k, v in (("i", "x"), ("j", "y")))
    return a.join(b, "seq").where("i <= j" if same else "i < j")


def _correlations(v: np.ndarray, known: np.ndarray, w: np.ndarray, known_w: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows of ``v``, rows of ``w``, periods, values by row, row and period) of the correlations over the last ``window`` periods known of both, infinite if one is constant there.

    Rows known in the same periods go together; in memory are the windows of some periods at a time.
    """
    (a, of_a), (b, of_b) = (np.unique(k, axis=0, return_inverse=True) for k in (known, known_w))
    for x in range(len(a)):
        for y in range(len(b)):
            both = np.flatnonzero(a[x] & b[y])
            ends = both[window - 1 :]
            if not len(ends):
                continue
            rows, others = np.flatnonzero(of_a.ravel() == x), np.flatnonzero(of_b.ravel() == y)
            out = np.empty((len(rows), len(others), len(ends)))
            step = max(1, BLOCK // (window * (len(rows) + len(others))))
            for k in range(0, len(ends), step):
                p, q = (_standard(m[np.ix_(r, both[k : k + step + window - 1])], window) for m, r in ((v, rows), (w, others)))
                scale = p[1].T[:, None, :] * q[1].T[None, :, :]
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    out[:, :, k : k + step] = np.where(scale == 0, INF, (p[0] @ q[0].transpose(0, 2, 1)).transpose(1, 2, 0) / window / scale)
            yield rows, others, ends, out


def _standard(v: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows less their means, their standard deviations) by period and row; a constant's is exactly 0."""
    x = np.lib.stride_tricks.sliding_window_view(v, window, axis=1).transpose(1, 0, 2)
    most = x.max(axis=2, keepdims=True)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.where(np.isfinite(most) & (most == x.min(axis=2, keepdims=True)), 0.0, x - x.mean(axis=2, keepdims=True))
        return x, np.sqrt((x * x).mean(axis=2))


def rolling_correlation(panel: DataFrame, window: int = 20) -> DataFrame:
    """(window_id, i, j, c): correlations over the last ``window`` periods that both have, for every period with so many; constants give null.

    ``panel``: one row per asset and period. Every two blocks of assets are a group, of a
    size by the number of periods, so that its result is at most ``CELLS`` rows: their
    windows are standardised once and multiplied, not once for every pair.
    """
    types = dict(panel.dtypes)
    p = cut(panel.where("ret is not null and asset is not null and seq is not null").select("seq", "asset", F.col("ret").cast("double").alias("v")))
    size = p.agg(F.countDistinct("asset").alias("assets"), F.countDistinct("seq").alias("periods")).first()
    blocks = -(-size["assets"] // max(1, min(64, int((CELLS / max(1, size["periods"])) ** 0.5)))) or 1
    own, other = F.pmod(F.xxhash64("asset"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    p = p.withColumn("own", own).withColumn("other", other).select("seq", "asset", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def f(key: tuple, t: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        at, names = pd.factorize(t["asset"].to_pandas(), sort=True)
        when, periods = pd.factorize(t["seq"].to_pandas(), sort=True)
        v, known = np.zeros((len(names), len(periods))), np.zeros((len(names), len(periods)), bool)
        v[at, when], known[at, when] = t["v"].to_numpy(), True
        in_first = np.zeros(len(names), bool)
        in_first[at[t["own"].to_numpy() == first]] = True
        here = [np.flatnonzero(in_first), np.flatnonzero(in_first if first == second else ~in_first)]
        names, periods, parts = pa.array(names, t["asset"].type), pa.array(periods, t["seq"].type), []
        for rows, others, ends, c in _correlations(v[here[0]], known[here[0]], v[here[1]], known[here[1]], window):
            x, y = (k.ravel() for k in np.meshgrid(here[0][rows], here[1][others], indexing="ij"))
            c = c.reshape(len(x), len(ends))
            if first == second:
                x, y, c = x[keep := x < y], y[keep], c[keep]
            i, j = (np.repeat(k(x, y), len(ends)) for k in (np.minimum, np.maximum))
            parts.append(pa.table([periods.take(pa.array(np.tile(ends, len(x)))), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(c.ravel(), mask=np.isinf(c.ravel()))], names=["window_id", "i", "j", "c"]))
        return pa.concat_tables(parts) if parts else pa.table({"window_id": periods[:0], "i": names[:0], "j": names[:0], "c": pa.array([], pa.float64())})

    return spread(p, "a", "b").groupBy("a", "b").applyInArrow(f, f"window_id {types['seq']}, i {types['asset']}, j {types['asset']}, c double")


def correlation_matrix(panel: DataFrame, value: str = "ret") -> DataFrame:
    """(i, j, c), i <= j, over all common periods."""
    c = F.try_divide(F.covar_pop("x", "y"), F.when(F.stddev_pop("x") * F.stddev_pop("y") > 0, F.stddev_pop("x") * F.stddev_pop("y")))
    return pairs_of(panel, value, same=True).groupBy("i", "j").agg(c.alias("c"))


def threshold_edges(corr: DataFrame, least: float = 0.3) -> DataFrame:
    """Edges with a weight |c| of at least ``least`` (compared at nine decimals)."""
    return corr.select("window_id", "i", "j", F.abs("c").alias("w")).where(F.round("w", 9) >= least)


def nodes_of(corr: DataFrame) -> DataFrame:
    return corr.select("window_id", F.explode(F.array("i", "j")).alias("node")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("window_id", F.col("i").alias("a"), F.col("j").alias("b"), "w").unionByName(edges.select("window_id", F.col("j").alias("a"), F.col("i").alias("b"), "w"))


def laplacian(edges: DataFrame, nodes: DataFrame, normalized: bool = False) -> DataFrame:
    """(window_id, i, j, value): D - A, or scaled by the degrees' roots; nodes without edges have zeros."""
    degree = both_ways(edges).groupBy("window_id", F.col("a").alias("node")).agg(F.sum("w").alias("deg"))
    deg = nodes.join(degree, ["window_id", "node"], "left").withColumn("deg", F.coalesce("deg", F.lit(0.0)))
    diagonal = deg.select("window_id", F.col("node").alias("i"), F.col("node").alias("j"), (F.when(F.col("deg") > 0, 1.0).otherwise(0.0) if normalized else F.col("deg")).alias("value"))
    off = both_ways(edges).withColumnsRenamed({"a": "i", "b": "j"})
    if normalized:
        for k in "ij":
            off = off.join(deg.select("window_id", F.col("node").alias(k), F.col("deg").alias(f"d{k}")), ["window_id", k])
        off = off.select("window_id", "i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))
    else:
        off = off.select("window_id", "i", "j", (-F.col("w")).alias("value"))
    return diagonal.unionByName(off)


def _joined_up(g: pd.DataFrame) -> pd.DataFrame:
    root = {n: n for n in g["i"]} | {n: n for n in g["j"]}

    def find(n: str) -> str:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in zip(g["i"], g["j"], strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pd.DataFrame({"window_id": g["window_id"].iloc[0], "node": list(root), "component": [find(n) for n in root]})


def components(edges: DataFrame, nodes: DataFrame, group_rows: int = 200_000) -> DataFrame:
    """(window_id, node, component): the least node name of each connected part.

    If no window has more than ``group_rows`` nodes and edges, each is one group of
    bounded size, joined up in a single shuffle. Else every node's label falls to the
    least one among its neighbours and then to its label's own label, so labels travel
    twice as far every round, until none changes; both ways give the same parts.
    """
    key = dict(nodes.dtypes)["window_id"]
    pairs = edges.select("window_id", "i", "j").unionByName(nodes.select("window_id", F.col("node").alias("i"), F.col("node").alias("j")))
    if (pairs.groupBy("window_id").count().agg(F.max("count")).first()[0] or 0) <= group_rows:
        return pairs.groupBy("window_id").applyInPandas(_joined_up, f"window_id {key}, node string, component string")
    both = cut(both_ways(edges.withColumn("w", F.lit(1.0))).select("window_id", "a", "b"))
    label = cut(nodes.select("window_id", "node", F.col("node").alias("component")))
    while True:
        heard = both.join(label.select("window_id", F.col("node").alias("b"), F.col("component").alias("c")), ["window_id", "b"]).groupBy("window_id", F.col("a").alias("node")).agg(F.min("c").alias("c"))
        near = cut(label.join(heard, ["window_id", "node"], "left").select("window_id", "node", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component")))
        jump = near.select("window_id", F.col("node").alias("component"), F.col("component").alias("to"))
        new = cut(near.join(jump, ["window_id", "component"]).select("window_id", "node", F.col("to").alias("component"), (F.col("to") < F.col("was")).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def _triangles_of(g: pd.DataFrame) -> pd.DataFrame:
    """Every edge leads to its end of more edges, so a node has few edges out; every two of a node's are looked up as an edge."""
    at, names = pd.factorize(pd.concat([g["i"], g["j"]]))
    degree, n = np.bincount(at), len(names)
    rank = np.empty(n, np.int64)
    rank[by_degree := np.argsort(degree, kind="stable")] = np.arange(n)
    i, j = rank[at[: len(g)]], rank[at[len(g) :]]
    edge = np.sort(np.minimum(i, j) * n + np.maximum(i, j))
    start, end, tri = edge // n, edge % n, np.zeros(n, np.int64)
    last = np.searchsorted(start, start, side="right")  # the edges of the same start after this one
    more = last - np.arange(len(edge)) - 1
    before = np.concatenate([[0], np.cumsum(more)])
    for k in range(0, int(before[-1]), BLOCK):
        pair = np.arange(k, min(k + BLOCK, int(before[-1])))
        first = np.searchsorted(before, pair, side="right") - 1
        b, c = end[first], end[first + 1 + pair - before[first]]
        code = b * n + c
        there = edge[np.minimum(np.searchsorted(edge, code), len(edge) - 1)] == code
        for x in (start[first], b, c):
            tri += np.bincount(x[there], minlength=n)
    return pd.DataFrame({"window_id": g["window_id"].iloc[0], "node": names[by_degree], "tri": tri})


def triangles(edges: DataFrame, group_rows: int = 200_000) -> DataFrame:
    """(window_id, node, tri): the triangles at every node that has any, or at least an edge.

    If no window has more than ``group_rows`` edges, each is one group of bounded size;
    else two edges of a node are joined with the third. Both ways give the same counts.
    """
    e = edges.select("window_id", "i", "j")
    if (e.groupBy("window_id").count().agg(F.max("count")).first()[0] or 0) <= group_rows:
        return spread(e, "window_id").groupBy("window_id").applyInPandas(_triangles_of, f"window_id {dict(e.dtypes)['window_id']}, node string, tri bigint")
    tri = e.join(e.select("window_id", F.col("i").alias("j"), F.col("j").alias("k")), ["window_id", "j"]).join(e.select("window_id", "i", F.col("j").alias("k")), ["window_id", "i", "k"])
    return tri.select("window_id", F.explode(F.array("i", "j", "k")).alias("node")).groupBy("window_id", "node").agg(F.count(F.lit(1)).alias("tri"))


def graph_metrics(edges: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per window: n_nodes, n_edges, density, avg_clustering, n_components, avg_degree_centrality."""
    both = both_ways(edges)
    degree = both.groupBy("window_id", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    n = nodes.join(degree, ["window_id", "node"], "left").join(triangles(edges), ["window_id", "node"], "left").fillna(0, ["deg", "tri"])
    local = F.when(F.col("deg") > 1, 2.0 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0)
    count = F.count(F.lit(1))
    out = n.groupBy("window_id").agg(count.alias("n_nodes"), (F.sum("deg") / 2).cast("bigint").alias("n_edges"), F.coalesce(F.try_divide(F.sum("deg").cast("double"), count * (count - 1)), F.lit(0.0)).alias("density"), F.avg(local).alias("avg_clustering"), F.coalesce(F.try_divide(F.avg("deg"), count - 1), F.lit(0.0)).alias("avg_degree_centrality"))
    return out.join(parts.groupBy("window_id").agg(F.countDistinct("component").alias("n_components")), "window_id")


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(window_id, node, x): the matrix (window_id, i, j, value) times the vector (window_id, node, x)."""
    return matrix.join(vector.select("window_id", F.col("node").alias("j"), "x"), ["window_id", "j"]).groupBy("window_id", F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def random_walk(edges: DataFrame, nodes: DataFrame, steps: int = 10, start: DataFrame | None = None, trajectory: bool = False) -> DataFrame:
    """(window_id, node, step, x): the walk's distribution after ``steps``, or after each; nodes without edges lose their mass.

    The start is uniform, or ``start`` (window_id, node, x) made to sum to 1.
    """
    both = both_ways(edges)
    out_of = both.groupBy("window_id", "a").agg(F.sum("w").alias("out"))
    move = cut(both.join(out_of, ["window_id", "a"]).select("window_id", F.col("b").alias("i"), F.col("a").alias("j"), (F.col("w") / F.col("out")).alias("value")))
    whole = W.partitionBy("window_id")
    state = nodes.withColumn("x", 1.0 / F.count(F.lit(1)).over(whole)) if start is None else start.withColumn("x", F.col("x") / F.sum("x").over(whole))
    base = nodes.select("window_id", "node")
    states = [state.withColumn("step", F.lit(0))]
    for s in range(1, steps + 1):
        state = base.join(matvec(move, state), ["window_id", "node"], "left").fillna(0.0, ["x"])
        state = cut(state) if s % 4 == 0 else state
        states.append(state.withColumn("step", F.lit(s)))
    out = states[-1]
    if trajectory:
        out = states[0]
        for s in states[1:]:
            out = out.unionByName(s)
    return out.select("window_id", "node", "step", "x")


def heat_taylor(lap: DataFrame, start: DataFrame, t: float = 1.0, terms: int = 40) -> DataFrame:
    """exp(-t L) x by its power series of matrix-vector products, for small spectra (N times the largest weight below 15 or so)."""
    term = total = start.select("window_id", "node", "x")
    for k in range(1, terms + 1):
        term = matvec(lap, term).withColumn("x", F.col("x") * (-t / k))
        if k % 5 == 0:
            term = cut(term)
        total = total.unionByName(term)
        if k % 10 == 0:
            total = cut(total.groupBy("window_id", "node").agg(F.sum("x").alias("x")))
    return total.groupBy("window_id", "node").agg(F.sum("x").alias("x"))


def _dense(g: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(g["i"]) | set(g["j"]))
    at = {k: n for n, k in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[g["i"].map(at), g["j"].map(at)] = g["value"]
    return names, m


def spectrum(lap: DataFrame) -> DataFrame:
    """(window_id, k, eigenvalue), ascending; a window's matrix is one small group."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        v = np.linalg.eigvalsh(_dense(g)[1])
        return pd.DataFrame({"window_id": g["window_id"].iloc[0], "k": np.arange(len(v)), "eigenvalue": v})

    return lap.groupBy("window_id").applyInPandas(f, "window_id bigint, k int, eigenvalue double")


def spectral_summary(lap: DataFrame) -> DataFrame:
    """spectral_gap (second eigenvalue less first, null for a single node) and max_eigenvalue per window."""
    s = spectrum(lap)
    return s.groupBy("window_id").agg((F.max(F.when(F.col("k") == 1, F.col("eigenvalue"))) - F.max(F.when(F.col("k") == 0, F.col("eigenvalue")))).alias("spectral_gap"), F.max("eigenvalue").alias("max_eigenvalue"))


def heat_kernel(lap: DataFrame, t: float = 1.0) -> DataFrame:
    """(window_id, i, j, value): the full matrix exp(-t L) of every window, by its eigenvectors."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        names, m = _dense(g)
        lam, v = np.linalg.eigh(m)
        h = (v * np.exp(-t * lam)) @ v.T
        i, j = np.meshgrid(range(len(names)), range(len(names)), indexing="ij")
        return pd.DataFrame({"window_id": g["window_id"].iloc[0], "i": [names[k] for k in i.ravel()], "j": [names[k] for k in j.ravel()], "value": h.ravel()})

    return lap.groupBy("window_id").applyInPandas(f, "window_id bigint, i string, j string, value double")


def heat_diffusion(lap: DataFrame, nodes: DataFrame, start: DataFrame | None = None, t: float = 1.0) -> DataFrame:
    """(window_id, node, x) after heat has spread for ``t`` from ``start``, by default uniform."""
    state = nodes.withColumn("x", 1.0 / F.count(F.lit(1)).over(W.partitionBy("window_id"))) if start is None else start
    return matvec(heat_kernel(lap, t), state)


def sinks_and_sources(start: DataFrame, spread: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(window_id, node, change, kind): sink above the threshold, source below its negative, else neutral."""
    d = start.select("window_id", "node", F.col("x").alias("x0")).join(spread, ["window_id", "node"])
    change = F.col("x") - F.col("x0")
    return d.select("window_id", "node", change.alias("change"), F.when(F.round(change, 9) > threshold, "sink").when(F.round(change, 9) < -threshold, "source").otherwise("neutral").alias("kind"))
