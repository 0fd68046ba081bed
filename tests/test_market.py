"""Rules, graphs, topology, backtests and splits against literal and brute-force values."""

import math
import random
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketshape.functions import rules as R
from marketshape.operators import matrix as M
from marketshape.operators import strategy as X
from marketshape.operators import topology as T

INF = float("inf")


def one(spark, expr, **values):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return d.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("s,ps,regime,c,want", [(0.5, 0.8, "stable", 1.0, 1.5), (0.5, 0.3, "stressed", 1.0, 0.24), (-0.5, 0.6, "stable", 0.8, -1.32), (0.5, 0.8, "stable", 0.3, 0.585)])
def test_position_size(spark, s, ps, regime, c, want):
    assert one(spark, R.position_size("s", "ps", "r", "c"), s=s, ps=ps, r=regime, c=c) == pytest.approx(want)


def test_scores_and_stops(spark):
    assert one(spark, R.stability_score("n", "m", "k", "l"), n=2, m=0.7, k=1, l=0.2) == pytest.approx(0.806667, abs=1e-6)
    assert one(spark, R.stability_score("n", "m", "k", "l"), n=5, m=0.3, k=1, l=0.4) == pytest.approx(0.093333, abs=1e-6)
    for side, want in ((1.0, (97.4, 105.4)), (-1.0, (102.6, 94.6)), (0.0, (102.6, 94.6))):
        got = [one(spark, e, p=100.0, q=side, v=2.0, s=0.7) for e in R.stop_and_target("p", "q", "v", "s")]
        assert got == pytest.approx(want)
    assert one(spark, R.heat_adjusted("p", "h"), p=1.0, h=0.1) == pytest.approx(0.5)
    assert one(spark, R.heat_adjusted("p", "h"), p=1.0, h=0.25) == pytest.approx(0.5)


@pytest.mark.parametrize("w,b,s,want", [(0.6, 2.0, 0.8, 0.08), (0.4, 1.0, 0.8, 0.0), (0.6, 2.0, 0.2, 0.02), (0.6, 0.0, 0.8, 0.0)])
def test_kelly(spark, w, b, s, want):
    assert one(spark, R.kelly("w", "b", "s"), w=w, b=b, s=s) == pytest.approx(want)


@pytest.mark.parametrize("n,m,want", [(1, 0.02, ("stable", 1.0)), (5, 0.25, ("stressed", 1.0)), (3, 0.1, ("transitioning", 1.0)), (2, 0.1, ("stable", 0.5))])
def test_rule_regime(spark, n, m, want):
    r = R.rule_regime("n", "m")
    assert one(spark, r["regime"], n=n, m=m) == want[0] and one(spark, r["confidence"], n=n, m=m) == pytest.approx(want[1])


def test_gate_and_descriptions(spark):
    g = R.gate("p", "s", "r", leak="l")
    assert one(spark, g["final_signal"], p=0.7, s=0.3, r="Stable", l=0.2) == "LONG"
    assert one(spark, g["confidence_score"], p=0.7, s=0.3, r="Stable", l=0.2) == pytest.approx(0.52)
    assert one(spark, g["reason"], p=0.9, s=0.8, r="Fragmented", l=0.2) == "H1_instability_exceeded_threshold"
    assert one(spark, g["confidence_score"], p=0.9, s=0.8, r="Fragmented", l=0.2) == pytest.approx(0.2)
    assert one(spark, g["reason_details"], p=0.7, s=0.3, r="Stable", l=0.2)[:2] == ["static_threshold=0.500", "nn_proba=0.700"]
    assert one(spark, R.described_regime("n", "k", "m"), n=5, k=2, m=0.15) == "Fragmented with feedback loops"
    assert one(spark, R.hedge("s", "l", "r")["ratio"], s=0.125, l=0.125, r="Stable") == 0.062
    with pytest.raises(ValueError):
        R.instability_score({"max": "a"}, {"max": "b"}, by="median")


def edges(spark, *rows):
    return spark.createDataFrame([(0, *r) for r in rows], "window_id bigint, i string, j string, w double")


def test_laplacian_walk_and_heat(spark):
    e = edges(spark, ("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0))
    n = M.nodes_of(e.withColumnRenamed("w", "c"))
    lap = M.laplacian(e, n)
    assert {(r["i"], r["j"]): r["value"] for r in lap.collect()}[("a", "a")] == 2.0
    assert [r["eigenvalue"] for r in M.spectrum(M.laplacian(e, n, True)).orderBy("k").collect()] == pytest.approx([0, 1.5, 1.5], abs=1e-9)
    start = n.withColumn("x", (F.col("node") == "a").cast("double"))
    want = {"a": (1 + 2 * math.exp(-3)) / 3, "b": (1 - math.exp(-3)) / 3, "c": (1 - math.exp(-3)) / 3}
    for got in (M.heat_diffusion(lap, n, start), M.heat_taylor(lap, start, terms=20)):
        assert {r["node"]: r["x"] for r in got.collect()} == pytest.approx(want)
    assert M.random_walk(e, n, 3, trajectory=True).count() == 12
    kinds = {r["node"]: r["kind"] for r in M.sinks_and_sources(start, M.heat_diffusion(lap, n, start)).collect()}
    assert kinds == {"a": "source", "b": "sink", "c": "sink"}


def test_walk_reaches_degrees_and_metrics(spark):
    e = edges(spark, ("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0))
    n = M.nodes_of(e.withColumnRenamed("w", "c")).unionByName(spark.createDataFrame([(0, "z")], "window_id bigint, node string"))
    parts = [{tuple(r) for r in M.components(e, n, group_rows=k).select("window_id", "node", "component").collect()} for k in (0, 500)]
    assert parts[0] == parts[1] and len(parts[0]) == 5
    path = edges(spark, *((f"n{k * 7 % 41:02d}", f"n{(k + 1) * 7 % 41:02d}", 1.0) for k in range(40)))
    assert {r["component"] for r in M.components(path, M.nodes_of(path.withColumnRenamed("w", "c")), group_rows=0).collect()} == {"n00"}
    m = M.graph_metrics(e, n, M.components(e, n)).first()
    assert (m["n_nodes"], m["n_edges"], m["n_components"]) == (5, 5, 2) and m["density"] == 0.5
    got = {r["node"]: r["x"] for r in M.random_walk(e, n.where("node <> 'z'"), 16).collect()}
    assert got == pytest.approx({"a": 0.2, "b": 0.3, "c": 0.3, "d": 0.2}, abs=1e-2)


def test_persistence_of_squares_and_fixtures(spark):
    pts = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]], float)
    bars = T.diagrams(spark.createDataFrame(T.point_distances(pts)), 2).collect()
    h1 = [(b["birth"], b["death"]) for b in bars if b["dim"] == 1]
    assert len(h1) == 1 and h1[0] == pytest.approx((math.sqrt(2), 2.0))
    d = spark.createDataFrame([(0, "a", "b", 0.2), (0, "a", "c", 0.4), (0, "b", "c", 0.3)], "window_id bigint, i string, j string, d double")
    assert sorted(b["death"] for b in T.diagrams(d).collect()) == pytest.approx([0.2, 0.3, INF])


def test_octahedron_has_a_void():
    pts = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)
    t = T.point_distances(pts)
    bars = T.persistence(list(range(6)), {(int(i), int(j)): w for i, j, w in zip(t["i"], t["j"], t["d"], strict=True)}, 2)
    assert [b for b in bars if b[0] == 2] == [(2, pytest.approx(math.sqrt(2)), pytest.approx(2.0))]
    assert not [b for b in bars if b[0] == 1]


def test_diagram_features(spark):
    g = spark.createDataFrame([(0, 0, 0.0, x) for x in (0.1, 0.3, 0.5, INF)] + [(1, 0, 0.0, INF)], "window_id bigint, dim int, birth double, death double")
    f = {r["window_id"]: r for r in T.diagram_features(g, 0, g).collect()}
    assert f[0]["n"] == 3 and f[0]["persistence_entropy"] == pytest.approx(0.936888, abs=1e-6) and f[0]["std_persistence"] == pytest.approx(0.163299, abs=1e-6)
    assert f[1]["n"] == 0 and f[1]["total_persistence"] == 0
    assert T.landscape(g, 0, 3, 50).count() == 150 and T.image(g, 0, 10, 10).count() == 100
    assert T.landscape(g, 1).count() == 0


def test_adaptive_threshold(spark):
    v = [0.2, 0.25, 0.22, 0.23, 0.24, 0.21, 0.26, 0.23, 0.22, 0.25]
    s = spark.createDataFrame([("u", i, x) for i, x in enumerate(v)], "u string, seq bigint, score double")
    r = T.adaptive_threshold(s, ["u"]).orderBy("seq").collect()
    assert r[-1]["baseline_mean"] == pytest.approx(0.231) and r[-1]["threshold"] == pytest.approx(0.267277, abs=1e-6)
    assert not r[3]["adaptive"] and r[3]["threshold"] == 0.5


@pytest.mark.parametrize("every", [1, 5])
def test_backtest_equals_the_recursion(spark, every):
    g = random.Random(every)
    rows = [("s", f"a{a}", t, g.uniform(-1.5, 1.5), g.gauss(0, 0.02)) for a in range(3) for t in range(40)]
    got = X.backtest(spark.createDataFrame(rows, "strategy string, asset string, seq bigint, signal double, ret double"), every=every).orderBy("seq").collect()
    at = {(a, t): (s, r) for _, a, t, s, r in rows}
    v = cash = 100_000.0
    pos = dict.fromkeys(("a0", "a1", "a2"), 0.0)
    for t in range(40):
        if t:
            v *= 1 + sum(pos[a] * at[a, t][1] for a in pos)
        if t % every == 0:
            new = {a: max(-1.0, min(1.0, at[a, t][0])) for a in pos}
            cost = sum(abs(new[a] - pos[a]) for a in pos) * v * 0.0015
            cash -= cost
            v -= cost if t else 0
            pos = new
        assert got[t]["equity"] == pytest.approx(v) and got[t]["cash"] == pytest.approx(cash)


def test_splits(spark):
    s = X.walk_forward_splits(spark, 200, 120, 20).collect()
    assert [r["test_start"] for r in s] == [120, 140, 160, 180] and s[0]["purge_start"] == 119
    assert X.walk_forward_splits(spark, 100, 120, 20).count() == 0
    with pytest.raises(ValueError):
        X.walk_forward_splits(spark, 200, 120, 20, step=0)
    c = X.cpcv_splits(spark, 103).collect()
    assert len({r["split_id"] for r in c}) == 10 and sum(r["seq_end"] - r["seq_start"] for r in c if r["role"] == "test") == 10 * 103 * 2 / 5 + 4 * 3 - 10 * 3 * 2 / 5


def test_ridge_and_ensembles(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w, b = X.ridge(df, ["a", "b"], "y")
    z = x - x.mean(0)
    assert w == pytest.approx(np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())))
    v = spark.createDataFrame([(0, 0, 1.0, 0.5, 1.0), (0, 1, -0.5, 0.5, 3.0)], "t bigint, model_idx int, signal double, confidence double, weight double")
    r = X.ensemble(v, ["t"]).first()
    assert (r["weighted_avg"], r["majority"], r["max_confidence"]) == (-0.125, 0.0, 1.0)


@pytest.mark.parametrize("method", ["gbm", "copula", "bootstrap", "shuffle", "parametric"])
def test_simulations_keep_moments(spark, method):
    g = np.random.default_rng(1)
    x = g.multivariate_normal([0, 0], [[1e-4, 6e-5], [6e-5, 1e-4]], size=200)
    p = spark.createDataFrame([(t, a, float(x[t, k])) for t in range(200) for k, a in enumerate("ab")], "seq bigint, asset string, ret double")
    s = X.simulate(p, method, sims=10)
    assert s.count() == 10 * 200 * 2
    wide = s.groupBy("sim_id", "seq").pivot("asset", ["a", "b"]).agg(F.first("ret"))
    assert abs(wide.agg(F.corr("a", "b")).first()[0] - np.corrcoef(x.T)[0, 1]) < 0.2


def test_residual_shape(spark):
    a = spark.createDataFrame([("a", 0, 0.05), ("a", 1, 0.03)], "asset string, seq bigint, value double")
    assert [round(r["residual"], 9) for r in X.residuals(a, a.withColumn("value", F.lit(0.02))).orderBy("seq").collect()] == [0.03, 0.01]
    with pytest.raises(ValueError, match="Shape mismatch"):
        X.residuals(a, a.limit(1))


def _rank2(columns):
    """The rank over two elements of columns given as whole numbers."""
    low = {}
    for c in columns:
        while c and c.bit_length() in low:
            c ^= low[c.bit_length()]
        if c:
            low[c.bit_length()] = c
    return len(low)


@pytest.mark.parametrize("seed", range(4))
def test_bars_alive_are_betti_numbers(seed):
    g = random.Random(seed)
    d = {(i, j): g.choice([1.0, 2.0, 3.0, 4.0]) for i in range(9) for j in range(i + 1, 9)}
    bars = T.persistence(list(range(9)), d, 2)
    for at in (1.0, 2.0, 3.0, 4.0):
        cells = [[c for c in combinations(range(9), k + 1) if all(d[e] <= at for e in combinations(c, 2))] for k in range(4)]
        index = [{c: k for k, c in enumerate(x)} for x in cells]
        rank = [0] + [_rank2([sum(1 << index[k - 1][f] for f in combinations(c, k)) for c in cells[k]]) for k in range(1, 4)]
        assert [sum(q == k and b <= at < e for q, b, e in bars) for k in range(3)] == [len(cells[k]) - rank[k] - rank[k + 1] for k in range(3)]


def test_second_dimension_holds_no_tetrahedra():
    x = np.random.default_rng(1).normal(size=(60, 60))
    c = np.corrcoef(x)
    tracemalloc.start()
    bars = T.persistence(list(range(60)), {(i, j): float(np.sqrt(2 - 2 * c[i, j])) for i in range(60) for j in range(i + 1, 60)}, 2, 2.0)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sum(q == 0 for q, _, _ in bars) == 60 and most < 80


def test_few_costly_windows_are_many_tasks(spark):
    d = spark.range(40).select(F.col("id").alias("window_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0).alias("d")) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))))).alias("x")).select("window_id", "x.*")
    assert T.diagrams(d).select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("seed", range(6))
def test_links_give_the_pairs_of_single_simplices(seed):
    g, n = np.random.default_rng(seed), 12
    w = np.triu(g.integers(0, 9 if seed % 2 else 10_000, (n, n)), 1)
    r = np.where(g.random((n, n)) < 0.2, T.NO_EDGE, w)
    r = np.triu(r, 1) + np.triu(r, 1).T
    last, cleared, want = int(r[r < T.NO_EDGE].max()), np.zeros(0, np.int64), []
    for q in range(3):
        pairs, cleared = T._pairs(r, q, last, cleared)
        want += [(q, a, b) for a, b in pairs if q]
    assert sorted(x for x in T._by_links(r, last, 2) if x[0]) == sorted(want)


def test_void_of_many_points_without_a_list_of_simplices(monkeypatch):
    monkeypatch.setattr(T, "_simplices", None)  # 1.3 million triangles
    x = np.random.default_rng(3).normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = T.point_distances(x)
    bars = T.persistence(list(range(200)), {(int(i), int(j)): w for i, j, w in zip(d["i"], d["j"], d["d"], strict=True)}, 2)
    assert sum(e - b > 0.5 for q, b, e in bars if q == 2) == 1 and not sum(e - b > 0.5 for q, b, e in bars if q == 1)


def test_correlations_by_blocks_without_a_join_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "pairs_of", None)
    monkeypatch.setattr(M, "CELLS", 200)  # blocks of two or three assets
    g = np.random.default_rng(0)
    v = g.normal(size=(7, 30))
    v[0, 10:20] = 0.1
    v[g.random(v.shape) < 0.1] = np.nan
    rows = [(s, f"a{a}", None if np.isnan(v[a, s]) else float(v[a, s])) for a in range(7) for s in range(30)]
    got = {(r["window_id"], r["i"], r["j"]): r["c"] for r in M.rolling_correlation(spark.createDataFrame(rows, "seq bigint, asset string, ret double"), 5).collect()}
    want = {}
    for a, b in combinations(range(7), 2):
        both = np.flatnonzero(~np.isnan(v[a]) & ~np.isnan(v[b]))
        for k in range(4, len(both)):
            x, y = v[a, both[k - 4 : k + 1]], v[b, both[k - 4 : k + 1]]
            want[int(both[k]), f"a{a}", f"a{b}"] = None if 0 in (np.ptp(x), np.ptp(y)) else np.corrcoef(x, y)[0, 1]
    assert got.keys() == want.keys() and None in want.values()
    assert all((c is None) == (got[k] is None) and (c is None or abs(c - got[k]) < 1e-9) for k, c in want.items())


def test_triangles_of_windows_as_groups_are_those_of_joins(spark):
    g = np.random.default_rng(5)
    rows = [(w, f"n{i:02d}", f"n{j:02d}") for w in range(3) for i, j in combinations(range(20), 2) if g.random() < 0.15 + 0.3 * w]
    edges = spark.createDataFrame(rows, "window_id bigint, i string, j string")
    found = [{(r["window_id"], r["node"]): r["tri"] for r in M.triangles(edges, bound).where("tri > 0").collect()} for bound in (200_000, 0)]
    near = {(w, a): {y if x == a else x for v, x, y in rows if v == w and a in (x, y)} for w, i, j in rows for a in (i, j)}
    want = {k: sum(b in near[k[0], c] for b, c in combinations(sorted(x), 2)) for k, x in near.items()}
    assert found[0] == found[1] == {k: x for k, x in want.items() if x}
