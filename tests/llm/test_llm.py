"""The operators for language-model data on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marketshape.llm.clusters import _map_of, cluster_windows, describe_clusters, pivot_clusters, pivot_rounds, scaled_points, sound_windows
from marketshape.llm.mixing import mix_sources, water_fill
from marketshape.llm.packing import best_fit, least_cost, pack_items
from marketshape.llm.toxicity import Words, plain, score_documents, source_rates
from marketshape.session import cut


def test_pivots_cover_all_and_lie_apart_in_a_round(spark):
    g = random.Random(3)
    rows = [(k % 90, g.random(), g.random() * 2) for k in range(400)] + [(500, 0.5, 0.5)] * 3
    r = pivot_clusters(spark.createDataFrame(rows, "id bigint, a double, b double"), "id", ["a", "b"], 0.4).collect()
    assert len(r) == 403 and max(x["distance"] for x in r) <= 0.4
    z, _ = scaled_points(spark.createDataFrame(rows, "id bigint, a double, b double"), "id", ["a", "b"], 0.4)
    p = [(x["z0"], x["z1"]) for x in pivot_rounds(z, 2, 0.4).collect()]
    assert all(min(math.dist(q, (x["z0"], x["z1"])) for q in p) <= 0.4 for x in z.collect())
    assert sum(math.dist(a, b) <= 0.4 for i, a in enumerate(p) for b in p[:i]) == 0  # a later round's records are none of an earlier one's


@pytest.mark.parametrize("others", [5_000, 40_000])
def test_a_small_group_is_found_whatever_the_rest(spark, others):
    x = spark.range(others + 60).select("id", *(F.when(F.col("id") < 60, 2.0 + 0.01 * F.randn(i)).otherwise((F.xxhash64("id", F.lit(i)) % 2 + F.randn(i + 9) * 0.1).cast("double")).alias(f"f{i}") for i in range(4)))
    m = cluster_windows(cut(x), "id", [f"f{i}" for i in range(4)])
    got = {r["cluster_id"]: r["n"] for r in m.where("id < 60").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert list(got.values()) == [60] and None not in got
    assert m.where(F.col("cluster_id") == list(got)[0]).count() == 60


def test_clusters_of_blobs(spark):
    g = random.Random(1)
    rows = [(k, c + g.gauss(0, 0.01), 1 - c + g.gauss(0, 0.01), "x") for k, c in enumerate([0.1] * 200 + [0.5] * 100 + [0.9] * 60)]
    rows += [(1000, 0.3, 0.1, "x"), (1001, None, 0.5, "x"), (1002, 0.1, 0.9, "x"), (1002, 0.1, 0.9, "x")]
    m = cluster_windows(spark.createDataFrame(rows, "id bigint, a double, b double, cell string"), "id", ["a", "b"])
    got = {r["id"]: r["cluster_id"] for r in m.collect()}
    assert len({got[k] for k in range(0, 200)}) == 1 and len({got[k] for k in range(360)}) == 3
    assert got[1000] is None and 1001 not in got and got[1002] == got[0]
    d = describe_clusters(m, "id", ["a", "b"], 2).collect()
    assert sorted({r["size"] for r in d}) == [60, 100, 202] and len(d) == 6
    empty = spark.createDataFrame([], "id bigint, a double, b double")
    assert cluster_windows(empty, "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize(("pivots", "broadcast"), [(50, True), (3_000, False)])
def test_pivots_by_cell_are_broadcast_by_count_not_by_file_size(spark, pivots, broadcast):
    zs, ks = [f"z{i}" for i in range(4)], [f"k{i}" for i in range(4)]
    p = cut(spark.range(pivots).select(F.col("id").alias("pivot"), *((F.col("id") % (i + 5)).cast("double").alias(z) for i, z in enumerate(zs)), *((F.col("id") % (i + 5)).cast("int").alias(k) for i, k in enumerate(ks))))
    points = cut(p.select(F.concat_ws(",", *ks).alias("cell"), *zs))
    near = points.join(_map_of(p, 4), "cell", "left")  # 3,000 pivots are 243,000 in their cells
    assert ("BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()) == broadcast
    assert near.where("pivots is not null").count() == pivots


def test_sound_windows(spark):
    h = spark.createDataFrame([(1, 0.5, 0.2), (1, 0.5, 0.2), (2, float("nan"), 0.1), (3, 0.5, 0.6), (4, 0.5, 0.2), (None, 0.5, 0.2)], "window_id bigint, max_persistence double, mean_persistence double")
    g = spark.createDataFrame([(1, 0.3, 0.5), (2, 0.3, 0.5), (3, 0.3, 0.5), (4, 0.3, 50.0)], "window_id bigint, spectral_gap double, density double")
    assert [r["window_id"] for r in sound_windows(h, g).collect()] == [1]


def test_best_fit_and_packing(spark):
    import numpy as np

    where, used = best_fit(np.array([6, 5, 4, 3, 2]), [10], 10)
    assert sorted(used) == [10, 10] and len(where) == 5
    assert least_cost(6, [8, 16], [1, 1], 0) == 8 and least_cost(6, [8, 16], [4, 6], 0) == 16
    g = random.Random(2)
    items = [(i, g.choice([0, 1, 7, 90, 400, 1500, None])) for i in range(400)] + [(7, 3), (7, 3)]
    kinds = {"s": 100, "m": 1000}
    p = pack_items(spark.createDataFrame(items, "doc_id bigint, size bigint"), kinds).collect()
    for k, cap in kinds.items():
        rows = [r for r in p if r["container_kind"] == k]
        assert sum(r["piece_tokens"] for r in rows) == sum(s or 0 for _, s in items)
        assert {r["doc_id"] for r in rows if r["n_pieces"] > 1} == {i for i, s in items if (s or 0) > cap}
        full = {}
        for r in rows:
            full.setdefault(r["container_id"], []).append(r)
        for c in full.values():
            assert sum(r["piece_tokens"] for r in c) == c[0]["used_tokens"] <= c[0]["capacity_tokens"] <= cap
        assert len(rows) == sum(max(1, -(-(s or 0) // cap)) for _, s in items)
    assert pack_items(spark.createDataFrame([], "doc_id bigint, size bigint"), kinds).count() == 0


def test_water_fill(spark):
    t = spark.createDataFrame([("a", 0.5, 2, 10), ("b", 0.25, 1, 1000), ("c", 0.25, 1, 1000)], "source string, target_share double, max_repeats int, size bigint")
    got = {r["source"]: r for r in water_fill(t, 2010.0).collect()}
    assert {k: r["give"] for k, r in got.items()} == {"a": 20, "b": 995.0, "c": 995.0} and [k for k, r in got.items() if r["short"]] == ["a"]
    one = water_fill(t.where("source = 'a'").withColumn("target_share", F.lit(1.0)), 30.0).first()
    assert one["give"] == 20.0 and one["short"]


def test_one_missing_id_may_hold_most_rows(spark):
    rows = [(None if k % 3 else k, "a", 10) for k in range(3000)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    items = spark.createDataFrame([*rows, *((k, "b", 10) for k in range(1000))], "doc_id bigint, source string, size bigint")
    m, rep = mix_sources(items, t)
    got = {r["source"]: r["mixed_size"] for r in rep.collect()}
    assert got["b"] == 10_000 and got["a"] == 30_000 and m.count() == 4000
    p = pack_items(items, {"s": 100}, shard_items=500)
    assert p.count() == 4000 and p.select("container_id").distinct().count() <= 400 + 8


def test_mixture_reaches_shares(spark):
    g = random.Random(4)
    rows = [(i, g.choice(["a", " A", "b", "b", "b", None, "", "zz"]), g.choice([10, 50, None])) for i in range(6000)]
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.45, 1), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    m, rep = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"), t)
    got = {r["source"]: r for r in rep.collect()}
    assert not got["none"]["reachable"] and got["none"]["actual_share"] == 0
    assert got["a"]["actual_share"] == pytest.approx(0.5 / 0.95, abs=0.01)
    assert m.agg(F.max("repeats")).first()[0] <= 3 and m.where("source = 'b'").agg(F.max("repeats")).first()[0] == 1
    m2, _ = mix_sources(spark.createDataFrame([], "doc_id bigint, source string, size bigint"), t)
    assert m2.count() == 0


def test_disguises():
    w = Words(["idiot", "fuck", "piece", "of", "asshole", "liars"])
    read = lambda t: [" ".join(s) for s in w.segments(t)]
    assert read("You f*ck 1d10t") == ["you fuck idiot"]
    assert read("idiiiiot, idoit, i d i o t, l.i.a.r.s") == ["idiot idiot idiot liars"]
    assert read("аssh​ole") == ["asshole"]
    assert read("") == [] and read(" \n ") == []
    assert plain("fÃ¼r") == "für" and read("x_1 = 5") == ["<id> <num>"]


def test_scores_find_open_and_disguised_abuse(spark):
    g = random.Random(6)
    things = ["index", "window", "table", "matrix", "series", "graph"]
    ordinary = lambda: f"{g.choice(['please', 'just', 'now'])} sort the {g.choice(things)} before the {g.choice(things)}."
    bad = lambda: f"you are {g.choice(['a', 'such a'])} {g.choice(['stupid', 'filthy', 'worthless'])} {g.choice(['idiot', 'moron', 'pig'])}."
    labels = [(i, ordinary(), False) for i in range(60)] + [(i, bad(), True) for i in range(60, 110)] + [(200, None, True), (201, "?", None)]
    docs = [(i, " ".join(ordinary() for _ in range(5)), "s") for i in range(200)] + [(300, ordinary() + " " + bad(), "S "), (301, "you are a st*pid 1d10t.", "t"), (302, None, None), (303, "", "t")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, source string, segments string, score int")
    lab = spark.createDataFrame(labels, "snippet_id bigint, snippet string, is_harmful boolean")
    s = score_documents(d, lab)
    got = {r["doc_id"]: r for r in s.collect()}
    assert len(got) == 204 and {k for k, r in got.items() if r["flagged"]} == {300, 301}
    assert got[302]["score"] == 0 and got[303]["score"] == 0
    rates = {r["source"]: (r["documents"], r["harmful"]) for r in source_rates(s).collect()}
    assert rates == {"s": (201, 1), "t": (2, 1), None: (1, 0)}
    assert score_documents(d.limit(0), lab).count() == 0
    assert score_documents(d, lab.limit(0)).where("flagged").count() == 0
