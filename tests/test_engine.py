"""The two models and the validation runs end to end on a small synthetic market."""

import pytest
from pyspark.sql import functions as F

from marketshape import engine as E
from marketshape.operators import strategy as X
from marketshape.sources import panels as P


@pytest.fixture(scope="module")
def market(spark):
    return P.synthetic_market(spark, assets=5, periods=90).cache()


def bars(market):
    p = F.col("price")
    return market.select("asset", "seq", F.date_add(F.lit("2020-01-01").cast("date"), F.col("seq").cast("int")).alias("t"), (p * 0.999).alias("open"), (p * 1.01).alias("high"), (p * 0.99).alias("low"), p.alias("close"), (1000 + F.col("seq") * 7 % 90).alias("volume"))


def test_engine_needs_a_fit_and_scores_every_window(market):
    e = E.GatedEngine(E.EngineConfig(window=60, hidden_layers=(4,)))
    with pytest.raises(ValueError):
        e.predict(bars(market))
    out = e.fit(bars(market), rounds=5).predict(bars(market)).collect()
    assert len(out) == 90 - 60  # the first return is missing
    assert all(r["final_signal"] in ("LONG", "SHORT", "NEUTRAL") and 0 <= r["confidence_score"] <= 1 for r in out)


def test_mutual_model(market):
    out = E.MutualModel(E.MutualConfig(window=60, detector="rule_based")).run(market).collect()
    assert len(out) == 31 * 5 and all(-1 <= r["signal"] <= 1 and abs(r["position"]) <= 3 for r in out)
    with pytest.raises(ValueError):
        E.MutualConfig(detector="magic")


def test_walk_forward_and_stress(spark, market):
    splits = X.walk_forward_splits(spark, 90, 40, 20, least=10)
    fit = lambda d: d.agg(F.avg("ret")).first()[0]
    out = E.walk_forward(market, splits, fit, lambda m, d: d.withColumn("e", F.col("ret") - m), lambda d: {"mse": d.agg(F.avg(F.col("e") ** 2)).first()[0]}).collect()
    assert len(out) == splits.count() == 2
    with pytest.raises(ValueError):
        E.walk_forward(market, splits, lambda d: 1 / 0, None, None)
    mean = lambda d: d.groupBy("sim_id").agg(F.avg("ret").alias("value")).withColumn("metric", F.lit("mean"))
    config = E.StressConfig(simulations=8)
    summary, verdict = E.stress(market, mean, "shuffle", config)
    r = summary.first()
    assert r["mean"] == pytest.approx(r["original"]) and verdict.first()["is_robust"]
    assert E.validate_correlation(market, X.simulate(market, "shuffle", 3), config).where("is_valid").count() == 3
