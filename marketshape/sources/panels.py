"""Market panels in long form from tables, and synthetic markets.

A panel has a row per asset and period: asset, t, seq (0, 1, ... over the periods), price, ret.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import DAY_ONE, micros, number, small, table


def scaffold(prices: DataFrame) -> DataFrame:
    """Every asset in every period, the last price carried forward; null before an asset's first.

    ``prices``: asset, t, price, one row each. As many rows as assets x periods; a window
    holds one asset's periods.
    """
    periods = prices.select("t").distinct().withColumn("seq", (F.row_number().over(W.orderBy("t")) - 1).cast("bigint"))  # one row per period
    cells = prices.select("asset").distinct().crossJoin(small(periods))  # the result's own rows
    w = W.partitionBy("asset").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return cells.join(prices, ["asset", "t"], "left").withColumn("price", F.last("price", True).over(w)).select("asset", "t", "seq", "price")


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds ret, the change to the asset's period before; null in its first or after a price of 0."""
    return panel.withColumn("ret", F.try_divide("price", F.lag("price").over(W.partitionBy("asset").orderBy("seq"))) - 1)


def last_periods(panel: DataFrame, lookback: int | None) -> DataFrame:
    """The last ``lookback`` periods of the panel, all if null."""
    if lookback is None:
        return panel
    end = panel.agg(F.max("seq").alias("end"))
    return panel.crossJoin(F.broadcast(end)).where(F.col("seq") > F.col("end") - lookback).drop("end")  # one row


def brand_month(spark: SparkSession, d: str) -> DataFrame:
    """25 brands by month: the mean net price of a unit shipped."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    p = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("asset"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("t"))
    return scaffold(p.agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("price")))


def segment_month(spark: SparkSession, d: str) -> DataFrame:
    """Five market segments by month: the mean order value."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    p = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("asset"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("t"))
    return scaffold(p.agg(F.avg("o_totalprice").alias("price")))


def event_bars(events: DataFrame) -> DataFrame:
    """Daily bars of every event type: asset, t, seq, open, high, low, close, volume (events in the bar)."""
    at = F.struct("ts", "event_id")
    b = events.groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("t")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return b.withColumn("seq", (F.row_number().over(W.partitionBy("asset").orderBy("t")) - 1).cast("bigint"))


def fields_as_assets(bars: DataFrame) -> DataFrame:
    """The single-asset form: the five fields of each entity's bars as five assets (entity, asset, seq, price)."""
    return bars.select(F.col("asset").alias("entity"), "seq", F.expr("stack(5, 'Open', open, 'High', high, 'Low', low, 'Close', close, 'Volume', cast(volume as double)) as (asset, price)"))


# Correlation, volatility and mean return of the three thirds of the synthetic market.
REGIMES = ((0.7, 0.01, 0.0005), (0.5, 0.02, 0.0002), (0.2, 0.03, -0.0003))


def synthetic_market(spark: SparkSession, assets: int = 10, periods: int = 500, seed: int = 42) -> DataFrame:
    """Correlated returns and prices in three regimes; the last has two halves of correlation 0.9 within.

    One factor for all assets and one per cluster give each return its correlation:
    sqrt(c) of the common and sqrt(1 - c) of an own normal draw.
    """

    def draw(*key: str, salt: int) -> F.Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(salt + i), *(F.col(k) for k in key)), F.lit(2_000_003)) + 1) / 2_000_005.0 for i in (0, 1)]
        return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])

    x = spark.range(periods).withColumnRenamed("id", "seq").crossJoin(F.broadcast(spark.range(assets).withColumnRenamed("id", "n")))  # the result's own rows
    third = F.least(F.floor(F.col("seq") * 3 / periods), F.lit(2))
    x = x.withColumns({"regime": third, "half": F.floor(F.col("n") * 2 / assets)})
    pick = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in REGIMES)), (F.col("regime") + 1).cast("int"))
    c, inner = pick(0), F.when(F.col("regime") == 2, 0.9 - REGIMES[2][0]).otherwise(0.0)
    z = F.sqrt(c) * draw("seq", salt=10) + F.sqrt(inner) * draw("seq", "half", salt=20) + F.sqrt(1 - c - inner) * draw("seq", "n", salt=30)
    x = x.select(F.concat(F.lit("Asset_"), (F.col("n") + 1).cast("string")).alias("asset"), "seq", (pick(2) + pick(1) * z).alias("ret"))
    return x.withColumn("price", 100 * F.product(1 + F.col("ret")).over(W.partitionBy("asset").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


# Correlation, volatility and mean return of the states a market of change points passes through.
STATES = ((0.3, 0.02, 0.0), (0.0, 0.03, 0.0), (0.8, 0.05, -0.001))


def _normal(seed: int, salt: int, *key: str) -> Column:
    """A standard normal draw by the hash of the key."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(salt + i), *(F.col(k) for k in key)), F.lit(2_000_003)) + 1) / 2_000_005.0 for i in (0, 1)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])


def change_point_market(spark: SparkSession, assets: int = 5, periods: int = 500, changes: list[int] | None = None, seed: int = 42) -> DataFrame:
    """(asset, seq, ret, open, high, low, close, volume) of a market whose state moves on with every period past a change point.

    The state is counted on by the number of change points passed, in every period anew,
    so between them it runs through moderate, absent and high correlation by turns.
    """
    points = [periods // 3, 2 * periods // 3] if changes is None else changes
    x = spark.range(periods).withColumnRenamed("id", "seq").crossJoin(F.broadcast(spark.range(assets).withColumnRenamed("id", "n")))  # the result's own rows
    steps = sum((F.greatest(F.col("seq") - p + 1, F.lit(0)) for p in points), F.lit(0))
    pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in STATES)), (F.pmod(steps, F.lit(3)) + 1).cast("int"))
    z = F.sqrt(pick(0)) * _normal(seed, 10, "seq") + F.sqrt(1 - pick(0)) * _normal(seed, 20, "seq", "n")
    x = x.withColumn("ret", pick(2) + pick(1) * z).withColumn("close", 100 * F.exp(F.sum("ret").over(W.partitionBy("n").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))))
    off = [_normal(seed, 30 + 10 * i, "seq", "n") for i in range(3)]
    volume = 1000 + F.pmod(F.xxhash64(F.lit(seed), "seq", "n"), F.lit(9000))
    return x.select(F.concat(F.lit("Asset_"), F.col("n").cast("string")).alias("asset"), "seq", "ret", (F.col("close") + 0.5 * off[0]).alias("open"), (F.col("close") + 1.5 * F.abs(off[1])).alias("high"), (F.col("close") - 1.5 * F.abs(off[2])).alias("low"), "close", volume.alias("volume"))


def random_correlation_market(spark: SparkSession, assets: int = 5, periods: int = 100, seed: int = 42) -> DataFrame:
    """(asset, seq, ret) with a random correlation from 0.3 to 0.7 for every two assets, random means and spreads.

    The matrix of assets is drawn and rooted here; the draws of a period are joined with its rows.
    """
    g = np.random.default_rng(seed)
    c = np.eye(assets)
    upper = np.triu_indices(assets, 1)
    c[upper] = c.T[upper] = g.uniform(0.3, 0.7, len(upper[0]))
    mean, spread = g.uniform(-0.01, 0.02, assets), g.uniform(0.01, 0.03, assets)
    v, q = np.linalg.eigh(c)
    root = (q * np.sqrt(np.maximum(v, 0.0))) @ q.T * spread[:, None]
    weights = spark.createDataFrame([(f"Asset_{i + 1}", j, float(root[i, j]), float(mean[i])) for i in range(assets) for j in range(assets)], "asset string, n bigint, w double, m double")
    z = spark.range(periods).withColumnRenamed("id", "seq").crossJoin(F.broadcast(spark.range(assets).withColumnRenamed("id", "n"))).withColumn("z", _normal(seed, 10, "seq", "n"))  # the draws
    return z.join(F.broadcast(weights), "n").groupBy("asset", "seq").agg((F.sum(F.col("w") * F.col("z")) + F.max("m")).alias("ret"))  # assets x assets rows


def jittered_scenarios(spark: SparkSession, assets: int = 10, jitter: float = 0.1, seed: int = 42) -> DataFrame:
    """``scenario_correlations`` with up to +-``jitter`` on every correlation, within -1 and 1."""
    u = F.pmod(F.xxhash64(F.lit(seed), "scenario", "i", "j"), F.lit(2_000_001)) / 1e6 - 1.0
    return scenario_correlations(spark, assets).withColumn("c", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") + jitter * u)))


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of the ohlcv readings, every asset on every day from its first on (the last close carried forward, volume 0): asset, t, seq, open, high, low, close, volume."""
    o = table(spark, d, "ohlcv").select("asset", micros("ts").alias("us"), "bar_id", "open_price", "high_price", "low_price", number("close_price").alias("c"), "volume").where(f"us >= {DAY_ONE} and asset is not null and c > 0")
    at = F.struct("us", "bar_id")
    b = o.groupBy("asset", F.date_from_unix_date(F.floor(F.col("us") / DAY_ONE).cast("int")).alias("t")).agg(F.min_by(number("open_price"), at).alias("open"), F.max(number("high_price")).alias("high"), F.min(number("low_price")).alias("low"), F.max_by("c", at).alias("close"), F.sum("volume").alias("volume"))
    s = scaffold(b.select("asset", "t", F.col("close").alias("price"))).where("price is not null").join(b, ["asset", "t"], "left")
    p = F.col("price")
    return s.select("asset", "t", "seq", *(F.coalesce(k, p).alias(k) for k in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0)).alias("volume"))


def scenario_correlations(spark: SparkSession, assets: int = 10) -> DataFrame:
    """Three correlation matrices (scenario, i < j, c): unified, fragmented in three blocks, crisis ring."""
    rows = []
    for i in range(assets):
        for j in range(i + 1, assets):
            step = min(j - i, assets - j + i)
            rows += [("unified", i, j, 0.7), ("fragmented", i, j, 0.8 if i * 3 // assets == j * 3 // assets else 0.2), ("crisis", i, j, 0.85 if step == 1 else 0.5 if step == 2 else 0.1)]
    return spark.createDataFrame(rows, "scenario string, i int, j int, c double")
