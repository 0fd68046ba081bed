"""Backtests, splits, stress tests, signal features, ensembles and models."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import small
from .matrix import pairs_of

# ---------------------------------------------------------------- backtest


def positions(signals: DataFrame, every: int = 1, most: float = 1.0) -> DataFrame:
    """Adds position: the last signal at a rebalance (seq a multiple of ``every``), within +-most. Keys: strategy, asset, seq."""
    w = W.partitionBy("strategy", "asset").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    target = F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce("signal", F.lit(0.0))))
    return signals.withColumn("position", F.last(F.when(F.col("seq") % every == 0, target), True).over(w))


def backtest(signals: DataFrame, cost: float = 0.001, slippage: float = 0.0005, every: int = 1, most: float = 1.0, capital: float = 100_000.0) -> DataFrame:
    """(strategy, seq, equity, cash, turnover, period_return) from (strategy, asset, seq, signal, ret).

    Signals meet returns by position in time. The equity recursion is a running product
    of (1 + portfolio return)(1 - cost x turnover), computed as one window per strategy
    over periods already summed over assets; the first period's cost hits the cash only.
    """
    c = cost + slippage
    p = positions(signals, every, most)
    w = W.partitionBy("strategy", "asset").orderBy("seq")
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    by = p.withColumns({"gain": before * F.coalesce("ret", F.lit(0.0)), "moved": F.abs(F.col("position") - before)}).groupBy("strategy", "seq").agg(F.sum("gain").alias("r"), F.sum("moved").alias("turnover"))
    t = W.partitionBy("strategy").orderBy("seq")
    first = F.row_number().over(t) == 1
    by = by.withColumn("r", F.when(first, 0.0).otherwise(F.col("r"))).withColumn("factor", F.when(F.row_number().over(t) == 1, 1.0).otherwise((1 + F.col("r")) * (1 - c * F.col("turnover"))))
    by = by.withColumn("equity", capital * F.product("factor").over(t.rowsBetween(W.unboundedPreceding, 0)))
    by = by.withColumn("paid", F.coalesce(F.lag("equity").over(t) * (1 + F.col("r")), F.lit(capital)) * c * F.col("turnover"))
    return by.withColumns({"cash": capital - F.sum("paid").over(t.rowsBetween(W.unboundedPreceding, 0)), "period_return": F.coalesce(F.col("equity") / F.lag("equity").over(t) - 1, F.lit(0.0))}).select("strategy", "seq", "equity", "cash", "turnover", "period_return")


def backtest_metrics(curve: DataFrame, by: list[str], capital: float = 100_000.0, year: int = 252) -> DataFrame:
    """total_return, annualized_return, volatility, sharpe_ratio, sortino_ratio, max_drawdown, calmar_ratio, win_rate, final_value per group; ratios are 0 without a denominator."""
    w = W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    r = F.col("period_return")
    d = curve.withColumn("fall", F.col("equity") / F.max("equity").over(w) - 1)
    a = d.groupBy(*by).agg(F.max_by("equity", "seq").alias("final_value"), F.count(F.lit(1)).alias("n"), (F.coalesce(F.stddev_samp(r), F.lit(0.0)) * math.sqrt(year)).alias("volatility"), (F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)) * math.sqrt(year)).alias("down"), F.min("fall").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"))
    a = a.withColumn("total_return", F.col("final_value") / capital - 1).withColumn("annualized_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), year / F.col("n")) - 1).otherwise(-1.0))
    ratio = lambda d: F.when(d > 0, F.col("annualized_return") / d).otherwise(0.0)
    return a.select(*by, "total_return", "annualized_return", "volatility", ratio(F.col("volatility")).alias("sharpe_ratio"), ratio(F.col("down")).alias("sortino_ratio"), "max_drawdown", ratio(F.abs("max_drawdown")).alias("calmar_ratio"), "win_rate", "final_value")


def rolling_windows(signals: DataFrame, train: int, test: int) -> DataFrame:
    """(window_id added) every stretch of ``test`` periods that follows ``train`` ones, seq from its start; no stretch, no rows."""
    end = signals.agg((F.max("seq") + 1).alias("n"))
    d = signals.crossJoin(F.broadcast(end)).withColumn("window_id", F.floor((F.col("seq") - train) / test))  # one row
    return d.where((F.col("seq") >= train) & ((F.col("window_id") + 1) * test + train <= F.col("n"))).withColumn("seq", F.col("seq") - train - F.col("window_id") * test).drop("n")


def summarise(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """mean, std (population), min and max of every metric: (by, metric, mean, std, min, max)."""
    long = metrics.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in names))).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


# ---------------------------------------------------------------- splits


def purge(train_end: Column, test_end: Column, pct: float) -> tuple[Column, Column]:
    """[start, end) of the purged periods around a test: a share of its length, at least one period, on each side."""
    size = F.greatest(F.lit(1), F.floor((test_end - train_end) * pct))
    return F.greatest(F.lit(0), train_end - size), test_end + size


def embargo(n: Column, pct: float = 0.01) -> Column:
    """Periods to leave out after a test; not applied by the splits, as ``purge`` covers them."""
    return F.greatest(F.lit(1), F.floor(n * pct))


def months_to_periods(months: int, days: int | None, n: int | None = None) -> int:
    """Periods of so many months: 21 each without dates, else by the mean density of ``n`` periods over ``days``."""
    return months * 21 if days is None else int(months * 30 * n / max(days, 1))


def walk_forward_splits(spark: SparkSession, n: int, train: int, test: int, step: int | None = None, purge_pct: float = 0.02, anchored: bool = True, least: int = 100) -> DataFrame:
    """split_id, train_start, train_end, test_start, test_end, purge_start, purge_end, for every test that fits.

    Anchored training starts at 0, else ``train`` periods before the test; splits with
    fewer than ``least`` training periods are left out.
    """
    step = test if step is None else step
    if step <= 0 or test <= 0:
        raise ValueError("step and test must be positive")
    s = spark.range(1).select(F.explode((F.sequence(F.lit(train), F.lit(n - test), F.lit(step)) if n - test >= train else F.array()).cast("array<bigint>")).alias("test_start"))
    s = s.withColumns({"train_start": F.lit(0).cast("bigint") if anchored else F.col("test_start") - train, "train_end": F.col("test_start"), "test_end": F.col("test_start") + test})
    a, z = purge(F.col("test_start"), F.col("test_end"), purge_pct)
    s = s.withColumns({"purge_start": a.cast("bigint"), "purge_end": z.cast("bigint")}).where(F.col("train_end") - F.col("train_start") >= least)
    return s.select((F.row_number().over(W.orderBy("test_start")) - 1).cast("bigint").alias("split_id"), "train_start", "train_end", "test_start", "test_end", "purge_start", "purge_end")  # one row per split


def split_rows(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """The panel's rows in every split, as role train (purged periods left out) or test; splits are few rows."""
    train = (F.col("seq") >= F.col("train_start")) & (F.col("seq") < F.col("train_end")) & ~((F.col("seq") >= F.col("purge_start")) & (F.col("seq") < F.col("purge_end")))
    test = (F.col("seq") >= F.col("test_start")) & (F.col("seq") < F.col("test_end"))
    j = panel.join(small(splits, 10_000), train | test)
    return j.withColumn("role", F.when(test, "test").otherwise("train")).drop("train_start", "train_end", "test_start", "test_end", "purge_start", "purge_end")


def cpcv_splits(spark: SparkSession, n: int, groups: int = 5, tests: int = 2, purge_pct: float = 0.02, over_purge: bool = True) -> DataFrame:
    """(split_id, seq_start, seq_end, role): combinatorial purged splits as intervals.

    Every choice of ``tests`` of the groups is a test. With ``over_purge`` the purge
    spans from the first to the last test period, all training between included; without
    it each test group is purged by itself.
    """
    size = n // groups
    ends = [(g * size, (g + 1) * size if g < groups - 1 else n) for g in range(groups)]
    rows = []
    for k, chosen in enumerate(combinations(range(groups), tests)):
        blocks = [(ends[chosen[0]][0], ends[chosen[-1]][1])] if over_purge else [ends[g] for g in chosen]
        gone = []
        for a, z in blocks:
            p = max(1, int((z - a) * purge_pct))
            gone.append((max(0, a - p), z + p))
        rows += [(k, *ends[g], "test") for g in chosen]
        for g in range(groups):
            if g not in chosen:
                left = [ends[g]]
                for a, z in gone:
                    left = [(x, y) for s, e in left for x, y in ((s, min(e, a)), (max(s, z), e)) if x < y]
                rows += [(k, a, z, "train") for a, z in left]
    return spark.createDataFrame(rows, "split_id bigint, seq_start bigint, seq_end bigint, role string")


# ---------------------------------------------------------------- stress


def draw(below: Column, *key: Column) -> Column:
    """A whole number from 0 to below ``below``, drawn by the MD5 of the key, so any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("bigint") % below


def _symmetric(rows: list, names: list[str]) -> np.ndarray:
    """The matrix of (i, j, c), i <= j, made positive definite by a shift of its diagonal if it isn't; no entry counts 0."""
    at = {k: n for n, k in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["c"] or 0.0
    least = np.linalg.eigvalsh(m).min()
    return m if least > 0 else m - 1.5 * min(least, -1e-12) * np.eye(len(m))


def simulate(panel: DataFrame, method: str, sims: int = 10, seed: int = 42, block: int | None = None, keep_correlation: bool = True) -> DataFrame:
    """(sim_id, seq, asset, ret): synthetic panels by gbm, copula, bootstrap, shuffle or parametric.

    bootstrap joins random blocks of periods by their index, shuffle permutes periods (or
    each asset's own); both are joins on a simulated index whose draws any engine can
    repeat. The normal models (gbm, parametric, copula) need the means and the
    covariances of every two assets over the periods both have, one aggregation whose
    matrix of assets comes to the driver; copula takes those of the normal scores of the
    ranks, and its draws meet the asset's own sorted returns in a join. Draws are made by
    simulation and chunk of periods, so no task holds a whole simulation.
    """
    p = panel.where("ret is not null").select("seq", "asset", "ret")
    spark = panel.sparkSession
    span = p.agg(F.min("seq").alias("a"), F.max("seq").alias("z")).first()
    if span["a"] is None:
        return spark.createDataFrame([], "sim_id bigint, seq bigint, asset string, ret double")
    first, n = int(span["a"]), int(span["z"] - span["a"] + 1)
    sim = spark.range(sims).withColumnRenamed("id", "sim_id")
    if method == "bootstrap":
        b = block or min(20, max(5, n // 20))
        at = sim.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))  # the result's own rows
        u = draw(F.lit(max(1, n - b)), F.lit(seed), F.col("sim_id"), F.floor(F.col("seq") / b))
        return at.withColumn("from", u + F.col("seq") % b + first).join(p.withColumnRenamed("seq", "from"), "from").select("sim_id", "seq", "asset", "ret")
    if method == "shuffle":
        key = ["sim_id"] if keep_correlation else ["sim_id", "asset"]
        all_rows = sim.crossJoin(p if not keep_correlation else p.select("seq").distinct())  # the result's own rows
        order = F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") for k in (*key, "seq"))))
        all_rows = all_rows.withColumn("to", (F.row_number().over(W.partitionBy(*key).orderBy(order, "seq")) - 1).cast("bigint"))
        d = all_rows.join(p, "seq") if keep_correlation else all_rows
        return d.select("sim_id", F.col("to").alias("seq"), "asset", "ret")
    if method not in ("gbm", "parametric", "copula"):
        raise ValueError(f"Unknown method: {method}")
    about = {r["asset"]: r for r in p.groupBy("asset").agg(F.avg("ret").alias("mean"), F.count(F.lit(1)).alias("n")).collect()}  # a row per asset
    names = sorted(about)
    if method == "copula":
        w = W.partitionBy("asset")
        p = p.withColumns({"k": F.row_number().over(w.orderBy("ret", "seq")) - 1, "rank": F.rank().over(w.orderBy("ret")) + (F.count(F.lit(1)).over(W.partitionBy("asset", "ret")) - 1) / 2, "n": F.count(F.lit(1)).over(w)})
        q = p.withColumn("score", normal_score(F.col("rank") / (F.col("n") + 1)))
        pairs = pairs_of(q, "score", same=True).groupBy("i", "j").agg(F.corr("x", "y").alias("c"))
    else:
        pairs = pairs_of(p, same=True).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("c"))
    cov = _symmetric(pairs.collect(), names)  # assets x assets
    root = np.linalg.cholesky(cov if keep_correlation else np.diag(np.diag(cov)))
    mean, size = np.array([about[k]["mean"] for k in names]), np.array([about[k]["n"] for k in names])
    chunk = max(1, 50_000 // len(names))
    chunks = -(-n // chunk)

    def run(batches):
        erf = np.frompyfunc(math.erf, 1, 1)
        for b in batches:
            for i in b["id"].tolist():
                s, part = divmod(i, chunks)
                rows = min(chunk, n - part * chunk)
                y = np.random.default_rng([seed, s, part]).standard_normal((rows, len(names))) @ root.T
                if method == "copula":
                    u = 0.5 + 0.5 * erf(y / np.sqrt(np.diag(cov)) / math.sqrt(2)).astype(float)
                    y = np.clip((u * size).astype(np.int64), 0, size - 1)
                else:
                    y = mean + y
                yield pd.DataFrame({"sim_id": s, "seq": np.repeat(np.arange(rows) + part * chunk, len(names)), "asset": names * rows, "x": y.ravel()})

    drawn = spark.range(sims * chunks).repartition(max(1, min(sims * chunks, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, f"sim_id bigint, seq bigint, asset string, x {'bigint' if method == 'copula' else 'double'}")
    if method == "copula":
        return drawn.join(p.select("asset", F.col("k").cast("bigint").alias("x"), "ret"), ["asset", "x"]).select("sim_id", "seq", "asset", "ret")
    return drawn.withColumnRenamed("x", "ret")


def normal_score(u: Column) -> Column:
    """The quantile of the standard normal distribution, 0 < u < 1; null for null."""

    def inverse(x: pd.Series) -> pd.Series:
        return x.map(NormalDist().inv_cdf, na_action="ignore").astype(float)

    return F.pandas_udf(inverse, "double")(u)


def correlation_preservation(a: DataFrame, b: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """One row: max_diff, mean_diff, is_valid of two correlation tables (i, j, c), off the diagonal."""
    d = a.select("i", "j", F.col("c").alias("c0")).join(b.select("i", "j", F.col("c").alias("c1")), ["i", "j"]).where("i != j").select(F.abs(F.col("c0") - F.col("c1")).alias("d"))
    return d.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_diff"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_diff")).withColumn("is_valid", F.col("max_diff") <= tolerance)


def stress_aggregate(values: DataFrame, original: DataFrame) -> DataFrame:
    """Per metric: original, mean, std, median, min, max, p05, p95 and the two-sided p_value of (sim_id, metric, value)."""
    d = values.join(F.broadcast(original), "metric")  # one row per metric
    pct = lambda q: F.percentile("value", F.lit(q))
    return d.groupBy("metric").agg(F.max("original").alias("original"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), pct(0.05).alias("p05"), pct(0.95).alias("p95"), F.avg((F.abs("value") >= F.abs("original")).cast("double")).alias("p_value"))


def robustness(aggregate: DataFrame, level: float = 0.05) -> DataFrame:
    """(metric, differs, degrades, is_robust): is_robust tells of all metrics together."""
    d = aggregate.select("metric", (F.col("p_value") < level).alias("differs"), ((F.col("original") > 0) & (F.col("mean") < 0.5 * F.col("original"))).alias("degrades"))
    return d.withColumn("is_robust", ~F.max(F.col("differs") | F.col("degrades")).over(W.partitionBy(F.lit(0))))  # one row per metric


# ---------------------------------------------------------------- features and models


def nn_features(bars: DataFrame) -> DataFrame:
    """Nine features a bar, always all: momentum 5/10/20, volume change, volatility 5/10, price to mean 10/20, spread; 0 where undefined."""
    w = W.partitionBy("asset").orderBy("seq")
    change = lambda c, k: F.try_divide(F.col(c).cast("double"), F.lag(c, k).over(w)) - 1
    last = lambda k: w.rowsBetween(1 - k, 0)
    d = bars.withColumn("r", change("close", 1))
    f = {f"momentum_{k}": change("close", k) for k in (5, 10, 20)} | {"volume_change": change("volume", 1)}
    f |= {f"volatility_{k}": F.when(F.count("r").over(last(k)) == k, F.stddev_samp("r").over(last(k))) for k in (5, 10)}
    f |= {f"price_to_ma_{k}": F.when(F.count("close").over(last(k)) == k, F.try_divide(F.col("close"), F.avg("close").over(last(k))) - 1) for k in (10, 20)}
    f["hl_spread"] = F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    return d.withColumns({k: F.coalesce(x, F.lit(0.0)) for k, x in f.items()}).drop("r")


def nn_targets(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Adds target: 1 if the close ``horizon`` bars on is higher, else 0; the last bars, without one, are dropped."""
    later = F.lead("close", horizon).over(W.partitionBy("asset").orderBy("seq"))
    return bars.withColumn("later", later).where("later is not null").withColumn("target", (F.col("later") > F.col("close")).cast("int")).drop("later")


FEATURES = ["momentum_5", "momentum_10", "momentum_20", "volume_change", "volatility_5", "volatility_10", "price_to_ma_10", "price_to_ma_20", "hl_spread"]


def standardise(df: DataFrame, names: list[str], suffix: str = "", weight: float = 1.0) -> DataFrame:
    """Columns less their mean, per their population spread (1 where it is 0), times ``weight``."""
    about = df.agg(*(F.avg(k).alias(f"m_{k}") for k in names), *(F.stddev_pop(k).alias(f"s_{k}") for k in names))
    d = df.crossJoin(F.broadcast(about))  # one row
    return d.withColumns({f"{k}{suffix}": (F.col(k) - F.col(f"m_{k}")) / F.when(F.col(f"s_{k}") > 1e-12, F.col(f"s_{k}")).otherwise(1.0) * weight for k in names}).drop(*about.columns)


def train_classifier(df: DataFrame, features: list[str] = FEATURES, label: str = "target", layers: tuple[int, ...] = (100, 50), rounds: int = 500, seed: int = 42):
    """A fitted multilayer perceptron on features less their mean per population spread (1 where it is 0), in at most ``rounds`` rounds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import SQLTransformer

    a = df.agg(*(F.avg(k).alias(f"m{i}") for i, k in enumerate(features)), *(F.stddev_pop(k).alias(f"s{i}") for i, k in enumerate(features))).first()
    scaled = ", ".join(f"(`{k}` - {a[f'm{i}'] or 0.0!r}D) / {(a[f's{i}'] if (a[f's{i}'] or 0) > 1e-12 else 1.0)!r}D AS _x{i}" for i, k in enumerate(features))
    steps = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="x", handleInvalid="keep"), MultilayerPerceptronClassifier(featuresCol="x", labelCol=label, layers=[len(features), *layers, 2], maxIter=rounds, seed=seed)]
    return Pipeline(stages=steps).fit(df)


def predict_up(model, df: DataFrame) -> DataFrame:
    """Adds p_up, the probability of class 1; 0.5 where a feature isn't a number."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return model.transform(df).withColumn("p_up", F.when(F.isnan(p), 0.5).otherwise(p)).drop(*(c for c in model.transform(df.limit(0)).columns if c.startswith("_x")), "x", "rawPrediction", "probability", "prediction")


def fit_regimes(df: DataFrame, names: list[str], method: str = "gmm", k: int = 3, tries: int = 10, seed: int = 42) -> DataFrame:
    """Adds label (clusters in ascending order of their mean first feature), regime and confidence.

    gmm: the best of ``tries`` Gaussian mixtures by likelihood; kmeans: the best by cost,
    its confidence a softmax of the negative distances.
    """
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = VectorAssembler(inputCols=names, outputCol="x").transform(df)
    if method == "gmm":
        m = max((GaussianMixture(k=k, featuresCol="x", maxIter=100, seed=seed + i).fit(d) for i in range(tries)), key=lambda m: m.summary.logLikelihood)
        d = m.transform(d).withColumn("p", vector_to_array("probability"))
        order = np.argsort([g.mean[0] for g in m.gaussiansDF.select("mean").collect()])  # k rows
    elif method == "kmeans":
        m = min((KMeans(k=k, featuresCol="x", seed=seed + i).fit(d) for i in range(tries)), key=lambda m: m.summary.trainingCost)
        centres = np.array(m.clusterCenters())
        order = np.argsort(centres[:, 0])
        dist = [F.exp(-F.sqrt(sum(((F.col(n) - float(c[i])) ** 2 for i, n in enumerate(names)), F.lit(0.0)))) for c in centres]
        d = m.transform(d).withColumn("p", F.array(*(x / sum(dist[1:], dist[0]) for x in dist)))
    else:
        raise ValueError(f"Unknown method: {method}")
    place = {int(c): i for i, c in enumerate(order)}
    new = F.element_at(F.array(*(F.lit(place[c]) for c in range(len(order)))), F.col("prediction") + 1)
    regime_names = ["stable", "transitioning", "stressed"]
    named = F.element_at(F.array(*(F.lit(regime_names[i] if i < 3 else f"regime_{i}") for i in range(k))), F.col("label") + 1)
    return d.withColumn("label", new).withColumn("regime", named).withColumn("confidence", F.array_max("p")).drop("x", "p", "prediction", "probability")


# ---------------------------------------------------------------- ensembles


def ridge(df: DataFrame, names: list[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Exact ridge coefficients and intercept from one aggregation of the moments."""
    cols = [*names, target]
    a = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols)))).first()
    k = len(names)
    g = np.array([[a[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * a["n"]
    y = np.array([a[f"c{i}_{k}"] for i in range(k)]) * a["n"]
    w = np.linalg.solve(g + alpha * np.eye(k), y)
    return w, float(a[f"m{k}"] - sum(w[i] * a[f"m{i}"] for i in range(k)))


def weighted_average_weights(df: DataFrame, names: list[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge coefficients over the sum of their sizes: the ensemble's weights, used without intercept."""
    w, _ = ridge(df, names, target, alpha)
    total = np.abs(w).sum() or 1.0
    return {n: float(x / total) for n, x in zip(names, w, strict=True)}


def boosted(df: DataFrame, names: list[str], target: str, task: str = "regression", trees: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = GBTRegressor if task == "regression" else GBTClassifier
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), kind(featuresCol="x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]).fit(df)


def stacked_classifier(df: DataFrame, names: list[str], target: str):
    """Logistic regression with the penalty of one unit over all rows, on columns as they are."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    n = max(1, df.count())
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), LogisticRegression(featuresCol="x", labelCol=target, maxIter=1000, regParam=1.0 / n, standardization=False)]).fit(df)


def stacked_regressor(df: DataFrame, names: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Adds prediction: ridge stacking, the models' columns (``names``) weighted by exact ridge coefficients plus the intercept."""
    w, b = ridge(df, names, target, alpha)
    return df.withColumn("prediction", sum((F.col(n) * float(x) for n, x in zip(names, w, strict=True)), F.lit(b)))


def feature_importance(model, names: list[str]) -> dict[str, float]:
    """How much each input counts in a meta-model: weights (a dict) and linear coefficients by size, trees by their own importances."""
    if isinstance(model, dict):
        return {n: abs(model[n]) for n in names}
    last = model.stages[-1]
    v = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return {n: abs(float(x)) for n, x in zip(names, v.toArray(), strict=True)}


GLOBAL_0 = ("n", "max_persistence", "mean_persistence", "std_persistence", "persistence_entropy")
GLOBAL_1 = (*GLOBAL_0, "total_persistence")


def global_vector(h0: DataFrame, h1: DataFrame, more: list[str] = ()) -> DataFrame:  # noqa: B006
    """(window_id, vector): five numbers of dimension 0, six of dimension 1, then the columns ``more`` of h1; 0 for what is missing."""
    a = h0.select("window_id", *(F.col(k).alias(f"{k}_0") for k in GLOBAL_0))
    b = h1.select("window_id", *(F.col(k).alias(f"{k}_1") for k in (*GLOBAL_1, *more)))
    cols = [*(f"{k}_0" for k in GLOBAL_0), *(f"{k}_1" for k in (*GLOBAL_1, *more))]
    return a.join(b, "window_id", "full").select("window_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols)).alias("vector"))


def local_vector(values: DataFrame, parts: list[str]) -> DataFrame:
    """(window_id, vector): the columns ``parts`` of (window_id, node), one after another, each in the order of the nodes; 0 for nulls."""
    one = F.struct("node", *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in parts))
    rows = values.groupBy("window_id").agg(F.array_sort(F.collect_list(one)).alias("r"))  # a window's nodes
    return rows.select("window_id", F.concat(*(F.col(f"r.{k}") for k in parts)).alias("vector"))


def flatten_features(windows: DataFrame, features: dict[str, list[str]]) -> DataFrame:
    """Adds vector: the groups of ``features`` in the order of their names, each group's columns in their own order."""
    cols = [c for k in sorted(features) for c in features[k]]
    return windows.withColumn("vector", F.array(*(F.col(c).cast("double") for c in cols)))


def feature_names(local: list[str] | int, whole: list[str] | int) -> list[str]:
    """local_<name> and global_<name> of the fused columns; numbers where only their count is known."""
    listed = lambda x: range(x) if isinstance(x, int) else x
    return [f"local_{k}" for k in listed(local)] + [f"global_{k}" for k in listed(whole)]


class Fusion:
    """Local and global columns on one scale: ``fit`` takes means and spreads, ``transform`` applies them to any rows."""

    def __init__(self, local_weight: float = 0.5, global_weight: float = 0.5):
        self.weights, self.about = (local_weight, global_weight), None

    def fit(self, df: DataFrame, local: list[str], whole: list[str]) -> Fusion:
        cols = [(k, w) for names, w in zip((local, whole), self.weights, strict=True) for k in names]
        a = df.agg(*(F.avg(k).alias(f"m_{k}") for k, _ in cols), *(F.stddev_pop(k).alias(f"s_{k}") for k, _ in cols)).first()
        self.about = [(k, w, a[f"m_{k}"] or 0.0, a[f"s_{k}"] if (a[f"s_{k}"] or 0.0) > 1e-12 else 1.0) for k, w in cols]
        self.names = feature_names(local, whole)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds a column of each fused feature, by ``feature_names``."""
        if self.about is None:
            raise ValueError("the fusion must be fitted before it transforms")
        return df.withColumns({n: (F.col(k) - m) / s * w for n, (k, w, m, s) in zip(self.names, self.about, strict=True)})


def momentum_signals(returns: DataFrame, mean_over: int = 10, spread_over: int = 20) -> DataFrame:
    """Adds signal to (asset, seq, ret): tanh of the mean over the last ten returns per the spread of the last twenty; 0 where there are fewer."""
    w = W.partitionBy("asset").orderBy("seq")
    a, z = w.rowsBetween(1 - mean_over, 0), w.rowsBetween(1 - spread_over, 0)
    mean = F.when(F.count("ret").over(a) == mean_over, F.avg("ret").over(a))
    spread = F.when(F.count("ret").over(z) == spread_over, F.stddev_samp("ret").over(z))
    return returns.withColumn("signal", F.coalesce(F.tanh(F.try_divide(mean, spread)), F.lit(0.0)))


def ensemble(votes: DataFrame, by: list[str]) -> DataFrame:
    """weighted_avg, majority and max_confidence of (by, model_idx, signal, confidence, weight); ties go to the first model."""
    return votes.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("signal")), F.sum("weight")), F.lit(0.0)).alias("weighted_avg"), F.avg(F.signum("signal")).alias("majority"), F.max_by("signal", F.struct("confidence", -F.col("model_idx"))).alias("max_confidence"))


def portfolio_heat(df: DataFrame, by: list[str]) -> DataFrame:
    """Volatility of the positions weighted by their size: (by, heat) from position, value, volatility; 0 without positions."""
    size = F.abs(F.col("position") * F.col("value"))
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.abs(F.col("position") * F.col("value") * F.col("volatility"))), F.when(F.sum(size) > 0, F.sum(size))), F.lit(0.0)).alias("heat"))


def residuals(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(asset, seq, residual) of two tables (asset, seq, value); ValueError if their keys differ."""
    keys = ["asset", "seq"]
    a, e = actual.select(*keys, F.col("value").alias("x")), expected.select(*keys, F.col("value").alias("y"))
    both = a.join(e, keys, "full")
    odd = a.join(e, keys, "left_anti").limit(1).count() + e.join(a, keys, "left_anti").limit(1).count()
    if odd:
        raise ValueError("Shape mismatch: actual and expected have different keys")
    return both.select(*keys, (F.col("x") - F.col("y")).alias("residual"))
