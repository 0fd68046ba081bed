"""Configurations, the two models end to end, and validation runs over callables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import rules as R
from .operators import matrix as M
from .operators import strategy as X
from .operators import topology as T
from .session import cut
from .sources import panels as P

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class EngineConfig:
    window: int = 100
    edge_threshold: float = 0.3
    longest_edge: float = 2.0
    top_dim: int = 2
    baseline: int = 30
    n_std: float = 2.0
    instability_threshold: float = 0.5
    h0_threshold: float = 0.3
    h1_threshold: float = 0.2
    normalization: str = "max"
    hidden_layers: tuple[int, ...] = (100, 50)
    seed: int = 42


@dataclass(frozen=True)
class MutualConfig:
    window: int = 20
    expected_over: int = 10
    diffusion_time: float = 1.0
    detector: str = "gmm"
    regimes: int = 3
    local_weight: float = 0.5
    global_weight: float = 0.5
    base: float = 1.0
    top: float = 3.0
    low: float = 0.1
    multipliers: dict = field(default_factory=lambda: dict(R.POSITION_MULTIPLIERS))

    def __post_init__(self) -> None:
        if self.detector not in ("gmm", "kmeans", "rule_based"):
            raise ValueError(f"Unknown detector: {self.detector}")


@dataclass(frozen=True)
class WalkForwardConfig:
    train_months: int = 36
    test_months: int = 12
    step_months: int | None = None
    purge_pct: float = 0.02
    least_train: int = 100
    anchored: bool = True


@dataclass(frozen=True)
class StressConfig:
    simulations: int = 1000
    keep_correlation: bool = True
    block: int | None = None
    tolerance: float = 0.15
    validated: int = 10
    seed: int = 42


def topology_features(corr: DataFrame, distance: str, top_dim: int = 1, longest: float = float("inf")) -> DataFrame:
    """window_id and n, max, mean, std, total, entropy of dimensions 0 and 1 (suffixes 0 and 1)."""
    d = R.signed_distance("c") if distance == "signed" else R.abs_distance("c")
    g = cut(T.diagrams(corr.select("window_id", "i", "j", d.alias("d")), top_dim, longest))
    short = {"n": "n", "max_persistence": "max", "mean_persistence": "mean", "std_persistence": "std", "total_persistence": "total", "persistence_entropy": "entropy"}
    out = None
    for k in (0, 1):
        f = T.diagram_features(g, k, g)
        f = f.select("window_id", *(F.col(a).alias(f"{b}{k}") for a, b in short.items()))
        out = f if out is None else out.join(f, "window_id")
    return out


class GatedEngine:
    """A price model's probability gated by the market's topology, for every period at once.

    ``fit`` trains the classifier on the bars (asset, seq, open .. volume) of one asset,
    the first by name if none is given; ``predict`` scores all periods of the panel.
    """

    def __init__(self, config: EngineConfig = EngineConfig()):  # noqa: B008
        self.config, self.model, self.asset = config, None, None

    def fit(self, bars: DataFrame, asset: str | None = None, rounds: int = 500) -> GatedEngine:
        self.asset = asset or bars.agg(F.min("asset")).first()[0]
        f = cut(X.nn_targets(X.nn_features(bars.where(F.col("asset") == self.asset))))
        self.model = X.train_classifier(f, layers=self.config.hidden_layers, rounds=rounds, seed=self.config.seed)
        return self

    def predict(self, bars: DataFrame, lookback: int | None = None) -> DataFrame:
        """window_id, at, p, regime, score, leak, threshold, final_signal, confidence_score, interval, hedge, reason, reason_details."""
        if self.model is None:
            raise ValueError("the engine must be fitted before it predicts")
        c = self.config
        panel = P.with_returns(P.last_periods(bars.select("asset", "t", "seq", F.col("close").alias("price")), lookback))
        corr = cut(M.rolling_correlation(panel, c.window))
        edges, nodes = cut(M.threshold_edges(corr, c.edge_threshold)), cut(M.nodes_of(corr))
        g = M.graph_metrics(edges, nodes, M.components(edges, nodes)).select("window_id", R.leakage_score("density", "n_components", "avg_clustering").alias("leak"))
        s = topology_features(corr, "signed", c.top_dim, c.longest_edge).join(g, "window_id")
        regime = R.engine_regime("n0", "max0", "n1", "max1", c.h0_threshold, c.h1_threshold)
        names = [{k: f"{k}{d}" for k in ("max", "mean", "total")} for d in (0, 1)]
        s = s.withColumns({"regime": regime["regime"], "regime_confidence": regime["confidence"], "score": R.instability_score(*names, by=c.normalization, longest=c.longest_edge), "seq": F.col("window_id"), "_all": F.lit(0)})
        s = T.adaptive_threshold(s, ["_all"], c.baseline, c.n_std).drop("_all", "seq")
        up = X.predict_up(self.model, X.nn_features(bars.where(F.col("asset") == self.asset))).select(F.col("seq").alias("window_id"), F.col("t").cast("string").alias("at"), F.col("p_up").alias("p"))
        s = s.join(up, "window_id").withColumns(R.gate("p", "score", "regime", leak="leak", threshold="threshold", baseline="baseline_mean", adaptive="adaptive", n0="n0", max1="max1", static=c.instability_threshold))
        lo, hi = R.confidence_interval("p", "confidence_score")
        h = R.hedge("score", "leak", "regime")
        return s.withColumns({"confidence_interval": F.array(lo, hi), "suggested_hedge": F.struct(h["instrument"].alias("instrument"), h["ratio"].alias("ratio"))})


class MutualModel:
    """Mispricings spread over the correlation graph, fused with topology into regimes and positions."""

    def __init__(self, config: MutualConfig = MutualConfig()):  # noqa: B008
        self.config = config

    def run(self, panel: DataFrame) -> DataFrame:
        """window_id, asset, residual, heat, signal, regime, confidence, stability, position from (asset, seq, ret)."""
        c = self.config
        corr = cut(M.rolling_correlation(panel, c.window))
        nodes = cut(M.nodes_of(corr))
        w = W.partitionBy("asset").orderBy("seq").rowsBetween(1 - c.expected_over, 0)
        r = panel.where("ret is not null").withColumn("x", F.col("ret") - F.avg("ret").over(w)).select(F.col("seq").alias("window_id"), F.col("asset").alias("node"), "x")
        start = cut(nodes.join(r, ["window_id", "node"]))
        lap = M.laplacian(corr.select("window_id", "i", "j", F.abs("c").alias("w")), nodes)
        heat = M.heat_diffusion(lap, nodes, start, c.diffusion_time).withColumnRenamed("x", "heat")
        raw = cut(start.join(heat, ["window_id", "node"]))
        z = F.col("x") * F.col("heat")
        raw = raw.withColumn("signal", F.tanh(z / (F.stddev_pop(z).over(W.partitionBy("window_id")) + 1e-8)))
        topo = topology_features(corr, "abs")
        local = raw.groupBy("window_id").agg(F.avg(F.abs("x")).alias("residual_size"), F.avg(F.abs("heat")).alias("heat_size"))
        f = cut(topo.join(local, "window_id"))
        if c.detector == "rule_based":
            f = f.withColumns(R.rule_regime("n0", "max1"))
        else:
            names = ["max0", "mean0", "entropy0", "max1", "total1"]
            scaled = X.standardise(f, names, "_f", c.global_weight)
            scaled = cut(X.standardise(scaled, ["residual_size", "heat_size"], "_f", c.local_weight))
            f = X.fit_regimes(scaled, [f"{k}_f" for k in [*names, "residual_size", "heat_size"]], c.detector, c.regimes)
        f = f.withColumn("stability", R.stability_score("n0", "max0", "n1", "max1"))
        out = raw.join(f.select("window_id", "regime", "confidence", "stability"), "window_id")
        return out.select("window_id", F.col("node").alias("asset"), F.col("x").alias("residual"), "heat", "signal", "regime", "confidence", "stability", R.position_size("signal", "stability", "regime", "confidence", c.base, c.top, c.low, c.multipliers).alias("position"))


    def risk_adjusted(self, details: DataFrame, signals: DataFrame) -> DataFrame:
        """(window_id, asset, position): another model's signals (window_id, asset, signal) sized by the regime and stability that ``run`` found."""
        c = self.config
        d = details.select("window_id", "regime", "confidence", "stability").distinct()
        return signals.join(d, "window_id").select("window_id", "asset", R.position_size("signal", "stability", "regime", "confidence", c.base, c.top, c.low, c.multipliers).alias("position"))


def market_signal(signals: DataFrame) -> DataFrame:
    """(window_id, signal): the mean over all assets of the window."""
    return signals.groupBy("window_id").agg(F.avg("signal").alias("signal"))


def rolling_fits(signals: DataFrame, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame], train: int, test: int) -> DataFrame:
    """Backtest metrics of a model fitted anew on ``train`` periods and used on the ``test`` periods after them, window by window.

    ``fit`` takes (asset, seq, ret), ``predict`` adds signal. The windows are a loop of
    the driver, as each fits a model; their backtests are one job.
    """
    end = signals.agg(F.max("seq")).first()[0]
    out = None
    for k, at in enumerate(range(train, (-1 if end is None else int(end)) + 1 - test + 1, test)):
        model = fit(signals.where((F.col("seq") >= at - train) & (F.col("seq") < at)))
        x = predict(model, signals.where((F.col("seq") >= at) & (F.col("seq") < at + test))).select(F.lit(f"{k:04d}").alias("strategy"), "asset", (F.col("seq") - at).alias("seq"), "ret", "signal")
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("the panel is shorter than one training and one test stretch")
    return X.backtest_metrics(X.backtest(out), ["strategy"])


Train, Predict, Metric = Callable[[DataFrame], object], Callable[[object, DataFrame], DataFrame], Callable[[DataFrame], dict[str, float]]


def walk_forward(panel: DataFrame, splits: DataFrame, train: Train, predict: Predict, metric: Metric) -> DataFrame:
    """(split_id, metric, value) of every split's test; a failing split is logged and left out, none left is a ValueError.

    The splits, a handful of rows, are a loop of the driver, as each fits a model; the
    data stay where they are.
    """
    rows = []
    for s in splits.orderBy("split_id").collect():
        train_rows = panel.where((F.col("seq") >= s["train_start"]) & (F.col("seq") < s["train_end"]) & ~((F.col("seq") >= s["purge_start"]) & (F.col("seq") < s["purge_end"])))
        test_rows = panel.where((F.col("seq") >= s["test_start"]) & (F.col("seq") < s["test_end"]))
        try:
            found = metric(predict(train(train_rows), test_rows))
        except Exception:  # noqa: BLE001
            log.warning("split %s failed", s["split_id"], exc_info=True)
            continue
        rows += [(s["split_id"], k, float(v)) for k, v in found.items()]
    if not rows:
        raise ValueError("no split succeeded")
    return panel.sparkSession.createDataFrame(rows, "split_id bigint, metric string, value double")


def stress(panel: DataFrame, evaluate: Callable[[DataFrame], DataFrame], method: str = "bootstrap", config: StressConfig = StressConfig()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(per-metric summary, robustness) of ``evaluate`` over simulated panels against the panel itself.

    ``evaluate`` takes rows (sim_id, seq, asset, ret) of all simulations and gives
    (sim_id, metric, value): one job for all of them. A value that is null or not a
    number is a failed simulation and left out; if all of a metric are, it has no row.
    """
    sims = cut(X.simulate(panel, method, config.simulations, config.seed, config.block, config.keep_correlation))
    real = evaluate(panel.where("ret is not null").select(F.lit(0).cast("bigint").alias("sim_id"), "seq", "asset", "ret"))
    summary = cut(X.stress_aggregate(evaluate(sims).where("value is not null and not isnan(value)"), cut(real.select("metric", F.col("value").alias("original")))))
    return summary, X.robustness(summary)


def validate_correlation(panel: DataFrame, sims: DataFrame, config: StressConfig = StressConfig()) -> DataFrame:  # noqa: B008
    """sim_id, max_diff, mean_diff, is_valid of the first simulations, how well they keep the correlations."""
    s = sims.where(F.col("sim_id") < config.validated)
    pairs = s.select("sim_id", "seq", F.col("asset").alias("i"), F.col("ret").alias("x")).join(s.select("sim_id", "seq", F.col("asset").alias("j"), F.col("ret").alias("y")), ["sim_id", "seq"]).where("i < j")
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    c1 = pairs.groupBy("sim_id", "i", "j").agg(F.try_divide(F.covar_pop("x", "y"), F.when(sd > 0, sd)).alias("c1"))
    d = c1.join(M.correlation_matrix(panel).withColumnRenamed("c", "c0"), ["i", "j"]).withColumn("d", F.abs(F.col("c1") - F.col("c0")))
    return d.groupBy("sim_id").agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff")).withColumn("is_valid", F.col("max_diff") <= config.tolerance)
