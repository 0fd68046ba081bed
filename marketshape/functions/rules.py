"""Scalar rules of regimes, risk, gating and hedging as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and weights by regime.
POSITION_MULTIPLIERS = {"stable": 1.5, "transitioning": 1.0, "stressed": 0.3}
REGIME_WEIGHTS = {"Stable": 1.0, "Trending": 0.8, "Fragmented": 0.3, "Stressed": 0.1}
HEDGE_MULTIPLIERS = {"Stable": 0.5, "Trending": 0.7, "Fragmented": 1.2, "Stressed": 1.5}
HEDGE_INSTRUMENTS = {"Stable": "CASH", "Trending": "SECTOR_ETF", "Fragmented": "VX_FUT", "Stressed": "VX_FUT"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def pick(of: str | Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(col(of) == k, F.lit(v)).otherwise(out)
    return out


def abs_distance(c: str | Column) -> Column:
    """1 - |correlation|."""
    return 1 - F.abs(col(c))


def signed_distance(c: str | Column) -> Column:
    """sqrt(2 (1 - correlation)), the difference held within 0 and 2."""
    return F.sqrt(2 * clip(1 - col(c), 0.0, 2.0))


def position_size(signal, score, regime, confidence, base: float = 1.0, top: float = 3.0, low: float = 0.1, multipliers: dict = POSITION_MULTIPLIERS) -> Column:
    """The signal times its leverage: more with a stable topology, a calm regime and confidence."""
    lever = (base + (top - base) * col(score)) * pick(regime, multipliers, 1.0) * col(confidence)
    return col(signal) * clip(lever, low, top)


def stability_score(n0, max0, n1, max1) -> Column:
    """High is stable: few and long-lived components, one loop scale near 0.2; n1 isn't used."""
    h0 = F.when(col(n0) > 0, 0.5 / (1 + col(n0))).otherwise(0.0) + 0.5 * F.least(col(max0), F.lit(1.0))
    h1 = F.greatest(F.lit(0.0), 1 - F.abs(col(max1) - 0.2) / 0.2)
    return clip(0.4 * h0 + 0.6 * h1, 0.0, 1.0)


def stop_and_target(price, position, volatility, score) -> tuple[Column, Column]:
    """Stop-loss and take-profit; a position of 0 counts as short."""
    side = F.when(col(position) > 0, 1.0).otherwise(-1.0)
    return col(price) - side * col(volatility) * (2 - col(score)), col(price) + side * col(volatility) * (2 + col(score))


def heat_adjusted(position, heat, most: float = 0.2) -> Column:
    """The position scaled down as the portfolio's heat nears its limit, halved beyond."""
    return F.when(col(heat) >= most, 0.5 * col(position)).otherwise(col(position) * F.least(F.lit(1.0), (most - col(heat)) / most))


def kelly(win, payoff, score, fraction: float = 0.25) -> Column:
    """Fractional Kelly stake scaled by the stability score; 0 without a payoff."""
    f = (col(win) * col(payoff) - (1 - col(win))) / F.when(col(payoff) > 0, col(payoff))
    return F.coalesce(F.when(col(payoff) > 0, clip(f, 0.0, 1.0) * fraction * col(score)), F.lit(0.0))


def rule_regime(n, m, few: int = 2, many: int = 4, low: float = 0.05, high: float = 0.2) -> dict[str, Column]:
    """Regime and confidence from component count and loop persistence.

    Each half of a regime's test that holds scores a half; ties go to stable, then to
    transitioning; without any score the regime is stable with a third.
    """
    n, m = col(n), col(m)
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    s = half(n <= few) + half(m < low)
    t = half((n > few) & (n < many)) + half((m > low) & (m < high))
    x = half(n >= many) + half(m > high)
    total = s + t + x
    best = F.when((s >= t) & (s >= x), "stable").when(t >= x, "transitioning").otherwise("stressed")
    return {"regime": best, "confidence": F.when(total > 0, F.greatest(s, t, x) / total).otherwise(1 / 3)}


def described_regime(n, loops, m, clusters: int = 3, persistence: float = 0.1) -> Column:
    apart, cycles = col(n) >= clusters, (col(loops) > 0) & (col(m) >= persistence)
    return F.when(apart & cycles, "Fragmented with feedback loops").when(apart, "Fragmented (multiple clusters)").when(cycles, "Connected with feedback loops").otherwise("Unified (single connected market)")


def engine_regime(n0, max0, loops, max1, h0: float = 0.3, h1: float = 0.2) -> dict[str, Column]:
    """Stable, Fragmented, Trending (loops alone) or Stressed (loops in a fragmented market), with a confidence."""
    apart, cycles = (col(n0) > 3) | (col(max0) > h0), (col(loops) > 0) & (col(max1) > h1)
    conf = F.when(cycles, F.least(col(max1) / h1, F.lit(1.0))).when(apart, F.least(col(max0) / h0, F.lit(1.0))).otherwise(1.0)
    return {"regime": F.when(apart & cycles, "Stressed").when(cycles, "Trending").when(apart, "Fragmented").otherwise("Stable"), "confidence": conf}


def instability_score(h0: dict[str, str], h1: dict[str, str], by: str = "max", longest: float = 2.0) -> Column:
    """High is unstable: ``by`` max the larger, mean or total the mean of both dimensions' values, per ``longest`` edge."""
    if by not in ("max", "mean", "total"):
        raise ValueError(f"Unknown normalization: {by}")
    a, b = col(h0[by]), col(h1[by])
    return F.least((F.greatest(a, b) if by == "max" else (a + b) / 2) / longest, F.lit(1.0))


def leakage_score(density, components, clustering) -> Column:
    """How much a thin, split or loosely knit graph lets signals leak."""
    return F.least(0.4 * (1 - col(density)) + F.when(col(components) > 1, 0.3 * F.least(col(components) / 5, F.lit(1.0))).otherwise(0.0) + 0.3 * (1 - col(clustering)), F.lit(1.0))


def gate(p, score, regime, leak=None, threshold=None, baseline=None, adaptive=None, n0=None, max1=None, static: float = 0.5) -> dict[str, Column]:
    """The model's probability gated by topology: final_signal, confidence_score, reason, reason_details.

    Above the threshold (the adaptive one where ``adaptive`` holds, else ``static``) the
    signal is neutral; below, the probability is drawn to 0.5 by the regime's weight.
    """
    p, score, weight = col(p), col(score), pick(regime, REGIME_WEIGHTS, 0.5)
    own = col(adaptive) if adaptive is not None else F.lit(False)
    limit = F.when(own, col(threshold)).otherwise(static) if threshold is not None else F.lit(static)
    odd = F.round(score - limit, 9) > 0
    drawn = F.round(0.5 + (p - 0.5) * weight, 9)
    signal = F.when(odd, "NEUTRAL").when(drawn > 0.55, "LONG").when(drawn < 0.45, "SHORT").otherwise("NEUTRAL")
    reason = F.when(odd, "H1_instability_exceeded_threshold").when(drawn > 0.55, "NN_prediction_bullish").when(drawn < 0.45, "NN_prediction_bearish").otherwise("NN_prediction_neutral")
    conf = F.when(odd, 0.2).otherwise((F.abs(p - 0.5) * 2 * 0.6 + (1 - score) * 0.4) * weight)
    said = [F.when(own, F.format_string("adaptive_threshold=%.3f", limit)).otherwise(F.format_string("static_threshold=%.3f", limit))]
    if baseline is not None:
        said.append(F.when(own, F.format_string("baseline_mean=%.3f", col(baseline))))
    if max1 is not None:
        said.append(F.when(odd & (col(max1) > 0.2), F.format_string("H1_max_persistence=%.3f", col(max1))))
    if n0 is not None:
        said.append(F.when(odd & (col(n0) > 3), F.format_string("H0_fragmentation=%d_clusters", col(n0))))
    said += [F.when(~odd, F.format_string("nn_proba=%.3f", p)), F.when(~odd, F.concat(F.lit("regime="), col(regime))), F.when(~odd, F.format_string("regime_weight=%.2f", weight))]
    if leak is not None:
        lost = F.when(col(leak) > 0.5, 0.2 * col(leak)).otherwise(0.0)
        conf = F.greatest(conf * (1 - lost), F.lit(0.0))
        said.append(F.when(col(leak) > 0.5, F.format_string("graph_leakage_penalty=%.3f", lost)))
    return {"final_signal": signal, "confidence_score": F.least(conf, F.lit(1.0)), "reason": reason, "reason_details": F.array_compact(F.array(*said))}


def confidence_interval(p, confidence) -> tuple[Column, Column]:
    half = (1 - col(confidence)) * 0.5
    return F.greatest(F.lit(0.0), col(p) - half), F.least(F.lit(1.0), col(p) + half)


def hedge(score, leak, regime) -> dict[str, Column]:
    ratio = F.least((col(score) + col(leak)) / 2 * pick(regime, HEDGE_MULTIPLIERS, 1.0), F.lit(1.0))
    return {"instrument": pick(regime, HEDGE_INSTRUMENTS, "CASH"), "ratio": F.bround(ratio, 3)}


def combined_signal(a, conf_a, b, conf_b, how: str = "weighted") -> Column:
    """Two signals as one: weighted by confidence, the more confident one (ties: the second), or their mean."""
    a, b, ca, cb = col(a), col(b), col(conf_a), col(conf_b)
    if how == "weighted":
        return F.when(ca + cb > 0, (ca * a + cb * b) / (ca + cb)).otherwise((a + b) / 2)
    if how == "max":
        return F.when(ca > cb, a).otherwise(b)
    if how == "average":
        return (a + b) / 2
    raise ValueError(f"Unknown method: {how}")


def threshold_signal(p, threshold: float = 0.5) -> Column:
    """1 above the threshold, -1 below its complement, else 0."""
    return F.when(col(p) > threshold, 1).when(col(p) < 1 - threshold, -1).otherwise(0)
