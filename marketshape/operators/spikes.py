"""Implausible readings in bars, judged against the usual behaviour of their own source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import DAY_ONE, cut, micros, number


SCORES = ("close_score", "high_score", "low_score", "volume_score")

#: Where each score's tail starts. Log volumes have a normal shoulder: from lower down their tail seems to end too soon.
STARTS = {"close_score": 0.95, "high_score": 0.95, "low_score": 0.95, "volume_score": 0.98}


def _median(a: Column) -> Column:
    """The middle of a short array; the lower of the two middles if their number is even; null if empty."""
    return F.when(F.size(a) > 0, F.element_at(F.sort_array(a), F.floor((F.size(a) + 1) / 2).cast("int")))


def bar_scores(bars: DataFrame, steps: DataFrame, near: int = 5, block_steps: int = 2048, halo_steps: int = 64) -> DataFrame:
    """Scores and rule marks of every bar with a usable time.

    A source is cut into blocks of ``block_steps`` grid steps, each with ``halo_steps``
    of its neighbours on both sides, so no task holds a whole source, however hot;
    readings farther apart than the halo aren't each other's neighbours.

    * close_score: distance in logs to the median of the ``near`` readings before and
      after (within 3 ``near`` steps), the smaller of the two, 0 where they lie on
      different sides of the bar (a move that lasts is near its successors);
    * high_score, low_score: how far the wick leaves the body, in logs;
    * volume_score: log of the volume over the larger of the source's median at that
      hour and the median around the bar (a day of high volume has high neighbours);
    * impossible: values that no bar can have;
    * flat, same: the price in all four fields, or the positive volume, is the one before;
      block, price_part and volume_part number the runs of such bars, which ``stuck_runs``
      counts. Those of the neighbouring blocks come along with own false.

    Nulls and NaN make the scores that need them null and never make a bar impossible.
    Readings of the same moment are no neighbours of each other.
    """
    us = micros("ts")
    step = F.coalesce(F.when(F.col("bar_minutes") > 0, F.col("bar_minutes")), F.lit(60)).cast("long") * 60_000_000
    b = (
        bars.where(us >= DAY_ONE)
        .select("bar_id", "asset", us.alias("us"), *(number(f"{x}_price").alias(x[0]) for x in ("open", "high", "low", "close")), F.col("volume").alias("v"))
        .join(cut(steps.groupBy("asset").agg(F.min("bar_minutes").alias("bar_minutes"))), "asset", "left")
        .withColumn("pos", (F.col("us") / step * 1_000_000).cast("long"))  # millionths of a step
        .drop("bar_minutes")
    )
    hour = F.floor(F.col("us") / 3_600_000_000) % 24
    usual = cut(b.where("v > 0").groupBy("asset", hour.alias("hour")).agg(F.percentile_approx(F.ln("v"), 0.5, 500).alias("usual")))
    size, halo = block_steps * 1_000_000, halo_steps * 1_000_000
    first, own, last = (F.floor((F.col("pos") + d) / size) for d in (-halo, 0, halo))
    cut_up = b.withColumn("own", own).withColumn("block", F.explode(F.array_distinct(F.array(first, "own", last))))

    w = W.partitionBy("asset", "block").orderBy("pos")
    far = 3 * near * 1_000_000
    before, after = w.rangeBetween(-far, -1), w.rangeBetween(1, far)
    lists = {"cb": F.reverse(F.collect_list("lc").over(before)), "ca": F.collect_list("lc").over(after), "vb": F.reverse(F.collect_list("lv").over(before)), "va": F.collect_list("lv").over(after)}
    rep = F.coalesce(F.lag("pos").over(w) != F.col("pos"), F.lit(True))
    earlier = w.rangeBetween(W.unboundedPreceding, -1)
    d = (
        cut_up.withColumns({f"l{x}": F.when(F.col(x) > 0, F.ln(x)) for x in "cv"})
        .withColumns({k: _median(F.slice(x, 1, near)) for k, x in lists.items()} | {"rep": rep})
        .withColumns({"pc": F.last(F.when(F.col("rep"), F.struct("c")), True).over(earlier)["c"], "pv": F.last(F.when(F.col("rep"), F.struct("v")), True).over(earlier)["v"]})
        .withColumns({"flat": F.coalesce((F.col("c") == F.col("pc")) & (F.col("o") == F.col("c")) & (F.col("h") == F.col("c")) & (F.col("l") == F.col("c")), F.lit(False)), "same": F.coalesce((F.col("v") > 0) & (F.col("v") == F.col("pv")), F.lit(False))})
        .withColumns({k: F.sum(F.when(F.col("rep") & ~F.col(x), 1).otherwise(0)).over(w.rangeBetween(W.unboundedPreceding, 0)) for k, x in (("price_part", "flat"), ("volume_part", "same"))})
        .where("block = own or flat or same")
    )
    v = F.col("lv")
    up, down = F.col("lc") - F.col("cb"), F.col("lc") - F.col("ca")
    close = F.when(up.isNull() | down.isNull(), F.least(F.abs(up), F.abs(down))).when(up * down <= 0, 0.0).otherwise(F.least(F.abs(up), F.abs(down)))
    body = [F.when(F.col(k) > 0, F.col(k)) for k in ("o", "c")]
    quiet = F.greatest("vb", "va", "usual")
    negative = (F.least("o", "h", "l", "c") <= 0) | (F.col("v") < 0) | (F.col("h") < F.col("l")) | (F.col("c") > F.col("h")) | (F.col("c") < F.col("l"))
    return d.withColumn("hour", hour).join(usual, ["asset", "hour"], "left").select(
        "bar_id", "asset", F.col("hour").cast("byte").alias("hour"), close.cast("float").alias("close_score"),
        F.greatest(F.ln(F.when(F.col("h") > 0, F.col("h")) / F.greatest(*body)), F.lit(0.0)).cast("float").alias("high_score"),
        F.greatest(F.ln(F.least(*body) / F.when(F.col("l") > 0, F.col("l"))), F.lit(0.0)).cast("float").alias("low_score"),
        F.when(quiet.isNotNull(), F.greatest(v - quiet, F.lit(0.0))).cast("float").alias("volume_score"),
        F.coalesce(negative, F.lit(False)).alias("impossible"),
        (F.col("block") == F.col("own")).alias("own"), "block", "rep", "flat", "same", F.col("price_part").cast("int").alias("price_part"), F.col("volume_part").cast("int").alias("volume_part"),
    )


def stuck_runs(scores: DataFrame) -> DataFrame:
    """The scores of the bars, each once, with price_run and volume_run, 0 outside runs; only the rows in runs are counted and joined."""
    d = scores.where("own")
    for mark, part, run in (("flat", "price_part", "price_run"), ("same", "volume_part", "volume_run")):
        runs = cut(scores.where(F.col(mark) & F.col("rep")).groupBy("asset", "block", F.col(part).alias("_part")).agg(F.count(F.lit(1)).cast("int").alias(run)))
        d = d.withColumn("_part", F.when(F.col(mark), F.col(part))).join(runs, ["asset", "block", "_part"], "left").withColumn(run, F.coalesce(run, F.lit(0))).drop("_part")
    return d.drop("own", "block", "rep", "flat", "same", "price_part", "volume_part")


def hourly_scores(scores: DataFrame) -> DataFrame:
    """Every source's median scores by hour of the day; the volume's score is against that already."""
    return cut(scores.where("own").groupBy("asset", "hour").agg(*(F.percentile_approx(k, 0.5, 200).alias(f"_{k}") for k in SCORES[:3])))


def seasonal_residuals(scores: DataFrame, usual: DataFrame) -> DataFrame:
    """Scores less their source's median at that hour."""
    d = scores.join(usual, ["asset", "hour"], "left")
    return d.withColumns({k: F.col(k) - F.coalesce(f"_{k}", F.lit(0.0)) for k in SCORES[:3]}).drop(*(f"_{k}" for k in SCORES[:3]))


def tail_fits(residuals: DataFrame, risk: float = 1e-6, starts: dict[str, float] = STARTS, gross: float = 20.0, prior: float = 2000.0, bin_width: float = 0.05) -> DataFrame:
    """(asset, score, n, exceedances, threshold, scale, shape, cutoff): peaks over threshold, fitted per source and score.

    The tail beyond a source's own ``starts`` quantile is taken as generalised Pareto.
    Its shape comes from the probability-weighted moments of the source's exceedances,
    its scale from their mean given the shape. Exceedances beyond ``gross`` times their
    median are left out of the moments, as the faults sought would make any tail heavy
    (an exponential tail has one in a million there). A source of few exceedances has an
    unsure shape, so it is drawn to the mean of all sources (weighted by exceedances) as
    if that were ``prior`` exceedances more. cutoff is the residual that a usual reading
    exceeds with probability ``risk``, the same for every source and size of input.

    Moments are sums over bins of a ``bin_width``-th of the median exceedance, at most
    gross / bin_width rows per source and score, so no source is sorted in one task.
    Sources whose scores don't vary have no row; nulls count nowhere.
    """
    q = cut(residuals.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(s, F.array(F.lit(starts[s]), F.lit((1 + starts[s]) / 2)), 2000).alias(f"q_{s}") for s in SCORES)))
    d = residuals.select("asset", *SCORES).join(q.drop("n"), "asset")

    def exceedance(s: str) -> Column:
        u, m = F.col(f"q_{s}")[0], F.col(f"q_{s}")[1] - F.col(f"q_{s}")[0]
        y = (F.col(s) - u) / F.when(m > 0, m)
        return F.when((y > 0) & (y <= gross), F.struct(F.lit(s).alias("score"), y.cast("double").alias("y")))

    y = d.select("asset", F.explode(F.array_compact(F.array(*map(exceedance, SCORES)))).alias("e")).select("asset", "e.*")
    bins = y.groupBy("asset", "score", F.floor(F.col("y") / bin_width).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("t"))
    w = W.partitionBy("asset", "score")
    below = F.sum("c").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("c") / 2
    bins = bins.withColumn("above", 1 - below / F.sum("c").over(w))
    fit = cut(bins.groupBy("asset", "score").agg(F.sum("c").alias("exceedances"), (F.sum("t") / F.sum("c")).alias("a0"), (F.sum(F.col("t") * F.col("above")) / F.sum("c")).alias("a1")))
    own = F.greatest(F.lit(-1.0), F.least(F.lit(0.9), 2 - F.try_divide("a0", F.col("a0") - 2 * F.col("a1"))))  # where its moments exist
    pooled = fit.groupBy("score").agg(F.try_divide(F.sum(own * F.col("exceedances")), F.sum("exceedances")).alias("pooled"))  # one row per score
    k = F.col("exceedances")
    fit = fit.withColumn("own", own).join(F.broadcast(pooled), "score").withColumn("shape", (k * F.coalesce("own", "pooled", F.lit(0.0)) + prior * F.coalesce("pooled", F.lit(0.0))) / (k + prior))
    long = q.select("asset", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.lit(1 - starts[s]).alias("tail"), F.col(f"q_{s}")[0].cast("double").alias("threshold"), (F.col(f"q_{s}")[1] - F.col(f"q_{s}")[0]).cast("double").alias("unit")) for s in SCORES))).alias("s")).select("asset", "n", "s.*")
    xi = F.when(F.abs("shape") < 1e-4, 1e-4).otherwise(F.col("shape"))
    fit = fit.join(long, ["asset", "score"]).withColumn("scale", F.col("unit") * F.col("a0") * (1 - xi))
    return fit.select("asset", "score", "n", "exceedances", "threshold", "scale", "shape", (F.col("threshold") + F.col("scale") / xi * (F.pow(F.col("tail") / risk, xi) - 1)).alias("cutoff"))


def fitted_tails(bars: DataFrame, steps: DataFrame, risk: float = 1e-6) -> DataFrame:
    """``tail_fits`` of the bars' seasonal residuals."""
    s = cut(bar_scores(bars, steps))
    return tail_fits(seasonal_residuals(s.where("own"), hourly_scores(s)), risk)


def flag_spikes(bars: DataFrame, steps: DataFrame, risk: float = 1e-6, least_score: float = 0.01, least_run: int = 4) -> DataFrame:
    """(bar_id, asset, reasons, implausible) of every bar with a usable time.

    reasons lists what holds of: impossible_value, close_spike, high_spike, low_spike,
    volume_spike, stuck_price, stuck_volume; a seasonal residual is a spike beyond its
    source's cutoff (``tail_fits``), though never below ``least_score``. A value is
    stuck from its second reading on where it stands for more readings in a row than the
    source shows by chance: for a tie probability of p among its n readings that is
    log(n / 0.001) / log(1 / p) repeats, and at least ``least_run``. Empty input gives
    no rows; null values alone flag nothing; every redelivered row is judged by itself;
    of a source with several bar lengths in ``steps`` the shortest counts.
    """
    s = cut(bar_scores(bars, steps))
    usual = hourly_scores(s)
    cuts = tail_fits(seasonal_residuals(s.where("own"), usual), risk).groupBy("asset").agg(*(F.max(F.when(F.col("score") == k, F.col("cutoff"))).alias(f"{k}_cut") for k in SCORES))
    runs = stuck_runs(s.where("flat or same")).groupBy("asset").agg(*(F.sum(F.when(F.col(k) > 0, 1 / F.col(k))).alias(f"{k}s") for k in ("price_run", "volume_run")))
    cuts = cut(s.where("own").groupBy("asset").agg(F.count(F.lit(1)).alias("n")).join(cuts, "asset", "left").join(runs, "asset", "left"))

    def stuck(k: str) -> Column:
        p = F.greatest(F.coalesce(F.col(f"{k}s"), F.lit(0.0)), F.lit(1.0)) / F.greatest(F.col("n"), F.lit(2))
        return F.col(k) >= F.greatest(F.lit(least_run), F.ceil(F.log(F.col("n") / 0.001) / F.log(1 / F.least(p, F.lit(0.2)))))

    reasons = {"impossible_value": F.col("impossible")} | {f"{k.removesuffix('_score')}_spike": F.col(k) > F.greatest(F.col(f"{k}_cut"), F.lit(least_score)) for k in SCORES} | {"stuck_price": stuck("price_run"), "stuck_volume": stuck("volume_run")}
    found = F.array_compact(F.array(*(F.when(x, k) for k, x in reasons.items())))
    return seasonal_residuals(stuck_runs(s), usual).join(cuts, "asset").select("bar_id", "asset", found.alias("reasons"), (F.size(found) > 0).alias("implausible"))
