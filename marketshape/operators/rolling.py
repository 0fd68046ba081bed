"""Totals and averages over trailing days, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SUM, COUNT = "decimal(38,10)", "bigint"


def daily_amounts(events: DataFrame, fields: list[str]) -> DataFrame:
    """Sums (exact decimals) and counts per entity and day: the only pass over the events."""
    return events.where("entity is not null and day is not null").groupBy("entity", "day").agg(*(F.sum(F.col(k).cast("decimal(24,10)")).alias(f"{k}_s") for k in fields), *(F.count(k).alias(f"{k}_n") for k in fields), F.max(F.coalesce("active", F.lit(False))).alias("active"), F.max("in_span").alias("in_span"))


def days_between(span: DataFrame, first: str, last: str, day: str, *keep: str) -> DataFrame:
    """A row for every day from ``first`` to ``last``, by months and their days, so that no array is long, however wide the span."""
    month = F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("_month")
    days = F.explode(F.sequence(F.greatest("_month", first), F.least(F.last_day("_month"), last))).alias(day)
    return span.select(*keep, first, last, month).select(*keep, days)


def trailing_totals(daily: DataFrame, fields: list[str], windows: tuple[int, ...] = (7, 30), places: int = 10) -> DataFrame:
    """For each entity and day of its span: active, and total_<field>_<w> and avg_<field>_<w> over the last w days.

    Every daily amount is an event of its own day that adds, and w days later one that
    subtracts; the running sums of these deltas are the totals, in exact decimals, so
    nothing drifts and an emptied window is exactly 0. Averages are per reading, null
    where the window has none. Totals and averages are rounded half up at ``places`` as
    decimals and only then made doubles. active tells whether the day itself had
    activity: the same deltas of an amount of 1 a day with activity, over one day.

    The span runs from an entity's first to its last day with in_span; an entity without
    one isn't listed. After the daily sums an entity has at most a row per calendar day
    and delta, whatever it had of events. Nulls add nothing; no rows give no rows.

    Input: entity, day (date), <field>_s, <field>_n, active, in_span.
    """
    of = {f"{k}_{p}_{w}": (f"{k}_{p}", w, SUM if p == "s" else COUNT) for w in windows for k in fields for p in "sn"} | {"active_1": ("active", 1, COUNT)}
    zero = {n: F.lit(0).cast(t) for n, (_, _, t) in of.items()}

    def delta(after: int, sign: int) -> DataFrame:
        amounts: list[Column] = []
        for n, (c, w, t) in of.items():
            x = F.coalesce(F.col(c).cast("int").cast(t) if c == "active" else F.col(c).cast(t), zero[n])
            x = -x if sign < 0 else x  # not times the sign: a product of decimals loses places
            amounts.append((x if after in (0, w) else zero[n]).alias(n))
        return daily.select("entity", F.date_add("day", after).alias("day"), *amounts, F.lit(False).alias("listed"))

    deltas = delta(0, 1)
    for w in sorted({1, *windows}):
        deltas = deltas.unionByName(delta(w, -1))
    span = daily.where("in_span").groupBy("entity").agg(F.min("day").alias("_a"), F.max("day").alias("_z"))
    days = days_between(span, "_a", "_z", "day", "entity").select("entity", "day", *(z.alias(n) for n, z in zero.items()), F.lit(True).alias("listed"))
    d = deltas.unionByName(days).groupBy("entity", "day").agg(*(F.sum(n).cast(t).alias(n) for n, (_, _, t) in of.items()), F.max("listed").alias("listed"))
    run = W.partitionBy("entity").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({n: F.sum(n).over(run) for n in of}).where("listed")
    out: list[Column] = [(F.col("active_1") > 0).alias("active")]
    for k in fields:
        for w in windows:
            s, n = F.col(f"{k}_s_{w}"), F.when(F.col(f"{k}_n_{w}") > 0, F.col(f"{k}_n_{w}").cast("decimal(10,0)"))
            fine, coarse = (F.round(x / n, places).cast("double") for x in (s.try_cast("decimal(30,10)"), s))  # coarse beyond 10^20
            out += [F.round(s, places).cast("double").alias(f"total_{k}_{w}"), F.coalesce(fine, coarse).alias(f"avg_{k}_{w}")]
    return d.select("entity", "day", *out)
