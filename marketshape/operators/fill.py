"""Filling missing values from similar records: verified dependencies, then neighbours, then groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

#: Words that stand for a missing text, compared trimmed and in lower case.
PLACEHOLDERS = ("", "-", "--", "---", ".", "?", "??", "#missing", "#n/a", "#na", "#value!", "#null!", "<na>", "<null>", "(null)", "[null]", "\\n", "empty", "missing", "n.a.", "n/a", "n/d", "na", "nan", "nat", "nd", "nil", "none", "not available", "null", "tba", "tbc", "tbd", "undefined", "unknown", "unspecified", "void")


def text_missing(c: str) -> Column:
    """Null, empty or blank text, or a placeholder word."""
    return F.col(c).isNull() | F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))).isin(*PLACEHOLDERS)


def not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def nines(c: str, digits: int) -> Column:
    """A number written with nines only, at least ``digits`` of them."""
    return F.format_string("%.4f", F.abs(c)).rlike(r"^9[9.]*0*$") & (F.length(F.regexp_replace(F.format_string("%.4f", F.abs(c)), r"[^9]", "")) >= digits)


def price_missing(c: str, usual: Column) -> Column:
    """Not finite, not positive, or a number of nines far (tenfold) from the source's usual price."""
    odd = nines(c, 3) & (usual.isNull() | (F.col(c) >= 10 * usual) | (F.col(c) * 10 <= usual))
    return not_finite(c) | F.coalesce((F.col(c) <= 0) | odd, F.lit(False))


def return_missing(c: str) -> Column:
    """Not finite, -1 or less, or a number of nines of 9 or more (9.99, 999)."""
    return not_finite(c) | F.coalesce((F.col(c) <= -1) | ((F.col(c) >= 9) & nines(c, 2)), F.lit(False))


#: Candidate left sides, the shorter ones first.
DETERMINANTS = (("asset",), ("seq",), ("sector_ok",), ("asset", "seq"), ("sector_ok", "seq"))

Dependency = tuple[str, tuple[str, ...], float]


def mine_dependencies(complete: DataFrame, targets: dict[str, str], determinants: tuple[tuple[str, ...], ...] = DETERMINANTS, max_violations: float = 0.02) -> tuple[DataFrame, list[Dependency]]:
    """Verified dependencies and their dictionaries: (target, determinant, key, value), [(target, determinant, error)].

    ``complete`` has the determinants' columns and, for every target, the column named
    in ``targets``, null where it isn't complete. The error of a dependency is the share
    of records, among keys with at least two, that differ from their key's usual value;
    it is verified up to ``max_violations``, if there is such a key, and if no part of
    its determinant is verified already. So a few wrong records cost no dictionary,
    whose value is the key's most frequent one (ties: the largest).

    A first pass per determinant, on hashes only, drops those where half the keys are at
    odds; values are counted for the rest. Both aggregate before they shuffle, so a hot
    key costs no more than a rare one. To the driver comes a row per candidate.
    """
    pairs = [(t, det) for det in determinants for t, c in targets.items() if c not in det]

    def known(det: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in det])

    seen = None
    for det in determinants:
        mine = [t for t, q in pairs if q == det]
        h = {t: F.xxhash64(targets[t]) for t in mine}
        has = {t: F.col(targets[t]).isNotNull() for t in mine}
        per_key = complete.where(known(det)).groupBy(*det).agg(*(f(F.when(has[t], h[t])).alias(f"{n}_{t}") for t in mine for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))))
        odd = per_key.agg(F.lit(",".join(det)).alias("determinant"), *(F.coalesce(F.avg(F.when(F.col(f"n_{t}") > 1, (F.col(f"lo_{t}") != F.col(f"hi_{t}")).cast("double"))), F.lit(1.0)).alias(t) if t in mine else F.lit(1.0).alias(t) for t in targets))
        seen = odd if seen is None else seen.unionByName(odd)
    likely = {(t, tuple(r["determinant"].split(","))) for r in seen.collect() for t in targets if r[t] <= 0.5}
    d = None
    for t, det in pairs:
        if (t, det) in likely:
            x = complete.where(known(det) & F.col(targets[t]).isNotNull()).groupBy(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in det)).alias("key"), F.col(targets[t]).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            x = x.select(F.lit(t).alias("target"), F.lit(",".join(det)).alias("determinant"), "key", "value", "n")
            d = x if d is None else d.unionByName(x)
    if d is None:
        return complete.sparkSession.createDataFrame([], "target string, determinant string, key string, value string"), []
    d = cut(d.groupBy("target", "determinant", "key").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.sum("n").alias("n"), F.max("n").alias("most")))
    errors = {(r["target"], tuple(r["determinant"].split(","))): r["e"] for r in d.where("n > 1").groupBy("target", "determinant").agg((1 - F.sum("most") / F.sum("n")).alias("e")).collect()}
    held: list[Dependency] = []
    for t, det in pairs:
        if errors.get((t, det), 1.0) <= max_violations and not any(t == u and set(q) < set(det) for u, q, _ in held):
            held.append((t, det, errors[t, det]))
    return d.select("target", "determinant", "key", "value"), held


def fill_missing(panel: DataFrame) -> DataFrame:
    """The panel with close_prices, ret, sector and regime filled, and where each value is from.

    Columns: row_id, seq, timestamps, asset, the four fields and for each ``<field>_from``:
    observed, ``fd:<determinant>`` (dictionary of a dependency mined from the complete
    records and verified), derived (close and return determine each other along an
    asset), neighbours (between the asset's or calendar's days before and after),
    group:<columns> (mean or most frequent value of the group, from the narrowest to the
    day), undefined (the return of an asset's first timestamp, left null), unfilled (no
    row of the same asset, sector or day has a value).

    A missing value is null, not a number, infinite, an empty text or placeholder word,
    a price that isn't positive, a return of -1 or less, or a number of nines. Repeated
    rows stay rows; an empty panel gives no rows; rows without asset or day can only be
    filled by the groups they do have. Other columns are left out.
    """
    p = panel.select("row_id", "seq", "timestamps", "asset", "sector", "close_prices", "ret", "regime")
    price = F.when(~not_finite("close_prices") & (F.col("close_prices") > 0), F.col("close_prices"))
    about = cut(p.groupBy("asset").agg(F.percentile_approx(price, 0.5, 200).alias("usual"), F.min("timestamps").alias("first")))
    marks = {"sector": text_missing("sector"), "regime": text_missing("regime"), "close_prices": price_missing("close_prices", F.col("usual")), "ret": return_missing("ret")}
    p = p.join(about, p["asset"].eqNullSafe(about["asset"]), "left").drop(about["asset"])
    p = cut(p.select("row_id", "seq", "timestamps", "asset", "first", *(F.when(~x, F.trim(k) if k in ("sector", "regime") else F.col(k)).alias(f"{k}_ok") for k, x in marks.items())))
    d, held = mine_dependencies(p, {k: f"{k}_ok" for k in marks})

    def with_dictionaries(t: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The table of these keys with a column fd_<target> of every dependency on them."""
        for target, det, _ in held:
            if det == keys:
                parts = F.split("key", "\u0001")
                of = d.where((F.col("target") == target) & (F.col("determinant") == ",".join(det)))
                of = of.select(*(parts[i].cast(dict(t.dtypes)[k]).alias(k) for i, k in enumerate(keys)), F.col("value").cast("double" if target in ("close_prices", "ret") else "string").alias(f"fd_{'_'.join(keys)}_{target}"))
                t = t.join(of, list(keys), "left")
        return t

    # one row per asset, per asset and day, per day, per sector and day: all fillings come from these
    per_asset = cut(with_dictionaries(p.where("asset is not null").groupBy("asset").agg(F.mode("sector_ok", True).alias("sector_asset")), ("asset",)))
    day = p.where("asset is not null and seq is not null").groupBy("asset", "seq").agg(F.max("sector_ok").alias("s"), F.max("close_prices_ok").alias("c"), F.max("ret_ok").alias("r"))
    w = W.partitionBy("asset").orderBy("seq")  # as many rows as the calendar has days
    back, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    known = F.when(F.col("c").isNotNull(), F.struct("seq", "c"))
    day = day.withColumns({"b": F.last(known, True).over(back), "a": F.first(known, True).over(ahead), "next_r": F.lead(F.struct("seq", "r")).over(w)})
    yesterday = F.when(F.col("b")["seq"] == F.col("seq") - 1, F.col("b")["c"])
    tomorrow = F.when((F.col("a")["seq"] == F.col("seq") + 1) & (F.col("next_r")["seq"] == F.col("seq") + 1), F.col("a")["c"] / (1 + F.col("next_r")["r"]))
    between = F.col("b")["c"] + (F.col("a")["c"] - F.col("b")["c"]) * (F.col("seq") - F.col("b")["seq"]) / (F.col("a")["seq"] - F.col("b")["seq"])
    day = day.withColumns({"c_derived": F.coalesce(yesterday * (1 + F.col("r")), tomorrow), "c_near": F.coalesce(between, F.col("b")["c"], F.col("a")["c"])})
    best_c = F.coalesce("c", "c_derived", "c_near")
    day = day.withColumns({"r_derived": F.coalesce(F.when(F.col("c").isNotNull(), F.col("c") / yesterday - 1), F.when(F.lag("seq").over(w) == F.col("seq") - 1, best_c / F.lag(best_c).over(w) - 1))})
    day = cut(with_dictionaries(day.join(per_asset.select("asset", "sector_asset"), "asset", "left").select("asset", "seq", F.coalesce("s", "sector_asset").alias("sector_ok"), "c", "r", "c_derived", "c_near", "r_derived"), ("asset", "seq")))
    sector_day = cut(with_dictionaries(day.where("sector_ok is not null").groupBy("sector_ok", "seq").agg(F.avg("r").alias("r_sector"), F.avg("c").alias("c_sector")), ("sector_ok", "seq")))
    means = day.groupBy("seq").agg(F.avg("r").alias("r_day"), F.avg("c").alias("c_day"), F.mode("sector_ok", True).alias("sector_day"))
    per_day = p.where("seq is not null").groupBy("seq").agg(F.mode("regime_ok", True).alias("regime_day")).join(means, "seq", "left")
    cal = W.orderBy("seq")  # the calendar: one row a day
    per_day = per_day.withColumn("regime_near", F.coalesce(F.last("regime_day", True).over(cal.rowsBetween(W.unboundedPreceding, -1)), F.first("regime_day", True).over(cal.rowsBetween(1, W.unboundedFollowing))))
    per_day = cut(with_dictionaries(per_day, ("seq",)))

    q = p.join(per_asset, "asset", "left").join(day.drop("sector_ok", "c", "r"), ["asset", "seq"], "left").join(per_day, "seq", "left")
    q = q.withColumns({"own": F.col("sector_ok"), "sector_ok": F.coalesce("sector_ok", "sector_asset")}).join(sector_day, ["sector_ok", "seq"], "left")
    if any(det == ("sector_ok",) for _, det, _ in held):
        q = q.join(with_dictionaries(p.where("sector_ok is not null").select("sector_ok").distinct(), ("sector_ok",)), "sector_ok", "left")
    fallback = {
        "sector": [("group:asset", "sector_asset"), ("group:seq", "sector_day")],
        "regime": [("group:seq", "regime_day"), ("neighbours", "regime_near")],
        "close_prices": [("derived", "c_derived"), ("neighbours", "c_near"), ("group:sector,seq", "c_sector"), ("group:seq", "c_day")],
        "ret": [("derived", "r_derived"), ("group:sector,seq", "r_sector"), ("group:seq", "r_day")],
    }
    start = F.coalesce(F.col("timestamps") == F.col("first"), F.lit(False)) & F.col("ret_ok").isNull()
    out: list[Column] = []
    for k, others in fallback.items():
        steps = [("observed", "own" if k == "sector" else f"{k}_ok"), *((f"fd:{','.join(x.removesuffix('_ok') for x in det)}", f"fd_{'_'.join(det)}_{k}") for t, det, _ in held if t == k), *others]
        value, at = F.coalesce(*(F.col(c) for _, c in steps)), F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in steps), F.lit("unfilled"))
        if k == "ret":
            value, at = F.when(~start, value), F.when(start, "undefined").otherwise(at)
        out += [value.alias(k), at.alias(f"{k}_from")]
    return q.select("row_id", "seq", "timestamps", "asset", *out)


def missing_values(filled: DataFrame) -> DataFrame:
    """(row_id, field_name) of every value that ``fill_missing`` found missing."""
    fields = ("close_prices", "ret", "sector", "regime")
    gone = F.array_compact(F.array(*(F.when(~F.col(f"{k}_from").isin("observed", "undefined"), k) for k in fields)))
    return filled.select("row_id", F.explode(gone).alias("field_name"))
