"""Queries of the cleaning operators over data_package, ohlcv and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import fill_missing, missing_values, return_missing
from ..operators.grid import held_out_error, regular_grid
from ..operators.rolling import daily_amounts, trailing_totals
from ..operators.spikes import fitted_tails, flag_spikes
from ..session import DAY_ONE, micros, number, table


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(table(spark, d, "data_package"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_values(p1_filled(spark, d))


def grid_readings(spark: SparkSession, d: str, series: str) -> DataFrame:
    if series == "ohlcv":
        steps = table(spark, d, "assets").groupBy("asset").agg(F.min("bar_minutes").alias("bar_minutes"))
        r = table(spark, d, "ohlcv").select("asset", micros("ts").alias("us"), number("close_price").alias("value"), "received_at", "bar_id").where(f"us >= {DAY_ONE} and value is not null")
        return r.join(steps, "asset").select(F.col("asset").alias("source"), (F.col("us") / 60e6).alias("minute"), F.col("bar_minutes").cast("long").alias("step"), "value", F.struct("us", micros("received_at").alias("at"), F.col("bar_id").alias("id")).alias("rank"))
    r = table(spark, d, "data_package").select("asset", micros("timestamps").alias("us"), "close_prices", "received_at", "row_id").where("us is not null")
    price = F.when(F.col("close_prices").between(1e-9, 99999.0), F.col("close_prices"))
    return r.select(F.col("asset").alias("source"), (F.col("us") / 60e6).alias("minute"), F.lit(1440).cast("long").alias("step"), price.alias("value"), F.struct("us", micros("received_at").alias("at"), F.col("row_id").alias("id")).alias("rank"))


SERIES = (("ohlcv", 240), ("data_package", 1440))  # and the minutes of their slots


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    parts = [regular_grid(grid_readings(spark, d, s), slot_minutes=m).withColumn("series", F.lit(s)) for s, m in SERIES]
    return parts[0].unionByName(parts[1]).withColumnRenamed("source", "asset")


def p2_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How well the factors meet a fiftieth of the cells, hidden from them."""
    parts = [held_out_error(grid_readings(spark, d, s), slot_minutes=m).withColumn("series", F.lit(s)) for s, m in SERIES]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The steps without a reading, from the table of filled and unsupported cells."""
    return p2_grid(spark, d).where(~F.col("has_reading")).select("series", "asset", "cell_minute")


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_spikes(table(spark, d, "ohlcv"), table(spark, d, "assets"))


def p3_tails(spark: SparkSession, d: str) -> DataFrame:
    """The fitted tail of every asset and score."""
    return fitted_tails(table(spark, d, "ohlcv"), table(spark, d, "assets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_flags(spark, d).where("implausible").select("bar_id")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per asset and UTC day; a redelivered bar counts as the last row received, activity as any row."""
    bars = table(spark, d, "ohlcv").select("asset", micros("ts").alias("us"), number("close_price").alias("c"), "volume", "received_at", "bar_id").where(f"us >= {DAY_ONE}")
    bars = bars.groupBy("asset", "us").agg(F.max_by(F.struct("c", "volume"), F.struct("received_at", "bar_id")).alias("x"), F.max(F.coalesce(F.col("volume") > 0, F.lit(False))).alias("active"))
    day = F.date_from_unix_date((F.floor(F.col("us") / 86_400_000_000)).cast("int")).alias("day")
    bars = bars.select(F.col("asset").alias("entity"), day, F.col("x.c").alias("close"), F.col("x.volume").cast("double").alias("volume"), F.lit(None).cast("double").alias("ret"), "active", F.lit(True).alias("in_span"))
    panel = table(spark, d, "data_package").select("asset", "timestamps", "ret", "received_at", "row_id").where(~return_missing("ret"))
    panel = panel.groupBy("asset", micros("timestamps").alias("us")).agg(F.max_by("ret", F.struct("received_at", "row_id")).alias("ret"))
    none = F.lit(None).cast("double")
    panel = panel.select(F.col("asset").alias("entity"), day, none.alias("close"), none.alias("volume"), "ret", F.lit(False).alias("active"), F.lit(False).alias("in_span"))
    fields = ["close", "volume", "ret"]
    return trailing_totals(daily_amounts(bars.unionByName(panel), fields), fields, places=6).withColumnRenamed("entity", "asset").withColumn("day_utc", F.date_format("day", "yyyy-MM-dd")).drop("day")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days whose running activity (one-day deltas) is 0."""
    return p5_totals(spark, d).where(~F.col("active")).select("asset", "day_utc")


QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p2_found, p2_grid, p2_held_out, p3_found, p3_flags, p3_tails, p5_found, p5_totals)}

_WORDS = "'', '-', '--', '#missing', 'n/a', 'nan', 'none', 'null', 'tbd', 'unknown'"
_DAYS = "WITH o AS (SELECT * FROM ohlcv WHERE ts >= TIMESTAMP '1970-01-02'), span AS (SELECT asset, min(ts)::DATE a, max(ts)::DATE z FROM o WHERE asset IS NOT NULL GROUP BY 1), days AS (SELECT asset, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS dd FROM span)"


def _rolling_sql() -> str:
    outs = []
    for k in ("close", "volume", "ret"):
        for w in (7, 30):
            frame = f"OVER (PARTITION BY asset ORDER BY dd RANGE BETWEEN INTERVAL {w - 1} DAY PRECEDING AND CURRENT ROW)"
            total, n = f"coalesce(sum({k}_s) {frame}, 0)", f"nullif(sum({k}_n) {frame}, 0)::HUGEINT"
            outs.append(f"round({total}, 6)::VARCHAR::DOUBLE AS total_{k}_{w}")
            units = f"({total} * 10000000000)::HUGEINT"  # half up in whole numbers, as division would be of doubles
            outs.append(f"((sign({total})::HUGEINT * ((2 * abs({units}) + {n} * 10000) // (2 * {n} * 10000)))::VARCHAR || 'e-6')::DOUBLE AS avg_{k}_{w}")
    return (
        _DAYS
        + """, last_rows AS (SELECT asset, ts, CASE WHEN isnan(close_price) THEN NULL ELSE close_price END AS c, volume FROM o QUALIFY row_number() OVER (PARTITION BY asset, ts ORDER BY received_at DESC, bar_id DESC) = 1),
        daily AS (SELECT asset, ts::DATE dd, sum(c::DECIMAL(24,10)) close_s, count(c) close_n, sum(volume::DECIMAL(24,10)) volume_s, count(volume) volume_n FROM last_rows GROUP BY 1, 2),
        act AS (SELECT asset, ts::DATE dd, coalesce(bool_or(volume > 0), false) active FROM o GROUP BY 1, 2),
        rr AS (SELECT asset, timestamps, ret FROM data_package WHERE ret IS NOT NULL AND NOT isnan(ret) AND NOT isinf(ret) AND ret > -1 QUALIFY row_number() OVER (PARTITION BY asset, timestamps ORDER BY received_at DESC, row_id DESC) = 1),
        rd AS (SELECT asset, timestamps::DATE dd, sum(ret::DECIMAL(24,10)) ret_s, count(ret) ret_n FROM rr GROUP BY 1, 2),
        j AS (SELECT coalesce(d.asset, r0.asset) AS asset, coalesce(d.dd, r0.dd) AS dd, d.asset IS NOT NULL AS listed, close_s, close_n, volume_s, volume_n, ret_s, ret_n FROM days d FULL JOIN rd r0 ON d.asset = r0.asset AND d.dd = r0.dd LEFT JOIN daily x ON x.asset = d.asset AND x.dd = d.dd),
        t AS (SELECT asset, dd, listed, """
        + ", ".join(outs)
        + """ FROM j)
        SELECT t.* EXCLUDE (dd, listed), strftime(t.dd, '%Y-%m-%d') AS day_utc, coalesce(active, false) AS active FROM t LEFT JOIN act USING (asset, dd) WHERE listed"""
    )


SQL = {
    "p1_found": f"""WITH m AS (SELECT asset, median(close_prices) u FROM data_package WHERE close_prices > 0 AND NOT isnan(close_prices) AND NOT isinf(close_prices) GROUP BY 1),
        f AS (SELECT asset, min(timestamps) t0 FROM data_package GROUP BY 1),
        p AS (SELECT d.*, u, t0 FROM data_package d LEFT JOIN m USING (asset) LEFT JOIN f USING (asset))
        SELECT row_id, 'sector' AS field_name FROM p WHERE sector IS NULL OR lower(trim(sector)) IN ({_WORDS})
        UNION ALL SELECT row_id, 'regime' FROM p WHERE regime IS NULL OR lower(trim(regime)) IN ({_WORDS})
        UNION ALL SELECT row_id, 'close_prices' FROM p WHERE close_prices IS NULL OR isnan(close_prices) OR isinf(close_prices) OR close_prices <= 0 OR (regexp_full_match(printf('%.2f', close_prices), '9+[.](99|00)') AND close_prices >= 999 AND (close_prices >= 10 * u OR close_prices * 10 <= u))
        UNION ALL SELECT row_id, 'ret' FROM p WHERE (ret IS NULL OR isnan(ret) OR isinf(ret) OR ret <= -1 OR ret IN (9.99, 99.99, 999, 9999)) AND timestamps IS DISTINCT FROM t0""",
    "p2_found": f"""WITH r AS (SELECT 'ohlcv' AS series, o.asset, bar_minutes::BIGINT AS step, floor(epoch_us(ts) / 60000000.0 / bar_minutes)::BIGINT AS cell FROM ohlcv o JOIN assets a ON a.asset = o.asset WHERE ts >= TIMESTAMP '1970-01-02' AND close_price IS NOT NULL AND NOT isnan(close_price)
        UNION ALL SELECT 'data_package', asset, 1440, floor(epoch_us(timestamps) / 86400000000.0)::BIGINT FROM data_package WHERE timestamps IS NOT NULL AND asset IS NOT NULL),
        e AS (SELECT series, asset, step, min(cell) a, max(cell) z FROM r GROUP BY 1, 2, 3),
        g AS (SELECT series, asset, step, unnest(range(a, z + 1)) AS cell FROM e)
        SELECT series, asset, cell * step AS cell_minute FROM g ANTI JOIN r USING (series, asset, step, cell)""",
    "p5_found": _DAYS + " SELECT asset, strftime(dd, '%Y-%m-%d') AS day_utc FROM days WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.asset = days.asset AND o.ts::DATE = dd AND volume > 0)",
    "p5_totals": _rolling_sql(),
}
