"""Irregular readings onto a regular grid, the gaps filled by a low-rank factorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut

BLOCK = 1024  # cells in a block; a block, not a source, is the unit of work


def occupied_cells(readings: DataFrame) -> DataFrame:
    """(source, step, block, cell, value) of every cell that holds a reading.

    ``readings``: source, minute (since 1970-01-01 00:00, fractional), step (minutes),
    value, rank (orders the readings of a cell; the last one with a value counts).
    """
    cell = F.floor(F.col("minute") / F.col("step"))
    r = readings.where("source is not null and minute is not null and step > 0").select("source", "step", cell.alias("cell"), F.floor(cell / BLOCK).alias("block"), "value", "rank")
    return r.groupBy("source", "step", "block", "cell").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("rank"))).alias("value"))


def empty_cells(cells: DataFrame) -> DataFrame:
    """(source, step, cell) of every cell without a reading between a source's first and last cell.

    Made block by block, so no array is longer than a block, however wide the span; a
    source with one reading thousands of years off does get all the cells between.
    """
    ends = cells.groupBy("source", "step").agg(F.min("cell").alias("a"), F.max("cell").alias("z"))
    ends = ends.select("source", "step", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / BLOCK / BLOCK), F.floor(F.col("z") / BLOCK / BLOCK))).alias("far"))
    blocks = ends.select("source", "step", "a", "z", F.explode(F.sequence(F.greatest(F.floor(F.col("a") / BLOCK), F.col("far") * BLOCK), F.least(F.floor(F.col("z") / BLOCK), F.col("far") * BLOCK + BLOCK - 1))).alias("block"))
    taken = cells.groupBy("source", "block").agg(F.collect_set("cell").alias("taken"))  # at most BLOCK in a set
    span = F.sequence(F.greatest("a", F.col("block") * BLOCK), F.least("z", F.col("block") * BLOCK + BLOCK - 1))
    gone = F.when(F.col("taken").isNull(), span).otherwise(F.array_except(span, "taken"))
    return blocks.join(taken, ["source", "block"], "left").select("source", "step", F.explode(gone).alias("cell"))


def _solve(d: DataFrame, rank: int, ridge: float) -> DataFrame:
    """(key, f, sse): the ridge solution of every row's normal equations by Cramer's rule, in one projection, and its squared error."""

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(f"{'-1.0' if j % 2 else '1.0'} * {x} * {det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j, x in enumerate(m[0])) + ")"

    g = [[f"g{max(i, j)}{min(i, j)}" for j in range(rank)] for i in range(rank)]
    sse = "zz" + "".join(f" - 2 * f[{i}] * y{i}" for i in range(rank)) + "".join(f" + f[{i}] * f[{j}] * {g[i][j]}" for i in range(rank) for j in range(rank))
    for i in range(rank):
        g[i][i] = f"({g[i][i]} + {ridge} * n)"
    replaced = ([[f"y{i}" if k == j else x for k, x in enumerate(r)] for i, r in enumerate(g)] for j in range(rank))
    return d.withColumn("f", F.array(*(F.expr(f"{det(m)} / {det(g)}") for m in replaced))).select("key", "f", F.expr(sse).alias("sse"))


def factorise(cells: DataFrame, slot_minutes: int, rank: int = 3, most_rounds: int = 12, tolerance: float = 1e-3, ridge: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alternating least squares over the source-by-time matrix of the log values.

    The cells of a source are averaged per slot of ``slot_minutes`` (or its own step, if
    longer), the knots between which ``low_rank`` reads the time factors; they are
    centred and scaled by the source's median and spread, and held within five spreads,
    so single wrong readings don't steer the factors. A value that isn't positive takes
    no part. Returns (key, f) of the sources, (key, f) of the slots and (source, mid,
    spread). Every round joins the observations with one side's factors, sums up the
    normal equations in parallel (partial sums, so a hot source is no hot task) and
    solves them in columns; a rank of at most 4 keeps that short. The rounds end when
    the squared error falls by less than ``tolerance`` of itself.
    """
    slot = F.floor(F.col("cell") * F.col("step") / slot_minutes)
    x = cut(cells.where("value > 0").groupBy("source", slot.alias("slot")).agg(F.avg(F.ln("value")).alias("x")))
    q = x.groupBy("source").agg(F.percentile_approx("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 500).alias("q"))
    scale = cut(q.select("source", F.col("q")[1].alias("mid"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 2.0, F.lit(1e-6)).alias("spread")))
    z = cut(x.join(scale, "source").select("source", "slot", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("x") - F.col("mid")) / F.col("spread"))).alias("z")))
    start = F.array(*((F.pmod(F.xxhash64("slot", F.lit(i)), F.lit(2_000_001)) / 1e6 - 1.0) for i in range(rank)))
    slots = z.select("slot").distinct().select(F.col("slot").alias("key"), start.alias("f"))

    counts = z.agg(F.approx_count_distinct("source").alias("source"), F.approx_count_distinct("slot").alias("slot")).first()
    few = {k: counts[k] <= BROADCAST_ROWS // 2 for k in ("source", "slot")}

    def side(known: DataFrame, by: str, of: str) -> DataFrame:
        known = known.select(F.col("key").alias(by), "f")
        d = z.join(F.broadcast(known) if few[by] else known, by)  # counted just above
        f = [F.col("f")[i] for i in range(rank)]
        sums = {f"g{i}{j}": F.sum(f[i] * f[j]) for i in range(rank) for j in range(i + 1)} | {f"y{i}": F.sum(f[i] * F.col("z")) for i in range(rank)}
        d = d.groupBy(F.col(of).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"), *(v.alias(k) for k, v in sums.items()))
        return _solve(d, rank, ridge)

    sources, before = cut(side(slots, "slot", "source")), float("inf")
    for _ in range(most_rounds):
        slots = side(sources, "source", "slot")
        sources = cut(side(slots, "slot", "source"))
        error = sources.agg(F.sum("sse")).first()[0] or 0.0
        if error >= before * (1 - tolerance):
            break
        before = error
    slots = cut(side(sources, "source", "slot").select("key", "f"))
    return sources.select("key", "f"), slots, scale


def low_rank(cells: DataFrame, factors: tuple[DataFrame, DataFrame, DataFrame], slot_minutes: int) -> DataFrame:
    """Adds mid, spread and guess (a log value, null if unsupported) to (source, step, cell): the product of the two factors.

    The time factor of a step is read between the two slots whose middles enclose the
    step's middle, so every step has its own; where one of them was never seen, the other
    counts.
    """
    sources, slots, scale = factors
    u = (F.col("cell") * F.col("step") + F.col("step") / 2) / slot_minutes - 0.5
    d = cells.withColumns({"_k": F.floor(u), "_w": u - F.floor(u)}).withColumn("_k1", F.when(F.col("_w") > 0, F.col("_k") + 1))
    about = sources.select(F.col("key").alias("source"), F.col("f").alias("_u")).join(scale, "source")
    d = d.join(about, "source", "left")
    for k, f in (("_k", "_f0"), ("_k1", "_f1")):
        d = d.join(slots.select(F.col("key").alias(k), F.col("f").alias(f)), k, "left")
    dot = lambda f: F.aggregate(F.zip_with("_u", f, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p0, p1 = dot("_f0"), dot("_f1")
    product = F.when(p0.isNull(), p1).when(p1.isNull(), p0).otherwise(p0 * (1 - F.col("_w")) + p1 * F.col("_w"))
    return d.withColumn("guess", F.col("mid") + F.col("spread") * product).drop("_k", "_k1", "_w", "_u", "_f0", "_f1")


def regular_grid(readings: DataFrame, slot_minutes: int = 240, rank: int = 3) -> DataFrame:
    """One row per source and grid step from its first to its last reading.

    Columns: source, cell_minute (start of the step in minutes since 1970-01-01 00:00),
    value, has_reading, status. status is observed (the last value read in the step, as
    it was), filled (the product of the source's and the step's factors, scaled back) or
    unsupported (no value, as no source has one around that time, or this source none at
    all). Readings without source or time count nowhere; a step of null or zero has no
    grid; an empty input gives no rows. Input columns as in ``occupied_cells``. The
    filled cells are written once, as a table of their own.
    """
    cells = cut(occupied_cells(readings))
    factors = factorise(cells, slot_minutes, rank)
    whole = cells.where("value is not null").select("source", (F.col("cell") * F.col("step")).alias("cell_minute"), "value", F.lit(True).alias("has_reading"), F.lit("observed").alias("status"))
    gaps = cells.where("value is null").select("source", "step", "cell", F.lit(True).alias("has_reading")).unionByName(empty_cells(cells).withColumn("has_reading", F.lit(False)))
    filled = low_rank(gaps, factors, slot_minutes).select("source", (F.col("cell") * F.col("step")).alias("cell_minute"), F.exp("guess").alias("value"), "has_reading", F.when(F.col("guess").isNotNull(), "filled").otherwise("unsupported").alias("status"))
    return whole.unionByName(cut(filled))


def held_out_error(readings: DataFrame, slot_minutes: int = 240, rank: int = 3, every: int = 50) -> DataFrame:
    """One row: cells, median_error, median_error_of_mid: how well hidden cells are met, in the source's spreads.

    A cell in ``every``, chosen by hash, is hidden from the factors and then compared;
    the last column takes the source's own median as the guess.
    """
    cells = cut(occupied_cells(readings).where("value > 0"))
    hidden = F.pmod(F.xxhash64("source", "cell"), F.lit(every)) == 0
    d = low_rank(cells.where(hidden), factorise(cells.where(~hidden), slot_minutes, rank), slot_minutes).where("guess is not null")
    off = lambda g: F.percentile_approx(F.abs(F.ln("value") - F.col(g)) / F.col("spread"), 0.5, 2000)
    return d.agg(F.count(F.lit(1)).alias("cells"), off("guess").alias("median_error"), off("mid").alias("median_error_of_mid"))
