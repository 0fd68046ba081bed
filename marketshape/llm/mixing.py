"""Mixing sources to target weights with capped repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

SLICES = 1024


def source_name(c: str) -> Column:
    """Trimmed and in lower case; null if nothing is left."""
    x = F.lower(F.regexp_replace(F.col(c), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(x != "", x)


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Adds give, what each source contributes, and short to (source, target_share, max_repeats, size).

    Every source is asked for its share of ``total`` and gives at most its size times
    its repeats. Those that can't are held at that (short: already in the first round,
    so by their own share), and the rest is asked of the others in proportion to their
    shares, until all are within their means or all are held. A round is one aggregation
    of the table; the level asked per share only rises, so there is a last one.
    """
    cap = F.col("size") * F.greatest(F.col("max_repeats"), F.lit(0)).cast("double")
    s = sources.withColumns({"cap": cap, "short": cap < F.col("target_share") * F.lit(total)})
    level, first = total, True
    while True:
        over = F.col("short") if first else F.col("cap") < F.col("target_share") * F.lit(level)
        x = s.agg(F.sum(F.when(over, F.col("cap"))).alias("held"), F.sum(F.when(~over, F.col("target_share"))).alias("weight")).first()
        new = max(level, (total - (x["held"] or 0.0)) / x["weight"]) if x["weight"] else level
        if new <= level * (1 + 1e-12):
            return s.withColumn("give", F.least(F.col("cap"), F.col("target_share") * F.lit(new))).drop("cap")
        level, first = new, False


def _edge(x: DataFrame, level: int) -> DataFrame:
    """(source, e<level>, b<level>): the slice of the hash at this level in which the sum of sizes passes ``part``, and the sum before it."""
    before = [f"e{k}" for k in range(1, level)]
    start = F.col(f"b{level - 1}") if level > 1 else F.lit(0)
    own = x.where(" and ".join(f"s{k} = e{k}" for k in range(1, level)) or "true")
    sums = own.groupBy("source", "part", *before, start.alias("b"), F.col(f"s{level}").alias("s")).agg(F.sum("size").alias("t"))
    sums = sums.withColumn("z", F.col("b") + F.sum("t").over(W.partitionBy("source").orderBy("s")))  # at most SLICES rows each
    return cut(sums.where("z > part").groupBy("source").agg(F.min("s").alias(f"e{level}"), F.min_by(F.col("z") - F.col("t"), "s").alias(f"b{level}")))


def mix_sources(items: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). ``items``: doc_id, source, size; ``targets``: source, target_share, max_repeats.

    mixture: doc_id, source, size, repeats (how often the document is in). Every document
    of a source is in the whole number of times its epochs hold, and a seeded part of
    them once more: in the order of a hash of its id, up to the fractional epoch's size.
    The order is cut at the right place by sums over slices of the hash, slices of these
    and, as repeated or missing ids have equal hashes, slices of a row number, so no
    source and no id is ever sorted in one task. report: source, target_share,
    max_repeats, size, epochs, reachable (not short in ``water_fill``), mixed_size,
    actual_share.

    The total is the size of all documents with a source. Sources are compared trimmed
    and in lower case; documents without source, or of a source without target, aren't
    in; sizes of null count 0; a target without documents has size 0; repeated targets
    count once, with their largest values.
    """
    d = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name("source").alias("source"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size")).where("source is not null")
    d = cut(d.withColumns({"h": F.xxhash64(F.lit(seed), "doc_id"), "row": F.monotonically_increasing_id()}))
    want = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    sizes = cut(d.groupBy("source").agg(F.sum("size").alias("size")))
    total = float(sizes.agg(F.sum("size")).first()[0] or 0)
    plan = water_fill(cut(want.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))), total)
    epochs = F.when(F.col("size") > 0, F.col("give") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(epochs + 1e-12).cast("int"), F.greatest(F.col("max_repeats"), F.lit(0)))
    plan = cut(plan.withColumns({"epochs": epochs, "whole": whole}).withColumn("part", F.when(F.col("whole") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("give") - F.col("whole") * F.col("size"))).otherwise(0.0)))
    x = d.join(plan.select("source", "whole", "part"), "source")
    x = x.withColumns({"s1": F.pmod("h", F.lit(SLICES)), "s2": F.pmod(F.floor(F.col("h") / SLICES), F.lit(SLICES)), "s3": F.pmod(F.xxhash64("row"), F.lit(SLICES))})
    for level in (1, 2, 3):
        x = x.join(_edge(x, level), "source", "left")
    edge = F.coalesce((F.col("s1") == F.col("e1")) & (F.col("s2") == F.col("e2")) & (F.col("s3") == F.col("e3")), F.lit(False))
    inside = F.col("e1").isNull() | (F.struct("s1", "s2", "s3") < F.struct("e1", "e2", "e3"))
    plain = x.where(~edge).select("doc_id", "source", "size", (F.col("whole") + ((F.col("part") > 0) & F.coalesce(inside, F.lit(False))).cast("int")).alias("repeats"))
    last = x.where(edge).withColumn("z", F.col("b3") + F.sum("size").over(W.partitionBy("source").orderBy("h", "row").rowsBetween(W.unboundedPreceding, 0)))  # a slice of a slice of a slice
    last = last.select("doc_id", "source", "size", (F.col("whole") + ((F.col("part") > 0) & (F.col("z") - F.col("size") / 2 <= F.col("part"))).cast("int")).alias("repeats"))
    mixture = cut(plain.unionByName(last).where("repeats > 0"))
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("mixed_size"))
    all_got = mixture.agg(F.sum(F.col("size") * F.col("repeats")).alias("all_size"))
    report = plan.select("source", "target_share", "max_repeats", "size", "epochs", (~F.col("short")).alias("reachable")).join(got, "source", "left").crossJoin(F.broadcast(all_got))  # one row of totals
    report = report.withColumn("mixed_size", F.coalesce("mixed_size", F.lit(0)))
    return mixture, report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_size").cast("double"), "all_size"), F.lit(0.0))).drop("all_size")
