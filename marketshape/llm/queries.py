"""Queries of the operators for language-model training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .clusters import cluster_windows, describe_clusters, pivot_clusters, sound_windows
from .mixing import mix_sources
from .packing import pack_items
from .toxicity import score_documents, source_rates

FIELDS = ["max_persistence", "mean_persistence", "spectral_gap", "density"]


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return cluster_windows(sound_windows(table(spark, d, "h0_features"), table(spark, d, "graph_metrics")), "window_id", FIELDS).select("window_id", "cluster_id")


def p4_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The pivot clusters before those that no gap parts are joined."""
    return pivot_clusters(sound_windows(table(spark, d, "h0_features"), table(spark, d, "graph_metrics")), "window_id", FIELDS)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = cluster_windows(sound_windows(table(spark, d, "h0_features"), table(spark, d, "graph_metrics")), "window_id", FIELDS)
    return describe_clusters(m, "window_id", FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    m = p4_members(spark, d).where("cluster_id is not null").dropDuplicates(["window_id"])
    pairs = table(spark, d, "window_pairs").select("window_a", "window_b")
    for x in "ab":
        pairs = pairs.join(m.select(F.col("window_id").alias(f"window_{x}"), F.col("cluster_id").alias(f"c{x}")), f"window_{x}")
    return pairs.where("ca = cb").select("window_a", "window_b")


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Size: tokens of the byte-level vocabulary, one for each UTF-8 byte."""
    return table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in table(spark, d, "pack_capacity").collect()}  # one row per kind
    return pack_items(sized_documents(spark, d), kinds)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_packed(spark, d).where("n_pieces > 1 and piece = 0").select("doc_id", "container_kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind and final length: containers, contents and the share of room used."""
    c = p6_packed(spark, d).groupBy("container_kind", "container_id").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.sum("piece_tokens").alias("used"))
    return c.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used_tokens"), F.round(F.try_divide(F.sum("used"), F.sum("capacity_tokens")), 6).alias("used_share"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: pieces, their tokens, items split, containers beyond capacity (none), and whether the room is within 1 % of the contents."""
    p = p6_packed(spark, d)
    c = p.groupBy("container_kind", "container_id").agg(F.max("capacity_tokens").alias("room"), F.max("used_tokens").alias("said"), F.sum("piece_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"), F.sum(((F.col("n_pieces") > 1) & (F.col("piece") == 0)).cast("bigint")).alias("split"))
    over = F.sum(((F.col("used") > F.col("room")) | (F.col("used") != F.col("said"))).cast("bigint"))
    return c.groupBy("container_kind").agg(F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.sum("split").alias("split_items"), over.alias("overfull"), (F.sum("room") <= 1.01 * F.sum("used")).alias("tight"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(sized_documents(spark, d), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each source is to contribute, before any document is chosen."""
    return p7_shares(spark, d).select("source", "target_share", "max_repeats", "size", F.round("epochs", 6).alias("epochs"), "reachable")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("not reachable").select("source")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_members, p4_clusters, p4_pivots, p6_found, p6_packed, p6_report, p6_invariants, p7_found, p7_mixture, p7_shares, p7_plan, p8_found, p8_scores, p8_rates)}

_SIZES = "s AS (SELECT lower(trim(source)) source, sum(coalesce(octet_length(encode(text)), 0))::BIGINT size FROM documents WHERE trim(source) <> '' GROUP BY 1)"

SQL = {
    "p6_invariants": """WITH x AS (SELECT coalesce(octet_length(encode(text)), 0) size FROM documents)
        SELECT container_kind, sum(greatest(1, ceil(size / capacity_tokens)))::BIGINT AS pieces, sum(size)::BIGINT AS tokens, count(*) FILTER (WHERE size > capacity_tokens) AS split_items, 0::BIGINT AS overfull, true AS tight FROM x, pack_capacity GROUP BY 1""",
    "p7_plan": f"""WITH {_SIZES}, m AS (SELECT lower(trim(t.source)) AS source, target_share, max_repeats, coalesce(size, 0) AS size, coalesce(size, 0) * max_repeats::DOUBLE AS cap, (SELECT sum(size) FROM s)::DOUBLE AS total FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source))),
        r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / target_share, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(target_share) OVER (ORDER BY cap / target_share, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM m),
        l AS (SELECT arg_min((total - held) / weight, cap / target_share) AS level FROM r WHERE cap / target_share >= (total - held) / weight)
        SELECT source, target_share, max_repeats, size, CASE WHEN size > 0 THEN round(least(cap, target_share * level) / size, 6) ELSE 0 END AS epochs, cap >= target_share * total AS reachable FROM m, l""",
    "p6_found": "SELECT doc_id, container_kind FROM documents, pack_capacity WHERE octet_length(encode(text)) > capacity_tokens",
    "p7_found": """WITH s AS (SELECT lower(trim(source)) source, sum(coalesce(octet_length(encode(text)), 0)) size FROM documents WHERE trim(source) <> '' GROUP BY 1)
        SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source))
        WHERE coalesce(size, 0) * max_repeats < target_share * (SELECT sum(size) FROM s)""",
}
