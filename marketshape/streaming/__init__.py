"""Bars and baselines as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, ts with zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling bars per event type; state of a bar is dropped once the watermark has passed it."""
    at = F.struct("ts", "event_id")
    b = events.withWatermark("ts", late).groupBy(F.window("ts", length), F.col("event_type").alias("asset"))
    return b.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")).select("asset", F.col("window.start").alias("t"), "open", "high", "low", "close", "volume")


def stream_baseline(scores: DataFrame, keep: int = 30, n_std: float = 2.0) -> DataFrame:
    """The adaptive threshold of (key, seq, score) rows as they come: the state is the last ``keep`` scores of a key.

    The rows of a micro-batch are taken in the order of seq; a score that comes in a
    later batch than its successors is the latest all the same. Of a batch, a key's rows
    are held in memory, so batches must be bounded (maxFilesPerTrigger).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, x in zip(rows["seq"], rows["score"], strict=True):
            past = [*past, float(x)][-keep:]
            m = sum(past) / len(past)
            sd = (sum((v - m) ** 2 for v in past) / len(past)) ** 0.5
            limit = m + n_std * sd if len(past) >= 5 else 0.5
            out.append((key[0], int(s), float(x), limit, bool(x > limit)))
        state.update((past,))
        yield pd.DataFrame(out, columns=["key", "seq", "score", "threshold", "is_anomaly"])

    return scores.groupBy("key").applyInPandasWithState(f, "key string, seq bigint, score double, threshold double, is_anomaly boolean", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run the stream over all there is into a parquet table and read it; in update mode the last row of a key counts."""
    out = f"{folder}/out"

    def sink(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_no", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch_no_{n:06d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
