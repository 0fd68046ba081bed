"""Session helpers shared by every operator: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count of it, stopped at this many rows, shows that it fits.
BROADCAST_ROWS = 200_000

#: In microseconds; a reading before 1970-01-02 has no usable time.
DAY_ONE = 86_400_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster has no folder
    that its executors share by chance, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_marketshape_folder", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="marketshape-")
            atexit.register(shutil.rmtree, folder, True)
            spark._marketshape_folder = folder
    return folder


def new_path(spark: SparkSession, kind: str = "marketshape") -> str:
    """A path of its own in the shared folder, removed by ``drop_tables``."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_drop_at_exit, spark)
    _TABLES.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a columnar table into the shared folder and read it back.

    It ends the lineage, survives the loss of any executor and, being compressed
    columns, takes a fraction of the disk of a row checkpoint. A join with the result
    knows its size: the planner broadcasts it below spark.sql.autoBroadcastJoinThreshold.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables written so far in this process; results that read them must be done."""
    jvm = spark.sparkContext._jvm
    while _TABLES:
        where = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_tables(spark)
    except Exception:  # noqa: BLE001
        pass  # the session is gone; its folder stays for the next cleaning


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    For tables read or cut, as the count runs them. Beyond the bound the join is a
    shuffle join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else with one for a sort-merge join.

    Unlike ``small`` it never leaves the choice to the planner, which goes by the bytes of
    the file: rows of few distinct values shrink there, but not in a broadcast, which the
    driver holds.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by its keys in as many parts as keep all cores busy.

    For few rows that cost much each: adaptive execution joins parts of few bytes, down
    to a single task for all of them, but not those of a given number.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(c: str | Column) -> Column:
    """A double with NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """A double with NaN and both infinities as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp with or without zone, read as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
