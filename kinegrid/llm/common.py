"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only on a single machine (master
    local) a temporary folder takes its place where that is unset; a cluster
    without a shared folder is an error.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    The files go when the result is no longer referenced, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, of a few numbers a row, marked for a broadcast if it has at most ``rows`` rows; else Spark joins it by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def hash_sample(rows: DataFrame, hashed: Column, n: int, total: int, distinct: bool = False) -> DataFrame:
    """The ``n`` rows with the smallest of their 64-bit hashes, of ``total`` rows (or, if ``distinct``, of as many different ones).

    A bound on the hash lets about twice as many through before they are sorted,
    so what reaches the one task that takes the smallest doesn't grow with the
    number of partitions. Rows that share a hash can make it fewer than ``n``.
    """
    share = min(1.0, (2 * n + 200) / max(total, 1))
    some = rows.withColumn("_hash", hashed)
    if share < 1:
        some = some.filter(F.col("_hash") <= F.lit(int(-(2**63) + share * (2**64 - 2**11))))
    if distinct:
        some = some.distinct()
    order = [F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    return some.orderBy("_hash", *order).limit(n).drop("_hash")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers hold, as texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone (52 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
