"""Session settings and materialisation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "kinegrid", **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC timestamps, and skewed joins split at run time."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a single machine where that is unset."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut.

    What Spark has inferred about the columns is dropped too: it would pile up
    in the plans of an iteration, round by round.
    """
    spark, name = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    checkpoint_dir(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def running_before(rows: DataFrame, groups: tuple[str, ...], order: str, amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the group that come before in ``order`` (unlike in each group).

    Rows are dealt out in order of group and ``order``. Sums within a part and
    of whole parts before it add up, so that no task holds a large group.
    """
    dealt = checkpointed(rows.repartitionByRange(*groups, order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*groups, "_part").agg(F.sum(amount).alias("_sum")).withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return placed.join(parts, [*groups, "_part"]).withColumn(out, F.col("_offset") + F.col("_within")).drop("_part", "_offset", "_within")
