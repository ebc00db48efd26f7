"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pose import point
from ..functions.stats import rounded

#: Added before rounding: sums in another order must not fall on the other side of a tie.
NUDGE = 1e-9


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(c: str, places: int = 6) -> Column:
    """A column for comparison: nudged off ties, then rounded."""
    return rounded(F.col(c) + NUDGE, places).alias(c)


def reps(spark: SparkSession, sf_dir: str, persons: int | None = 10) -> DataFrame:
    """(rep_id, person, excursion, signal, condition, view): a line of an order as a repetition; customers share ``persons`` numbers, or have their own."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rep_id"),
        (F.col("o_custkey") if persons is None else F.col("o_custkey") % persons).alias("person"),
        F.col("l_quantity").alias("excursion"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("signal"),
        F.col("l_returnflag").alias("condition"),
        F.col("l_linestatus").alias("view"),
    )


REPS_SQL = """
reps AS (
  SELECT l_orderkey * 10 + l_linenumber AS rep_id, o_custkey % 10 AS person, l_quantity AS excursion,
    l_extendedprice / l_quantity AS signal, l_returnflag AS condition, l_linestatus AS view
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, side, frame, value): a user's events as a series; error events are gaps."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.select(
        F.col("user_id").alias("entity"),
        F.when(F.col("event_type").isin("click", "purchase"), "R").otherwise("L").alias("side"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_type",
    )


SERIES_SQL = """
series AS (
  SELECT user_id AS entity, CASE WHEN event_type IN ('click', 'purchase') THEN 'R' ELSE 'L' END AS side,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    CASE WHEN event_type <> 'error' THEN value END AS value, epoch_us(ts) AS us, event_type
  FROM events)"""


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, side, frame, value) with frames of each side counted on their own."""
    order = Window.partitionBy("entity", "side").orderBy("frame")
    return series(spark, sf_dir).withColumn("frame", (F.row_number().over(order) - 1).cast("long")).select("entity", "side", "frame", "value")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, frame, lm): the first 34 numbers of an embedding as 17 points, in pixels; its label is the clip."""
    e = load(spark, sf_dir, "embeddings")
    order = Window.partitionBy("label").orderBy("vec_id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: point((F.get("embedding", 2 * k).cast("double") + 1) * 320, (F.get("embedding", 2 * k + 1).cast("double") + 1) * 240))
    return e.select(F.col("label").alias("entity"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("vec_id"), pixels.alias("lm"))


#: The same, with the coordinates as lists x and y (1-based).
POSES_SQL = """
poses AS (
  SELECT label AS entity, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
    [(embedding[2 * k + 1]::DOUBLE + 1) * 320 FOR k IN range(17)] AS x,
    [(embedding[2 * k + 2]::DOUBLE + 1) * 240 FOR k IN range(17)] AS y
  FROM embeddings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, model, fold, y_true, y_pred): quality labels against two rules on the length of a text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rules = F.array(
        F.struct(F.lit("length").alias("model"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("y_pred")),
        F.struct(F.lit("bucket").alias("model"), F.least(F.floor(F.col("n_chars") / 800), F.lit(2)).cast("int").alias("y_pred")),
    )
    return labels.join(docs, "doc_id").select(
        F.col("lang").alias("dataset"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("quality").cast("int").alias("y_true"), "doc_id", F.inline(rules)
    )


PREDICTIONS_SQL = """
predictions AS (
  SELECT lang AS dataset, (doc_id % 5)::INT AS fold, quality::INT AS y_true, doc_id, 'length' AS model, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS y_pred
  FROM labels JOIN documents USING (doc_id)
  UNION ALL
  SELECT lang, (doc_id % 5)::INT, quality::INT, doc_id, 'bucket', least(n_chars // 800, 2)::INT
  FROM labels JOIN documents USING (doc_id))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, model, score): mean discounts of lines by flag and number, some of them equal or missing."""
    lines = load(spark, sf_dir, "lineitem")
    named = F.concat("l_returnflag", F.lit("_clf_"), (F.col("l_orderkey") % 7).cast("string"))
    grouped = lines.groupBy(named.alias("dataset"), F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("model")).agg(F.avg("l_discount").alias("mean"), F.count("*").alias("n"))
    return grouped.select("dataset", "model", F.when(F.col("n") % 11 != 0, F.bround("mean", 3)).alias("score"))


SCORES_SQL = """
scores AS (
  SELECT l_returnflag || '_clf_' || (l_orderkey % 7)::VARCHAR AS dataset, 'm' || (l_linenumber % 4)::VARCHAR AS model,
    CASE WHEN count(*) % 11 <> 0 THEN round_even(avg(l_discount), 3) END AS score
  FROM lineitem GROUP BY 1, 2)"""
