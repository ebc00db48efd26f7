"""Mix sources to target weights by repeating documents.

Words are summed per source, targets follow from the weights, and each source
gets a rate, its target over its size. Every document is emitted floor(rate)
times, plus once more if a hash of its id falls below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, cut, table, unit_hash

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Per source: source_size, target, and rate (target over size, 0 for an empty source).

    ``sizes`` has a row (source, size) per document. Sources in order of code
    points, null last, take the weights in turn. All targets together equal all
    sizes. A target stops at ``max_rate`` times its source's size, and what is
    cut off goes to the others by weight until no target is above: the targets
    are min(max_rate * size, level * weight) for the one level that gives that
    sum. The sources in order of size over weight are capped one after the
    other, so running sums give the level: that of the first source that stays
    below its cap, which is the highest among those that do. This table has a row per source;
    the windows over all of it see no documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    cap = F.lit(max_rate) * F.col("source_size")
    # the source's own cap belongs to the sums only if it is capped itself
    before = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("_level", left / weight_left).withColumn("_open", cap / F.col("weight") >= F.col("_level"))
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    target = F.when(F.col("_open"), F.col("weight") * level).otherwise(cap.cast("double"))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("_open"), F.least(F.lit(float(max_rate)), target / F.col("source_size"))).otherwise(F.lit(float(max_rate)))
    return levels.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies_of(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more if ``draw``, a number in [0, 1), lies below the rest."""
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def with_draws(docs: DataFrame, key: str, text: str, source: str, seed: str = SEED) -> DataFrame:
    """``docs`` with _draw: a hash of the id, the same in every run.

    Rows that share an id, or have none, must not share a draw, or a source of
    them would be taken all or not at all. Theirs is a hash of the id, the
    source, the text and the row's number among rows equal in these. Equal rows
    are numbered within parts, and the parts add up, so no task holds a large
    group of them; which one has which number makes no difference.
    """
    k, t, s = (F.col(f"`{c}`") for c in (key, text, source))
    repeated = bounded_broadcast(docs.filter(k.isNotNull()).groupBy(k.alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"))
    if repeated.isEmpty() and docs.filter(k.isNull()).isEmpty():
        return docs.withColumn("_draw", unit_hash(k, seed))
    # rows without an id match nothing; they stay out of the joins, where they would all meet
    single = docs.filter(k.isNotNull()).join(repeated, k == F.col("_key"), "left_anti").withColumn("_draw", unit_hash(k, seed))
    alike = docs.filter(k.isNotNull()).join(repeated, k == F.col("_key"), "left_semi").unionByName(docs.filter(k.isNull()))
    digest = F.sha2(F.concat_ws(":", *(F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256) for c in (k, s, t)), *(c.isNull().cast("string") for c in (k, s, t))), 256)
    shared = cut(alike.withColumns({"_digest": digest, "_part": F.spark_partition_id()}))
    parts = shared.groupBy("_digest", "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_digest", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_digest", "_part").orderBy(F.lit(0)))
    numbered = shared.withColumn("_number", number).join(offsets, ["_digest", "_part"])
    drawn = unit_hash(F.concat_ws(":", "_digest", F.col("_offset") + F.col("_number")), seed)
    return single.unionByName(numbered.withColumn("_draw", drawn).drop("_digest", "_part", "_number", "_offset"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies.

    The targets have a row per source. They are written once, and Spark picks a
    broadcast only if they are small; else it joins by shuffle and splits hot
    sources. A null text has size 0; sources without words get a target of 0.
    Columns of ``docs`` named like an added one are replaced.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies", "_source", "_rate", "_draw", "_key", "_digest", "_part", "_number", "_offset")
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = cut(source_targets(sizes, weights, max_rate))
    named = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    return (
        with_draws(docs, key, text, source, seed)
        .withColumn("_size", word_count(F.col(text)))
        .join(named, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies_of(F.col("_rate"), F.col("_draw")))
        .drop("_source", "_rate", "_draw")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as ``mix_plan`` says, with the columns of ``docs``."""
    text, key, source = (options.get(k, d) for k, d in (("text", "text"), ("key", "doc_id"), ("source", "source")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(0).alias("_")).alias("row")
    used = {name: F.col(f"`{c}`").alias(name) for name, c in (("text", text), ("key", key), ("source", source))}
    plan = mix_plan(docs.select(row, *used.values()), **(options | {"text": "text", "key": "key", "source": "source"}))
    copies = plan.select("row", "text", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return copies.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; a row for each, in no order.

    A null text has size 0, a null source is a source of its own. Rows that
    share a doc_id, or have none, are drawn one by one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mix_plan(docs)
    return plan.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM by_source),
levels AS (
  SELECT *,
    ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(level) AS level FROM levels WHERE cap::DOUBLE / weight >= level),
targets AS (
  SELECT source, source_size,
    CASE WHEN cap::DOUBLE / weight >= levels.level THEN weight * level.level ELSE cap::DOUBLE END AS target,
    CASE WHEN source_size = 0 THEN 0.0 WHEN cap::DOUBLE / weight >= levels.level
         THEN least(3.0::DOUBLE, weight * level.level / source_size) ELSE 3.0 END::DOUBLE AS rate
  FROM levels, level),
drawn AS (
  SELECT s.*, t.source_size, t.target, t.rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn
"""
