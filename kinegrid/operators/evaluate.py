"""Scoring of classifiers from long tables of predictions.

A prediction row has y_true and y_pred, and whatever columns group it: dataset,
model, fold. Every metric is an aggregate of one confusion count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def confusion_counts(predictions: DataFrame, *by: str) -> DataFrame:
    """(by..., y_true, y_pred, n) for the pairs that occur; partial sums leave little to shuffle."""
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, *by: str, extra_labels: tuple = ()) -> DataFrame:
    """Dense: a row for every pair of labels in the union of both columns and ``extra_labels``, 0 where it never occurs.

    The labels of a group are an array of its own, so that no join pairs them.
    """
    counts = confusion_counts(predictions, *by)
    either = counts.select(*by, F.explode(F.array("y_true", "y_pred")).alias("label"))
    extra = F.array(*map(F.lit, extra_labels)) if extra_labels else None
    labels = F.collect_set("label") if extra is None else F.array_union(F.collect_set("label"), extra)
    grid = either.groupBy(*by).agg(F.sort_array(labels).alias("labels")) if by else either.agg(F.sort_array(labels).alias("labels"))
    pairs = grid.select(*by, "labels", F.explode("labels").alias("y_true")).select(*by, "y_true", F.explode("labels").alias("y_pred"))
    return pairs.join(counts, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(predictions: DataFrame, *by: str) -> DataFrame:
    """(by..., label, actual, predicted, hits, precision, recall, f1) over the union of labels; 0 on an empty denominator."""
    counts = confusion_counts(predictions, *by)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    summed = counts.select(*by, F.inline(sides)).groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("actual", "predicted", "hits")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return summed.withColumns({"precision": zero(ratio("hits", "predicted")), "recall": zero(ratio("hits", "actual"))}).withColumn(
        "f1", zero(ratio(2 * F.col("hits"), F.col("actual") + F.col("predicted")))
    )


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """macro_f1 over the union of labels, macro_f1_present and balanced_accuracy over those in y_true, accuracy."""
    classes = per_class(predictions, *by)
    present = F.col("actual") > 0
    return classes.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1_present"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
        ratio(F.sum("hits"), F.sum("actual")).alias("accuracy"),
        F.sum("actual").alias("n"),
    )


METRICS = ("macro_f1", "macro_f1_present", "balanced_accuracy", "accuracy")


def fold_summary(predictions: DataFrame, *by: str, fold: str = "fold") -> DataFrame:
    """Mean and population standard deviation of every metric over folds."""
    each = metrics(predictions, *by, fold)
    sums = [f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return each.groupBy(*by).agg(*sums, F.count("*").alias("n_folds"))


def average_ranks(scores: DataFrame, score: str, *by: str, descending: bool = True) -> DataFrame:
    """Ranks within each group; equal scores share their mean rank."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc() if descending else F.col(score))
    peers = Window.partitionBy(*by, score)
    return scores.withColumn("rank", F.rank().over(order) + (F.count("*").over(peers) - 1) / 2)


def rank_table(scores: DataFrame, dataset: str = "dataset", model: str = "model", score: str = "score", tolerance: float = 1e-12) -> DataFrame:
    """Per model: mean_rank, wins, mean and median score, and n_datasets (all of the input, also those left out).

    Non-finite scores don't count; datasets with fewer than two scored models
    are left out. Every model within ``tolerance`` of a dataset's best wins it.
    """
    known = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    here = Window.partitionBy(dataset)
    fair = known.withColumns({"_n": F.count("*").over(here), "_best": F.max(score).over(here)}).filter("_n >= 2")
    ranked = average_ranks(fair, score, dataset)
    total = scores.agg(F.countDistinct(dataset)).first()[0]
    return ranked.groupBy(model).agg(
        F.avg("rank").alias("mean_rank"),
        F.count_if(F.col(score) >= F.col("_best") - tolerance).alias("wins"),
        F.avg(score).alias("mean_score"),
        F.median(score).alias("median_score"),
        F.count("*").alias("n_ranked"),
        F.lit(total).alias("n_datasets"),
    )


def best_models(scores: DataFrame, dataset: str = "dataset", model: str = "model", score: str = "score") -> DataFrame:
    """(dataset, model, score): the best-scored model of each dataset, the first by name of equal ones; non-finite scores don't count."""
    known = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    best = F.min_by(F.struct(model, score), F.struct((-F.col(score)).alias("s"), F.col(model).alias("m"))).alias("_b")
    return known.groupBy(dataset).agg(best).select(dataset, f"_b.{model}", f"_b.{score}")


def dataset_order(names: DataFrame, prefixes: tuple[str, ...], dataset: str = "dataset") -> DataFrame:
    """(dataset, rank): names with the first of ``prefixes`` come first, those with none last; sort by rank, then name."""
    rank = F.coalesce(*(F.when(F.startswith(F.col(dataset), F.lit(p)), F.lit(k)) for k, p in enumerate(prefixes)), F.lit(len(prefixes)))
    return names.select(dataset).distinct().withColumn("rank", rank)


def family_table(scores: DataFrame, models: tuple[str, ...], dataset: str = "dataset", model: str = "model", score: str = "score", separator: str = "_clf") -> DataFrame:
    """Mean score per dataset family (the part of the name before ``separator``) and model, and n, the most datasets of any model."""
    named = scores.withColumn("family", F.split(F.col(dataset), separator, 2)[0])
    wide = named.groupBy("family").pivot(model, list(models)).agg(F.avg(score))
    sizes = named.groupBy("family", model).agg(F.count(score).alias("_n")).groupBy("family").agg(F.max("_n").alias("n"))
    return wide.join(sizes, "family")


def loso_folds(rows: DataFrame, group: str) -> DataFrame:
    """Each row once per held-out group, with split test for its own group and train for the others.

    That many rows are the result asked for; who trains fold by fold filters on
    ``group <> held_out`` instead. The groups are a scalar subquery.
    """
    groups = rows.filter(F.col(group).isNotNull()).agg(F.sort_array(F.collect_set(group)))
    held = F.explode(groups.scalar()).alias("held_out")
    return rows.select("*", held).withColumn("split", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))


def hashed_folds(rows: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """K folds by a hash of the key: the same on every run and for any partitioning."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups that occur on both sides; a clean split gives none."""
    return train.select(group).intersect(test.select(group))


def assert_no_group_leak(train: DataFrame, test: DataFrame, group: str) -> None:
    found = [r[0] for r in leaked_groups(train, test, group).orderBy(group).limit(5).collect()]
    if found:
        raise ValueError(f"groups on both sides: {found}")


def fold_complement(rows: DataFrame, fold: Column) -> DataFrame:
    """The rows that are not in a fold."""
    return rows.filter(~F.coalesce(fold, F.lit(False)))


def stable_unique(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the first place of each, in that order."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen")).orderBy("first_seen")
