"""Metrics of two rules that predict quality labels, and ranks of models over datasets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import evaluate as ev
from ..operators import grid
from .tables import PREDICTIONS_SQL, SCORES_SQL, load, predictions, scores

MODELS = ("m0", "m1", "m2", "m3")
FOLDS = 5


def _broken(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Fails where the test rows have no short text."""
    if test.min() > 60:
        raise ValueError("no short text")
    return np.where(test[:, 0] > 300, 1, 0)


def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules on the length of a text, on every fold of every language; one of them fails on some folds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    rows = load(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("dataset"), (F.col("doc_id") % FOLDS).cast("int").alias("part"), F.col("doc_id").alias("row"), F.array(F.col("n_chars").cast("double")).alias("x"), F.col("quality").alias("y_true")
    )
    cells = grid.cells_of(grid.fit_grid(grid.folded(rows, FOLDS), {"majority": grid.most_frequent, "nearest": grid.nearest_mean, "broken": _broken}))
    return cells.select("dataset", "fold", "model", "rows", "hits", "error")


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(predictions(spark, sf_dir), "model", extra_labels=(3,)).select("model", "y_true", "y_pred", "n")


def eval_per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = ev.per_class(predictions(spark, sf_dir), "model")
    return classes.select("model", "label", "actual", "predicted", *(rounded(c).alias(c) for c in ("precision", "recall", "f1")))


def _metric(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ev.metrics(predictions(spark, sf_dir), "dataset", "model").select("dataset", "model", rounded(name).alias(name))

    return run


def eval_accuracy_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.metrics(predictions(spark, sf_dir), "model", "fold").select("model", "fold", rounded("accuracy").alias("accuracy"), "n")


def eval_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ev.fold_summary(predictions(spark, sf_dir), "model")
    return summary.select("model", "n_folds", *(rounded(f"{m}_{s}").alias(f"{m}_{s}") for m in ev.METRICS for s in ("mean", "std")))


def eval_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ev.rank_table(scores(spark, sf_dir))
    return ranks.select("model", "wins", "n_ranked", "n_datasets", *(rounded(c).alias(c) for c in ("mean_rank", "mean_score", "median_score")))


def eval_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = scores(spark, sf_dir).filter("score is not null")
    return ev.average_ranks(known, "score", "dataset").select("dataset", "model", "score", F.col("rank").cast("double").alias("rank"))


def eval_family_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.family_table(scores(spark, sf_dir), MODELS).select("family", "n", *(rounded(m).alias(m) for m in MODELS))


def eval_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_models(scores(spark, sf_dir))


def eval_dataset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dataset_order(scores(spark, sf_dir), ("R", "N_clf_3"))


def folds_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.loso_folds(load(spark, sf_dir, "embeddings").select("vec_id", "label"), "label").select("vec_id", "held_out", "split")


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on both sides of a split of all events: a third to test, the rest to train."""
    events = load(spark, sf_dir, "events").select("user_id", F.coalesce(F.col("event_id") % 3 == 0, F.lit(False)).alias("test"))
    return ev.leaked_groups(events.filter("test"), events.filter("not test"), "user_id")


def fold_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return ev.fold_complement(docs, F.col("doc_id") % 5 == 2)


def labels_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stable_unique(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")




def _classes(*by: str) -> str:
    keys = ", ".join(by)
    return f"""WITH {PREDICTIONS_SQL},
sides AS (
  SELECT {keys}, y_true AS label, 1 AS actual, 0 AS predicted, (y_true = y_pred)::INT AS hits FROM predictions
  UNION ALL SELECT {keys}, y_pred, 0, 1, 0 FROM predictions),
classes AS (
  SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(actual, 0), 0) AS recall,
    coalesce(2.0::DOUBLE * hits / nullif(actual + predicted, 0), 0) AS f1
  FROM (SELECT {keys}, label, sum(actual)::BIGINT AS actual, sum(predicted)::BIGINT AS predicted, sum(hits)::BIGINT AS hits FROM sides GROUP BY ALL)),
metrics AS (
  SELECT {keys}, avg(f1) AS macro_f1, avg(f1) FILTER (actual > 0) AS macro_f1_present, avg(recall) FILTER (actual > 0) AS balanced_accuracy,
    sum(hits)::DOUBLE / sum(actual) AS accuracy, sum(actual)::BIGINT AS n
  FROM classes GROUP BY ALL)
"""


_FAIR = f"""WITH {SCORES_SQL},
known AS (SELECT * FROM scores WHERE score IS NOT NULL),
fair AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS k, max(score) OVER (PARTITION BY dataset) AS best FROM known)"""

QUERIES = {
    "eval_confusion": eval_confusion,
    "eval_per_class_f1": eval_per_class_f1,
    "eval_macro_f1": _metric("macro_f1"),
    "eval_macro_f1_present": _metric("macro_f1_present"),
    "eval_balanced_accuracy": _metric("balanced_accuracy"),
    "eval_accuracy_by_fold": eval_accuracy_by_fold,
    "eval_fold_summary": eval_fold_summary,
    "eval_rank_table": eval_rank_table,
    "eval_average_ranks": eval_average_ranks,
    "eval_family_pivot": eval_family_pivot,
    "eval_best_model": eval_best_model,
    "eval_dataset_order": eval_dataset_order,
    "model_grid": model_grid,
    "folds_loso": folds_loso,
    "leak_check": leak_check,
    "fold_complement": fold_complement,
    "labels_in_order": labels_in_order,
}
ORACLES = {
    "model_grid": """WITH d AS (SELECT lang AS dataset, (doc_id % 5)::INT AS part, doc_id, n_chars::DOUBLE AS x, quality AS y FROM labels JOIN documents USING (doc_id)),
folds AS (SELECT DISTINCT dataset, k::INT AS fold FROM d, range(5) AS r(k)),
train AS (SELECT f.dataset, fold, y, count(*) AS n, avg(x) AS m FROM folds f JOIN d ON d.dataset = f.dataset AND part <> fold GROUP BY ALL),
top AS (SELECT dataset, fold, y FROM train QUALIFY row_number() OVER (PARTITION BY dataset, fold ORDER BY n DESC, y) = 1),
near AS (
  SELECT d.dataset, fold, doc_id, d.y, t.y AS p FROM d JOIN train t ON t.dataset = d.dataset AND part = fold
  QUALIFY row_number() OVER (PARTITION BY d.dataset, fold, doc_id ORDER BY (x - m) * (x - m), t.y) = 1)
SELECT d.dataset, fold, 'majority' AS model, count(*) AS rows, count(*) FILTER (d.y = t.y) AS hits, NULL AS error FROM d JOIN top t ON t.dataset = d.dataset AND part = fold GROUP BY ALL
UNION ALL SELECT dataset, fold, 'nearest', count(*), count(*) FILTER (y = p), NULL FROM near GROUP BY ALL
UNION ALL SELECT dataset, part, 'broken', CASE WHEN min(x) > 60 THEN 0 ELSE count(*) END, CASE WHEN min(x) > 60 THEN 0 ELSE count(*) FILTER (y = (x > 300)::INT) END,
  CASE WHEN min(x) > 60 THEN 'ValueError: no short text' END FROM d GROUP BY dataset, part""",
    "eval_confusion": f"""WITH {PREDICTIONS_SQL},
labels AS (SELECT DISTINCT model, label FROM (
  SELECT model, y_true AS label FROM predictions UNION ALL SELECT model, y_pred FROM predictions UNION ALL SELECT DISTINCT model, 3 FROM predictions))
SELECT a.model, a.label AS y_true, b.label AS y_pred, count(p.doc_id) AS n
FROM labels a JOIN labels b ON a.model = b.model LEFT JOIN predictions p ON p.model = a.model AND p.y_true = a.label AND p.y_pred = b.label GROUP BY ALL""",
    "eval_per_class_f1": _classes("model") + "SELECT model, label, actual, predicted, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM classes",
    **{f"eval_{m}": _classes("dataset", "model") + f"SELECT dataset, model, round_even({m}, 6) AS {m} FROM metrics" for m in ("macro_f1", "macro_f1_present", "balanced_accuracy")},
    "eval_accuracy_by_fold": _classes("model", "fold") + "SELECT model, fold, round_even(accuracy, 6) AS accuracy, n FROM metrics",
    "eval_fold_summary": _classes("model", "fold")
    + "SELECT model, count(*) AS n_folds, "
    + ", ".join(f"round_even({f}({m}), 6) AS {m}_{s}" for m in ev.METRICS for s, f in (("mean", "avg"), ("std", "stddev_pop")))
    + " FROM metrics GROUP BY model",
    "eval_rank_table": _FAIR
    + """, ranked AS (
  SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS rank FROM fair WHERE k >= 2)
SELECT model, count(*) FILTER (score >= best - 1e-12) AS wins, count(*) AS n_ranked, (SELECT count(DISTINCT dataset) FROM scores) AS n_datasets,
  round_even(avg(rank)::DOUBLE, 6) AS mean_rank, round_even(avg(score), 6) AS mean_score, round_even(median(score), 6) AS median_score FROM ranked GROUP BY model""",
    "eval_average_ranks": _FAIR + "SELECT dataset, model, score, (rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0)::DOUBLE AS rank FROM known",
    "eval_family_pivot": f"""WITH {SCORES_SQL},
named AS (SELECT split_part(dataset, '_clf', 1) AS family, model, score FROM scores)
SELECT family, max(n) AS n, """
    + ", ".join(f"round_even(max(mean) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS)
    + " FROM (SELECT family, model, avg(score) AS mean, count(score) AS n FROM named GROUP BY ALL) GROUP BY family",
    "eval_best_model": _FAIR + " SELECT dataset, model, score FROM known QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) = 1",
    "eval_dataset_order": f"""WITH {SCORES_SQL}
SELECT DISTINCT dataset, CASE WHEN starts_with(dataset, 'R') THEN 0 WHEN starts_with(dataset, 'N_clf_3') THEN 1 ELSE 2 END AS rank FROM scores""",
    "folds_loso": "SELECT vec_id, l.label AS held_out, CASE WHEN e.label = l.label THEN 'test' ELSE 'train' END AS split FROM embeddings e, (SELECT DISTINCT label FROM embeddings) l",
    "leak_check": "SELECT user_id FROM events WHERE coalesce(event_id % 3 = 0, FALSE) INTERSECT SELECT user_id FROM events WHERE NOT coalesce(event_id % 3 = 0, FALSE)",
    "fold_complement": "SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 2",
    "labels_in_order": "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1",
}
