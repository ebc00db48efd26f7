"""A grid of fits as one job: every model on every fold of every dataset, each timed and failing by itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Predicts test rows from training rows: (x, y, x of the test) to labels.
FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
CELL = ("dataset", "fold", "model")
#: Rows of a fold that a task may hold. Folds beyond it belong to the learners of Spark, see ``models``.
MOST_ROWS = 1_000_000


def folded(rows: DataFrame, folds: int) -> DataFrame:
    """Rows (dataset, part, ...) once for each of ``folds`` folds, with split: test where the row's part is the fold, else train."""
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.withColumn("split", F.when(F.col("part") == F.col("fold"), "test").otherwise("train")).drop("part")


def fit_grid(rows: DataFrame, fits: Mapping[str, FitPredict], most_rows: int = MOST_ROWS) -> DataFrame:
    """(dataset, fold, model, row, y_true, y_pred, seconds, error) from rows (dataset, fold, split, row, x, y_true).

    A cell of the grid is a task's work: a model, a dataset and a fold. It gives
    a row per test row with its prediction, and the seconds that the cell took.
    A cell that fails, when it fits or when it predicts, gives one row with the
    error and neither row nor labels; so does one whose fold has more than
    ``most_rows`` rows, none of which it is given then. Missing features are 0;
    rows without a label are tested, not learned from.
    """
    held = rows.select("dataset", "fold", "split", "row", "x", F.col("y_true").cast("long").alias("y_true"))
    sizes = held.groupBy("dataset", "fold").agg(F.count("*").alias("_n"))
    many = sizes.filter(F.col("_n") > most_rows)
    fine = held.join(many, ["dataset", "fold"], "left_anti")
    schema = StructType([held.schema["dataset"], held.schema["fold"], StructField("model", StringType()), held.schema["row"], held.schema["y_true"], StructField("y_pred", held.schema["y_true"].dataType), StructField("seconds", DoubleType()), StructField("error", StringType())])

    def run(table: pa.Table) -> pa.Table:
        dataset, fold, model = (table.column(c)[0] for c in CELL)
        train, test = (table.filter(pa.compute.equal(table.column("split"), s)) for s in ("train", "test"))
        train = train.filter(pa.compute.is_valid(train.column("y_true")))
        began = time.perf_counter()
        try:
            predicted = np.asarray(fits[model.as_py()](_matrix(train), train.column("y_true").to_numpy(), _matrix(test)))
            if predicted.shape != (test.num_rows,):
                raise ValueError(f"{test.num_rows} rows, predictions of shape {predicted.shape}")
            error, told = None, test
        except Exception as e:  # noqa: BLE001  a model's failure is a result of its own
            error, told, predicted = f"{type(e).__name__}: {e}", test.slice(0, 0), None
        seconds, n = time.perf_counter() - began, told.num_rows if error is None else 1
        of = lambda c: told.column(c).combine_chunks() if error is None else pa.nulls(1, told.schema.field(c).type)
        labels = pa.array(predicted, pa.int64()) if error is None else pa.nulls(1, pa.int64())
        same = lambda v, t=None: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v] * n, v.type if isinstance(v, pa.Scalar) else t)
        return pa.Table.from_arrays([same(dataset), same(fold), same(model), of("row"), of("y_true"), labels, same(seconds, pa.float64()), same(error, pa.string())], schema.names)

    cells = fine.withColumn("model", F.explode(F.array(*map(F.lit, fits)))).groupBy(*CELL).applyInArrow(run, schema)
    refused = many.withColumn("model", F.explode(F.array(*map(F.lit, fits)))).select(
        *CELL, *(F.lit(None).cast(schema[c].dataType).alias(c) for c in ("row", "y_true", "y_pred")), F.lit(0.0).alias("seconds"), F.format_string("%d rows are too many for a task", F.col("_n")).alias("error")
    )
    return cells.unionByName(refused)


def _matrix(table: pa.Table) -> np.ndarray:
    rows = [np.nan_to_num(np.array(x, float)) for x in table.column("x").to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, 0))


def cells_of(grid: DataFrame) -> DataFrame:
    """(dataset, fold, model, rows, hits, seconds, error): a row per cell."""
    hit = F.count_if(F.col("y_true") == F.col("y_pred"))
    return grid.groupBy(*CELL).agg(F.count("row").alias("rows"), hit.alias("hits"), F.first("seconds").alias("seconds"), F.first("error").alias("error"))


def most_frequent(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """The most frequent label, the smallest of equally frequent ones."""
    labels, counts = np.unique(y, return_counts=True)
    return np.full(len(test), labels[counts.argmax()])


def nearest_mean(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """The label whose mean is nearest, the smallest of equally near ones."""
    labels = np.unique(y)
    means = np.stack([x[y == k].mean(axis=0) for k in labels])
    return labels[((test[:, None, :] - means) ** 2).sum(axis=2).argmin(axis=1)]

