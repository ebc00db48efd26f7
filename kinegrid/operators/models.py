"""Classifiers behind one signature: fit(train) gives a function that adds y_pred to test rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Shares that leave a Python worker at once, 4 MB, and series of a task.
BATCH_VALUES, TASK_ROWS = 1 << 19, 2048
#: Of rows that are kept for the next iteration: an array of half a region of the JVM's heap (1 MB in small ones) takes whole regions.
BLOCK_MB = 0.4

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def majority(train: DataFrame, test: DataFrame, label: str = "y_true") -> DataFrame:
    """The most frequent label of the training rows, the smallest of equally frequent ones."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))).first()[0]
    return test.withColumn("y_pred", F.lit(best))


def majority_by(rows: DataFrame, *by: str, label: str = "y_true") -> DataFrame:
    """(by..., y_pred): the majority label of each group, all groups in one aggregate."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("y_pred"))


def balanced_weights(train: DataFrame, label: str = "y_true") -> DataFrame:
    """Adds weight n / (k * n_c), so that every class weighs the same."""
    counts = train.groupBy(label).agg(F.count("*").alias("_c"))
    n, k = counts.agg(F.sum("_c"), F.count("*")).first()
    return train.join(counts, label).withColumn("weight", F.lit(float(n or 0)) / (F.lit(float(k or 1)) * F.col("_c"))).drop("_c")


def random_forest(train: DataFrame, test: DataFrame, features: list[str], label: str = "y_true", trees: int = 300, seed: int = 0) -> DataFrame:
    """Balanced forest on columns; missing features count as 0."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x").transform
    model = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="weight", numTrees=trees, seed=seed, predictionCol="_p").fit(assemble(balanced_weights(train, label).na.fill(0.0, features)))
    return model.transform(assemble(test.na.fill(0.0, features))).withColumn("y_pred", F.col("_p").cast("int")).drop("_x", "_p", "rawPrediction", "probability")


def flattened(tensors: DataFrame, key: str = "case", channel: str = "channel", value: str = "values") -> DataFrame:
    """(case, x): all channels of a case, in order, as one array."""
    ordered = F.sort_array(F.collect_list(F.struct(channel, value)))
    return tensors.groupBy(key).agg(F.flatten(F.transform(ordered, lambda c: c[value])).alias("x"))


def kernel_dilations(length: int, features: int = 10_000, most: int = 32) -> list[tuple[int, int]]:
    """(dilation, biases of each kernel): dilations from 1 to what fits the length, evenly in exponents, with the features shared out among them."""
    each = features // len(KERNELS)
    reach = max(0.0, np.log2(max((length - 1) / (KERNELS.shape[1] - 1), 1)))
    steps, counts = np.unique(np.exp2(np.linspace(0, reach, min(each, most))).astype(int), return_counts=True)
    shares = counts * each // counts.sum()
    shares[: each - shares.sum()] += 1
    return [(int(d), int(n)) for d, n in zip(steps, shares, strict=True) if n]


#: The fixed kernels: nine weights, three of them 2 and the others -1, in every arrangement.
KERNELS = np.array([[2.0 if k in chosen else -1.0 for k in range(9)] for chosen in combinations(range(9), 3)])


def kernel_responses(x: np.ndarray, dilation: int) -> np.ndarray:
    """(kernels, samples): all kernels over a series padded with zeros."""
    padded = np.pad(x, 4 * dilation)
    return KERNELS @ np.stack([padded[k * dilation : k * dilation + len(x)] for k in range(9)])


def kernel_biases(samples: list[np.ndarray], dilations: list[tuple[int, int]]) -> list[np.ndarray]:
    """Per dilation (kernels, biases): quantiles of the responses to one of ``samples`` each, spread evenly by the golden ratio."""
    out, seen = [], 0
    for k, (dilation, n) in enumerate(dilations):
        places = (np.arange(seen, seen + len(KERNELS) * n).reshape(len(KERNELS), n) + 1) * ((np.sqrt(5) + 1) / 2) % 1
        seen += places.size
        responses = [kernel_responses(samples[(k * len(KERNELS) + j) % len(samples)], dilation)[j] for j in range(len(KERNELS))]
        out.append(np.stack([np.quantile(r, p) for r, p in zip(responses, places, strict=True)]))
    return out


def kernel_features(x: np.ndarray, dilations: list[tuple[int, int]], biases: list[np.ndarray]) -> np.ndarray:
    """The share of positive responses for every kernel, dilation and bias.

    Every other kernel counts only samples that it meets without padding, if any.
    """
    out = []
    for (dilation, _), bias in zip(dilations, biases, strict=True):
        above = kernel_responses(x, dilation)[:, None, :] > bias[:, :, None]
        share, margin = above.mean(axis=2), 4 * dilation
        if len(x) > 2 * margin:
            share[1::2] = above[1::2, :, margin:-margin].mean(axis=2)
        out.append(share.ravel())
    return np.concatenate(out)


def _with_shares(x: str, dilations: list[tuple[int, int]], biases: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``features`` to Arrow batches. A row of shares is far larger than its series, so rows leave in batches of ``BATCH_VALUES`` shares."""
    held = max(1, BATCH_VALUES // max(1, sum(b.size for b in biases)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                part = batch.slice(at, held)
                shares = [kernel_features(_series(v), dilations, biases) for v in part.column(x).to_pylist()]
                ends = np.cumsum([0, *map(len, shares)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shares)))], [*part.schema.names, "features"])

    return run


def with_kernel_features(rows: DataFrame, length: int, samples: list[np.ndarray], x: str = "x", features: int = 10_000) -> DataFrame:
    """Adds ``features``, about that many shares; dilations and biases travel with the function. Rows are dealt out to all cores."""
    dilations = kernel_dilations(length, features)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    kinds = StructType([*rows.schema, StructField("features", ArrayType(DoubleType()))])
    return rows.repartition(parts).mapInArrow(_with_shares(x, dilations, kernel_biases(samples, dilations)), kinds)


def _series(v) -> np.ndarray:
    return np.nan_to_num(np.asarray(v, float))


def kernel_classifier(train: DataFrame, test: DataFrame, length: int, label: str = "y_true", x: str = "x", features: int = 10_000, sample: int = 256) -> DataFrame:
    """Balanced logistic regression on fixed convolution kernels; biases come from at most ``sample`` training rows, those with the smallest hashes."""
    some = [_series(r[0]) for r in train.orderBy(F.xxhash64(x)).limit(sample).select(x).collect()]
    made = lambda rows: with_kernel_features(rows, length, some, x, features).withColumn("_x", array_to_vector("features"))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", regParam=0.01, predictionCol="_p", maxBlockSizeInMB=BLOCK_MB).fit(made(balanced_weights(train, label)))
    return model.transform(made(test)).withColumn("y_pred", F.col("_p").cast("int")).drop("_x", "_p", "features", "rawPrediction", "probability")


def evaluate_folds(fit_predict: FitPredict, load_fold: Callable[[int], tuple[DataFrame, DataFrame]], folds: int) -> tuple[DataFrame | None, dict[int, str]]:
    """Predictions of all folds with their fold, and the folds that failed with their reasons; one failure stops no other."""
    done, failed = None, {}
    for k in range(folds):
        try:
            out = fit_predict(*load_fold(k)).withColumn("fold", F.lit(k))
            done = out if done is None else done.unionByName(out)
        except Exception as e:  # noqa: BLE001
            failed[k] = str(e)
    return done, failed


def evaluate_models(fits: dict[str, FitPredict], load_fold: Callable[[int], tuple[DataFrame, DataFrame]], folds: int) -> tuple[DataFrame | None, dict[tuple[str, int], str]]:
    """Predictions of every model on all folds with columns model and fold, and the (model, fold) that failed with their reasons."""
    done, failed = None, {}
    for name, fit_predict in fits.items():
        out, broken = evaluate_folds(fit_predict, load_fold, folds)
        failed |= {(name, k): why for k, why in broken.items()}
        if out is not None:
            out = out.withColumn("model", F.lit(name))
            done = out if done is None else done.unionByName(out, allowMissingColumns=True)
    return done, failed
