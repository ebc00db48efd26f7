"""Quality rules and an isolation forest over their statistics.

Each text gets rule statistics. The forest is grown on documents labelled as
good; random splits isolate a document that is unlike them after few steps. The
threshold on that anomaly score comes from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample, small_batches, table

SYMBOLS = b"#*$%&|<>"
#: What the forest sees, and by how much its split ranges reach past the rows of a node at least.
FEATURES = ("word_length", "symbols_per_word", "distinct_share", "dup_line_share")
MARGINS = np.array([0.5, 0.1, 0.05, 0.1])
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_lines long"
#: Rows that the forest is grown on, and rows per tree.
FIT_ROWS, TREE_ROWS, TREES = 8192, 256, 100
#: Share of good labelled rows that a threshold has to keep.
KEEP = 0.998
WINDOW = 5


def text_stats(text: str | None, window: int = WINDOW) -> tuple[int, ...]:
    """The statistics in ``STATS`` of one whole text; null counts as empty.

    Words are runs other than ASCII white space, so bytes.split() finds them. A
    line that has a word and equals an earlier one is a duplicate. Repeat words
    are those in a window of 5 words that the text holds twice or more.
    """
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    chars = sum(map(len, words)) - len(data.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\f")]
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    repeated = 0
    if len(seen := dict.fromkeys(windows)) < len(windows):
        counts = dict.fromkeys(seen, 0)
        for w in windows:
            counts[w] += 1
        covered = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
        repeated = int((np.cumsum(covered[:n]) > 0).sum())
    return n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(set(words)), len(lines)


def with_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its key and ``STATS``, from one pass over the texts without a shuffle."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([text_stats(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(names)))], [key, *names])

    selected = docs.select(key, text)
    return selected.mapInArrow(run, f"{key} {selected.schema[key].dataType.simpleString()}, {STATS}")


def with_features(stats: DataFrame) -> DataFrame:
    """``FEATURES`` from the statistics; all 0 for a text without words."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return stats.withColumns(dict(zip(FEATURES, (per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_distinct", "n_words"), per("n_dup_lines", "n_lines")), strict=True)))


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a random search tree of n rows isolates one."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(rows: np.ndarray, seed: int = 7, trees: int = TREES, tree_rows: int = TREE_ROWS) -> dict[str, np.ndarray]:
    """Trees as heaps: feature (-1: leaf), threshold, and at leaves the path length.

    Node k has its children at 2k+1 and 2k+2. A split is drawn from the range of
    the node's rows and a margin around it, so that a row outside of what the
    good rows show is cut off early even where they are all alike. The same rows
    and seed give the same forest.
    """
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    shape = (trees, 2 ** (depth + 1) - 1)
    forest = {"feature": np.full(shape, -1, np.int8), "threshold": np.zeros(shape), "path": np.zeros(shape), "norm": mean_depth(size), "depth": np.array(depth)}
    for t in range(trees):
        todo = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
        while todo:
            node, level, x = todo.pop()
            if level == depth or len(x) < 2:
                forest["path"][t, node] = level + mean_depth(len(x))
                continue
            f = rng.integers(x.shape[1])
            low, high = x[:, f].min(), x[:, f].max()
            margin = max(MARGINS[f], (high - low) / 4)
            at = rng.uniform(low - margin, high + margin)
            right = x[:, f] > at
            forest["feature"][t, node], forest["threshold"][t, node] = f, at
            todo += [(2 * node + 1, level + 1, x[~right]), (2 * node + 2, level + 1, x[right])]
    return forest


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / norm): near 1 for rows that few splits isolate, below 0.5 for ordinary ones."""
    total, at = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(forest["depth"])):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[at, f] > threshold[node]), node)
        total += path[node]
    return np.exp2(-total / len(forest["feature"]) / max(float(forest["norm"]), 1e-9))


def with_anomaly(features: DataFrame, forest: dict[str, np.ndarray]) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(forest)  # TREES * 511 nodes, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly(shared.value, x))], [*b.schema.names, "anomaly"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema)
    return features.mapInArrow(run, f"{kinds}, anomaly double")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """Statistics, base_failed, anomaly and kept for every row of ``docs``.

    The forest is grown on at most ``fit_rows`` documents that ``labels`` call
    good (quality 1) and that pass the base rules, those with the smallest
    hashes of their keys. The threshold comes from all labelled documents that
    pass the base rules: at least ``keep`` of the good ones stay below it, and
    all of them if nearly all bad ones lie above. Without any good one, only the
    base rules decide. A document
    with several labels counts with its lowest; rows that repeat a key are each
    judged.
    """
    stats = cut(with_features(with_stats(docs, key)).withColumn("base_failed", base_failed()))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("_quality"))
    passing = stats.filter(~F.col("base_failed")).join(marks, key)
    good = passing.filter("_quality = 1").select(F.xxhash64(key).alias("h"), *FEATURES)
    sample = hash_sample(good, F.col("h"), fit_rows, good.count()).select(*FEATURES).toPandas().to_numpy(float)
    if not len(sample):
        return stats.withColumns({"anomaly": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    forest = grow_forest(sample)
    scored = with_anomaly(stats, forest)
    share = lambda quality, p: F.percentile_approx(F.when(F.col("_quality") == quality, F.col("anomaly")), p, 10_000)
    good_high, good_max, bad_low = with_anomaly(passing, forest).agg(share(1, keep), share(1, 1.0), share(0, 0.02)).first()
    limit = max(good_high, min(good_max, good_high if bad_low is None else bad_low))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document; a row for each, in no order.

    A null text has no words and fails the base rules. Rows that repeat a doc_id
    or a text are judged each.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = judge_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
