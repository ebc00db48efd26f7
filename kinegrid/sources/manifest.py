"""Clip manifests, repetition tables and the small files around them."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.build import REP_COLUMNS
from ..operators.validate import SchemaError, as_double, column_problems

#: The columns of a manifest, in their order.
CLIP_STRINGS = ("clip_id", "file", "person_id", "condition", "view", "label_source", "dedup_group", "session", "notes", "qc_status")
CLIP_NUMBERS = ("camera_angle_deg", "detection_rate", "view_score", "torso_len_cv")
CLIP_COLUMNS = ("clip_id", "file", "person_id", "condition", "view", "label_source", "camera_angle_deg", "dedup_group", "session", "notes", "detection_rate", "view_score", "torso_len_cv", "qc_status")
CLIP_REQUIRED = ("clip_id", "file", "person_id", "condition", "view")

_REP_KINDS = dict.fromkeys(("rep_id", "clip_id", "person_id", "condition", "view", "side", "flags"), T.StringType()) | {"rep_index": T.IntegerType()}
REPS = T.StructType([T.StructField(c, _REP_KINDS.get(c, T.DoubleType())) for c in REP_COLUMNS])


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SchemaError(f"{path} has no header")
    return [c.strip().lstrip("﻿") for c in first[0][0].split(",")]


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """A manifest: text columns keep blanks as '', numbers are NULL where blank or unreadable; unknown or missing columns are an error."""
    columns = header(spark, path)
    unknown, missing = column_problems(columns, list(CLIP_REQUIRED), list(CLIP_COLUMNS))
    if unknown or missing:
        raise SchemaError(f"unknown columns {unknown}, missing columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("emptyValue", "").option("multiLine", True).csv(path)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("intent" if c == "label_source" else "ok" if c == "qc_status" else "")
    number = lambda c: as_double(c) if c in columns else F.lit(None).cast("double")
    return raw.select(*((number(c) if c in CLIP_NUMBERS else text(c)).alias(c) for c in CLIP_COLUMNS))


def write_clips(clips: DataFrame, path: str) -> None:
    """One CSV with the columns in their order; a manifest is small."""
    clips.select(*CLIP_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_reps(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV by its suffix."""
    return spark.read.schema(REPS).option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def write_reps(reps: DataFrame, path: str) -> None:
    reps.select(*(F.col(f.name).cast(f.dataType) for f in REPS)).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, folder: str, name: str = "reps") -> DataFrame:
    """``name``.parquet below a folder, or else ``name``.csv."""
    for kind in ("parquet", "csv"):
        path = f"{folder}/{name}.{kind}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return read_reps(spark, path)
    raise FileNotFoundError(f"neither {name}.parquet nor {name}.csv in {folder}")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, dedup_group) from a duplicates report; no report gives no rows."""
    try:
        return spark.read.option("header", True).csv(path).select("file", "dedup_group")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, dedup_group string")


def clip_id(file: Column | str) -> Column:
    """The lower-case stem of a path, with anything but letters and digits as _."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def clips_template(spark: SparkSession, folder: str, groups: DataFrame, suffix: str = "mp4") -> DataFrame:
    """A manifest row for every file below a folder, with its group and blanks for what people fill in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    known = files.join(groups, "file", "left")
    fixed = {"clip_id": clip_id("file"), "file": F.col("file"), "label_source": F.lit("intent"), "dedup_group": F.coalesce("dedup_group", F.lit("")), "qc_status": F.lit("ok")}
    return known.select(*(fixed.get(c, F.lit(None).cast("double") if c in CLIP_NUMBERS else F.lit("")).alias(c) for c in CLIP_COLUMNS))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> '' and not startswith(query, '#')")


def safe_stem(text: Column, longest: int = 60) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "_"), "^_+|_+$", "")
    return F.substring(cleaned, 1, longest)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results to resume from: # lines, short rows and unreadable numbers are left out."""
    schema = "dataset string, model string, macro_f1_mean double, macro_f1_std double, macro_f1_present_mean double, macro_f1_present_std double, balanced_accuracy_mean double, balanced_accuracy_std double, accuracy_mean double, accuracy_std double, n_folds int, seconds double, per_fold string"
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)
    return rows.filter("dataset is not null and model is not null and macro_f1_mean is not null")


def remaining(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The (dataset, model) that have no result yet."""
    return planned.join(done.select("dataset", "model").distinct(), ["dataset", "model"], "left_anti")


def read_fold(spark: SparkSession, root: str, dataset: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a table partitioned by dataset, fold and split; only their files are read."""
    rows = spark.read.parquet(root).filter((F.col("dataset") == dataset) & (F.col("fold") == fold))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def describe_folds(spark: SparkSession, root: str) -> DataFrame:
    """Cases per dataset, fold, split and class."""
    return spark.read.parquet(root).groupBy("dataset", "fold", "split", "y").agg(F.count("*").alias("n"))


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, folds): the datasets of a table partitioned by dataset and fold, sorted by name."""
    return spark.read.parquet(root).select("dataset", "fold").distinct().groupBy("dataset").agg(F.count("*").alias("folds")).orderBy("dataset")


def n_folds(spark: SparkSession, root: str, dataset: str, known: dict[str, int] | None = None) -> int:
    """How many folds a dataset has. ``known`` answers where the table can't be read; an unknown dataset is a KeyError."""
    try:
        found = list_datasets(spark, root).filter(F.col("dataset") == dataset).first()
    except AnalysisException:
        if known is None:
            raise
        found = None
    if found is None and dataset not in (known or {}):
        raise KeyError(f"unknown dataset {dataset}")
    return found.folds if found is not None else known[dataset]


def write_results(results: DataFrame, predictions: DataFrame, folder: str) -> None:
    """Results and predictions by dataset; only the datasets at hand are written anew, so a run can go on where it stopped."""
    for name, rows in (("results", results), ("predictions", predictions)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{folder}/{name}")


def save_band(band: DataFrame, path: str) -> None:
    """A row per bin as JSON lines; NULL fields are kept."""
    band.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_band(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("held_out string, low double, high double, bin int, mean double, std double, p05 double, p95 double, count long").json(path)


def load_config(path: str) -> dict[str, Any]:
    """A JSON mapping on the driver; YAML if a reader for it is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not a mapping")
    return found


def config_value(config: dict[str, Any], name: str) -> Any:
    """A value by its dotted name; a missing key is an error that says which."""
    at: Any = config
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"{name}: no {part}")
        at = at[part]
    return at


def config_hash(config: dict[str, Any]) -> str:
    """Twelve digits that follow the settings, but not those whose names begin with _."""
    public = {k: v for k, v in config.items() if not k.startswith("_")}
    return hashlib.sha256(json.dumps(public, sort_keys=True, default=str).encode()).hexdigest()[:12]


def write_manifest(folder: str, config: dict[str, Any], stage: str, **extra: Any) -> dict[str, Any]:
    """Record which settings made a folder."""
    entry = {"stage": stage, "config_hash": config_hash(config), "written_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **extra}
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "_manifest.json").write_text(json.dumps(entry, indent=2, default=str), encoding="utf-8")
    return entry


def read_manifest(folder: str) -> dict[str, Any] | None:
    path = Path(folder, "_manifest.json")
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None
