"""Frames of landmarks, their masks, and the report files."""

from __future__ import annotations

import html
import sys
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "entity string, frame int, lm array<struct<x:double,y:double,z:double,v:double>>, bottom array<double>, mask_valid boolean, latency_ms double"


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames by clip: this is the boundary after which nothing is extracted again."""
    frames.write.mode("overwrite").partitionBy("entity").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def extracted(spark: SparkSession, path: str, make=None) -> DataFrame:
    """Frames from ``path``, made and written first if they aren't there. Frames without any mask are refused."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if make is None:
            raise FileNotFoundError(path)
        write_frames(make(), path)
    frames = read_frames(spark, path)
    bad = frames.groupBy("entity").agg(F.count_if(F.col("bottom").isNotNull()).alias("masks")).filter("masks = 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].entity} has no mask")
    return frames.withColumn("mask_valid", F.coalesce("mask_valid", F.lit(True)))


def between(frames: DataFrame, fps: Column, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """The frames within [start_s, end_s); with a literal ``fps`` the bounds are constants that reach the scan."""
    frame = F.col("frame")
    out = frames if start_s is None else frames.filter(frame >= F.lit(start_s) * fps)
    return out if end_s is None else out.filter(frame < F.lit(end_s) * fps)


def probe(clips: DataFrame, to: int = 16) -> DataFrame:
    """Clip metadata with the rate defaulted to 30 and the dimensions snapped."""
    return clips.withColumns({"fps": F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0), "width": snap(F.col("w"), to), "height": snap(F.col("h"), to)})


def snap(value: Column, to: int = 16) -> Column:
    """The nearest multiple, halves to the even one, at least one."""
    return F.greatest(F.lit(to), (F.rint(value / to) * to).cast("int"))


def timestamp_ms(frame: Column, fps: Column) -> Column:
    return F.floor(frame * 1000.0 / fps).cast("int")


def extraction_summary(frames: DataFrame) -> DataFrame:
    """Per clip: detection and mask rates, and the median latency."""
    seen = F.exists("lm", lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    return frames.groupBy("entity").agg(
        F.count("*").alias("n_frames"), F.avg(F.coalesce(seen, F.lit(False)).cast("int")).alias("detection_rate"), F.avg(F.coalesce("mask_valid", F.lit(False)).cast("int")).alias("mask_rate"), F.median("latency_ms").alias("latency_ms")
    )


def export_segments(frames: DataFrame, segments: DataFrame, fps: float, path: str) -> None:
    """The frames of each segment, a folder per segment."""
    at = F.col("frame") / fps
    cut = frames.join(segments.select("entity", "segment", "start_s", "end_s"), "entity").filter((at >= F.col("start_s")) & (at < F.col("end_s")))
    cut.drop("start_s", "end_s").write.mode("overwrite").partitionBy("entity", "segment").parquet(path)


def decode_image(data_url: Column) -> Column:
    """The bytes of a data URL; NULL for anything else."""
    body = F.when(data_url.startswith("data:"), F.split_part(data_url, F.lit(","), F.lit(2)))
    return F.try_to_binary(body, F.lit("base64"))


def frame_payload(rows: DataFrame) -> DataFrame:
    """(entity, frame, payload): a frame as JSON with [x, y, visibility] of each landmark, to six places."""
    cell = lambda v: F.bround(v, 6)
    joints = F.transform("lm", lambda p: F.array(cell(p["x"]), cell(p["y"]), cell(p["v"])))
    return rows.select("entity", "frame", F.to_json(F.struct(F.col("frame"), joints.alias("landmarks")), {"ignoreNullFields": "false"}).alias("payload"))


def union_report(parts: list[DataFrame], first: tuple[str, ...]) -> DataFrame:
    """All rows under the union of their columns: the fixed ones first, then the others sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*first, *sorted(set(out.columns) - set(first)))


def html_pages(rows: DataFrame, columns: list[str], page: int = 10_000) -> Iterator[str]:
    """Pages of ``page`` rows each, until all have been shown: rejected ones first, then by clip.

    Rows come to the driver one partition after the other.
    """
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
    ordered = rows.orderBy(F.col("status") != "reject", "clip_id").select(*columns).toLocalIterator()
    listed = list(islice(ordered, page))
    while True:
        body = "".join(f"<tr>{cells('td', r)}</tr>" for r in listed)
        yield f"<!doctype html><meta charset='utf-8'><table><tr>{cells('th', columns)}</tr>{body}</table>"
        if not (listed := list(islice(ordered, page))):
            return


def html_report(rows: DataFrame, columns: list[str]) -> str:
    """All rows on one page; see ``html_pages`` for long tables."""
    return next(html_pages(rows, columns, sys.maxsize))
