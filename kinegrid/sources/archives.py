"""Frames from archives of extracted clips, as a data source: ``spark.read.format("clip_archives").load(folder)``.

An archive is a file ``<clip_id>.npz`` with kpts_raw (frames, landmarks, 4),
mask (frames, rows, columns), and perhaps mask_valid (frames), fps and
frame_size. Each is a partition of its own; a filter on clip_id leaves the
others unopened.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "clip_archives"
SCHEMA = "clip_id string, frame long, lm array<struct<x:double,y:double,z:double,visibility:double>>, bottom array<double>, mask_valid boolean, fps double, width int, height int"
_POINT = pa.struct([(c, pa.float64()) for c in ("x", "y", "z", "visibility")])
#: Frames of a batch.
BATCH = 256


@dataclass
class Archive(InputPartition):
    path: str
    clip_id: str


def lowest_rows(mask: np.ndarray) -> np.ndarray:
    """(frames, columns): the lowest occupied row of each column, NaN in empty ones."""
    occupied = mask > 0
    last = mask.shape[1] - 1 - np.argmax(occupied[:, ::-1, :], axis=1)
    return np.where(occupied.any(axis=1), last.astype(float), np.nan)


def checked(clip_id: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays of an archive, with mask_valid; an archive whose silhouettes can't belong to its landmarks is refused."""
    if "kpts_raw" not in arrays:
        raise ValueError(f"{clip_id} has no landmarks")
    if "mask" not in arrays:
        raise ValueError(f"{clip_id} has no mask, so nothing can be measured on its silhouette; extract it again with masks")
    frames, masks = len(arrays["kpts_raw"]), len(arrays["mask"])
    if frames != masks:
        raise ValueError(f"{clip_id} has {frames} frames of landmarks and {masks} masks, so they don't belong together; extract it again")
    valid = arrays.get("mask_valid", np.ones(frames, bool))
    if len(valid) != frames:
        raise ValueError(f"{clip_id} has {frames} frames and {len(valid)} marks of valid masks")
    return arrays | {"mask_valid": np.asarray(valid, bool)}


def batches(clip_id: str, arrays: dict[str, np.ndarray], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA``; landmarks that aren't finite are NULL."""
    known = checked(clip_id, arrays)
    points, masks, valid = np.asarray(known["kpts_raw"], float), known["mask"], known["mask_valid"]
    fps = float(known["fps"]) if "fps" in known else None
    width, height = (int(v) for v in known["frame_size"]) if "frame_size" in known else (None, None)
    for first in range(0, len(points), size):
        some, bottoms = points[first : first + size], lowest_rows(masks[first : first + size])
        n, flat = len(some), some.reshape(-1, some.shape[-1])
        lm = pa.StructArray.from_arrays([pa.array(flat[:, k], mask=~np.isfinite(flat[:, k])) for k in range(4)], fields=list(_POINT))
        lists = lambda values, width: pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), values)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([clip_id] * n),
                pa.array(np.arange(first, first + n)),
                lists(lm, some.shape[1]),
                lists(pa.array(bottoms.ravel(), mask=np.isnan(bottoms.ravel())), bottoms.shape[1]),
                pa.array(valid[first : first + n]),
                pa.array([fps] * n, pa.float64()),
                pa.array([width] * n, pa.int32()),
                pa.array([height] * n, pa.int32()),
            ],
            [c.split()[0] for c in ("clip_id", "frame", "lm", "bottom", "mask_valid", "fps", "width", "height")],
        )


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) and f.attribute == ("clip_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("clip_id",) else None
            if names is None:
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[Archive]:
        files, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        listed = sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file and f.extension == "npz")
        found = [Archive(f"{self.folder.rstrip('/')}/{p.rsplit('/', 1)[-1]}", p.rsplit("/", 1)[-1][: -len(".npz")]) for p in listed]
        return [a for a in found if self.wanted is None or a.clip_id in self.wanted]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive is left to read
            return
        files, path = pyarrow.fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as data:
            yield from batches(partition.clip_id, {k: data[k] for k in data.files})


class ClipArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        folder = self.options["path"]
        return ArchiveReader(folder if "://" in folder else f"file://{folder}")


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClipArchives)
