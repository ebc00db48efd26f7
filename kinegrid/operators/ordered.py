"""Passes over long series in order, with what is carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Takes what the series has carried so far (None at its start) and its next rows; returns what it carries on and the rows that it makes.
Step = Callable[[Any, pa.RecordBatch], tuple[Any, pa.RecordBatch | None]]


def spans(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, rows) of each run of rows with one key."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
    first = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[first]:
            yield keys[first], first, k - first
            first = k


def in_order(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], step: Step, schema: str | StructType, finish: Callable[[Any], pa.RecordBatch | None] | None = None) -> DataFrame:
    """What ``step`` makes of every series, read in order batch by batch.

    A series streams through one task; what it carries is all that the task
    holds of it, however long it is. ``finish`` may add rows at its end. Null
    keys are a series of their own.
    """
    names = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carried, begun = None, None, False
        for batch in batches:
            for key, first, n in spans(batch, names):
                if begun and key != current and finish is not None and (out := finish(carried)) is not None:
                    yield out
                if not begun or key != current:
                    current, carried, begun = key, None, True
                carried, out = step(carried, batch.slice(first, n))
                if out is not None:
                    yield out
        if begun and finish is not None and (out := finish(carried)) is not None:
            yield out

    return rows.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, schema)
