"""The One Euro filter, a smoother whose cutoff follows the speed of the signal.

Each output depends on the one before, so a series streams in order through one
task, which holds two numbers of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ordered import in_order
from .series import FRAME, KEY, VALUE

MIN_CUTOFF, BETA, D_CUTOFF = 1.0, 0.007, 1.0


def alpha(cutoff: float, dt: float) -> float:
    """Weight of a new sample for a cutoff frequency and a step."""
    return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * cutoff) / dt)


class OneEuro:
    """The filter at some point of a series. A missing sample stays missing, and the filter starts anew after it."""

    def __init__(self, fps: float, min_cutoff: float = MIN_CUTOFF, beta: float = BETA, d_cutoff: float = D_CUTOFF):
        self.dt, self.min_cutoff, self.beta = 1.0 / fps, min_cutoff, beta
        self.slow = alpha(d_cutoff, self.dt)
        self.smooth: float | None = None
        self.slope = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The next samples, filtered."""
        out, dt, smooth, slope = np.full(len(x), np.nan), self.dt, self.smooth, self.slope
        for k, v in enumerate(x.tolist()):
            if not math.isfinite(v):
                smooth = None
                continue
            if smooth is None:
                smooth, slope = v, 0.0
            else:
                slope = self.slow * (v - smooth) / dt + (1 - self.slow) * slope
                a = alpha(self.min_cutoff + self.beta * abs(slope), dt)
                smooth = a * v + (1 - a) * smooth
            out[k] = smooth
        self.smooth, self.slope = smooth, slope
        return out


def one_euro(x: np.ndarray, fps: float, zero_phase: bool = False, **parameters: float) -> np.ndarray:
    """Forward, and with ``zero_phase`` backward over the result, so that nothing lags."""
    out = OneEuro(fps, **parameters)(np.asarray(x, float))
    return OneEuro(fps, **parameters)(out[::-1])[::-1] if zero_phase else out


def smooth_series(rows: DataFrame, fps: float, zero_phase: bool = False, value: str = VALUE, out: str = "smooth", **parameters: float) -> DataFrame:
    """(entity, frame, value, smooth) with each series filtered in order of frames; with ``zero_phase`` a second pass reads them backward."""
    selected = rows.select(KEY, FRAME, value)
    schema = StructType([*selected.schema, StructField(out, DoubleType())])

    def over(column: str):
        def step(state: OneEuro | None, part: pa.RecordBatch) -> tuple[OneEuro, pa.RecordBatch]:
            state = state or OneEuro(fps, **parameters)
            samples = part.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
            filtered = state(samples)
            return state, pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-1]), pa.array(filtered, mask=~np.isfinite(filtered))], schema.names)

        return step

    forward = in_order(selected, (KEY,), (FRAME,), over(value), schema)
    return in_order(forward, (KEY,), (F.col(FRAME).desc(),), over(out), schema) if zero_phase else forward
