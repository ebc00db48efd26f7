"""Repetitions in a series, their timing, and the sessions they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import one_euro
from .series import FRAME, KEY, VALUE, rate

SIDE = "side"
MIN_DISTANCE_S, DWELL, MIN_TEMPO_S, MAX_TEMPO_S = 0.8, 0.05, 0.4, 6.0
SET_GAP_S, MIN_SET, MARGIN_S = 12.0, 3, 1.5


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples above both neighbours; a plateau counts once, in its middle, rounded down. The ends never count."""
    if len(x) < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])  # of each run of equal samples
    stop = np.r_[start[1:], len(x)] - 1
    level = x[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (start[top] + stop[top]) // 2


def far_apart(peaks: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """The peaks that stay if, from the highest down, each removes those nearer than ``distance``.

    The peaks that are left form a chain, so each is met once when it goes.
    """
    at, n = peaks.tolist(), len(peaks)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    keep = [True] * n
    for k in np.argsort(heights, kind="stable")[::-1].tolist():
        if not keep[k]:
            continue
        left, right = before[k], after[k]
        while left >= 0 and at[k] - at[left] < distance:
            keep[left] = False
            left = before[left]
        while right < n and at[right] - at[k] < distance:
            keep[right] = False
            right = after[right]
        before[k], after[k] = left, right
        if left >= 0:
            after[left] = k
        if right < n:
            before[right] = k
    return peaks[np.array(keep, bool)]


def _left_bases(tops: list[float], valleys: list[float]) -> list[float]:
    """For each top the lowest sample between it and the last higher top before it, or the start.

    ``valleys[k]`` is the lowest sample between tops k - 1 and k. The stack
    holds the tops that no later one has passed, each with its own base.
    """
    out: list[float] = []
    stack: list[tuple[float, float]] = []
    for top, valley in zip(tops, valleys, strict=True):
        base = min(top, valley)
        while stack and stack[-1][0] <= top:
            base = min(base, stack.pop()[1])
        stack.append((top, base))
        out.append(base)
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points on either side, up to a higher sample or the end.

    Between a peak and the nearest higher sample the series has no other
    maximum as high, so the local maxima and the lowest samples between them
    tell all; they are passed twice.
    """
    if not len(peaks):
        return np.zeros(0)
    tops = np.unique(np.concatenate([[0], local_maxima(x), peaks, [len(x) - 1]]))
    valleys = np.minimum.reduceat(x, tops)  # from each top to the next
    valleys[:-1] = np.minimum(valleys[:-1], x[tops[1:]])
    heights, between = x[tops].tolist(), valleys[:-1].tolist()
    left = _left_bases(heights, [heights[0], *between])
    right = _left_bases(heights[::-1], [heights[-1], *between[::-1]])[::-1]
    base = np.maximum(left, right)[np.searchsorted(tops, peaks)]
    return x[peaks] - base


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    peaks = local_maxima(x)
    peaks = far_apart(peaks, x[peaks], distance)
    return peaks[prominences(x, peaks) >= prominence]


def auto_prominence(x: np.ndarray, fraction: float = 0.25, floor: float = 0.02) -> float:
    known = x[np.isfinite(x)]
    if len(known) < 2:
        return floor
    low, high = np.percentile(known, [5, 95])
    return max(floor, fraction * (high - low))


def reps_of(x: np.ndarray, fps: float, distance_s: float = MIN_DISTANCE_S, fraction: float = 0.25, floor: float = 0.02) -> Iterator[tuple[int, int, int, float]]:
    """(start, peak, end, excursion) of each repetition; the excursion is the smoothed amplitude."""
    x = np.asarray(x, float)
    if not np.isfinite(x).any():
        return
    limit = auto_prominence(x, fraction, floor)
    smooth = one_euro(x, fps, zero_phase=True)
    known = np.flatnonzero(np.isfinite(smooth))
    if not len(known):
        return
    filled = np.interp(np.arange(len(x)), known, smooth[known])
    slope = np.diff(filled)
    falls, rises = np.flatnonzero(slope < 0), np.flatnonzero(slope > 0)
    for peak in find_peaks(filled, max(1, int(np.rint(distance_s * fps))), limit):
        fallen, risen = np.searchsorted(falls, peak), np.searchsorted(rises, peak)
        start = int(falls[fallen - 1]) + 1 if fallen else 0  # after the last fall before the peak
        end = int(rises[risen]) if risen < len(rises) else len(x) - 1  # where the first rise after it begins
        if end > start:
            yield start, int(peak), end, float(filled[peak])


def find_reps(rows: DataFrame, fps: float | str, value: str = VALUE, **options: float) -> DataFrame:
    """(entity, side, start, peak, end, excursion) from rows (entity, side, frame, value); ``fps`` may be a column.

    A series is filtered and searched as a whole in one grouped function, so
    that it is shuffled once. Frames of a series count from 0 without gaps.
    """

    def run(key: tuple, series: pd.DataFrame) -> pd.DataFrame:
        x = series.sort_values(FRAME)[value].to_numpy(float)
        found = list(reps_of(x, float(series[fps].iloc[0]) if isinstance(fps, str) else fps, **options))
        out = pd.DataFrame(found, columns=["start", "peak", "end", "excursion"]).astype({"start": "int64", "peak": "int64", "end": "int64", "excursion": "float64"})
        out.insert(0, SIDE, key[1])
        out.insert(0, KEY, key[0])
        return out

    kind = rows.schema[KEY].dataType.simpleString()
    return rows.select(KEY, SIDE, FRAME, value, *([fps] if isinstance(fps, str) else [])).groupBy(KEY, SIDE).applyInPandas(run, f"{KEY} {kind}, {SIDE} string, start long, peak long, end long, excursion double")


def in_order() -> Window:
    """Repetitions of an entity by start; of two at once the right comes first."""
    return Window.partitionBy(KEY).orderBy("start", F.desc(SIDE))


def with_timing(reps: DataFrame, fps: float | str) -> DataFrame:
    """start_s, peak_s, end_s, durations, and overlap_s: the gap to the next repetition, negative if they overlap, NULL on the last."""
    s = lambda a, b: (F.col(a) - F.col(b)) / rate(fps)
    each = {f"{c}_s": F.col(c) / rate(fps) for c in ("start", "peak", "end")}
    each |= {"duration_s": s("end", "start"), "t_extend_s": s("peak", "start"), "t_return_s": s("end", "peak")}
    following = F.lead("start").over(in_order())
    out = reps.withColumns(each).withColumn("overlap_s", (following - F.col("end")) / rate(fps))
    return out.withColumn("overlaps_next", F.coalesce(F.col("overlap_s") < 0, F.lit(False)))


def with_dwell(reps: DataFrame, rows: DataFrame, fps: float | str, share: float = DWELL, value: str = VALUE) -> DataFrame:
    """dwell_s: time within ``share`` of the largest raw value of the repetition.

    An equi-join on series with a range on frames; repetitions are few per series.
    """
    samples = rows.select(KEY, SIDE, FRAME, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    inside = reps.join(samples, [KEY, SIDE]).filter(F.col(FRAME).between(F.col("start"), F.col("end")))
    top = F.max("_v").over(Window.partitionBy(KEY, SIDE, "start"))
    held = inside.withColumn("_top", top).groupBy(KEY, SIDE, "start").agg(F.count_if(F.col("_v") >= F.col("_top") * (1 - share)).alias("_n"))
    return reps.join(held, [KEY, SIDE, "start"], "left").withColumn("dwell_s", F.col("_n") / rate(fps)).drop("_n")


def with_alternation(reps: DataFrame) -> DataFrame:
    """rep_index in order, and alternation_broken on a repetition with the same side as the one before."""
    same = F.col(SIDE) == F.lag(SIDE).over(in_order())
    return reps.withColumns({"rep_index": F.row_number().over(in_order()), "alternation_broken": F.coalesce(same, F.lit(False))})


def with_flags(reps: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("overlaps_next"), "overlaps_next"), F.when(F.col("alternation_broken"), "alternation_broken")))
    return reps.withColumn("flags", flags)


def alternation_summary(reps: DataFrame) -> DataFrame:
    """Per entity: repetitions of either side, how many overlap, and whether the sides alternate throughout."""
    return reps.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(SIDE) == "R").alias("n_right"),
        F.count_if(F.col(SIDE) == "L").alias("n_left"),
        F.bool_and(~F.col("alternation_broken")).alias("intact"),
        F.count_if("overlaps_next").alias("n_overlapping"),
    )


def plausible(reps: DataFrame, least: float = MIN_TEMPO_S, most: float = MAX_TEMPO_S) -> DataFrame:
    """Repetitions that extend in a humanly possible time; both bounds count."""
    return reps.filter(F.col("t_extend_s").between(least, most))


def sessions(events: DataFrame, gap_s: float = SET_GAP_S, start: str = "start_s", end: str = "end_s", tie: str | None = None) -> DataFrame:
    """Adds ``segment``: a new one begins where more than ``gap_s`` pass after the end of the one before."""
    order = Window.partitionBy(KEY).orderBy(start, *([tie] if tie else []))
    fresh = F.when(F.col(start) - F.lag(end).over(order) > gap_s, 1).otherwise(0)
    return events.withColumn("_fresh", fresh).withColumn("segment", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def find_segments(reps: DataFrame, length_s: Column, gap_s: float = SET_GAP_S, least: int = MIN_SET, margin_s: float = MARGIN_S) -> DataFrame:
    """(entity, segment, start_s, end_s, n_reps, sides) of runs of at least ``least`` repetitions, padded and kept within the clip.

    ``length_s`` is a column of ``reps``: the length of the clip.
    """
    placed = sessions(reps, gap_s).withColumn("_length", length_s)
    sides = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", SIDE))), lambda s: s[SIDE]), "")
    grouped = placed.groupBy(KEY, "segment").agg(F.min("start_s").alias("_from"), F.max("end_s").alias("_to"), F.count("*").alias("n_reps"), sides.alias("sides"), F.max("_length").alias("_length"))
    return grouped.filter(F.col("n_reps") >= least).select(
        KEY, "segment", F.greatest(F.lit(0.0), F.col("_from") - margin_s).alias("start_s"), F.least("_length", F.col("_to") + margin_s).alias("end_s"), "n_reps", "sides"
    )


def activity_summary(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Per clip of ``clips`` (entity, clip_s): segments, repetitions, time in exercise and its share, and the list of segments."""
    listed = segments.groupBy(KEY).agg(
        F.count("*").alias("n_segments"),
        F.sum("n_reps").alias("total_reps"),
        F.sum(F.col("end_s") - F.col("start_s")).alias("exercise_s"),
        F.sort_array(F.collect_list(F.struct("start_s", "end_s", "n_reps"))).alias("segments"),
    )
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    out = clips.join(listed, KEY, "left")
    exercise = zero("exercise_s", 0.0)
    return out.select(
        KEY,
        zero("n_segments", 0).alias("n_segments"),
        zero("total_reps", 0).alias("total_reps"),
        F.bround(exercise, 1).alias("exercise_s"),
        F.bround("clip_s", 1).alias("clip_s"),
        F.bround(zero(F.try_divide(exercise, F.col("clip_s")), 0.0), 3).alias("exercise_fraction"),
        "segments",
    )
