"""Ordered series: one row per (entity, frame).

All windows partition by the entity and order by the frame, so that one shuffle
serves every operator applied to a series in turn.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

from ..functions.ranks import Ranked, spread
from ..functions.stats import finite
from .ordered import in_order

KEY, FRAME, VALUE = "entity", "frame", "value"


def by_frame(key: str = KEY, frame: str = FRAME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(frame)


def whole(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key)


def first_difference(rows: DataFrame, fps: float, value: str = VALUE, out: str = "velocity") -> DataFrame:
    """(x - previous x) * fps; 0 on the first frame, NULL next to a gap."""
    before, n = F.lag(value).over(by_frame()), F.row_number().over(by_frame())
    return rows.withColumn(out, F.when(n == 1, F.lit(0.0)).otherwise((F.col(value) - before) * fps))


def rate(fps: float | str) -> Column:
    """Frames a second: a number for all series, or the column that has each series' own."""
    return F.col(fps) if isinstance(fps, str) else F.lit(float(fps))


def speed(rows: DataFrame, fps: float | str, x: str = "x", y: str = "y") -> DataFrame:
    """Length of the step to each frame, times fps; the first frame has none and goes."""
    dx, dy = (F.col(c) - F.lag(c).over(by_frame()) for c in (x, y))
    return rows.withColumns({"speed": F.hypot(dx, dy) * rate(fps), "_n": F.row_number().over(by_frame())}).filter("_n > 1").drop("_n")


def neighbours(value: str = VALUE, frame: str = FRAME) -> tuple[Column, Column, Column, Column]:
    """Frame and value of the last known sample up to here, and of the first from here on."""
    back = by_frame(frame=frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_frame(frame=frame).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(frame))
    return F.last(at, True).over(back), F.last(value, True).over(back), F.first(at, True).over(ahead), F.first(value, True).over(ahead)


def _between(f0: Column, v0: Column, f1: Column, v1: Column, frame: Column) -> Column:
    return F.when(f1 == f0, v0).otherwise(v0 + (v1 - v0) * ((frame - f0) / (f1 - f0)))


def fill_gaps(rows: DataFrame, max_gap: int = 5, value: str = VALUE) -> DataFrame:
    """Fill runs of at most ``max_gap`` missing frames linearly, never before the first or after the last sample.

    Adds ``filled`` and ``valid``, which says that the frame has a value now.
    """
    f0, v0, f1, v1 = neighbours(value)
    short = f0.isNotNull() & f1.isNotNull() & (f1 - f0 - 1 <= max_gap)
    out = rows.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(short, _between(f0, v0, f1, v1, F.col(FRAME))))
    return out.withColumn("valid", F.col("filled").isNotNull())


def fill_all(rows: DataFrame, value: str = VALUE, out: str = "filled") -> DataFrame:
    """Fill every gap linearly, and flatly beyond the first and last sample."""
    f0, v0, f1, v1 = neighbours(value)
    return rows.withColumn(out, F.coalesce(_between(f0, v0, f1, v1, F.col(FRAME)), v0, v1))


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """(entity, start, stop) of each run of frames with ``flag``, half open."""
    n = F.row_number()
    marked = rows.select(KEY, FRAME, n.over(by_frame()).alias("_n"), F.coalesce(flag, F.lit(False)).alias("_f"))
    island = marked.filter("_f").withColumn("_k", F.col("_n") - n.over(by_frame()))
    return island.groupBy(KEY, "_k").agg(F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("stop")).drop("_k")


def _sampled(rows: DataFrame, n_out: Column, position: Callable[[Column], Column], value: str) -> DataFrame:
    """Interpolate each whole series at n_out positions, a frame number for each k.

    A series is one array here, as it is short against the number of series;
    no join is needed to fetch the neighbours of a position.
    """
    series = rows.groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct(FRAME, F.col(value).alias("v")))), lambda s: s["v"]).alias("x"))
    sized = series.withColumn("n", F.size("x")).withColumn("n_out", n_out.cast("int"))

    def sample(k: Column) -> Column:
        p = F.least(F.greatest(position(k), F.lit(0.0)), (F.col("n") - 1).cast("double"))
        low = F.floor(p).cast("int")
        left, right = F.get("x", low), F.get("x", F.least(low + 1, F.col("n") - 1))
        return F.when(p == low, left).otherwise(left + (right - left) * (p - low))

    # only the samples leave the row, not the series with each of them
    return sized.select(KEY, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), sample)).alias("k", "value"))


def resample_fps(rows: DataFrame, fps_in: float, fps_out: float, value: str = VALUE) -> DataFrame:
    """Resample linearly to another rate: floor((n - 1) / fps_in * fps_out) + 1 samples at k / fps_out."""
    if fps_in == fps_out:
        return _sampled(rows, F.col("n"), lambda k: k.cast("double"), value)
    n_out = F.when(F.col("n") < 2, F.col("n")).otherwise(F.floor((F.col("n") - 1) / F.lit(float(fps_in)) * F.lit(float(fps_out))) + 1)
    return _sampled(rows, n_out, lambda k: k / F.lit(float(fps_out)) * F.lit(float(fps_in)), value)


def resample_length(rows: DataFrame, n: int, value: str = VALUE) -> DataFrame:
    """Resample linearly to ``n`` samples over the whole span; a single sample repeats."""
    return _sampled(rows, F.lit(n), lambda k: k * ((F.col("n") - 1) / F.lit(float(max(n - 1, 1)))), value)


def calibration_deviation(rows: DataFrame, frames: int = 30, value: str = VALUE) -> DataFrame:
    """The value less the median of the known samples among the first ``frames`` frames."""
    first = F.row_number().over(by_frame()) <= frames
    marked = rows.withColumn("_calib", F.when(first, F.col(value)))
    return marked.withColumn("calibration", F.median("_calib").over(whole())).withColumn("deviation", F.col(value) - F.col("calibration")).drop("_calib")


def first_crossing(rows: DataFrame, k: float, value: str = VALUE) -> DataFrame:
    """(entity, threshold, crossing): the first frame above mean + k * population deviation of the first max(3, n // 5) frames.

    Series of fewer than 10 frames have no crossing.
    """
    n, i = F.count("*").over(whole()), F.row_number().over(by_frame())
    marked = rows.select(KEY, FRAME, value, n.alias("n"), F.when(i <= F.greatest(F.lit(3), F.floor(n / 5)), F.col(value)).alias("_calib"))
    limit = F.avg("_calib").over(whole()) + k * F.stddev_pop("_calib").over(whole())
    return marked.withColumn("threshold", limit).groupBy(KEY).agg(F.first("threshold").alias("threshold"), F.min(F.when((F.col(value) > F.col("threshold")) & (F.col("n") >= 10), F.col(FRAME))).alias("crossing"))


def lead_time(rows: DataFrame, fps: float, k: float, leader: str, follower: str) -> DataFrame:
    """(entity, lead_s): how long before ``follower`` ``leader`` crosses; NULL if either never does."""
    one, two = (first_crossing(rows, k, c).select(KEY, F.col("crossing").alias(c)) for c in (leader, follower))
    return one.join(two, KEY).select(KEY, ((F.col(follower) - F.col(leader)) / F.lit(float(fps))).alias("lead_s"))


def summary_features(rows: DataFrame, value: str = VALUE) -> DataFrame:
    """Mean, population deviation, extremes and range; mean absolute and deviation of first differences."""
    step = rows.withColumn("_d", F.col(value) - F.lag(value).over(by_frame()))
    return step.groupBy(KEY).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        (F.max(value) - F.min(value)).alias("span"),
        F.avg(F.abs("_d")).alias("mean_abs_step"),
        F.stddev_pop("_d").alias("std_step"),
    )


def prominence_threshold(rows: DataFrame, fraction: float = 0.25, floor: float = 0.02, low: float = 0.05, high: float = 0.95, value: str = VALUE) -> DataFrame:
    """(entity, prominence): the larger of ``floor`` and a fraction of the spread between two percentiles; ``floor`` below two samples."""
    spread = F.percentile(value, high) - F.percentile(value, low)
    return rows.withColumn(value, finite(value)).groupBy(KEY).agg(F.when(F.count(value) < 2, F.lit(floor)).otherwise(F.greatest(F.lit(floor), fraction * spread)).alias("prominence"))


def walk_to_minima(rows: DataFrame, value: str = VALUE) -> DataFrame:
    """For every frame, taken as a peak, the frames that it descends to on either side, over plateaus too."""
    order = by_frame()
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    marked = rows.withColumns({"_up": F.when(before > F.col(value), F.col(FRAME)), "_down": F.when(after > F.col(value), F.col(FRAME))})
    start = F.last("_up", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    end = F.first("_down", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumns({"start": F.coalesce(start, F.min(FRAME).over(whole())), "end": F.coalesce(end, F.max(FRAME).over(whole()))}).drop("_up", "_down")


def rolling_range(rows: DataFrame, seconds: float, at: str = "t", value: str = VALUE, least: int = 8) -> DataFrame:
    """Spread between the floor-index 5th and 95th percentiles of the last ``seconds``; 0 below ``least`` samples.

    Samples of one time see each other. A series streams in order through one
    task, which holds the window's values in order: each comes and goes once,
    and no row sorts its window anew. Missing samples count for nothing.
    """
    out = StructType([f for f in rows.schema if f.name != "range"] + [StructField("range", DoubleType())])
    kept = out.names[:-1]

    def ranges(ranked: Ranked, window: deque, part: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of ``part``, whose last time is complete, with their ranges."""
        times, values, found, first = part.column(at).to_pylist(), part.column(value).to_pylist(), [], 0
        for k, t in enumerate(times):
            if values[k] is not None and values[k] == values[k]:
                window.append((t, values[k]))
                ranked.add(values[k])
            if k + 1 < len(times) and times[k + 1] == t:
                continue
            while window and window[0][0] < t - seconds:
                ranked.remove(window.popleft()[1])
            found += [spread(ranked, least)] * (k + 1 - first)
            first = k + 1
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.float64())], out.names)

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def step(state: tuple | None, part: pa.RecordBatch) -> tuple[tuple, pa.RecordBatch | None]:
        ranked, window, held = state or (Ranked(), deque(), [])
        times = part.column(at)
        last = times[-1].as_py()
        if times[0].as_py() == last and (not held or held[0].column(at)[0].as_py() == last):
            return (ranked, window, [*held, part]), None
        both = whole([*held, part])
        times = both.column(at).to_pylist()
        done = len(times) - 1
        while times[done - 1] == last:  # more samples of the last time may come
            done -= 1
        return (ranked, window, [both.slice(done)]), ranges(ranked, window, both.slice(0, done))

    def finish(state: tuple) -> pa.RecordBatch:
        ranked, window, held = state
        return ranges(ranked, window, whole(held))

    return in_order(rows.select(*kept).filter(F.col(at).isNotNull()), (KEY,), (at,), step, out, finish)


def static_frames(rows: DataFrame, joints: str = "joints", threshold: float = 0.005) -> DataFrame:
    """Marks frames whose joints move less than ``threshold`` on average; the first frame copies the second; unknown is not static.

    ``joints`` is an array of structs with x and y.
    """
    before = F.lag(joints).over(by_frame())
    moved = F.zip_with(joints, before, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    known = F.filter(moved, lambda m: m.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, m: s + m) / F.size(known))
    marked = rows.withColumn("_m", mean)
    own = F.when(F.row_number().over(by_frame()) == 1, F.lead("_m").over(by_frame())).otherwise(F.col("_m"))
    return marked.withColumn("static", F.coalesce(own < threshold, F.lit(False))).drop("_m")
