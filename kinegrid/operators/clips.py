"""Per-clip operators on frames of landmarks and silhouettes.

Frames are rows (entity, frame, lm). What a clip shares, its median torso or its
floor, is aggregated to a row per clip and joined back; Spark broadcasts that
side if it is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pose
from ..functions.stats import finite, ratio
from .series import FRAME, KEY, by_frame, whole


def torso_reference(frames: DataFrame, layout: pose.Layout = pose.L33, stat: str = "median") -> DataFrame:
    """(entity, torso): median or mean torso length of the clip; an error below 1e-6."""
    length = finite(pose.torso_len(F.col("lm"), layout))
    value = F.median(length) if stat == "median" else F.avg(length)
    checked = F.when(F.col("torso") >= 1e-6, F.col("torso")).otherwise(F.raise_error(F.lit("degenerate torso")))
    return frames.groupBy(KEY).agg(value.alias("torso")).withColumn("torso", F.when(F.col("torso").isNotNull(), checked))


def torso_cv(frames: DataFrame, layout: pose.Layout = pose.L33) -> DataFrame:
    """(entity, torso_len_cv): population deviation over mean of the torso length."""
    length = finite(pose.torso_len(F.col("lm"), layout))
    return frames.groupBy(KEY).agg(ratio(F.stddev_pop(length), F.avg(length)).alias("torso_len_cv"))


def normalize(frames: DataFrame, layout: pose.Layout = pose.L33, rotate: bool = True, stat: str = "median") -> DataFrame:
    """``lm`` in torso lengths around the hip, torso along +x; ``angle`` is the frame's torso angle before that."""
    reference = torso_reference(frames, layout, stat)
    out = frames.join(reference, KEY).withColumns({"angle": pose.torso_angle(F.col("lm"), layout), "lm": pose.normalized(F.col("lm"), F.col("torso"), layout, rotate)})
    return out.drop("torso")


def view_scores(frames: DataFrame, layout: pose.Layout = pose.L33) -> DataFrame:
    """(entity, view_score, view): median of the frames' hip ratios, and its class."""
    scored = frames.groupBy(KEY).agg(F.median(finite(pose.hip_ratio(F.col("lm"), layout))).alias("view_score"))
    return scored.withColumn("view", pose.classify_view(F.col("view_score")))


def rotation_deviation(frames: DataFrame, calibration: int = 30, layout: pose.Layout = pose.L33) -> DataFrame:
    """(entity, frame, rot, rot_dev, depth_dev): proxies less their medians over the first ``calibration`` frames.

    Depths are NULL where landmarks have no z.
    """
    has_z = "z" in frames.schema["lm"].dataType.elementType.names
    depth = pose.depth_proxy(F.col("lm"), layout) if has_z else F.lit(None).cast("double")
    first = F.row_number().over(by_frame()) <= calibration
    marked = frames.select(KEY, FRAME, pose.hip_ratio(F.col("lm"), layout, 1e-9).alias("rot"), depth.alias("depth"), first.alias("_first"))
    median = lambda c: F.median(F.when(F.col("_first"), F.col(c))).over(whole())
    return marked.select(KEY, FRAME, "rot", (F.col("rot") - median("rot")).alias("rot_dev"), (F.col("depth") - median("depth")).alias("depth_dev"))


def features(normalised: DataFrame, fps: float, lumbar: str | None = None) -> DataFrame:
    """(entity, frame, features): the 109 channels of normalised 17-point frames."""
    order = by_frame()
    stacked = pose.stacked(F.col("lm"), F.lag("lm").over(order), F.row_number().over(order) == 1, fps, F.col(lumbar) if lumbar else None)
    return normalised.select(KEY, FRAME, stacked.alias("features"))


def rep_tensors(features_by_frame: DataFrame, reps: DataFrame, length: int = 32) -> DataFrame:
    """(entity, rep, k, features): each repetition resampled to ``length`` rows; those of fewer than two frames go.

    A repetition is an array of its frames: an equi-join on the clip with a
    range on frames, then interpolation without another join.
    """
    inside = reps.select(KEY, "rep", "start", "end").join(features_by_frame, KEY).filter(F.col(FRAME).between(F.col("start"), F.col("end")))
    arrays = inside.groupBy(KEY, "rep").agg(F.transform(F.sort_array(F.collect_list(F.struct(FRAME, "features"))), lambda s: s["features"]).alias("x")).filter(F.size("x") >= 2)
    last = F.size("x") - 1

    def at(k: Column) -> Column:
        p = k * (last / F.lit(float(length - 1)))
        low = F.least(F.floor(p).cast("int"), last - 1)
        return F.zip_with(F.get("x", low), F.get("x", low + 1), lambda a, b: a + (b - a) * (p - low))

    # only the samples leave the row, not the frames with each of them
    samples = arrays.select(KEY, "rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)).alias("k", "features"))
    return samples.select(KEY, "rep", "k", "features")


def rep_values(reps: DataFrame, signals: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per repetition (entity, rep, start, peak, end) mean, largest and largest absolute value of each signal, and its value at the peak."""
    inside = reps.select(KEY, "rep", "start", "peak", "end").join(signals, KEY).filter(F.col(FRAME).between(F.col("start"), F.col("end")))
    aggregates = []
    for n in names:
        v = finite(n)
        aggregates += [F.avg(v).alias(f"{n}_mean"), F.max(v).alias(f"{n}_peak"), F.max(F.abs(v)).alias(f"{n}_abs_peak"), F.max(F.when(F.col(FRAME) == F.col("peak"), v)).alias(f"{n}_at_peak")]
    return inside.groupBy(KEY, "rep").agg(*aggregates)


def with_masks(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with the mask of the same frame; those without one have a NULL ``bottom`` and mask_valid false."""
    named = masks.select(KEY, FRAME, "bottom", F.lit(True).alias("_has"))
    return frames.join(named, [KEY, FRAME], "left").withColumn("mask_valid", F.coalesce("_has", F.lit(False))).drop("_has")


def clip_summary(frames: DataFrame, layout: pose.Layout = pose.L33) -> DataFrame:
    """Per clip: frames, detection rate, mean visibility of the trunk, torso variation and view score, in one aggregate."""
    lm = F.col("lm")
    length = finite(pose.torso_len(lm, layout))
    has_v = "v" in frames.schema["lm"].dataType.elementType.names
    seen = pose.visible(lm, (*layout.shoulders, *layout.hips)) if has_v else F.lit(None).cast("double")
    return frames.groupBy(KEY).agg(
        F.count("*").alias("n_frames"),
        F.avg(pose.detected(lm).cast("int")).alias("detection_rate"),
        F.avg(seen).alias("mean_visibility_core"),
        ratio(F.stddev_pop(length), F.avg(length)).alias("torso_len_cv"),
        F.median(finite(pose.hip_ratio(lm, layout))).alias("view_score"),
    )


def measured(frames: DataFrame, records: DataFrame, segments: DataFrame, layout: pose.Layout = pose.L33) -> DataFrame:
    """One row of twelve measures per clip of ``records`` (entity, file, fps): what triage decides on.

    ``segments`` (entity, start_s, end_s, n_reps) are its stretches of exercise.
    A clip without frames has 0 of them, no rates, and no exercise. A rate that
    isn't positive counts as 30.
    """
    exercise = segments.groupBy(KEY).agg(F.sum("n_reps").alias("n_reps"), F.sum(F.col("end_s") - F.col("start_s")).alias("_s"))
    rated = records.select(KEY, "file", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"))
    all_ = rated.join(clip_summary(frames, layout), KEY, "left").join(exercise, KEY, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    duration = F.col("n_frames") / F.col("fps")
    third = lambda c: F.bround(c, 3).alias(c)
    return all_.select(
        KEY,
        "file",
        "n_frames",
        third("fps"),
        F.bround(duration, 1).alias("duration_s"),
        *map(third, ("detection_rate", "mean_visibility_core", "view_score")),
        F.when(F.col("view_score").isNotNull(), pose.classify_view(F.col("view_score"))).alias("view"),
        third("torso_len_cv"),
        F.coalesce("n_reps", F.lit(0)).alias("n_reps"),
        F.bround(F.coalesce(F.try_divide("_s", duration), F.lit(0.0)), 3).alias("exercise_fraction"),
    )


def assessed(summary: DataFrame) -> DataFrame:
    """A clip's summary with a list of warnings."""
    checks = (
        (F.col("detection_rate") < 0.90, "body not found in many frames"),
        (F.col("mean_visibility_core") < 0.70, "trunk hidden"),
        (F.col("torso_len_cv") > 0.10, "camera moves"),
        (pose.classify_view(F.col("view_score")) != "side", "not a side view"),
    )
    return summary.withColumn("warnings", F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in checks))))


def lower_boundary(pixels: DataFrame, width: int) -> DataFrame:
    """(entity, frame, bottom) from occupied pixels (entity, frame, x, y): the largest y of each column, NULL in empty ones."""
    columns = pixels.groupBy(KEY, FRAME, "x").agg(F.max("y").cast("double").alias("y"))
    mapped = columns.groupBy(KEY, FRAME).agg(F.map_from_entries(F.collect_list(F.struct("x", "y"))).alias("m"))
    return mapped.select(KEY, FRAME, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.try_element_at("m", x)).alias("bottom"))


def boundary_points(masks: DataFrame) -> DataFrame:
    """(entity, frame, x, y) of the occupied columns."""
    return masks.select(KEY, FRAME, F.posexplode("bottom").alias("x", "y")).filter(F.col("y").isNotNull())


def floor_points(masks: DataFrame, static: str | None = None, frames: int = 30, least: int = 8, top: float = 0.80) -> DataFrame:
    """The points a floor is fitted to: of all frames, or of the first ``frames`` static ones if these give enough; then only the lowest fifth, if enough."""
    points = F.posexplode("bottom").alias("x", "y")
    if static is None:
        some = masks.select(KEY, FRAME, points).filter(F.col("y").isNotNull())
    else:
        nth = F.row_number().over(Window.partitionBy(KEY, "_static").orderBy(FRAME))
        marked = masks.withColumn("_static", F.coalesce(F.col(static), F.lit(False))).withColumn("_first", F.col("_static") & (nth <= frames))
        known = marked.select(KEY, FRAME, "_first", points).filter(F.col("y").isNotNull())
        some = _of_clip(known, known.groupBy(KEY).agg(F.count_if("_first").alias("_n"))).filter(F.col("_first") | (F.col("_n") < least)).select(KEY, FRAME, "x", "y")
    heights = some.groupBy(KEY, "y").agg(F.count("*").alias("_c"))
    cut = heights.groupBy(KEY).agg(F.percentile("y", top, F.col("_c")).alias("_cut"))
    high = _of_clip(heights, cut).groupBy(KEY).agg(F.first("_cut").alias("_cut"), F.sum(F.when(F.col("y") >= F.col("_cut"), F.col("_c")).otherwise(0)).alias("_n"))
    return _of_clip(some, high).filter((F.col("y") >= F.col("_cut")) | (F.col("_n") < least)).select(KEY, FRAME, "x", "y")


def _of_clip(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with what their clip shares; clips may be null."""
    return rows.join(shared.withColumnRenamed(KEY, "_clip"), F.col(KEY).eqNullSafe(F.col("_clip"))).drop("_clip")


def floor_percentile(points: DataFrame, p: float = 0.95, within: float = 3.0, least: int = 8) -> DataFrame:
    """(entity, a, b, inlier_ratio, n_points): a level floor at a percentile; fewer than ``least`` points give NULL and 0."""
    heights = points.groupBy(KEY, "y").agg(F.count("*").alias("_c"))
    fitted = _of_clip(heights, heights.groupBy(KEY).agg(F.percentile("y", p, F.col("_c")).alias("b")))
    near = F.when(F.abs(F.col("y") - F.col("b")) <= within, F.col("_c")).otherwise(0)
    out = fitted.groupBy(KEY).agg(F.first("b").alias("b"), (F.sum(near) / F.sum("_c")).alias("inlier_ratio"), F.sum("_c").alias("n_points"))
    fine = F.col("n_points") >= least
    return out.select(KEY, F.when(fine, F.lit(0.0)).alias("a"), F.when(fine, F.col("b")).alias("b"), F.when(fine, F.col("inlier_ratio")).otherwise(0.0).alias("inlier_ratio"), "n_points")


def fit_line(x: np.ndarray, y: np.ndarray, draws: np.ndarray, within: float = 3.0, least: int = 8) -> tuple[float, float, float]:
    """(a, b, inlier ratio): of the level line at the median and the lines through the ``draws`` (pairs of places) the one with most points near it.

    That line is fitted anew to its points, if they are ``least`` and not above
    each other. ``floor_ransac`` does the same by aggregates.
    """
    first, second = draws[x[draws[:, 0]] != x[draws[:, 1]]].T
    slopes = np.r_[0.0, (y[second] - y[first]) / (x[second] - x[first])]
    heights = np.r_[np.median(y), y[first] - slopes[1:] * x[first]]
    near = np.abs(y - np.outer(slopes, x) - heights[:, None]) <= within
    best = near.sum(axis=1).argmax()
    line, chosen = (slopes[best], heights[best]), near[best]
    if chosen.sum() >= least and np.unique(x[chosen]).size > 1:
        line = np.polyfit(x[chosen], y[chosen], 1)
        chosen = np.abs(y - np.polyval(line, x)) <= within
    return float(line[0]), float(line[1]), float(np.mean(chosen))


def consensus_line(x: np.ndarray, y: np.ndarray, trials: int = 200, within: float = 3.0, least: int = 8, seed: int = 0) -> tuple[float, float, float]:
    """``fit_line`` of a few points, with the draws that ``drawn`` makes for as many."""
    order = np.lexsort((y, x))
    place = lambda t, end: int(hashlib.md5(f"{seed}:{t}:{end}".encode()).hexdigest()[:12], 16) % len(x)
    return fit_line(x[order], y[order], np.array([(place(t, "i"), place(t, "j")) for t in range(trials)]), within, least)


def drawn(sizes: DataFrame, trials: int = 200, seed: int = 0) -> DataFrame:
    """(entity, trial, i, j): two places for each trial, from a hash of seed, trial and end, in clips of ``n_points`` points."""
    place = lambda end: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "trial", F.lit(end))), 1, 12), 16, 10).cast("long") % F.col("n_points")
    trial = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial")
    return sizes.select(KEY, "n_points", trial).select(KEY, "trial", place("i").alias("i"), place("j").alias("j"))


def floor_ransac(points: DataFrame, trials: int = 200, within: float = 3.0, least: int = 8, seed: int = 0) -> DataFrame:
    """(entity, a, b, inlier_ratio, n_points) by consensus: ``fit_line`` for each clip, its points counted by aggregates.

    No clip is held by one task. Equal points count together; the points that a
    trial draws are found by their ranks in the order of x and y, which add up
    from the sizes of the columns.
    """
    from ..session import checkpointed

    tally = checkpointed(points.groupBy(KEY, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("_c")))
    sizes = checkpointed(tally.groupBy(KEY).agg(F.sum("_c").alias("n_points"), F.percentile("y", 0.5, F.col("_c")).alias("_level")))
    enough = sizes.filter(F.col("n_points") >= least)

    columns = tally.groupBy(KEY, "x").agg(F.sum("_c").alias("_c"))
    before = columns.select(F.col(KEY).alias("_clip"), F.col("x").alias("_x"), (F.sum("_c").over(Window.partitionBy(KEY).orderBy("x")) - F.col("_c")).alias("_before"))
    ranked = tally.withColumn("_below", F.sum("_c").over(Window.partitionBy(KEY, "x").orderBy("y")) - F.col("_c")).join(before, F.col(KEY).eqNullSafe(F.col("_clip")) & (F.col("x") == F.col("_x")))
    first = F.col("_before") + F.col("_below")
    draws = drawn(enough, trials, seed)
    # the ranks drawn in a clip are an array, so that points meet a row per clip
    wanted = draws.groupBy(KEY).agg(F.collect_set("i").alias("_i"), F.collect_set("j").alias("_j")).select(KEY, F.array_union("_i", "_j").alias("_ranks"))
    hit = F.filter("_ranks", lambda r: (r >= first) & (r < first + F.col("_c")))
    found = checkpointed(_of_clip(ranked.drop("_clip"), wanted).select(F.col(KEY).alias("_clip"), F.explode(hit).alias("_rank"), "x", "y"))
    ends = draws
    for end, suffix in (("i", "0"), ("j", "1")):
        at = found.select("_clip", "_rank", F.col("x").alias(f"x{suffix}"), F.col("y").alias(f"y{suffix}"))
        ends = ends.join(at, F.col(KEY).eqNullSafe(F.col("_clip")) & (F.col(end) == F.col("_rank"))).drop("_clip", "_rank")
    sloped = ends.filter("x0 <> x1").select(KEY, "trial", "x0", "y0", ((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))
    level = enough.select(KEY, F.lit(-1).cast("long").alias("trial"), F.lit(0.0).alias("x0"), F.col("_level").alias("y0"), F.lit(0.0).alias("slope"))
    lines = checkpointed(sloped.unionByName(level).groupBy(KEY).agg(F.collect_list(F.struct("trial", "x0", "y0", "slope")).alias("_lines")))

    gap = F.col("y") - (F.col("_l.slope") * (F.col("x") - F.col("_l.x0")) + F.col("_l.y0"))
    tried = _of_clip(tally, lines).select(KEY, "x", "y", "_c", F.explode("_lines").alias("_l"))
    agreed = tried.groupBy(KEY, "_l").agg(F.sum(F.when(F.abs(gap) <= within, F.col("_c")).otherwise(0)).alias("_agree"))
    # of lines that equally many points agree with, the first
    best = checkpointed(agreed.groupBy(KEY).agg(F.min_by(F.struct("_l", "_agree"), F.struct((-F.col("_agree")).alias("n"), "_l.trial")).alias("_b")).select(KEY, "_b._l", "_b._agree"))

    # least squares of the gaps to that line, as these are small numbers
    dx = F.col("x") - F.col("_l.x0")
    inside = _of_clip(tally, best).filter(F.abs(gap) <= within)
    total = lambda c: F.sum(F.col("_c") * c)
    sums = inside.groupBy(KEY).agg(total(F.lit(1.0)).alias("n"), total(dx).alias("x"), total(gap).alias("g"), total(dx * dx).alias("xx"), total(dx * gap).alias("xg"), (F.max("x") > F.min("x")).alias("wide"))
    tilt = ratio(F.col("xg") - F.col("x") * F.col("g") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    refit = sums.filter((F.col("n") >= least) & F.col("wide")).select(F.col(KEY).alias("_clip"), tilt.alias("_tilt"), (F.col("g") / F.col("n")).alias("_g"), (F.col("x") / F.col("n")).alias("_x"))
    known = best.join(refit, F.col(KEY).eqNullSafe(F.col("_clip")), "left").drop("_clip")
    a = F.col("_l.slope") + F.coalesce("_tilt", F.lit(0.0))
    b = F.col("_l.y0") - F.col("_l.slope") * F.col("_l.x0") + F.coalesce(F.col("_g") - F.col("_tilt") * (F.col("_x") + F.col("_l.x0")), F.lit(0.0))
    fitted = checkpointed(known.select(KEY, a.alias("a"), b.alias("b"), F.when(F.col("_tilt").isNull(), F.col("_agree")).alias("_agree")))
    near = F.sum(F.when(F.abs(F.col("y") - (F.col("a") * F.col("x") + F.col("b"))) <= within, F.col("_c")).otherwise(0))
    counted = _of_clip(tally, fitted).groupBy(KEY).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.coalesce(F.first("_agree"), near).alias("_agree")).withColumnRenamed(KEY, "_clip")
    out = sizes.join(counted, F.col(KEY).eqNullSafe(F.col("_clip")), "left")
    return out.select(KEY, "a", "b", F.coalesce(F.col("_agree") / F.col("n_points"), F.lit(0.0)).alias("inlier_ratio"), "n_points")


def sparc(speed: np.ndarray, fs: float, padding: int = 4, cutoff: float = 10.0, amplitude: float = 0.05) -> float | None:
    """Spectral arc length of a speed profile: less negative is smoother. NULL below four samples and for no movement.

    The published measure: the magnitudes of the padded spectrum over their
    largest, up to ``cutoff`` and between the outermost ones of at least
    ``amplitude``, as a curve over that band stretched to 1; its length, negated.
    """
    known = np.asarray(speed, float)
    known = known[np.isfinite(known)]
    if known.size < 4:
        return None
    size = 1 << ((known.size - 1).bit_length() + padding)
    half = np.abs(np.fft.rfft(known, size))
    peak = half.max()
    if peak == 0:
        return None
    # the other half mirrors this one; it is reached only if the cutoff exceeds half the rate
    curve = np.r_[half, half[-2:0:-1]][: int(cutoff * size / fs * (1 + 1e-12)) + 1] / peak
    loud = np.flatnonzero(curve >= amplitude)
    steps = int(np.ptp(loud)) if loud.size else 0
    if steps == 0:
        return None
    return -float(np.hypot(1 / steps, np.diff(curve[loud[0] : loud[-1] + 1])).sum())


def smoothness(rows: DataFrame, fs: float | str, *by: str, value: str = "speed") -> DataFrame:
    """(by..., sparc) of each group's samples in order of frames; ``fs`` may be the column with each group's own rate."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = sparc(group.sort_values(FRAME)[value].to_numpy(float), float(group[fs].iloc[0]) if isinstance(fs, str) else fs)
        return pd.DataFrame({**{b: [k] for b, k in zip(by, key, strict=True)}, "sparc": pd.array([out], "Float64")})

    kinds = ", ".join(f"{b} {rows.schema[b].dataType.simpleString()}" for b in by)
    return rows.select(*by, FRAME, value, *([fs] if isinstance(fs, str) else [])).groupBy(*by).applyInPandas(run, f"{kinds}, sparc double")


def minimum_jerk(n: int, amplitude: float = 1.0) -> Column:
    """The smoothest speed profile of ``n`` samples: 30 t^2 (1 - t)^2."""
    t = lambda k: k / F.lit(float(max(n - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(30.0 * amplitude) * t(k) * t(k) * (1 - t(k)) * (1 - t(k)))


def inferred(frames: DataFrame, backbone: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run a pose model over frames: ``backbone`` is called once per task and gives a function from batches to rows of ``schema``."""

    def run(batches):
        infer = backbone()
        for batch in batches:
            yield infer(batch)

    return frames.mapInPandas(run, schema)
