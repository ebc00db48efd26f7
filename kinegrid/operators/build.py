"""From frames to one row per repetition: the batch path in one chain of DataFrames.

Nothing loops over clips. Each step is one of the other operators, applied to
all clips at once; a clip that has to be left out is left out by a join with
its ``reason``, which is told in the diagnostics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pose, silhouette
from ..session import checkpointed
from . import clips, segments
from .series import FRAME, KEY, VALUE, speed, static_frames

#: The columns of a repetition's row, in their order.
REP_COLUMNS = (
    "rep_id", "clip_id", "person_id", "condition", "view", "side", "rep_index", "start_s", "end_s", "peak_s", "duration_s", "t_extend_s", "t_return_s", "dwell_s", "overlap_s", "excursion_peak",
    "lumbar_gap_mean", "lumbar_gap_peak", "lumbar_gap_at_excursion_peak", "rib_gap_peak", "rot_dev_peak", "sparc_wrist", "sparc_ankle", "flags",
)


@dataclass(frozen=True)
class BuildRules:
    """The first four hold for clips whose record has no column of that name, or a NULL in it."""

    fps: float = 30.0
    #: Size of the image that landmarks are shares of, and of the masks.
    width: int = 640
    height: int = 480
    mask_height: int = 480
    layout: pose.Layout = pose.L33
    floor: str = "percentile"
    least_inliers: float = 0.80
    static: float = 0.005
    static_frames: int = 30
    calibration: int = 30


#: What each clip has of its own, and its frames carry.
OWN = ("fps", "width", "height", "mask_height")


def _owned(records: DataFrame, rules: BuildRules) -> DataFrame:
    """(entity, ``OWN``) of the clips in ``records``."""
    own = [F.coalesce(*([F.col(c).cast("double")] if c in records.columns else []), F.lit(float(getattr(rules, c)))).alias(c) for c in OWN]
    return records.select(_named("clip_id"), *own).groupBy(KEY).agg(*(F.min(c).alias(c) for c in OWN))


def _named(c: str) -> Column:
    return F.col(c).alias(KEY)


def _sided(frames: DataFrame, per_torso: bool, layout: pose.Layout) -> DataFrame:
    """(entity, frame, fps, side, value): the wrist's distance from the opposite ankle, for either side."""
    both = pose.contralateral(F.col("lm"), layout, per_torso=per_torso)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"_c.{s}").alias(VALUE)) for s in ("R", "L")))
    return frames.select(KEY, FRAME, "fps", both.alias("_c")).select(KEY, FRAME, "fps", F.inline(sides))


def exercise_segments(pixels: DataFrame, rules: BuildRules) -> DataFrame:
    """(entity, segment, start_s, end_s, n_reps, sides) of frames in pixels: where plausible repetitions follow each other."""
    lengths = pixels.groupBy(KEY).agg(F.min("fps").alias("fps"), F.count("*").alias("n_frames"))
    found = segments.find_reps(_sided(pixels, True, rules.layout), "fps").join(lengths, KEY)
    return segments.find_segments(segments.plausible(segments.with_timing(found, "fps")), F.col("n_frames") / F.col("fps"))


def floors(frames: DataFrame, rules: BuildRules) -> DataFrame:
    """(entity, a, b, inlier_ratio, n_points) from the real masks, of static frames if they give enough points."""
    known = static_frames(frames.filter("mask_valid"), "lm", rules.static)
    points = clips.floor_points(known, "static", rules.static_frames)
    return (clips.floor_ransac if rules.floor == "ransac" else clips.floor_percentile)(points)


def frame_signals(frames: DataFrame, floor: DataFrame, rules: BuildRules) -> DataFrame:
    """(entity, frame, lumbar, rib, rib_lead, rot): gaps under the torso, NULL without a mask, the rib's over the lumbar one, and the turn of the hips."""
    on_mask = frames.join(floor.select(KEY, "a", "b"), KEY).withColumn("lm", pose.scaled(F.col("lm"), F.size("bottom").cast("double"), F.col("mask_height")))
    torso, along, hip = pose.torso_len(F.col("lm"), rules.layout), pose.torso_vector(F.col("lm"), rules.layout), pose.hip_center(F.col("lm"), rules.layout)
    placed = on_mask.select(KEY, FRAME, "bottom", "mask_valid", "a", "b", torso.alias("torso"), hip["x"].alias("hip"), F.try_divide(along["x"], torso).alias("unit"))

    def gap(fractions: tuple[float, float]) -> Column:
        place = silhouette.window(F.col("hip"), F.col("unit"), F.col("torso"), fractions, F.size("bottom"))
        return F.when(F.col("mask_valid"), silhouette.band_signal(F.col("bottom"), F.col("a"), F.col("b"), place, F.col("torso"))["area"])

    gaps = placed.select(KEY, FRAME, gap(silhouette.LUMBAR).alias("lumbar"), gap(silhouette.RIB).alias("rib"))
    turned = clips.rotation_deviation(_pixels(frames), rules.calibration, rules.layout).select(KEY, FRAME, F.col("rot_dev").alias("rot"))
    return gaps.join(turned, [KEY, FRAME]).withColumn("rib_lead", F.col("rib") - F.col("lumbar"))


def rep_smoothness(normalised: DataFrame, reps: DataFrame, rules: BuildRules) -> DataFrame:
    """(entity, rep, sparc_wrist, sparc_ankle) of the wrist and the ankle that move in each repetition (entity, rep, side, start, end)."""
    layout = rules.layout
    inside = reps.select(KEY, "rep", "side", "start", "end").join(normalised, KEY).filter(F.col(FRAME).between(F.col("start"), F.col("end")))
    right = F.col("side") == "R"
    limb = lambda one, other: F.when(right, pose.at(F.col("lm"), one)).otherwise(pose.at(F.col("lm"), other))
    out = reps.select(KEY, "rep")
    for name, (one, other) in (("wrist", (layout.wrists[1], layout.wrists[0])), ("ankle", (layout.ankles[0], layout.ankles[1]))):
        # a repetition is an entity of its own here, so that speeds stay within it
        track = inside.select(F.struct(KEY, "rep").alias("_rep"), FRAME, "fps", limb(one, other).alias("p")).select(F.col("_rep").alias(KEY), FRAME, "fps", "p.x", "p.y")
        moved = speed(track, "fps").select(f"{KEY}.{KEY}", f"{KEY}.rep", FRAME, "fps", "speed")
        out = out.join(clips.smoothness(moved, "fps", KEY, "rep").withColumnRenamed("sparc", f"sparc_{name}"), [KEY, "rep"], "left")
    return out


def _pixels(frames: DataFrame) -> DataFrame:
    return frames.withColumn("lm", pose.scaled(F.col("lm"), F.col("width"), F.col("height")))


def build_reps(records: DataFrame, frames: DataFrame, rules: BuildRules = BuildRules()) -> tuple[DataFrame, DataFrame]:
    """The repetitions (``REP_COLUMNS``) and the diagnostics of all clips.

    ``records`` has (clip_id, person_id, condition, view, qc_status) and, if
    clips have these of their own, fps, width, height and mask_height; ``frames``
    (entity, frame, lm, bottom, mask_valid) with landmarks as shares of the
    image and frames numbered from 0. Diagnostics have a row per record; its
    ``reason`` says why a clip has no repetitions: it was rejected before, no
    exercise was found, no frame has a mask, or no floor was. A clip that passes
    has none, and ``alternation_intact`` is NULL where there is no repetition.
    """
    taken = records.filter(F.coalesce(F.col("qc_status") != "reject", F.lit(True)))
    own = checkpointed(_owned(taken, rules))
    known = checkpointed(frames.drop(*OWN).join(own, KEY))
    rates = own.select(KEY, "fps")
    pixels = _pixels(known)
    found = checkpointed(exercise_segments(pixels, rules))
    floor = checkpointed(floors(known, rules))
    counted = found.groupBy(KEY).agg(F.count("*").alias("n_segments"))
    masked = known.groupBy(KEY).agg(F.avg(F.col("mask_valid").cast("int")).alias("mask_rate"))
    summary = clips.clip_summary(pixels, rules.layout).join(counted, KEY, "left").join(masked, KEY, "left").join(floor, KEY, "left")
    summary = summary.withColumn("view_found", pose.classify_view(F.col("view_score"))).withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    reason = (
        F.when(F.col("n_segments") == 0, "no exercise segment detected")
        .when(F.col("mask_rate") == 0, "no segmentation mask on any frame")
        .when(F.col("b").isNull(), "floor estimate failed")
        .when(F.col("inlier_ratio") < rules.least_inliers, F.format_string(f"floor inlier ratio %.2f below {rules.least_inliers}", F.col("inlier_ratio")))
    )
    told = checkpointed(summary.withColumn("reason", reason))
    fine = told.filter("reason is null").select(KEY)

    # a segment is a series of its own, numbered from 0
    edge = lambda c: F.rint(F.col(c) * F.col("fps")).cast("long")
    parts = found.join(fine, KEY, "left_semi").join(rates, KEY).select(KEY, "segment", "fps", edge("start_s").alias("low"), edge("end_s").alias("high"))
    normalised = checkpointed(clips.normalize(pixels.join(fine, KEY, "left_semi"), rules.layout).select(KEY, FRAME, "fps", "lm"))
    series = _sided(normalised, False, rules.layout).join(parts.drop("fps"), KEY).filter((F.col(FRAME) >= F.col("low")) & (F.col(FRAME) < F.col("high")))
    part = F.concat_ws("#", KEY, "segment")
    series = series.select(part.alias(KEY), (F.col(FRAME) - F.col("low")).alias(FRAME), "fps", "side", VALUE)
    reps = segments.find_reps(series, "fps").join(parts.select(part.alias(KEY), "fps"), KEY)
    reps = segments.with_dwell(segments.with_timing(reps, "fps"), series, "fps")
    reps = segments.with_flags(segments.with_alternation(reps)).withColumnRenamed(KEY, "_part")
    shifted = {c: F.col(c) + F.col("low") for c in ("start", "peak", "end")} | {f"{c}_s": F.col(f"{c}_s") + F.col("low") / F.col("fps") for c in ("start", "peak", "end")}
    placed = reps.join(parts.drop("fps").withColumn("_part", part), "_part").withColumns(shifted)
    order = segments.Window.partitionBy(KEY).orderBy("segment", "start", F.desc("side"))
    numbered = checkpointed(placed.withColumn("rep", F.row_number().over(order) - 1))

    values = clips.rep_values(numbered, frame_signals(known.join(fine, KEY, "left_semi"), floor, rules), ("lumbar", "rib", "rot"))
    smooth = rep_smoothness(normalised, numbered, rules)
    rows = numbered.join(values, [KEY, "rep"], "left").join(smooth, [KEY, "rep"], "left").join(taken.withColumn(KEY, F.col("clip_id")), KEY)
    made = {
        "rep_id": F.format_string("%s__%03d%s", F.col("clip_id"), F.col("rep"), F.col("side")),
        "rep_index": F.col("rep"),
        "excursion_peak": F.col("excursion"),
        "lumbar_gap_mean": F.col("lumbar_mean"),
        "lumbar_gap_peak": F.col("lumbar_peak"),
        "lumbar_gap_at_excursion_peak": F.col("lumbar_at_peak"),
        "rib_gap_peak": F.col("rib_peak"),
        "rot_dev_peak": F.col("rot_abs_peak"),
        "flags": F.array_join("flags", ";"),
    }
    out = checkpointed(rows.select(*(made[c].alias(c) if c in made else F.col(c) for c in REP_COLUMNS)))

    per_clip = out.groupBy(_named("clip_id")).agg(F.count("*").alias("n_reps"), F.bool_and(~F.contains(F.col("flags"), F.lit("alternation_broken"))).alias("alternation_intact"))
    diagnosed = told.join(per_clip, KEY, "left").withColumnRenamed(KEY, "clip_id").withColumn("n_reps", F.coalesce("n_reps", F.lit(0)))
    rejected = F.when(F.col("qc_status") == "reject", "qc_status=reject").otherwise(F.coalesce("reason", F.when(F.col("n_frames").isNull(), "no frames")))
    told = records.select("clip_id", "qc_status").join(diagnosed, "clip_id", "left").withColumn("reason", rejected)
    return out, told.withColumn("n_reps", F.coalesce("n_reps", F.lit(0))).drop("qc_status")


def dataset_summary(reps: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: clips, repetitions, persons, and repetitions by condition."""
    counts = reps.groupBy("condition").agg(F.count("*").alias("n"))
    by = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("condition", F.lit("")).alias("condition"), "n")))).alias("by_condition"))
    totals = reps.agg(F.count("*").alias("n_reps"), F.countDistinct("person_id").alias("n_persons"))
    return totals.withColumn("by_condition", by.scalar()).withColumn("n_clips", diagnostics.agg(F.count("*")).scalar())
