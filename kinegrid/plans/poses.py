"""Landmarks and silhouettes made from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pose, silhouette
from ..functions.stats import rounded
from ..operators import build, clips, segments
from .tables import NUDGE, POSES_SQL, load, poses

L = pose.L17


def _exploded(frame: DataFrame, name: str) -> DataFrame:
    return frame.select("vec_id", F.posexplode(name).alias("k", "v"))


def pose_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clips.normalize(poses(spark, sf_dir), L)
    return done.select("vec_id", F.posexplode("lm").alias("k", "p")).select("vec_id", "k", rounded("p.x").alias("x"), rounded("p.y").alias("y"))


def pose_view_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.view_scores(poses(spark, sf_dir), L).select("entity", rounded("view_score").alias("view_score"), "view")


def pose_bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("vec_id", pose.bone_vectors(F.col("lm")).alias("bones"))
    return rows.select("vec_id", F.posexplode("bones").alias("k", "p")).select("vec_id", "k", rounded("p.x").alias("x"), rounded("p.y").alias("y"))


def pose_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("vec_id", pose.joint_angles(F.col("lm")).alias("a"))
    return _exploded(rows, "a").select("vec_id", "k", rounded("v").alias("angle"))


def pose_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("vec_id", F.posexplode(pose.flip_horizontal(F.col("lm"), 640, L)).alias("k", "p"))
    return rows.select("vec_id", "k", rounded("p.x").alias("x"), rounded("p.y").alias("y"))


def pose_contralateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = poses(spark, sf_dir).select("vec_id", pose.contralateral(F.col("lm"), L).alias("c"), pose.contralateral(F.col("lm"), L, per_torso=True).alias("t"))
    return both.select("vec_id", *(rounded(f"{s}.{side}").alias(f"{s}_{side.lower()}") for s in "ct" for side in "RL"))


def pose_rotation_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.rotation_deviation(poses(spark, sf_dir), 10, L).select("entity", "frame", rounded("rot").alias("rot"), rounded("rot_dev").alias("rot_dev"))


def pose_torso_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.torso_cv(poses(spark, sf_dir), L).select("entity", rounded("torso_len_cv").alias("torso_len_cv"))


def pose_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("vec_id", rounded(pose.geometric_signal(F.col("lm"), L)).alias("signal"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.features(clips.normalize(poses(spark, sf_dir), L), 30.0)


def _sums(rows: DataFrame) -> list[Column]:
    """Sums of each block of the channels in features."""
    total = lambda a, n: F.aggregate(F.slice(rows["features"], a + 1, n), F.lit(0.0), lambda s, v: s + v)
    out, base = [], 0
    for name, n in pose.CHANNELS:
        out.append((F.bround(total(base, n), 4) + F.lit(0.0)).alias(name))
        base += n
    return out


def pose_features109(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each block of channels; the blocks themselves have queries of their own."""
    f = _features(spark, sf_dir)
    return f.select("entity", "frame", F.size("features").alias("n"), *_sums(f))


def pose_flip_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of the image mirrored in pixels: their sums, and how far they lie from the mirrored channels at most."""
    rows = poses(spark, sf_dir)
    turned = clips.features(clips.normalize(rows.withColumn("lm", pose.flip_horizontal(F.col("lm"), 640, L)), L), 30.0)
    mirrored = _features(spark, sf_dir).select("entity", "frame", pose.flip_features(F.col("features")).alias("mirrored"))
    gap = F.aggregate(F.zip_with("features", "mirrored", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: F.greatest(s, v))
    both = turned.join(mirrored, ["entity", "frame"])
    return both.select("entity", "frame", rounded(gap, 4).alias("gap"), *_sums(both))


def clip_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clips.assessed(clips.clip_summary(poses(spark, sf_dir), L))
    return out.select("entity", "n_frames", rounded("detection_rate").alias("detection_rate"), rounded("torso_len_cv").alias("torso_len_cv"), rounded("view_score").alias("view_score"), F.array_join("warnings", "; ").alias("warnings"))


def clip_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve measures of each clip; every fourth frame begins a repetition, and every sixth repetition is followed by a long rest."""
    frames = poses(spark, sf_dir)
    n = F.floor(F.col("frame") / 4)
    reps = frames.filter(F.col("frame") == 4 * n).select("entity", (2 * n + 20 * F.floor(n / 6)).cast("double").alias("start_s"), F.when(n % 2 == 0, "R").otherwise("L").alias("side"))
    sets = segments.find_segments(reps.withColumn("end_s", F.col("start_s") + 1.5), F.lit(1e6), 12.0, 4, 0.0)
    records = load(spark, sf_dir, "embeddings").select(F.col("label").alias("entity")).distinct().select("entity", F.concat(F.lit("clip"), "entity", F.lit(".mp4")).alias("file"), F.when(F.col("entity") % 3 == 0, 0.0).otherwise(0.5).alias("fps"))
    return clips.measured(frames, records, sets, L).drop("mean_visibility_core")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, frame, vec_id, bottom): numbers of an embedding as a silhouette of 64 columns; low ones are empty."""
    e = load(spark, sf_dir, "embeddings")
    bottom = F.transform("embedding", lambda v: F.when(v > -0.15, F.bround(v.cast("double") * 100 + 100, 3)))
    return e.select(F.col("label").alias("entity"), F.col("vec_id").alias("frame"), "vec_id", bottom.alias("bottom"))




def mask_place() -> Column:
    hip = F.lit(20.0) + F.col("vec_id") % 7 * 0.5
    return silhouette.window(hip, F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-1.0), F.lit(80.0), silhouette.LUMBAR, F.lit(64))


def silhouette_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masks(spark, sf_dir).withColumn("w", mask_place())
    s = silhouette.band_signal(F.col("bottom"), F.lit(0.05), F.lit(118.0), F.col("w"), F.lit(80.0))
    return rows.withColumn("s", s).select("vec_id", F.col("w.x0").alias("x0"), F.col("w.x1").alias("x1"), rounded(F.col("s.area") + NUDGE).alias("area"), rounded(F.col("s.peak") + NUDGE).alias("peak"), "s.width")


def _column(x: Column) -> Column:
    """Every ninth column stays empty: its pixels are one to the right."""
    return x + (x % 9 == 4).cast("int")


def silhouette_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    pixels = lines.select((F.col("l_suppkey") % 5).cast("int").alias("entity"), (F.col("l_orderkey") % 11).cast("int").alias("frame"), _column(F.col("l_quantity").cast("int")).alias("x"), (F.col("l_partkey") % 400).cast("int").alias("y"))
    found = clips.lower_boundary(pixels, 52)
    return found.select("entity", "frame", F.posexplode("bottom").alias("x", "y"))


def silhouette_perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masks(spark, sf_dir).withColumn("w", mask_place())
    lift = F.col("vec_id") % 5 * 1.0
    return rows.select("vec_id", F.posexplode(silhouette.lifted(F.col("bottom"), F.col("w"), lift)).alias("x", "y")).select("vec_id", "x", rounded("y").alias("y"))


def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clips.floor_percentile(clips.floor_points(masks(spark, sf_dir)))
    return found.select("entity", rounded("a").alias("a"), rounded("b").alias("b"), rounded("inlier_ratio").alias("inlier_ratio"), "n_points")


def floor_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clips.floor_ransac(clips.floor_points(masks(spark, sf_dir)))
    return found.select("entity", rounded("a").alias("a"), rounded("b", 4).alias("b"), rounded("inlier_ratio").alias("inlier_ratio"), "n_points")


def smoothness_sparc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series import FPS, series

    rows = series(spark, sf_dir).select("entity", "frame", F.col("value").alias("speed"))
    return clips.smoothness(rows, FPS, "entity").select("entity", rounded("sparc").alias("sparc"))


def _build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cluster of embeddings as a clip: landmarks as shares of the image, silhouettes, and a record each."""
    bottoms = masks(spark, sf_dir).select("vec_id", "bottom")
    share = lambda p: p.withField("x", p["x"] / 640).withField("y", p["y"] / 480)
    frames = poses(spark, sf_dir).join(bottoms, "vec_id").select(F.col("entity").cast("string").alias("entity"), "frame", F.transform("lm", share).alias("lm"), "bottom", (F.col("vec_id") % 10 != 0).alias("mask_valid"))
    known = load(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clip_id")).distinct()
    records = known.select("clip_id", F.concat(F.lit("p"), F.col("clip_id").cast("int") % 4).alias("person_id"), F.lit("correct").alias("condition"), F.lit("side").alias("view"), F.when(F.col("clip_id") == "3", "reject").otherwise("ok").alias("qc_status"))
    return build.build_reps(records, frames, build.BuildRules(fps=2.0, layout=L, least_inliers=0.05))


def build_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _build(spark, sf_dir)
    return made


def build_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, told = _build(spark, sf_dir)
    return told


_T = """, torsos AS (
  SELECT *, (x[12] + x[13]) / 2 AS hx, (y[12] + y[13]) / 2 AS hy, (x[6] + x[7]) / 2 AS sx, (y[6] + y[7]) / 2 AS sy FROM poses),
lengths AS (SELECT *, sqrt((sx - hx) ** 2 + (sy - hy) ** 2) AS torso, sqrt((x[12] - x[13]) ** 2 + (y[12] - y[13]) ** 2) AS hips, atan2(sy - hy, sx - hx) AS angle FROM torsos)"""
_N = """, refs AS (SELECT entity, median(torso) AS ref FROM lengths GROUP BY entity),
turned AS (
  SELECT l.entity, l.frame, l.vec_id,
    [cos(angle) * (x[k + 1] - hx) / ref + sin(angle) * (y[k + 1] - hy) / ref FOR k IN range(17)] AS x,
    [cos(angle) * (y[k + 1] - hy) / ref - sin(angle) * (x[k + 1] - hx) / ref FOR k IN range(17)] AS y
  FROM lengths l JOIN refs r USING (entity))"""
_PARENTS = "[" + ", ".join(map(str, pose.PARENTS17)) + "]"
_TRIPLES = "[" + ", ".join(f"[{a}, {v}, {c}]" for a, v, c in pose.ANGLES17) + "]"
_MIRROR = "[" + ", ".join(map(str, L.permutation)) + "]"
_BONES = "[x[k + 1] - x[{p}[k + 1] + 1] FOR k IN range(1, 17)] AS bx, [y[k + 1] - y[{p}[k + 1] + 1] FOR k IN range(1, 17)] AS by_".format(p=_PARENTS)
_ANGLES = f"""[abs(atan2(
    (x[t[1] + 1] - x[t[2] + 1]) * (y[t[3] + 1] - y[t[2] + 1]) - (y[t[1] + 1] - y[t[2] + 1]) * (x[t[3] + 1] - x[t[2] + 1]),
    (x[t[1] + 1] - x[t[2] + 1]) * (x[t[3] + 1] - x[t[2] + 1]) + (y[t[1] + 1] - y[t[2] + 1]) * (y[t[3] + 1] - y[t[2] + 1]))) FOR t IN {_TRIPLES}] AS a"""
MASKS_SQL = """masks AS (
  SELECT label AS entity, vec_id, [CASE WHEN v > -0.15::FLOAT THEN round_even(v::DOUBLE * 100 + 100, 3) END FOR v IN embedding] AS bottom FROM embeddings),
ends AS (
  SELECT *, round_even(20 + vec_id % 7 * 0.5::DOUBLE, 0) AS e0, round_even(20 + vec_id % 7 * 0.5::DOUBLE + 0.35::DOUBLE * 80 * CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END, 0) AS e1 FROM masks),
placed AS (SELECT *, greatest(0, least(64, least(e0, e1)))::INT AS x0, greatest(0, least(64, greatest(e0, e1)))::INT AS x1 FROM ends)"""
_FLOOR = """, points AS (SELECT entity, unnest(range(64)) AS x, unnest(bottom) AS y FROM masks),
known AS (SELECT entity, x, y FROM points WHERE y IS NOT NULL),
cut AS (SELECT entity, quantile_cont(y, 0.8) AS c FROM known GROUP BY entity),
high AS (SELECT k.entity, k.x, k.y FROM known k JOIN cut USING (entity) WHERE k.y >= c),
level AS (SELECT entity, quantile_cont(y, 0.95) AS b FROM high GROUP BY entity)"""


def _p(tail: str, *more: str) -> str:
    return f"WITH {POSES_SQL}{''.join(more)}\n{tail}"


_XY = "SELECT vec_id, unnest(range({n}))::INT AS k, round_even(unnest({x}), 6) AS x, round_even(unnest({y}), 6) AS y FROM {t}"

_MADE = f", made AS (SELECT entity, frame, x, y, {_BONES}, {_ANGLES} FROM turned)"
#: Across the torso a mirror image has the other sign.
_BLOCKS = """SELECT entity, frame, {also}, round_even(list_sum(x) {s} list_sum(y), 4) AS joint, round_even(list_sum(bx) {s} list_sum(by_), 4) AS bone,
  round_even(coalesce(((list_sum(x) {s} list_sum(y)) - lag(list_sum(x) {s} list_sum(y)) OVER (PARTITION BY entity ORDER BY frame)) * 30, 0), 4) AS velocity,
  round_even(list_sum(a), 4) AS angle, 0.0::DOUBLE AS lumbar FROM made"""

QUERIES = {
    f.__name__: f
    for f in (
        pose_normalize, pose_view_score, pose_bones, pose_angles, pose_flip, pose_contralateral, pose_rotation_dev, pose_torso_cv, pose_geometric,
        pose_features109, pose_flip_agrees, clip_triage, clip_measures, silhouette_gap, silhouette_boundary, silhouette_perturb, floor_percentile, floor_ransac, smoothness_sparc,
        build_reps, build_diagnostics,
    )
}
ORACLES = {
    "pose_normalize": _p(_XY.format(n=17, x="x", y="y", t="turned"), _T, _N),
    "pose_view_score": _p("""SELECT entity, round_even(s, 6) AS view_score, CASE WHEN s < 0.12 THEN 'side' WHEN s < 0.21 THEN 'oblique45' ELSE 'other' END AS view
FROM (SELECT entity, median(hips / torso) AS s FROM lengths GROUP BY entity)""", _T),
    "pose_bones": _p(_XY.format(n=16, x="bx", y="by_", t="bones"), f", bones AS (SELECT vec_id, {_BONES} FROM poses)"),
    "pose_angles": _p("SELECT vec_id, unnest(range(8))::INT AS k, round_even(unnest(a), 6) AS angle FROM angles", f", angles AS (SELECT vec_id, {_ANGLES} FROM poses)"),
    "pose_flip": _p(_XY.format(n=17, x="fx", y="fy", t="flipped"), f", flipped AS (SELECT vec_id, [639 - x[m + 1] FOR m IN {_MIRROR}] AS fx, [y[m + 1] FOR m IN {_MIRROR}] AS fy FROM poses)"),
    "pose_contralateral": _p("""SELECT vec_id, round_even(r, 6) AS c_r, round_even(l, 6) AS c_l, round_even(r / torso, 6) AS t_r, round_even(l / torso, 6) AS t_l
FROM (SELECT vec_id, torso, sqrt((x[11] - x[16]) ** 2 + (y[11] - y[16]) ** 2) AS r, sqrt((x[10] - x[17]) ** 2 + (y[10] - y[17]) ** 2) AS l FROM lengths)""", _T),
    "pose_rotation_dev": _p("""SELECT entity, frame, round_even(rot, 6) AS rot, round_even(rot - c, 6) AS rot_dev FROM (
  SELECT entity, frame, hips / torso AS rot, median(hips / torso) FILTER (frame < 10) OVER (PARTITION BY entity) AS c FROM lengths)""", _T),
    "pose_torso_cv": _p("SELECT entity, round_even(stddev_pop(torso) / avg(torso), 6) AS torso_len_cv FROM lengths GROUP BY entity", _T),
    "pose_geometric": _p("""SELECT vec_id, round_even((kx * ey - ky * ex) / sqrt(kx * kx + ky * ky) / sqrt(ex * ex + ey * ey), 6) AS signal FROM (
  SELECT vec_id, (x[14] + x[15]) / 2 - sx AS kx, (y[14] + y[15]) / 2 - sy AS ky, hx - sx AS ex, hy - sy AS ey FROM lengths)""", _T),
    "pose_features109": _p(_BLOCKS.format(also="109 AS n", s="+"), _T, _N, _MADE),
    "pose_flip_agrees": _p(_BLOCKS.format(also="0.0::DOUBLE AS gap", s="-"), _T, _N, _MADE),
    "clip_triage": _p("""SELECT entity, n_frames, round_even(seen, 6) AS detection_rate, round_even(cv, 6) AS torso_len_cv, round_even(s, 6) AS view_score,
  array_to_string(list_filter([CASE WHEN cv > 0.1 THEN 'camera moves' END, CASE WHEN s >= 0.12 THEN 'not a side view' END], lambda w: w IS NOT NULL), '; ') AS warnings
FROM (SELECT entity, count(*) AS n_frames, stddev_pop(torso) / avg(torso) AS cv, median(hips / torso) AS s,
  avg((len(list_filter(x || y, lambda v: isfinite(v))) > 0)::INT) AS seen FROM lengths GROUP BY entity)""", _T),
    "clip_measures": _p("""SELECT c.entity, 'clip' || c.entity || '.mp4' AS file, n_frames, fps, round_even(n_frames / fps, 1) AS duration_s, round_even(seen, 3) AS detection_rate, round_even(s, 3) AS view_score,
  CASE WHEN s < 0.12 THEN 'side' WHEN s < 0.21 THEN 'oblique45' ELSE 'other' END AS view, round_even(cv, 3) AS torso_len_cv,
  coalesce(n_reps, 0)::BIGINT AS n_reps, round_even(coalesce(exercise / (n_frames / fps), 0), 3) AS exercise_fraction
FROM (SELECT entity, count(*) AS n_frames, CASE WHEN entity % 3 = 0 THEN 30.0::DOUBLE ELSE 0.5::DOUBLE END AS fps, stddev_pop(torso) / avg(torso) AS cv, median(hips / torso) AS s,
    avg((len(list_filter(x || y, lambda v: isfinite(v))) > 0)::INT) AS seen FROM lengths GROUP BY entity) c
LEFT JOIN (
  SELECT entity, sum(n) AS n_reps, sum(length) AS exercise FROM (
    SELECT entity, frame // 24 AS part, count(*) AS n, max(frame / 4) * 2 - min(frame / 4) * 2 + 1.5 AS length FROM poses WHERE frame % 4 = 0 GROUP BY ALL) WHERE n >= 4 GROUP BY entity) e
ON e.entity = c.entity""", _T),
    "silhouette_gap": f"""WITH {MASKS_SQL},
gaps AS (SELECT vec_id, x0, x1, [coalesce(greatest(0, 0.05::DOUBLE * k + 118 - bottom[k + 1]), 0) FOR k IN range(x0, x1)] AS g FROM placed)
SELECT vec_id, x0, x1, round_even(coalesce(list_sum(g), 0) / 6400 + 1e-9, 6) AS area, round_even(coalesce(list_max(g), 0) / 80 + 1e-9, 6) AS peak, len(g)::INT AS width FROM gaps""",
    "silhouette_boundary": """WITH pixels AS (
  SELECT (l_suppkey % 5)::INT AS entity, (l_orderkey % 11)::INT AS frame, l_quantity::INT + (l_quantity::INT % 9 = 4)::INT AS x, l_partkey % 400 AS y FROM lineitem),
tops AS (SELECT entity, frame, x, max(y)::DOUBLE AS y FROM pixels GROUP BY ALL),
grid AS (SELECT entity, frame, unnest(range(52))::INT AS x FROM (SELECT DISTINCT entity, frame FROM pixels))
SELECT g.entity, g.frame, g.x, t.y FROM grid g LEFT JOIN tops t ON t.entity = g.entity AND t.frame = g.frame AND t.x = g.x""",
    "silhouette_perturb": f"""WITH {MASKS_SQL}
SELECT vec_id, k::INT AS x, round_even(CASE WHEN k >= x0 AND k < x1 THEN bottom[k + 1] - vec_id % 5 ELSE bottom[k + 1] END, 6) AS y FROM (SELECT *, unnest(range(64)) AS k FROM placed)""",
    "floor_percentile": f"""WITH {MASKS_SQL}{_FLOOR}
SELECT h.entity, 0.0::DOUBLE AS a, round_even(any_value(b), 6) AS b, round_even(avg((abs(y - b) <= 3)::INT), 6) AS inlier_ratio, count(*) AS n_points
FROM high h JOIN level USING (entity) GROUP BY h.entity""",
    "floor_ransac": f"""WITH {MASKS_SQL}{_FLOOR},
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY x, y) - 1 AS r FROM high),
sizes AS (SELECT entity, count(*) AS n, quantile_cont(y, 0.5) AS middle FROM high GROUP BY entity),
draws AS (
  SELECT entity, t AS trial, ('0x' || substr(md5('0:' || t || ':i'), 1, 12))::BIGINT % n AS i, ('0x' || substr(md5('0:' || t || ':j'), 1, 12))::BIGINT % n AS j
  FROM sizes, range(200) AS d(t)),
lines AS (
  SELECT entity, -1 AS trial, 0.0::DOUBLE AS x0, middle AS y0, 0.0::DOUBLE AS slope FROM sizes
  UNION ALL
  SELECT d.entity, trial, p.x, p.y, (q.y - p.y) / (q.x - p.x)
  FROM draws d JOIN ranked p ON p.entity = d.entity AND p.r = i JOIN ranked q ON q.entity = d.entity AND q.r = j WHERE p.x <> q.x),
agreed AS (
  SELECT l.entity, trial, x0, y0, slope, count(*) FILTER (abs(y - (slope * (x - x0) + y0)) <= 3) AS k
  FROM lines l JOIN high h ON h.entity = l.entity GROUP BY ALL),
best AS (SELECT * FROM agreed QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC, trial) = 1),
fitted AS (
  SELECT b.entity, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM best b JOIN high h ON h.entity = b.entity
  WHERE abs(y - (slope * (x - x0) + y0)) <= 3 GROUP BY b.entity)
SELECT f.entity, round_even(f.a, 6) AS a, round_even(f.b, 4) AS b, round_even(avg((abs(y - (f.a * x + f.b)) <= 3)::INT), 6) AS inlier_ratio, count(*) AS n_points
FROM fitted f JOIN high h ON h.entity = f.entity GROUP BY ALL""",
}
