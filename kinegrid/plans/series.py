"""Operators on ordered series, over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import finite, rounded
from ..operators import filters, segments
from ..operators import series as s
from .tables import SERIES_SQL, load, series, sided

FPS = 30.0


def series_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.first_difference(series(spark, sf_dir), FPS).select("entity", "frame", rounded("velocity").alias("velocity"))


def series_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumns({"x": F.col("value"), "y": F.col("value") * F.col("value") / 100})
    return s.speed(rows, FPS).select("entity", "frame", rounded("speed").alias("speed"))


def series_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fill_gaps(series(spark, sf_dir), 2).select("entity", "frame", rounded("filled").alias("filled"), "valid")


def series_fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fill_all(series(spark, sf_dir)).select("entity", "frame", rounded("filled").alias("filled"))


def series_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.runs(series(spark, sf_dir), F.col("value") > 100).select("entity", "start", "stop")


def series_resample_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.resample_fps(s.fill_all(series(spark, sf_dir)), 24.0, 30.0, "filled").select("entity", "k", rounded("value").alias("value"))


def series_resample_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.resample_length(s.fill_all(series(spark, sf_dir)), 32, "filled").select("entity", "k", rounded("value").alias("value"))


def series_calib_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.calibration_deviation(series(spark, sf_dir)).select("entity", "frame", rounded("calibration").alias("calibration"), rounded("deviation").alias("deviation"))


def series_first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.first_crossing(series(spark, sf_dir), 1.0).select("entity", rounded("threshold").alias("threshold"), "crossing")


def series_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("late", F.coalesce(F.lag("value", 3).over(s.by_frame()), F.lit(0.0)))
    return s.lead_time(rows, FPS, 1.0, "value", "late").select("entity", rounded("lead_s").alias("lead_s"))


def series_summary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.summary_features(series(spark, sf_dir))
    return out.select("entity", *(rounded(c).alias(c) for c in ("mean", "std", "low", "high", "span", "mean_abs_step", "std_step")))


def series_prominence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.prominence_threshold(series(spark, sf_dir)).select("entity", rounded("prominence").alias("prominence"))


def series_walk_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.walk_to_minima(s.fill_all(series(spark, sf_dir)), "filled").select("entity", "frame", "start", "end")


def series_rolling_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("t", F.floor(F.col("us") / 1_000_000))
    return s.rolling_range(rows, 6 * 3600, "t").select("entity", "frame", rounded("range").alias("range_value"))


def _smoothed(spark: SparkSession, sf_dir: str, zero_phase: bool) -> DataFrame:
    return filters.smooth_series(series(spark, sf_dir), FPS, zero_phase).select("entity", "frame", F.bround(finite("smooth"), 5).alias("smooth"))


def series_one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, False)


def series_one_euro_zero_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, True)


def reps_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.find_reps(sided(spark, sf_dir), FPS / 10).select("entity", "side", "start", "peak", "end", rounded("excursion").alias("excursion"))


def event_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repetitions: begun at ts, for value seconds, with the peak at a third."""
    e = load(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    length = F.greatest(F.lit(3), F.floor("value").cast("long"))
    return e.select(
        F.col("user_id").alias("entity"),
        "event_id",
        F.when(F.col("event_type").isin("click", "purchase"), "R").otherwise("L").alias("side"),
        start.alias("start"),
        (start + F.floor(length / 3)).alias("peak"),
        (start + length).alias("end"),
    )


def reps_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = event_reps(spark, sf_dir).dropDuplicates(["entity", "side", "start"])
    timed = segments.with_timing(reps.drop("event_id", "peak", "end").withColumns({"peak": F.col("start") + 40, "end": F.col("start") + 4000}), FPS)
    return timed.select("entity", "side", "start", *(rounded(c).alias(c) for c in ("duration_s", "t_extend_s", "t_return_s", "overlap_s")), "overlaps_next")


def reps_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = event_reps(spark, sf_dir).select("entity", "side", "start").distinct()
    return segments.with_alternation(reps).select("entity", "side", "start", "rep_index", "alternation_broken")


def reps_alternation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = event_reps(spark, sf_dir).select("entity", "side", "start").distinct()
    flagged = segments.with_alternation(reps).withColumn("overlaps_next", F.lit(False))
    return segments.alternation_summary(flagged)


def reps_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = event_reps(spark, sf_dir).withColumn("t_extend_s", (F.col("peak") - F.col("start")) / 10.0)
    return segments.plausible(reps).select("event_id", rounded("t_extend_s").alias("t_extend_s"))


HOURS = 6 * 3600.0


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = event_reps(spark, sf_dir).withColumns({"start_s": F.col("start").cast("double"), "end_s": F.col("end").cast("double")})
    return timed.withColumn("clip_s", F.lit(4e9))


def segments_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sessions(_sessions(spark, sf_dir), HOURS, tie="event_id").select("entity", "event_id", F.col("segment").cast("long").alias("segment"))


def segments_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _sessions(spark, sf_dir).dropDuplicates(["entity", "start"]).withColumn("end_s", F.col("start_s") + 10)
    # of two at once either may stay: only what both agree on is shown
    found = segments.find_segments(unique, F.col("clip_s"), HOURS)
    return found.select("entity", F.col("segment").cast("long").alias("segment"), "start_s", "end_s", "n_reps")


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _sessions(spark, sf_dir).dropDuplicates(["entity", "start"]).withColumn("end_s", F.col("start_s") + 10)
    clips = load(spark, sf_dir, "events").select(F.col("user_id").alias("entity")).distinct().withColumn("clip_s", F.lit(2_592_000.0))
    out = segments.activity_summary(segments.find_segments(unique, F.col("clip_s") * 1e4, HOURS), clips)
    return out.select("entity", F.col("n_segments").cast("long").alias("n_segments"), F.col("total_reps").cast("long").alias("total_reps"), "exercise_s", "exercise_fraction")


def _w(tail: str, more: str = "") -> str:
    return f"WITH RECURSIVE {SERIES_SQL}{more}\n{tail}"


_NEAR = """, near AS (
  SELECT *, max(CASE WHEN value IS NOT NULL THEN frame END) OVER back AS f0, min(CASE WHEN value IS NOT NULL THEN frame END) OVER ahead AS f1
  FROM series WINDOW back AS (PARTITION BY entity ORDER BY frame ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT n.entity, n.frame, n.value, n.f0, n.f1, a.value AS v0, b.value AS v1,
    CASE WHEN n.f0 = n.f1 THEN a.value ELSE a.value + (b.value - a.value) * ((n.frame - n.f0)::DOUBLE / (n.f1 - n.f0)) END AS lerp
  FROM near n LEFT JOIN series a ON a.entity = n.entity AND a.frame = n.f0 LEFT JOIN series b ON b.entity = n.entity AND b.frame = n.f1),
whole AS (SELECT entity, frame, coalesce(lerp, v0, v1) AS filled FROM filled)"""
_SAMPLED = """, lists AS (SELECT entity, list(filled ORDER BY frame) AS x, count(*) AS n FROM whole GROUP BY entity),
points AS ({points}),
placed AS (SELECT *, least(greatest(position, 0), n - 1) AS p FROM points)
SELECT entity, k, round_even(CASE WHEN p = floor(p) THEN x[floor(p)::BIGINT + 1]
  ELSE x[floor(p)::BIGINT + 1] + (x[least(floor(p)::BIGINT + 1, n - 1) + 1] - x[floor(p)::BIGINT + 1]) * (p - floor(p)) END, 6) AS value FROM placed"""
_CROSS = """, marked AS (
  SELECT *, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER (PARTITION BY entity ORDER BY frame) AS i FROM {source}),
limits AS (SELECT entity, avg({v}) + stddev_pop({v}) AS threshold FROM marked WHERE i <= greatest(3, n // 5) GROUP BY entity),
crossed AS (SELECT m.entity, any_value(l.threshold) AS threshold, min(CASE WHEN m.{v} > l.threshold AND m.n >= 10 THEN m.frame END) AS crossing
  FROM marked m JOIN limits l USING (entity) GROUP BY m.entity)"""


def _euro(source: str, name: str) -> str:
    """One Euro over (entity, frame, value) of ``source``, row by row."""
    return f"""{name}_n AS (SELECT entity, frame, value, row_number() OVER (PARTITION BY entity ORDER BY frame) AS i FROM {source}),
{name}_r AS (
  SELECT entity, i, frame, value AS x, CASE WHEN value IS NOT NULL THEN 0.0::DOUBLE END AS dx FROM {name}_n WHERE i = 1
  UNION ALL
  SELECT entity, i, frame,
    CASE WHEN value IS NULL THEN NULL WHEN px IS NULL THEN value ELSE w * value + (1 - w) * px END,
    CASE WHEN value IS NULL THEN NULL WHEN px IS NULL THEN 0.0 ELSE d END
  FROM (
    SELECT *, 1 / (1 + 1 / (2 * pi() * (1.0::DOUBLE + 0.007::DOUBLE * abs(d))) / (1.0::DOUBLE / 30)) AS w
    FROM (
      SELECT n.entity, n.i, n.frame, n.value, r.x AS px,
        (1 / (1 + 1 / (2 * pi()) / (1.0::DOUBLE / 30))) * (n.value - r.x) / (1.0::DOUBLE / 30) + (1 - 1 / (1 + 1 / (2 * pi()) / (1.0::DOUBLE / 30))) * r.dx AS d
      FROM {name}_r r JOIN {name}_n n ON n.entity = r.entity AND n.i = r.i + 1))),
{name} AS (SELECT entity, frame, x AS value FROM {name}_r)"""


_REPS = """, reps AS (
  SELECT user_id AS entity, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'R' ELSE 'L' END AS side,
    epoch(ts)::DOUBLE AS s, floor(epoch(ts))::BIGINT AS start, greatest(3, floor(value)::BIGINT) AS length FROM events),
sides AS (SELECT DISTINCT entity, side, start FROM reps),
turns AS (SELECT *, row_number() OVER w AS rep_index, coalesce(side = lag(side) OVER w, FALSE) AS alternation_broken FROM sides WINDOW w AS (PARTITION BY entity ORDER BY start, side DESC)),
starts AS (SELECT DISTINCT entity, start, start::DOUBLE AS start_s, start::DOUBLE + 10 AS end_s FROM reps),
cut AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY entity ORDER BY start_s) > 21600 THEN 1 ELSE 0 END AS fresh FROM starts),
placed AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY start_s ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM cut),
found AS (SELECT entity, segment, greatest(0, min(start_s) - 1.5) AS start_s, max(end_s) + 1.5 AS end_s, count(*) AS n_reps FROM placed GROUP BY 1, 2 HAVING count(*) >= 3)"""

QUERIES = {
    f.__name__: f
    for f in (
        series_diff, series_speed, series_gapfill, series_fill_all, series_runs, series_resample_fps, series_resample_length,
        series_calib_deviation, series_first_crossing, series_lead_time, series_summary_features, series_prominence_threshold,
        series_walk_minima, series_rolling_range, series_one_euro, series_one_euro_zero_phase, reps_find, reps_timing,
        reps_alternation, reps_alternation_summary, reps_plausible, segments_sessionize, segments_find, activity_summary,
    )
}
ORACLES = {
    "series_diff": _w("SELECT entity, frame, round_even(CASE WHEN frame = 0 THEN 0.0::DOUBLE ELSE (value - lag(value) OVER (PARTITION BY entity ORDER BY frame)) * 30 END, 6) AS velocity FROM series"),
    "series_speed": _w("""SELECT entity, frame, round_even(sqrt(dx * dx + dy * dy) * 30, 6) AS speed FROM (
  SELECT entity, frame, value - lag(value) OVER w AS dx, value * value / 100 - lag(value * value / 100) OVER w AS dy FROM series WINDOW w AS (PARTITION BY entity ORDER BY frame)) WHERE frame > 0"""),
    "series_gapfill": _w("""SELECT entity, frame, round_even(v, 6) AS filled, v IS NOT NULL AS valid FROM (
  SELECT entity, frame, CASE WHEN value IS NOT NULL THEN value WHEN f1 - f0 - 1 <= 2 THEN lerp END AS v FROM filled)""", _NEAR),
    "series_fill_all": _w("SELECT entity, frame, round_even(filled, 6) AS filled FROM whole", _NEAR),
    "series_runs": _w("""SELECT entity, min(frame) AS start, max(frame) + 1 AS stop FROM (
  SELECT entity, frame, frame - row_number() OVER (PARTITION BY entity ORDER BY frame) AS k FROM series WHERE value > 100) GROUP BY entity, k"""),
    "series_resample_fps": _w(_SAMPLED.format(points="SELECT entity, x, n, k, k / 30.0::DOUBLE * 24.0::DOUBLE AS position FROM (SELECT *, unnest(range(CASE WHEN n < 2 THEN n ELSE (floor((n - 1) / 24.0::DOUBLE * 30.0::DOUBLE) + 1)::BIGINT END)) AS k FROM lists)"), _NEAR),
    "series_resample_length": _w(_SAMPLED.format(points="SELECT entity, x, n, k, k * ((n - 1) / 31.0::DOUBLE) AS position FROM (SELECT *, unnest(range(32)) AS k FROM lists)"), _NEAR),
    "series_calib_deviation": _w("""SELECT entity, frame, round_even(c, 6) AS calibration, round_even(value - c, 6) AS deviation FROM (
  SELECT *, median(value) FILTER (frame < 30) OVER (PARTITION BY entity) AS c FROM series)"""),
    "series_first_crossing": _w("SELECT entity, round_even(threshold, 6) AS threshold, crossing FROM crossed", _CROSS.format(source="series", v="value")),
    "series_lead_time": _w("""SELECT a.entity, round_even((b.crossing - a.crossing) / 30.0::DOUBLE, 6) AS lead_s FROM crossed a JOIN (
  WITH late AS (SELECT entity, frame, coalesce(lag(value, 3) OVER (PARTITION BY entity ORDER BY frame), 0.0) AS late FROM series)"""
        + _CROSS.format(source="late", v="late") + " SELECT * FROM crossed) b USING (entity)", _CROSS.format(source="series", v="value")),
    "series_summary_features": _w("""SELECT entity, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS std, round_even(min(value), 6) AS low, round_even(max(value), 6) AS high,
  round_even(max(value) - min(value), 6) AS span, round_even(avg(abs(d)), 6) AS mean_abs_step, round_even(stddev_pop(d), 6) AS std_step
FROM (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY frame) AS d FROM series) GROUP BY entity"""),
    "series_prominence_threshold": _w("""SELECT entity, round_even(CASE WHEN count(value) < 2 THEN 0.02
  ELSE greatest(0.02::DOUBLE, 0.25::DOUBLE * (quantile_cont(value, 0.95) - quantile_cont(value, 0.05))) END, 6) AS prominence FROM series GROUP BY entity"""),
    "series_walk_minima": _w(""", steps AS (
  SELECT *, lag(filled) OVER w AS b, lead(filled) OVER w AS a FROM whole WINDOW w AS (PARTITION BY entity ORDER BY frame))
SELECT entity, frame,
  coalesce(max(CASE WHEN b > filled THEN frame END) OVER (PARTITION BY entity ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS start,
  coalesce(min(CASE WHEN a > filled THEN frame END) OVER (PARTITION BY entity ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(frame) OVER (PARTITION BY entity)) AS "end"
FROM steps""", _NEAR),
    "series_rolling_range": _w(""", timed AS (SELECT *, us // 1000000 AS t FROM series),
gathered AS (SELECT entity, frame, list_sort(list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)) AS w FROM timed)
SELECT entity, frame, round_even(CASE WHEN coalesce(len(w), 0) < 8 THEN 0.0::DOUBLE ELSE w[floor((len(w) - 1) * 0.95::DOUBLE)::INT + 1] - w[floor((len(w) - 1) * 0.05::DOUBLE)::INT + 1] END, 6) AS range_value FROM gathered"""),
    "series_one_euro": _w("SELECT entity, frame, round_even(value, 5) AS smooth FROM f", ", " + _euro("series", "f")),
    "series_one_euro_zero_phase": _w("SELECT entity, -frame AS frame, round_even(value, 5) AS smooth FROM g", ", " + _euro("series", "f") + ", turned AS (SELECT entity, -frame AS frame, value FROM f), " + _euro("turned", "g")),
    "reps_timing": _w("""SELECT entity, side, start, round_even(4000 / 30.0::DOUBLE, 6) AS duration_s, round_even(40 / 30.0::DOUBLE, 6) AS t_extend_s, round_even(3960 / 30.0::DOUBLE, 6) AS t_return_s,
  round_even(gap / 30.0::DOUBLE, 6) AS overlap_s, coalesce(gap < 0, FALSE) AS overlaps_next
FROM (SELECT *, lead(start) OVER (PARTITION BY entity ORDER BY start, side DESC) - (start + 4000) AS gap FROM sides)""", _REPS),
    "reps_alternation": _w("SELECT entity, side, start, rep_index, alternation_broken FROM turns", _REPS),
    "reps_alternation_summary": _w("""SELECT entity, count(*) AS n, count(*) FILTER (side = 'R') AS n_right, count(*) FILTER (side = 'L') AS n_left,
  bool_and(NOT alternation_broken) AS intact, 0::BIGINT AS n_overlapping FROM turns GROUP BY entity""", _REPS),
    "reps_plausible": _w("SELECT event_id, round_even((length // 3) / 10.0::DOUBLE, 6) AS t_extend_s FROM reps WHERE (length // 3) / 10.0::DOUBLE BETWEEN 0.4 AND 6.0", _REPS),
    "segments_sessionize": _w("""SELECT entity, event_id, sum(fresh) OVER (PARTITION BY entity ORDER BY start, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (
  SELECT *, CASE WHEN start - lag(start + length) OVER (PARTITION BY entity ORDER BY start, event_id) > 21600 THEN 1 ELSE 0 END AS fresh FROM reps)""", _REPS),
    "segments_find": _w("SELECT entity, segment, start_s, end_s, n_reps FROM found", _REPS),
    "activity_summary": _w("""SELECT e.entity, coalesce(count(f.entity), 0) AS n_segments, coalesce(sum(f.n_reps), 0)::BIGINT AS total_reps,
  round_even(coalesce(sum(f.end_s - f.start_s), 0.0), 1) AS exercise_s, round_even(coalesce(sum(f.end_s - f.start_s), 0.0) / 2592000, 3) AS exercise_fraction
FROM (SELECT DISTINCT entity FROM reps) e LEFT JOIN found f ON f.entity = e.entity GROUP BY e.entity""", _REPS),
}
