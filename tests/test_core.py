"""Operators against closed forms, generated truth and plain Python."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinegrid.functions import pose, silhouette, stats
from kinegrid.operators import bands, build, clips, dedup, evaluate, filters, grid, models, qc, segments, series, validate
from kinegrid.sources import frames as fr
from kinegrid.sources import manifest as mf
from kinegrid.functions import ranks
from kinegrid.sources import archives
from kinegrid.streaming import buffered, progress, speech
from kinegrid.streaming import queries as sq
from kinegrid.streaming.counter import CounterRules, CounterState, advance
from kinegrid.streaming.engine import Engine, EngineRules, fitted_floor
from kinegrid.streaming.machines import Judging
from kinegrid.streaming.session import SessionRules


def rows_of(spark, values, entity="a"):
    return spark.createDataFrame([(entity, k, v) for k, v in enumerate(values)], "entity string, frame long, value double")


def column(df, name, order="frame"):
    return [r[name] for r in df.orderBy(order).collect()]


def bump(reps: int, per: int, height: float = 1.0) -> np.ndarray:
    t = np.arange(per) / per
    return np.tile(height * 0.5 * (1 - np.cos(2 * np.pi * t)), reps)


# --- statistics and missing values -------------------------------------------


def test_wilson_known_values(spark):
    lo, hi = stats.wilson("k", "n")
    got = spark.createDataFrame([(0, 48), (0, 0), (7, 9)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert [tuple(r) for r in got] == [pytest.approx(w, abs=1e-4) for w in ((0.0, 0.0741), (0.0, 1.0), (0.4526, 0.9368))]


def test_finite_and_rounding(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.5,), (-0.0000001,), (None,)], "x double")
    assert [r[0] for r in df.select(stats.finite("x")).collect()] == [None, None, 2.5, -1e-07, None]
    assert [r[0] for r in df.select(stats.rounded("x", 0)).collect()] == [None, None, 2.0, 0.0, None]


# --- bands --------------------------------------------------------------------


def reps_frame(spark, rows):
    return spark.createDataFrame(rows, "rep_id int, person string, excursion double, signal double, condition string, view string")


def test_bin_edges_follow_searchsorted(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(2000):
        low = rng.choice([0.1, 0.3, 1.0])
        high = low + rng.choice([0.7, 1.1, 3.3, 0.0])
        n = rng.choice([3, 20])
        edges = np.linspace(low, high, n + 1)
        value = float(rng.choice([*edges, rng.uniform(low - 0.2, high + 0.2)]))
        exact = [high if i == n else low + i * ((high - low) / n) for i in range(n + 1)]
        want = int(np.clip(np.searchsorted(exact, value, "right") - 1, 0, n - 1))
        cases.append((value, low, high, n, want))
    for n in (3, 20):
        df = spark.createDataFrame([c for c in cases if c[3] == n], "v double, low double, high double, n int, want int")
        assert df.filter(bands.bin_of(F.col("v"), F.col("low"), F.col("high"), n) != F.col("want")).count() == 0


def test_loso_leaves_each_person_out_and_abstains(spark):
    rng = random.Random(2)
    rows = [(k, f"p{k % 4}", rng.uniform(0.3, 1.6), 0.002 + rng.gauss(0, 1e-4), "correct", "side") for k in range(120)]
    reps = reps_frame(spark, rows)
    band = bands.fit_loso(reps)
    assert sorted(r[0] for r in band.select("held_out").distinct().collect()) == ["p0", "p1", "p2", "p3"]
    counts = {r.held_out: r.n for r in band.groupBy("held_out").agg(F.sum("count").alias("n")).collect()}
    assert counts == {f"p{k}": 90 for k in range(4)}
    huge = reps_frame(spark, [(k, "p0", 0.3 + k * 0.065, 1e6, "correct", "side") for k in range(20)])
    for r in bands.score(huge, band, F.col("person")).collect():
        assert (r.exceeds is None) == (r.reason != "")
        assert r.support >= 2 or r.exceeds is None


def test_bands_of_few_rows(spark):
    one = reps_frame(spark, [(1, "p", 1.0, 0.1, "c", "v")])
    assert bands.fit_pooled(one).collect() == [] and bands.fit_loso(one).collect() == []
    two = reps_frame(spark, [(1, "p", 1.0, 0.1, "c", "v"), (2, "q", 1.0, 0.1, "c", "v"), (3, "q", None, 0.1, "c", "v"), (4, "q", 1.0, float("nan"), "c", "v")])
    pooled = bands.fit_pooled(two)
    assert [(r.bin, r["count"], r.std) for r in pooled.collect()] == [(19, 2, 0.0)]
    verdict = bands.score(two.limit(1), pooled, F.lit(bands.POOLED)).first()
    assert verdict.reason == "bin has no spread" and verdict.exceeds is None


def test_gate_compares_intervals(spark):
    rates = spark.createDataFrame([("bad", 0.5, 0.9), ("good", 0.0, 0.4)], "condition string, ci_low double, ci_high double")
    assert bands.separated(rates, "bad", "good").first().passed
    assert not bands.separated(rates, "good", "bad").first().passed
    assert not bands.separated(rates.limit(0), "good", "bad").first().passed


# --- evaluation ---------------------------------------------------------------


def test_metrics_count_unseen_predictions(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b"), ("b", "b")], "y_true string, y_pred string")
    m = evaluate.metrics(p).first()
    assert m.macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert m.macro_f1_present == pytest.approx((2 / 3 + 1) / 2)
    assert m.balanced_accuracy == pytest.approx(0.75) and m.accuracy == pytest.approx(0.75)
    assert evaluate.confusion_matrix(p, extra_labels=("z",)).count() == 16


def test_ranks_share_ties_and_wins(spark):
    s = spark.createDataFrame([("d", "m1", 0.9), ("d", "m2", 0.9), ("d", "m3", 0.1), ("e", "m1", 0.5), ("f", "m1", 0.5), ("f", "m3", float("nan"))], "dataset string, model string, score double")
    got = {r.model: r for r in evaluate.rank_table(s).collect()}
    assert (got["m1"].mean_rank, got["m2"].mean_rank, got["m3"].mean_rank) == (1.5, 1.5, 3.0)
    assert (got["m1"].wins, got["m2"].wins, got["m3"].wins) == (1, 1, 0)
    assert got["m1"].n_datasets == 3


def test_folds_and_leaks(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(9)], "id int, g string")
    folds = evaluate.loso_folds(rows, "g")
    assert folds.filter("split = 'test'").count() == 9 and folds.count() == 27
    with pytest.raises(ValueError, match="both sides"):
        evaluate.assert_no_group_leak(rows.filter("id < 5"), rows.filter("id > 6"), "g")
    evaluate.assert_no_group_leak(rows.filter("g = 'a'"), rows.filter("g = 'b'"), "g")
    hashed = evaluate.hashed_folds(spark.range(1000), "id", 5)
    assert hashed.groupBy("fold").count().count() == 5


# --- series -------------------------------------------------------------------


def test_gaps_up_to_the_limit_are_filled(spark):
    x = [None, 0.0, None, None, None, None, None, 6.0, None, None, None, None, None, None, 13.0, None]
    out = series.fill_gaps(rows_of(spark, x), 5)
    assert column(out, "filled") == [None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, *[None] * 6, 13.0, None]
    assert column(series.fill_all(rows_of(spark, x)), "filled") == [0.0, *[float(k) for k in range(14)], 13.0][:1] + [float(k) for k in range(14)] + [13.0]


@pytest.mark.parametrize("fps", [23.976, 25.0, 29.97, 30.0])
def test_resampling_keeps_duration_and_ramps(spark, fps):
    n = 100
    out = series.resample_fps(rows_of(spark, [k / fps for k in range(n)]), fps, 30.0)
    values = column(out, "value", "k")
    assert abs((len(values) - 1) / 30 - (n - 1) / fps) <= 1 / 30
    assert np.allclose(values, np.arange(len(values)) / 30, atol=1e-9)


def test_resampling_to_a_length(spark):
    assert column(series.resample_length(rows_of(spark, [0.0, 1.0, 2.0]), 5), "value", "k") == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert column(series.resample_length(rows_of(spark, [3.0]), 4), "value", "k") == [3.0] * 4


def test_one_euro_filters(spark):
    assert np.allclose(filters.one_euro(np.full(50, 7.5), 30), 7.5)
    step = filters.one_euro(np.r_[np.zeros(10), np.ones(120)], 30)
    assert (np.diff(step[10:]) >= -1e-12).all() and step.max() <= 1 and step[-1] > 0.99
    noise = np.random.default_rng(0).normal(0, 1, 400)
    assert filters.one_euro(noise, 30, beta=0.0).std() < noise.std() / 2
    peak = np.exp(-((np.arange(120) - 60) ** 2) / 200)
    assert abs(int(np.argmax(filters.one_euro(peak, 30, zero_phase=True))) - 60) <= 3
    gap = filters.one_euro(np.array([1.0, np.nan, 5.0]), 30)
    assert gap[0] == 1 and np.isnan(gap[1]) and gap[2] == 5
    out = filters.smooth_series(rows_of(spark, [1.0, None, 5.0]), 30.0)
    assert column(out, "smooth") == [1.0, None, 5.0]


@pytest.mark.parametrize("n", [4, 6, 10])
def test_reps_are_counted(spark, n):
    x = bump(n, 60)
    rows = rows_of(spark, [float(v) for v in x]).withColumn("side", F.lit("R"))
    got = segments.find_reps(rows, 30.0).orderBy("start").collect()
    assert len(got) == n
    assert all(abs(r.peak - (30 + 60 * k)) <= 3 for k, r in enumerate(got))


def test_reps_of_flat_missing_and_crowded_series():
    assert list(segments.reps_of(np.ones(100), 30)) == []
    assert list(segments.reps_of(np.full(50, np.nan), 30)) == []
    assert list(segments.reps_of(np.array([1.0]), 30)) == []
    close = np.zeros(90)
    close[30:36] = close[36:42] = np.hanning(6)
    assert len(list(segments.reps_of(close, 30))) <= 1


def brute_prominence(x, p):
    def side(step):
        low, k = x[p], p + step
        while 0 <= k < len(x) and x[k] <= x[p]:
            low = min(low, x[k])
            k += step
        return low

    return x[p] - max(side(-1), side(1))


def test_peaks_and_prominences_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x = rng.integers(0, 6, 60).astype(float)
        peaks = segments.local_maxima(x)
        assert all(x[p] >= x[p - 1] and x[p] >= x[p + 1] for p in peaks)
        assert np.allclose(segments.prominences(x, peaks), [brute_prominence(x, p) for p in peaks])
        apart = segments.far_apart(peaks, x[peaks], 5)
        assert (np.diff(apart) >= 5).all()
    assert segments.local_maxima(np.array([0, 1, 1, 1, 0.0])).tolist() == [2]


def test_timing_alternation_and_dwell(spark):
    reps = spark.createDataFrame([("a", "R", 0, 30, 40), ("a", "L", 30, 45, 60), ("a", "L", 75, 80, 90)], "entity string, side string, start long, peak long, end long")
    timed = {r.start: r for r in segments.with_flags(segments.with_alternation(segments.with_timing(reps, 30.0))).collect()}
    assert timed[0].overlap_s == pytest.approx(-10 / 30) and timed[0].flags == ["overlaps_next"]
    assert timed[30].overlap_s == pytest.approx(0.5) and timed[30].flags == []
    assert timed[75].overlap_s is None and timed[75].flags == ["alternation_broken"]
    rows = spark.createDataFrame([("a", "R", k, 1.0 if 10 <= k < 20 else 0.5) for k in range(41)], "entity string, side string, frame long, value double")
    assert segments.with_dwell(reps.limit(1), rows, 30.0).first().dwell_s == pytest.approx(10 / 30)


def test_sessions_split_on_a_strictly_larger_gap(spark):
    e = spark.createDataFrame([("a", "R", 0.0, 1.0), ("a", "L", 13.0, 14.0), ("a", "R", 26.1, 27.0)], "entity string, side string, start_s double, end_s double")
    assert [r.segment for r in segments.sessions(e).orderBy("start_s").collect()] == [0, 0, 1]
    found = segments.find_segments(e, F.lit(27.5), gap_s=20).first()
    assert (found.start_s, found.end_s, found.n_reps, found.sides) == (0.0, 27.5, 3, "RLR")
    tempo = spark.createDataFrame([(0.4,), (6.0,), (0.39,), (6.01,)], "t_extend_s double")
    assert segments.plausible(tempo).count() == 2


def test_static_frames(spark):
    at = lambda x: [{"x": x, "y": 0.0}]
    df = spark.createDataFrame([("a", k, at(x)) for k, x in enumerate([0.0, 0.001, 0.5, None])], "entity string, frame long, joints array<struct<x:double,y:double>>")
    assert column(series.static_frames(df), "static") == [True, True, False, False]


# --- landmarks and silhouettes -------------------------------------------------

LM = "entity string, frame long, lm array<struct<x:double,y:double,z:double,v:double>>"


def base_pose() -> np.ndarray:
    """Hip centre (400, 300), torso of 100 along +x, hips 10 apart."""
    rng = np.random.default_rng(1)
    lm = np.c_[rng.uniform(300, 600, 33), rng.uniform(200, 400, 33), np.zeros(33), np.ones(33)]
    for k, (x, y) in {11: (500, 295), 12: (500, 305), 23: (400, 295), 24: (400, 305), 15: (520, 200), 16: (520, 210), 27: (250, 330), 28: (250, 320)}.items():
        lm[k, :2] = x, y
    return lm


def pose_frame(spark, poses):
    return spark.createDataFrame([("a", k, [tuple(None if math.isnan(v) else float(v) for v in p) for p in lm]) for k, lm in enumerate(poses)], LM)


def xy(df) -> np.ndarray:
    return np.array([[(p.x, p.y) for p in r.lm] for r in df.orderBy("frame").collect()], float)


def turned(lm: np.ndarray, degrees: float) -> np.ndarray:
    a, out = math.radians(degrees), lm.copy()
    out[:, :2] = lm[:, :2] @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    return out


def test_normalisation_is_invariant(spark):
    lm = base_pose()
    base = xy(clips.normalize(pose_frame(spark, [lm] * 3)))
    moved, scaled = lm.copy(), lm.copy()
    moved[:, :2] += (120, -80)
    scaled[:, :2] *= 1.7
    for other in (moved, scaled, turned(lm, 37)):
        assert np.allclose(xy(clips.normalize(pose_frame(spark, [other] * 3))), base, atol=1e-6)
    assert np.allclose((base[0, 23] + base[0, 24]) / 2, 0) and np.allclose((base[0, 11] + base[0, 12]) / 2, (1, 0))


def test_normalisation_uses_the_median_and_keeps_gaps(spark):
    lm, missing, long = base_pose(), np.full((33, 4), np.nan), base_pose()
    long[[11, 12], 0] += 900
    df = pose_frame(spark, [lm] * 7 + [long] * 3 + [missing])
    assert clips.torso_reference(df).first().torso == pytest.approx(100)
    out = xy(clips.normalize(df))
    assert np.isnan(out[-1]).all() and np.allclose(out[0], xy(clips.normalize(pose_frame(spark, [lm])))[0])
    flat = base_pose()
    flat[[11, 12], :2] = flat[[23, 24], :2]
    with pytest.raises(Exception, match="degenerate"):
        clips.torso_reference(pose_frame(spark, [flat])).collect()


def test_view_scores_and_classes(spark):
    got = clips.view_scores(pose_frame(spark, [base_pose()])).first()
    assert got.view_score == pytest.approx(0.10) and got.view == "side"
    classes = spark.createDataFrame([(0.12,), (0.21,), (None,)], "s double").select(pose.classify_view(F.col("s")))
    assert [r[0] for r in classes.collect()] == ["oblique45", "other", "other"]


def test_flips_are_involutions_and_agree(spark):
    lm = base_pose()
    df = pose_frame(spark, [lm, turned(lm, 10), turned(lm, 15)])
    twice = df.withColumn("lm", pose.flip_horizontal(pose.flip_horizontal(F.col("lm"), 640), 640))
    assert np.allclose(xy(twice), xy(df))
    small = df.withColumn("lm", pose.to_coco17(F.col("lm")))
    one = clips.features(clips.normalize(small.withColumn("lm", pose.flip_horizontal(F.col("lm"), 640, pose.L17)), pose.L17), 30.0)
    two = clips.features(clips.normalize(small, pose.L17), 30.0).withColumn("features", pose.flip_features(F.col("features")))
    a, b = (np.array(column(d, "features")) for d in (one, two))
    assert a.shape == (3, 109) and np.allclose(a, b, atol=1e-9)
    assert len(pose.channel_names()) == 109 and len(set(pose.channel_names())) == 109
    with pytest.raises(IndexError):
        pose.L17.mirror(17)


def test_angles_by_hand(spark):
    lm = np.zeros((17, 4))
    lm[5, :2], lm[7, :2], lm[9, :2] = (0, 0), (1, 0), (2, 0)
    lm[11, :2], lm[13, :2], lm[15, :2] = (0, 0), (1, 0), (1, 1)
    angles = pose_frame(spark, [lm]).select(pose.joint_angles(F.col("lm"))).first()[0]
    assert angles[1] == pytest.approx(math.pi) and angles[7] == pytest.approx(math.pi / 2)


def test_contralateral_per_torso(spark):
    lm = base_pose()
    lm[16, :2], lm[27, :2] = (500, 300), (300, 300)
    both = pose_frame(spark, [lm]).select(pose.contralateral(F.col("lm"), per_torso=True).alias("c")).first().c
    assert both.R == pytest.approx(2.0)
    lm[[11, 12], :2] = lm[[23, 24], :2]
    assert pose_frame(spark, [lm]).select(pose.contralateral(F.col("lm"), per_torso=True).alias("c")).first().c.R is None


def test_silhouette_window_and_slope(spark):
    one = spark.createDataFrame([(400.0, 1.0), (400.0, -1.0)], "x double, u double")
    w = one.select(silhouette.window(F.col("x"), F.col("u"), F.lit(100.0), silhouette.LUMBAR, F.lit(640)).alias("w")).collect()
    assert [(r.w.x0, r.w.x1) for r in w] == [(400, 435), (365, 400)]
    deltas = [0, 2, 4, 8, 16]
    df = spark.createDataFrame([(d, [300.0] * 640) for d in deltas], "d int, bottom array<double>")
    place = silhouette.window(F.lit(400.0), F.lit(1.0), F.lit(100.0), silhouette.LUMBAR, F.lit(640))
    signal = silhouette.band_signal(silhouette.lifted(F.col("bottom"), place, F.col("d")), F.lit(0.0), F.lit(300.0), place, F.lit(100.0))
    area = [r[0] for r in df.select(signal["area"]).collect()]
    assert area[0] == 0 and np.allclose(np.polyfit(deltas, area, 1)[0], 35 / 100**2, rtol=0.05)
    none = df.limit(1).select(silhouette.band_signal(F.col("bottom"), F.lit(0.0), F.lit(300.0), place, F.lit(0.0))["area"]).first()[0]
    assert none is None


def test_bands_without_one_person_equal_brute_force(spark, monkeypatch):
    """Ties, persons with one row, one with most rows, one with both extremes; more persons than any list would take."""
    monkeypatch.setattr(bands, "STRETCH", 4)
    rng = np.random.default_rng(4)
    rows = [(f"p{k % 40 if k % 3 else 7}", float(np.round(rng.uniform(1, 9), 1)), float(np.round(rng.normal(5, 2), 1))) for k in range(500)]
    rows += [("lone", 4.0, 1e3), ("wide", 0.5, 3.0), ("wide", 30.0, 3.5), (None, 5.0, 5.0), ("nan", float("nan"), 1.0)]
    reps = spark.createDataFrame(rows, "person string, excursion double, signal double").repartition(3)
    usable = [r for r in rows if r[0] is not None and r[1] == r[1]]
    for bins in (3, 20):
        want = {}
        for person in {r[0] for r in usable}:
            e, s = np.array([r[1:] for r in usable if r[0] != person]).T
            edges = np.linspace(e.min(), e.max(), bins + 1)
            place = np.clip(np.searchsorted(edges, e, "right") - 1, 0, bins - 1)
            for b in np.unique(place):
                v = s[place == b]
                want[person, int(b)] = (e.min(), e.max(), v.mean(), v.std(ddof=1) if len(v) > 1 else -1, *np.percentile(v, [5, 95]), len(v))
        got = {(r.held_out, r.bin): (r.low, r.high, r.mean, -1 if r.std is None else r.std, r.p05, r.p95, r["count"]) for r in bands.fit_loso(reps, bins).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=1e-9), k
    e, s = np.array([r[1:] for r in rows if r[1] == r[1]]).T
    pooled = {r.bin: (r.mean, r.p05, r["count"]) for r in bands.fit_pooled(reps, 1).collect()}
    assert pooled[0] == pytest.approx((s.mean(), np.percentile(s, 5), len(s)))


def test_spreads_far_from_zero_and_without_a_far_person(spark):
    """Bins at unlike heights, and one person far above all others: no digits are lost."""
    rng = np.random.default_rng(12)
    rows = [(f"p{k % 5}", float(k % 10) + 0.5, 1e6 * (k % 10) + float(rng.normal(0, 0.01))) for k in range(1500)]
    rows += [("far", float(k % 10) + 0.5, 1e9 + float(rng.normal(0, 0.01))) for k in range(40)]
    rows += [("p0", 0.2, 0.0), ("p1", 10.4, 9e6)]
    near = [r for r in rows if r[0] != "far"]
    e, s = np.array([r[1:] for r in near]).T
    pooled = {r.bin: r for r in bands.fit_pooled(spark.createDataFrame(near, "person string, excursion double, signal double"), 10).collect()}
    for b in range(10):
        v = s[np.clip(np.searchsorted(np.linspace(0.2, 10.4, 11), e, "right") - 1, 0, 9) == b]
        assert (pooled[b].mean, pooled[b].std) == pytest.approx((v.mean(), v.std(ddof=1)), rel=1e-6)
    loso = {(r.held_out, r.bin): r for r in bands.fit_loso(spark.createDataFrame(rows, "person string, excursion double, signal double"), 10).collect()}
    for person in {r[0] for r in rows}:
        e, s = np.array([r[1:] for r in rows if r[0] != person]).T
        place = np.clip(np.searchsorted(np.linspace(e.min(), e.max(), 11), e, "right") - 1, 0, 9)
        for b in range(10):
            v = s[place == b]
            assert (loso[person, b].mean, loso[person, b].std) == pytest.approx((v.mean(), v.std(ddof=1)), rel=1e-6), (person, b)


def test_loso_folds_of_many_groups(spark):
    rows = spark.range(3000).select(F.col("id"), F.col("id").alias("g"))
    assert evaluate.loso_folds(rows, "g").filter("split = 'test'").count() == 3000


def fitted(spark, x, y):
    """``clips.fit_line`` of points in the order that ``clips.floor_ransac`` ranks them in."""
    order = np.lexsort((y, x))
    draws = clips.drawn(spark.createDataFrame([("c", len(x))], "entity string, n_points long")).orderBy("trial").select("i", "j").collect()
    return clips.fit_line(x[order], y[order], np.array(draws))


def test_floor_fits(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 600, 400))
    y = 0.15 * x + 120 + rng.normal(0, 0.5, 400)
    y[rng.choice(400, 48, replace=False)] -= rng.uniform(20, 80, 48)
    a, b, inside = fitted(spark, x, y)
    assert abs(a - 0.15) < 0.02 and abs(b - 120) < 3 and 0.8 < inside < 1
    points = spark.createDataFrame([("c", float(u), float(v)) for u, v in zip(x, y, strict=True)] + [("d", 1.0, 2.0)], "entity string, x double, y double")
    got = {r.entity: r for r in clips.floor_ransac(points).collect()}
    assert got["c"].a == pytest.approx(a) and got["d"].a is None and got["d"].inlier_ratio == 0
    level = {r.entity: r for r in clips.floor_percentile(points.withColumn("frame", F.lit(0))).collect()}
    assert level["c"].a == 0 and level["d"].b is None


def test_floor_takes_all_frames_unless_static_ones_are_known(spark):
    rng = np.random.default_rng(5)
    bottom = np.round(rng.normal(100, 20, (100, 16)) + 0.8 * np.arange(16), 1)
    rows = [(c, f, [float(v) if v > 70 else None for v in bottom[f] + 5 * f * (c == "c")]) for c in ("c", "d") for f in range(100)]
    masks = spark.createDataFrame(rows + [(None, 0, [1.0] * 3)], "entity string, frame int, bottom array<double>").repartition(4)

    def brute(clip, frames):
        known = sorted((float(x), y) for c, f, b in rows if c == clip and f in frames for x, y in enumerate(b) if y is not None)
        cut = np.percentile([y for _, y in known], 80)
        return np.array([p for p in known if p[1] >= cut]).T

    points = clips.floor_points(masks)
    level, tilted = ({r.entity: r for r in f(points).collect()} for f in (clips.floor_percentile, clips.floor_ransac))
    for clip in "cd":
        x, y = brute(clip, range(100))
        b = np.percentile(y, 95)
        assert (level[clip].n_points, tilted[clip].n_points) == (len(y), len(y))
        assert (level[clip].b, level[clip].inlier_ratio) == pytest.approx((b, np.mean(np.abs(y - b) <= 3)))
        assert (tilted[clip].a, tilted[clip].b, tilted[clip].inlier_ratio) == pytest.approx(fitted(spark, x, y))
    assert (level[None].b, level[None].n_points, tilted[None].a, tilted[None].inlier_ratio) == (None, 3, None, 0)
    still = masks.withColumn("still", F.when(F.col("entity") == "d", F.col("frame") % 2 == 1).otherwise(False))
    some = clips.floor_points(still, "still").groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in some} == {"c": len(brute("c", range(100))[0]), "d": len(brute("d", range(1, 60, 2))[0]), None: 3}


def test_leaks_and_components_take_all_rows(spark, sf_dir):
    from kinegrid.plans import duplicates, evaluation

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").collect()
    sides = [{r.user_id for r in events if (r.event_id % 3 == 0) == side} for side in (True, False)]
    assert {r.user_id for r in evaluation.leak_check(spark, sf_dir).collect()} == sides[0] & sides[1]

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", F.floor(F.col("o_totalprice") / 20_000).alias("p")).collect()
    parent = {r.c_custkey: r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").collect()}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    met: dict = {}
    for o in orders:
        a, b = find(met.setdefault((o.o_orderdate, o.p), o.o_custkey)), find(o.o_custkey)
        parent[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in duplicates.dedup_components(spark, sf_dir).collect()} == {c: find(c) for c in parent}


def test_the_registered_forest_has_300_trees(spark, sf_dir, monkeypatch):
    from kinegrid.plans import duplicates

    grown, forest = [], models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **named: grown.append(named["numTrees"]) or forest(**named))
    assert duplicates.model_rf_summary(spark, sf_dir).filter("y_pred is null").count() == 0
    assert grown == [300]


def test_smoothness(spark):
    t = np.linspace(0, 1, 60)
    smooth = 30 * t**2 * (1 - t) ** 2
    noisy = smooth + np.abs(np.random.default_rng(0).normal(0, 0.3, 60))
    assert clips.sparc(smooth, 60) > clips.sparc(noisy, 60)
    assert clips.sparc(smooth * 5, 60) == pytest.approx(clips.sparc(smooth, 60), rel=1e-9)
    assert clips.sparc([1.0, 2.0], 60) is None and clips.sparc(np.zeros(20), 60) is None and clips.sparc(np.full(20, np.nan), 60) is None
    made = spark.range(1).select(clips.minimum_jerk(60)).first()[0]
    assert np.allclose(made, smooth)
    for rate in (60, 12):  # at 12 the cutoff lies beyond half the rate
        size = 4096 if len(noisy) > 64 else 1024
        grid = np.arange(size) * rate / size
        level = np.abs(np.fft.fft(noisy, size))[grid <= 10] / np.abs(np.fft.fft(noisy, size)).max()
        first, last = np.flatnonzero(level >= 0.05)[[0, -1]]
        arc = sum(math.dist((0, level[k]), (1 / (last - first), level[k + 1])) for k in range(first, last))
        assert clips.sparc(noisy, rate) == pytest.approx(-arc)


def test_rep_values_and_tensors(spark):
    f = spark.createDataFrame([("a", k, [float(k), 2.0 * k]) for k in range(10)], "entity string, frame long, features array<double>")
    reps = spark.createDataFrame([("a", 1, 2, 4, 6), ("a", 2, 9, 9, 9)], "entity string, rep int, start long, peak long, end long")
    out = clips.rep_tensors(f, reps, 9).orderBy("k").collect()
    assert [r.features for r in out] == [[2 + k / 2, 4.0 + k] for k in range(9)]
    values = clips.rep_values(reps, f.select("entity", "frame", (F.col("frame") * 1.0 - 5).alias("s")), ("s",)).orderBy("rep").first()
    assert (values.s_mean, values.s_peak, values.s_abs_peak, values.s_at_peak) == (-1.0, 1.0, 3.0, -1.0)


def moving_clip(name, reps=6, fps=30, flat=False, mask=True):
    """Frames of a body that lies along x and reaches out with either diagonal in turn; its back arches in every third repetition."""
    rows = []
    for k in range(60 + 60 * reps + 60):
        lm = [[0.5, 0.5, 0.0, 1.0] for _ in range(33)]
        for j, x in ((11, 0.30), (12, 0.30), (23, 0.60), (24, 0.60)):
            lm[j] = [x + 0.002 * (j % 2), 0.55, 0.0, 1.0]
        n, t = divmod(k - 60, 60)
        reach = 0.0 if flat or not 0 <= n < reps else 0.25 * math.sin(math.pi * t / 60) ** 2
        right = n % 2 == 0
        for j, x, side in ((16, 0.45, True), (15, 0.45, False), (27, 0.70, True), (28, 0.70, False)):
            out = reach if side == right else 0.0
            lm[j] = [x - out if j < 20 else x + out, 0.40, 0.0, 1.0]
        arch = 12.0 if 0 <= n < reps and n % 3 == 2 and 20 < t < 40 else 0.0
        bottom = [300.0 - (arch if 0.5 <= c / 64 <= 0.6 else 0.0) for c in range(64)]
        rows.append((name, k, [tuple(p) for p in lm], bottom if mask else [None] * 64, mask))
    return rows


def test_frames_become_rows_of_repetitions(spark):
    frames = moving_clip("a") + moving_clip("still", flat=True) + moving_clip("dark", mask=False) + moving_clip("out")
    schema = "entity string, frame long, lm array<struct<x:double,y:double,z:double,v:double>>, bottom array<double>, mask_valid boolean"
    records = spark.createDataFrame([(c, "p1", "correct", "side", s) for c, s in (("a", "ok"), ("still", None), ("dark", ""), ("out", "reject"), ("lost", "ok"))], "clip_id string, person_id string, condition string, view string, qc_status string")
    reps, told = build.build_reps(records, spark.createDataFrame(frames, schema).repartition(4), build.BuildRules())
    assert tuple(reps.columns) == build.REP_COLUMNS
    rows = reps.orderBy("rep_index").collect()
    assert [r.rep_id for r in rows] == [f"a__{k:03d}{'RL'[k % 2]}" for k in range(6)]
    for k, r in enumerate(rows):
        assert abs(r.peak_s - (90 + 60 * k) / 30) < 0.2 and r.start_s < r.peak_s < r.end_s
        assert (r.lumbar_gap_at_excursion_peak > 0.01) == (k % 3 == 2) and r.lumbar_gap_peak >= r.lumbar_gap_mean >= 0
        assert r.sparc_wrist < 0 and r.sparc_ankle < 0 and r.flags in ("", "overlaps_next")
    reasons = {r.clip_id: r for r in told.collect()}
    assert {c: r.reason for c, r in reasons.items()} == {"a": None, "still": "no exercise segment detected", "dark": "no segmentation mask on any frame", "out": "qc_status=reject", "lost": "no frames"}
    assert (reasons["a"].n_reps, reasons["a"].alternation_intact, reasons["still"].alternation_intact) == (6, True, None)
    whole = build.dataset_summary(reps, told).first()
    assert (whole.n_clips, whole.n_reps, whole.n_persons, whole.by_condition) == (5, 6, 1, {"correct": 6})


def test_clips_with_rates_and_sizes_of_their_own(spark):
    """Two clips built together are as each by itself under its own rules; NULL and missing columns take the rules'."""
    schema = "entity string, frame long, lm array<struct<x:double,y:double,z:double,v:double>>, bottom array<double>, mask_valid boolean"
    frames = spark.createDataFrame(moving_clip("a", 4) + moving_clip("b", 4) + moving_clip("c", 4), schema).cache()
    rows = [("a", "p", "correct", "side", "ok", 20.0, 1280.0), ("b", "p", "correct", "side", "ok", 40.0, 640.0), ("c", "q", "correct", "side", "ok", None, None)]
    records = spark.createDataFrame(rows, "clip_id string, person_id string, condition string, view string, qc_status string, fps double, width double")
    together, told = build.build_reps(records, frames)
    assert {r.clip_id for r in told.filter("n_reps = 4").collect()} == {"a", "b", "c"}
    for clip, rules in (("a", build.BuildRules(fps=20.0, width=1280)), ("b", build.BuildRules(fps=40.0)), ("c", build.BuildRules())):
        alone, _ = build.build_reps(records.filter(F.col("clip_id") == clip).drop("fps", "width"), frames, rules)
        assert sorted(map(str, alone.collect())) == sorted(map(str, together.filter(F.col("clip_id") == clip).collect()))
    lengths = {r.clip_id: r.d for r in together.groupBy("clip_id").agg(F.avg("duration_s").alias("d")).collect()}
    assert lengths["a"] > 1.4 * lengths["c"] > 1.4 * lengths["b"]


# --- rules and gates ------------------------------------------------------------


def test_three_kinds_of_missing(spark):
    df = spark.createDataFrame([(1, {"m": 0.5}), (2, {"m": float("nan")}), (3, {"m": None}), (4, {}), (5, {"m": 0.95}), (6, {"m": 1.0})], "id int, measures map<string,double>")
    got = {r.id: (r.flags, r.status) for r in qc.evaluate(df, (qc.Gate("m", least=0.95),)).collect()}
    assert got[1] == (["m=0.5<0.95"], "flag") and got[2] == (["m=None<0.95"], "flag")
    assert got[3] == got[4] == (["m:missing"], "flag") and got[5] == got[6] == ([], "ok")
    assert {r.id: r.unwired for r in qc.unwired_gates(df, (qc.Gate("m", least=1),)).collect()}[4] == ["m"]
    strict = qc.evaluate(df, (qc.Gate("m", least=0.95, rejects=True),))
    assert {r.status: r.n for r in qc.summarise(strict).collect()} == {"reject": 4, "ok": 2}


def test_manifest_rules(spark):
    fine = ("c1", "p", "correct", "side", "ok", "intent", "G1")
    rows = [(k, *r) for k, r in enumerate([fine, ("", *fine[1:]), fine, ("c2", "", *fine[2:]), ("c3", "p", "odd", *fine[3:]), ("c4", "q", *fine[2:6], "G1"), ("c5", "q", *fine[2:6], "")])]
    df = spark.createDataFrame(rows, "row int, clip_id string, person_id string, condition string, view string, qc_status string, label_source string, dedup_group string")
    got = {r.row: r.rule for r in validate.clip_violations(df, "row").collect()}
    assert got == {1: "empty clip_id", 2: "duplicate clip_id", 3: "empty person_id", 4: "unknown condition"}
    assert [(r.dedup_group, r.persons) for r in validate.shared_groups(df.filter("row <> 3")).collect()] == [("G1", ["p", "q"])]
    with pytest.raises(validate.SchemaError):
        validate.first_violation(validate.clip_violations(df, "row"), "row")
    with pytest.raises(validate.SchemaError):
        validate.assert_not_circular(["a"], "lumbar_gap_peak")


def test_manifest_files(spark, tmp_path):
    path = tmp_path / "clips.csv"
    path.write_text("clip_id,file,person_id,condition,view,detection_rate,dedup_group\nc1,a.mp4,p,correct,side,0.9,\nc2,b.mp4,p,correct,side,nan,G1\nc3,c.mp4,p,correct,side,,\n")
    got = mf.read_clips(spark, str(path)).orderBy("clip_id").collect()
    assert [r.detection_rate for r in got] == [0.9, None, None] and [r.dedup_group for r in got] == ["", "G1", ""]
    out = str(tmp_path / "out")
    mf.write_clips(mf.read_clips(spark, str(path)), out)
    assert mf.read_clips(spark, out).count() == 3
    path.write_text("clip_id,other\nx,y\n")
    with pytest.raises(validate.SchemaError):
        mf.read_clips(spark, str(path))
    assert mf.read_groups(spark, str(tmp_path / "none.csv")).count() == 0
    names = spark.createDataFrame([("/x/My Clip-1.MP4",)], "f string").select(mf.clip_id("f")).first()[0]
    assert names == "my_clip_1"
    assert mf.config_hash({"a": 1, "_b": 2}) == mf.config_hash({"a": 1}) and len(mf.config_hash({})) == 12
    with pytest.raises(KeyError):
        mf.config_value({"a": {}}, "a.b")


def test_frames_round_trip(spark, tmp_path):
    rows = [("a", k, [(0.1, 0.2, 0.0, 1.0)], [1.0, None], None, 5.0) for k in range(3)]
    made = spark.createDataFrame(rows, fr.FRAMES)
    path = str(tmp_path / "frames")
    got = fr.extracted(spark, path, lambda: made)
    assert got.count() == 3 and got.first().mask_valid
    summary = fr.extraction_summary(got).first()
    assert summary.detection_rate == 1 and summary.latency_ms == 5
    with pytest.raises(FileNotFoundError):
        fr.extracted(spark, str(tmp_path / "no"))
    bad = str(tmp_path / "bad")
    with pytest.raises(ValueError, match="no mask"):
        fr.extracted(spark, bad, lambda: made.withColumn("bottom", F.lit(None).cast("array<double>")))
    snapped = spark.createDataFrame([(7.0,), (24.0,), (40.0,)], "v double").select(fr.snap(F.col("v"))).collect()
    assert [r[0] for r in snapped] == [16, 32, 32]
    urls = spark.createDataFrame([("data:x;base64,aGk=",), ("junk",), ("data:x,%%",)], "u string").select(fr.decode_image(F.col("u"))).collect()
    assert bytes(urls[0][0]) == b"hi" and urls[1][0] is None and urls[2][0] is None
    assert "<td>&lt;</td>" in fr.html_report(spark.createDataFrame([("<", "ok")], "clip_id string, status string"), ["clip_id"])


# --- duplicates -----------------------------------------------------------------


def test_hamming_matches_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"f{k % 4}", float(k), rng.getrandbits(63)) for k in range(40)]
    rows += [("g", float(k), h ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(12)))) for k, (_, _, h) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, "file string, ts_s double, h long")
    got = {(r.file_a, r.ts_a, r.file_b, r.ts_b) for r in dedup.matches(df).collect()}
    want = {(a, s, b, t) for a, s, x in rows for b, t, y in rows if a != b and bin(x ^ y).count("1") <= 8}
    assert got == want
    sizes = {f: sum(a == f for a, _, _ in rows) for f, _, _ in rows}
    share = {(r.file_a, r.file_b): r.similarity for r in dedup.similarity(df).collect()}
    assert share == {(a, b): len({s for x, s, y, _ in want if (x, y) == (a, b)}) / sizes[a] for a, b in {(w[0], w[2]) for w in want}}


def _broadcast_keys(df) -> set[str]:
    """The first key of every broadcast join in the plan; joins of Spark's own choice, by the sizes that it takes for granted."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)", df._jdf.queryExecution().executedPlan().toString()))


def _alike(seed: int) -> list[tuple[str, float, int]]:
    """Files of a few frames each, many within 8 bits of others', and a frame that all of them have."""
    rng = random.Random(seed)
    pool = [rng.getrandbits(64) for _ in range(30)]
    rows = []
    for f in range(24):
        for k in range(rng.randrange(2, 9)):
            h = rng.choice(pool) ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 4, 8, 9))))
            rows.append((f"f{f:02d}", float(k), h - (1 << 64) if h >> 63 else h))
        rows.append((f"f{f:02d}", 9.0, 0))
    return rows


def _far(a: int, b: int) -> int:
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def test_near_hashes_meet_once_in_blocks_and_are_not_broadcast(spark, monkeypatch):
    hashes = sorted({h for seed in range(3) for _, _, h in _alike(seed)})
    df = spark.createDataFrame([(h,) for h in hashes] + [(None,), (hashes[0],)], "h long")
    for block in (dedup.BLOCK, 20):
        monkeypatch.setattr(dedup, "BLOCK", block)
        for radius in (2, 8):
            near = dedup.near_hashes(df, radius)
            assert _broadcast_keys(near) <= {"k"}  # values of sections that many hashes have
            assert sorted(map(tuple, near.collect())) == sorted((a, b, _far(a, b)) for a in hashes for b in hashes if _far(a, b) <= radius)
    monkeypatch.setattr(dedup, "PAIRS_AT_ONCE", 7)
    h, group, own = np.arange(20, dtype=np.uint64), np.zeros(20, np.int64), np.zeros(20, np.int32)
    pairs = [(int(x), int(y)) for one, other, _ in dedup._section_pairs(h, group, own, 1, 8) for x, y in zip(one, other, strict=True)]
    # their first section differs; beyond two bits of the part they'd meet in another one
    assert sorted(map(sorted, pairs)) == sorted([a, b] for a in range(20) for b in range(a + 1, 20) if _far(a, b) <= 2)


def _plain_shares(rows: list[tuple[str, float, int]]) -> dict[tuple[str, str], float]:
    files = {f: [h for g, _, h in rows if g == f] for f, _, _ in rows}
    share = {(a, b): sum(any(_far(x, y) <= 8 for y in files[b]) for x in files[a]) / len(files[a]) for a in files for b in files if a != b}
    return {p: s for p, s in share.items() if s}


def test_similarity_of_lists_of_files_is_not_broadcast(spark, monkeypatch):
    rows = _alike(4)
    df = spark.createDataFrame(rows + rows[:3], "file string, ts_s double, h long")
    want = _plain_shares(rows + rows[:3])
    for listed in (dedup.LISTED, 2):
        monkeypatch.setattr(dedup, "LISTED", listed)
        found = dedup.similarity(df)
        assert _broadcast_keys(found) <= {"k"}
        assert {(r.file_a, r.file_b): r.similarity for r in found.collect()} == want


def test_similar_looks_up_what_it_has_not_asked(spark, monkeypatch):
    rows = _alike(5)
    df = spark.createDataFrame(rows, "file string, ts_s double, h long")
    monkeypatch.setattr(dedup, "LISTED", 3)
    for wide, least in ((0, 0.5), (0, 0.15), (dedup.WIDE, 0.85)):
        monkeypatch.setattr(dedup, "WIDE", wide)
        found = dedup.similar(df, least)
        assert _broadcast_keys(found) <= {"k"}
        assert {(r.file_a, r.file_b): r.similarity for r in found.collect()} == {p: s for p, s in _plain_shares(rows).items() if s >= least}


def test_subsets_of_some_pairs_are_not_broadcast(spark):
    rows = _alike(6)
    df = spark.createDataFrame(rows, "file string, ts_s double, h long")
    files = {f: [(t, h) for g, t, h in rows if g == f] for f, _, _ in rows}
    want = {}
    for (a, b), share in _plain_shares(rows).items():
        best = [min((_far(x, y), t) for t, y in files[b])[1] for _, x in files[a] if any(_far(x, y) <= 8 for _, y in files[b])]
        if share >= 0.5 and len(best) >= 2 and max(best) - min(best) >= 1:
            want[a, b] = (min(best), max(best))
    found = dedup.subsets(df, min_span_s=1.0)
    assert want and _broadcast_keys(found) <= {"k"}
    assert {(r.file_a, r.file_b): (r.start_s, r.end_s) for r in found.collect()} == want


def test_groups_alone_and_their_names_are_not_broadcast(spark):
    rows = [(f, t, h) for f, t, h in _alike(7) if t < 9]
    rows += [(f"g{f}", t, h) for f, t, h in rows if f in ("f03", "f04")] + [("h", t, h) for f, t, h in rows if f == "f03" and t > 0]
    df = spark.createDataFrame(rows, "file string, ts_s double, h long")
    files = df.select("file").distinct()
    groups = dedup.merged_groups(files, df, F.col("file"))
    assert _broadcast_keys(groups) <= {"all"}  # a row for each part of the numbered rows
    both, _ = dedup.build_groups(files, df, F.col("file"))
    got = {r.id: r.dedup_group for r in groups.collect()}
    assert got == {r.id: r.dedup_group for r in both.collect()} and len({got[f] for f in ("f03", "gf03", "h")}) == 1


def test_report_alone_is_not_broadcast(spark):
    rows = [(f, t, h) for f, t, h in _alike(8) if t < 9]
    rows += [("g", t, h) for f, t, h in rows if f == "f03"]
    df = spark.createDataFrame(rows, "file string, ts_s double, h long")
    files = df.select("file").distinct()
    told = dedup.build_report(files, df, F.col("file"))
    assert not _broadcast_keys(told)
    _, both = dedup.build_groups(files, df, F.col("file"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, both.collect()))
    assert {r.file: r.action for r in told.collect()}["g"] == "duplicate"


def test_similar_files_without_all_pairs(spark):
    """Random files, copies, and one black frame in every file: what is left out shares less than the bound."""
    rng = random.Random(9)
    pool = [rng.getrandbits(62) for _ in range(120)]
    rows = []
    for f in range(40):
        picked = rng.sample(pool, 9) if f % 4 else pool[f : f + 9]
        rows += [(f"f{f:02d}", float(k), h ^ (1 << rng.randrange(60)) if rng.random() < 0.4 else h) for k, h in enumerate(picked)] + [(f"f{f:02d}", 9.0, 0)]
    rows += [(f"g{k}", t, h) for k in range(3) for f, t, h in rows if f == "f04"]
    df = spark.createDataFrame(rows, "file string, ts_s double, h long").cache()
    every = {(r.file_a, r.file_b): r.similarity for r in dedup.similarity(df).collect()}
    assert len(every) == 43 * 42  # the black frame
    for least in (0.15, 0.5, 1.0):
        got = {(r.file_a, r.file_b): r.similarity for r in dedup.similar(df, least).collect()}
        assert got == {p: s for p, s in every.items() if s >= least}
        held = dedup._held(df)
        found = dedup.candidates(held, dedup.near_hashes(held), least).count()
        assert len(got) <= found < 0.6 * len(every), (least, found)
    assert {r.file: (r.first, r.copies) for r in dedup.same_frames(df).filter("copies > 1").collect()} == {f: ("f04", 4) for f in ("f04", "g0", "g1", "g2")}
    files = df.select("file").distinct()
    groups, told = dedup.build_groups(files, df, F.col("file"))
    plain = dedup.judged_pairs(dedup.similarity(df))
    labels = dedup.components(files.withColumnRenamed("file", "id"), plain.filter("action = 'merge'"))
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, dedup.group_names(labels).collect()))
    acted = {}
    for r in plain.collect():
        for f in (r.a, r.b):
            acted[f] = "duplicate" if "duplicate" in (acted.get(f), "duplicate" if r.action == "merge" else "") else "review"
    assert {r.file: r.action for r in told.collect()} == {r.file: acted.get(r.file, "unique") for r in files.collect()}


def test_subsets_and_components(spark):
    whole = [("whole", float(k), 1 << k) for k in range(0, 40)]
    part = [("part", float(k), 1 << (k + 10)) for k in range(12)]
    far = [("whole", float(k), (1 << k) * 0x1FF) for k in range(0, 0)]
    df = spark.createDataFrame(whole + part + far, "file string, ts_s double, h long").withColumn("h", F.col("h") * F.lit(0) + F.xxhash64("h"))
    found = {(r.file_a, r.file_b): (r.start_s, r.end_s) for r in dedup.subsets(df, radius=2).collect()}
    assert found[("part", "whole")] == (10.0, 21.0)
    nodes = spark.range(60)
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 49) if k != 20] + [(5, 5)], "a long, b long")
    got = {r.id: r.component for r in dedup.components(nodes, links).collect()}
    assert all(got[k] == (0 if k <= 20 else 21 if k <= 49 else k) for k in range(60))
    names = {r.id: r.dedup_group for r in dedup.group_names(dedup.components(nodes, links)).collect()}
    assert names[0] == "G01" and names[30] == "G02"


def test_dhash_bits(spark):
    gray = [9 - x for _ in range(8) for x in range(9)]
    assert spark.range(1).select(dedup.dhash(F.array(*map(F.lit, gray)))).first()[0] == -1
    assert spark.range(1).select(dedup.dhash(F.array(*map(F.lit, reversed(gray))))).first()[0] == 0


# --- models ---------------------------------------------------------------------


def test_models(spark):
    train = spark.createDataFrame([(k, k % 2, float(k % 2) + 0.1 * (k % 3)) for k in range(60)], "id int, y_true int, f double")
    assert models.majority(train.filter("id < 3"), train).first().y_pred == 0
    out = models.random_forest(train, train, ["f"], trees=10)
    assert out.filter("y_true = y_pred").count() == 60
    waves = spark.createDataFrame([(k, k % 2, [math.sin(j * (0.3 if k % 2 else 1.5) + k) for j in range(64)]) for k in range(60)], "id int, y_true int, x array<double>")
    assert models.kernel_classifier(waves.filter("id < 40"), waves, 64).filter("y_true = y_pred").count() >= 55

    def load(k):
        if k == 1:
            raise RuntimeError("no such fold")
        return train, train

    done, failed = models.evaluate_folds(models.majority, load, 2)
    assert done.count() == 60 and failed == {1: "no such fold"}


# --- streams --------------------------------------------------------------------


def live_count(x, hz=30.0) -> int:
    state, rules = CounterState(), CounterRules()
    return sum(advance(state, rules, v, k, k / hz) is not None for k, v in enumerate(x))


@pytest.mark.parametrize("n", [1, 3, 8])
def test_live_counter(n):
    assert live_count(0.5 + bump(n, 60)) == n
    assert live_count(0.5 + bump(4, 12), hz=6.0) == 4
    assert live_count(0.5 + np.random.default_rng(0).normal(0, 0.004, 300)) == 0
    gap = 0.5 + bump(3, 60)
    gap[80:86] = np.nan
    assert live_count(gap) == 3


def test_live_counter_waits_for_the_descent():
    x = 0.5 + bump(1, 60)
    assert live_count(x[:31]) == 0
    state = CounterState()
    for k, v in enumerate(0.5 + bump(20, 60)):
        advance(state, CounterRules(), v, k, k / 30)
    assert state.seen[-1][1] - state.seen[0][1] <= 12.0 + 1e-9


def live_samples(spark, n=8):
    r, rows = bump(n, 60), []
    for k in range(100 + 60 * n):
        v = 0.5 + (float(r[k - 100]) if k >= 100 else 0.0)
        odd = (k - 100) // 60
        rows.append(("s", k, k / 30, v if odd % 2 == 0 or k < 100 else 0.5, v if odd % 2 or k < 100 else 0.5, 0.01 + (0.02 if k >= 100 and odd == 7 and 25 <= (k - 100) % 60 < 35 else 0.0), 0.001))
    df = spark.createDataFrame(rows, "session string, frame long, t double, right double, left double, gap double, turn double")
    return df.withColumn("ts", F.timestamp_micros(((F.col("t") + 1000) * 1e6).cast("long"))).drop("t")


def stream_of(spark, rows, folder, parts):
    """``rows`` as a stream of files, one after the other by ``parts``, and then word that much time has passed."""
    dealt = rows.withColumn("_part", parts).cache()
    for k in sorted(r[0] for r in dealt.select("_part").distinct().collect()):
        dealt.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    far = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.timestamp_seconds(F.lit(3 * 10**9)).alias("ts") for f in rows.schema]
    spark.range(1).coalesce(1).select(*far).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def taken(events, folder):
    query = events.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return events.sparkSession.read.parquet(f"{folder}/out")


def test_streams_equal_replays_in_any_order_of_arrival(spark, tmp_path):
    """Five sessions whose samples come up to 2 s late; two more samples come far too late."""
    one = live_samples(spark)
    rows = one.crossJoin(spark.range(5).select(F.concat(F.lit("s"), F.col("id")).alias("name"))).withColumn("session", F.col("name")).drop("name")
    rows = rows.withColumn("ts", F.timestamp_millis(F.unix_millis("ts") + 1_700_000_000_000))
    late = rows.filter("frame IN (10, 11) AND session = 's1'").withColumn("right", F.lit(99.0))
    arrival = F.unix_millis("ts") / 1000 + F.pmod(F.xxhash64("session", "frame"), F.lit(2000)) / 1000
    parts = F.when(F.col("right") == 99.0, F.lit(99)).otherwise(F.floor((arrival - 1_700_001_000) / 3).cast("int"))
    stream = stream_of(spark, rows.unionByName(late), str(tmp_path / "in"), parts)
    judged = sorted(map(str, sq.replay_sessions(rows).collect()))
    assert len(judged) == 40
    machine = Judging()
    listener = progress.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    events = taken(progress.observed(buffered.session_events(stream, machine, 2.0)), str(tmp_path))
    assert sorted(map(str, buffered.rows_of(events, machine).collect())) == judged
    assert sorted((r.session, r.frame) for r in buffered.late_of(events).collect()) == [("s1", 10), ("s1", 11)]
    reports = {r.session: r for r in buffered.reports_of(events).collect()}
    told = sq.session_report(sq.replay_sessions(rows)).collect()
    assert {(r.session, r.total_reps, r.correct_reps) for r in told} == {(r.session, r.total_reps, r.correct_reps) for r in reports.values()}
    assert {r.reason for r in reports.values()} == {"idle"} and reports["s0"].error_counts == {"lumbar_arch": 1} and reports["s0"].counted_reps == 8
    for _ in range(100):
        try:
            seen = spark.read.schema(progress.PROGRESS).parquet(str(tmp_path / "progress")).agg(F.sum("late"), F.sum("rows"), F.sum("reports"), F.sum("input_rows")).first()
        except Exception:  # the listener has not written yet
            seen = None
        if seen and seen[2] == 5:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert tuple(seen) == (2, 40, 5, rows.count() + 3)


def test_sessions_end_by_a_stop_or_when_they_are_full(spark, tmp_path):
    rows = live_samples(spark).withColumn("control", F.lit(None).cast("string"))
    stop = rows.withColumn("control", F.when(F.col("frame") == 500, "stop"))
    machine = Judging(SessionRules(max_reps=2))
    both = stop.unionByName(rows.withColumn("session", F.lit("full")))
    events = taken(buffered.session_events(stream_of(spark, both, str(tmp_path / "in"), F.lit(0)), machine, 5.0), str(tmp_path))
    reports = {r.session: (r.reason, r.total_reps) for r in buffered.reports_of(events).collect()}
    assert reports == {"s": ("max_reps", 2), "full": ("max_reps", 2)}
    assert sorted(map(str, buffered.rows_of(events, machine).collect())) == sorted(map(str, sq.replay(both, machine).collect()))
    events = taken(buffered.session_events(stream_of(spark, stop, str(tmp_path / "in2"), F.lit(0)), Judging(), 5.0), str(tmp_path / "2"))
    assert [r.reason for r in buffered.reports_of(events).collect()] == ["stop"]


def test_a_batch_that_is_done_again_changes_nothing(spark, tmp_path):
    write = buffered.upsert_to(str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(rows, "session string, n int")
    for number, rows in ((0, [("a", 1), (None, 5)]), (1, [("a", 2), ("b", 3)]), (0, [("a", 1), (None, 5)]), (1, [("a", 2), ("b", 3)])):
        write(batch(*rows), number)
    left = buffered.upserted(spark.read.parquet(str(tmp_path)), "session")
    assert sorted((r.session or "", r.n) for r in left.collect()) == [("", 5), ("a", 2), ("b", 3)]


def test_engine_freezes_its_calibration(spark):
    rng = np.random.default_rng(3)
    rules = EngineRules(session=SessionRules(setup_s=0.3, setup_samples=3))
    samples, lines = [], []
    r = bump(8, 60)
    for k in range(600):
        v = 0.5 + (float(r[k - 100]) if 100 <= k < 580 else 0.0)
        odd = (k - 100) // 60 % 2
        bottom = [None if x % 7 == 3 else float(100 + rng.integers(0, 3) - (5.0 if k > 400 and x < 20 else 0.0)) for x in range(40)]
        samples.append((f"s{k % 1}", k, None if k % 10 == 4 else bottom, 2, 30, 20.0, float(rng.normal(1, 0.1)), v if not odd else 0.5, v if odd else 0.5, k % 2 == 0))
        lines.append(bottom)
    engine = Engine(rules)
    state, rows = engine.load(None), []
    for s in samples:
        sample = dict(zip(("bottom", "x0", "x1", "torso", "proxy", "right", "left", "still"), s[2:], strict=True))
        rows += engine.feed(state, s[1], s[1] / 30, sample)
        state = engine.load(engine.dump(state))  # as between batches
    masks = [s for s in samples if s[2] is not None]
    ready = masks[14][1]
    assert [x["floor_ready"] for x in rows] == [k >= ready for k in range(600)]
    assert state.rotation == np.median([s[6] for s in masks[:15]]) and not state.bottoms and not state.proxies
    still = np.array([(x, y) for s in masks[:15] if s[9] for x, y in enumerate(s[2]) if y is not None])
    y = still[:, 1][still[:, 1] >= np.percentile(still[:, 1], 80)]
    assert state.floor["b"] == np.percentile(y, 95) and state.floor["n_points"] == len(y)
    after = masks[20]
    gaps = [max(0.0, state.floor["b"] - v) for v in after[2][2:30] if v is not None]
    assert rows[after[1]]["gap"] == pytest.approx(sum(gaps) / 400) and rows[after[1]]["turn"] == pytest.approx(after[6] - state.rotation)
    assert rows[ready]["gap"] is not None and rows[ready]["turn"] is None and rows[masks[15][1]]["turn"] is not None
    active = [x for x in rows if x["z"] is not None]
    assert active and all(x["phase"] == "ACTIVE" for x in active) and rows[-1]["reps_done"] == state.session.judged > 0
    df = spark.createDataFrame(samples, "session string, frame long, bottom array<double>, x0 int, x1 int, torso double, proxy double, right double, left double, still boolean")
    df = df.withColumn("ts", F.timestamp_micros((F.col("frame") * 1e6 / 30).cast("long")))
    got = sorted(((x.frame, x.gap, x.z) for x in sq.replay(df, engine).collect()))
    assert got == [(x["frame"], x["gap"], x["z"]) for x in rows]
    x, y = np.array([(float(k % 50), 80 + 0.1 * (k % 50) + (9 if k % 5 == 0 else 0)) for k in range(200)]).T
    floor = fitted_floor([[None] * 3], [False], rules)
    assert floor == {"a": None, "b": None, "inlier_ratio": 0.0, "n_points": 0}
    points = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y, strict=True)], "entity string, x double, y double")
    want = clips.floor_ransac(points).first()
    assert clips.consensus_line(x, y) == pytest.approx((want.a, want.b, want.inlier_ratio))


def test_rolling_ranges_of_a_dense_series(spark):
    """Ties, gaps, missing samples, a window of thousands of samples over many batches."""
    rng = random.Random(5)
    rows = [("a", k // 2 * 0.01 if k % 50 else k // 2 * 0.01 + 0.005, None if k % 11 == 0 else float(rng.randrange(1000))) for k in range(24_000)]
    rows += [("b", 1.0, float(k)) for k in range(15_000)] + [(None, float(k), float(k % 3)) for k in range(40)]
    got = series.rolling_range(spark.createDataFrame(rows, "entity string, t double, value double"), 30.0).collect()
    assert len(got) == len(rows)
    assert {r.range for r in got if r.entity == "b"} == {float(int(0.95 * 14_999) - int(0.05 * 14_999))}
    some = sorted((t, v) for e, t, v in rows if e == "a" and v is not None)
    for r in rng.sample([r for r in got if r.entity == "a"], 60):
        window = sorted(v for t, v in some if r.t - 30.0 <= t <= r.t)
        top = len(window) - 1
        assert r.range == (window[int(0.95 * top)] - window[int(0.05 * top)] if len(window) >= 8 else 0.0)


def test_peaks_of_a_long_series_in_linear_time():
    rng = np.random.default_rng(6)
    x = np.round(np.cumsum(rng.normal(size=1_000_000)), 1)
    began = time.perf_counter()
    found = segments.find_peaks(x, 20, 1.0)
    assert len(found) > 10_000 and time.perf_counter() - began < 20
    for k in rng.choice(len(found), 20, replace=False):
        p = found[k]
        higher = np.flatnonzero(x > x[p])
        low = higher[higher < p].max(initial=-1) + 1
        high = higher[higher > p].min(initial=len(x))
        assert segments.prominences(x, found[k : k + 1])[0] == pytest.approx(x[p] - max(x[low : p + 1].min(), x[p:high].min()))
    assert (np.diff(found) >= 20).all()


def test_series_in_order_across_batches(spark):
    x = [float(np.sin(k / 9)) if k % 500 else None for k in range(12_000)]
    rows = [("a", k, v) for k, v in enumerate(x)] + [(None, k, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "entity string, frame long, value double").repartition(7)
    for zero_phase in (False, True):
        got = sorted((r.frame, r.smooth) for r in filters.smooth_series(df, 30.0, zero_phase).filter("entity = 'a'").collect())
        want = filters.one_euro(np.array(x, float), 30.0, zero_phase)
        assert [s for _, s in got] == [None if v != v else v for v in want.tolist()]


def test_messages_in_a_stream_and_in_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for session in ("a", "b"):
        done = right = 0
        for k in range(300):
            if rng.random() < 0.5:
                done += 1
                errors = rng.choice([[], [], [], ["rotation", "too_fast"], ["lumbar_arch"]])
                right += not errors
            rows.append((session, k, ("SETUP", "ACTIVE", "DONE")[k // 100], done, right, errors if done else None, 1_700_000_000 + k * rng.choice([1, 2])))
    df = spark.createDataFrame(rows, "session string, frame long, phase string, reps_done long, reps_correct long, errors array<string>, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    rules = speech.SpeechRules(texts={"praise": "well done"})
    batch = sorted(map(str, sq.replay(df, speech.Coaching(rules)).collect()))
    stream = stream_of(spark, df, str(tmp_path / "in"), F.pmod(F.xxhash64("frame"), F.lit(3)))
    machine = speech.Coaching(rules)
    events = taken(buffered.session_events(stream, machine, 3600.0), str(tmp_path))
    assert sorted(map(str, buffered.rows_of(events, machine).collect())) == batch
    assert any("well done" in b for b in batch) and any("phase:DONE" in b for b in batch)


def test_a_full_queue_drops_and_forgets():
    state, rules = speech.SpeechState(), speech.SpeechRules(cooldown_s=4.0, waiting=2, service_s=1.5)
    assert [speech.say(state, rules, 0.0, k) for k in "abcd"] == [0.0, 1.5, 3.0, None]
    assert speech.say(state, rules, 1.6, "a") is None  # heard too lately
    assert speech.say(state, rules, 1.6, "d") == 4.5  # was dropped, so not heard; one has left the queue
    assert speech.say(state, rules, 1.7, "d", forced=True) is None
    assert speech.say(state, rules, 9.0, "a", forced=True) == 9.0


def test_grid_of_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(d, int(k % 3), k, [float(rng.normal(k % 2, 0.1)), None], int(k % 2)) for d in ("x", "y") for k in range(30)] + [("x", 0, 99, [5.0, 1.0], None)]
    df = grid.folded(spark.createDataFrame(rows, "dataset string, part int, row long, x array<double>, y_true int"), 3)

    def fails(x, y, test):
        if len(test) == 11:
            raise RuntimeError("cannot predict")
        time.sleep(0.05)
        return np.zeros(len(test) - (len(test) == 99))

    fits = {"majority": grid.most_frequent, "nearest": grid.nearest_mean, "fails": fails, "short": lambda x, y, t: np.zeros(1)}
    out = grid.fit_grid(df, fits).cache()
    cells = {(r.dataset, r.fold, r.model): r for r in grid.cells_of(out).collect()}
    assert len(cells) == 2 * 3 * 4
    for (d, k, model), r in cells.items():
        n = 11 if (d, k) == ("x", 0) else 10
        if model == "nearest":
            assert (r.rows, r.hits, r.error) == (n, 10, None)
        if model == "fails":
            assert (r.rows, r.error) == ((0, "RuntimeError: cannot predict") if n == 11 else (10, None)) and (n == 11 or r.seconds >= 0.05)
        if model == "short":
            assert r.rows == 0 and "predictions of shape" in r.error
    assert out.filter("model = 'majority' AND row = 99").count() == 1
    refused = grid.cells_of(grid.fit_grid(df, {"majority": grid.most_frequent}, most_rows=30)).collect()
    assert {(r.dataset, r.error is not None, r.rows) for r in refused} == {("x", True, 0), ("y", False, 10)}


def test_clip_archives(spark, tmp_path):
    rng = np.random.default_rng(8)
    clips_of = {}
    for name, n in (("one", 300), ("two", 5), ("none", 0)):
        points, mask = rng.normal(size=(n, 33, 4)), rng.random((n, 12, 7)) > 0.8
        points[:1] = np.nan
        clips_of[name] = points, mask
        np.savez(tmp_path / f"{name}.npz", kpts_raw=points, mask=mask.astype(np.uint8), fps=24.0, frame_size=np.array([640, 480]))
    np.savez(tmp_path / "bare.npz", kpts_raw=np.zeros((2, 33, 4)))
    np.savez(tmp_path / "stale.npz", kpts_raw=np.zeros((3, 33, 4)), mask=np.zeros((2, 4, 4)))
    (tmp_path / "notes.txt").write_text("x")
    archives.register(spark)
    frames = spark.read.format(archives.NAME).load(str(tmp_path))
    wanted = frames.filter(F.col("clip_id").isin("one", "two", "none"))
    assert wanted.rdd.getNumPartitions() == 3  # the refused ones aren't opened
    got = sorted(wanted.collect(), key=lambda r: (r.clip_id, r.frame))
    assert [(r.clip_id, r.frame) for r in got] == [("one", k) for k in range(300)] + [("two", k) for k in range(5)]
    for r in (got[7], got[302]):
        points, mask = clips_of[r.clip_id]
        assert [tuple(p) for p in r.lm] == [tuple(p) for p in points[r.frame].tolist()]
        assert r.bottom == [float(np.flatnonzero(c)[-1]) if c.any() else None for c in mask[r.frame].T]
        assert (r.mask_valid, r.fps, r.width, r.height) == (True, 24.0, 640, 480)
    assert got[0].lm[0].x is None
    for name, why in (("bare", "has no mask"), ("stale", "3 frames of landmarks and 2 masks")):
        with pytest.raises(Exception, match=why):
            frames.filter(F.col("clip_id") == name).collect()
    assert frames.filter("clip_id = 'absent'").collect() == []


def test_ranked_values():
    rng = random.Random(3)
    ranked, plain = ranks.Ranked(), []
    for k in range(6000):
        if plain and rng.random() < 0.45:
            v = plain.pop(rng.randrange(len(plain)))
            ranked.remove(v)
        else:
            v = float(rng.randrange(50) if k % 3 else rng.random())
            plain.append(v)
            ranked.add(v)
        if k % 97 == 0:
            assert [ranked[j] for j in range(len(ranked))] == sorted(plain)
    assert ranks.spread(ranks.Ranked(map(float, range(101))), 8) == 90.0 and ranks.spread(ranks.Ranked([1.0, 9.0]), 8) == 0.0
    with pytest.raises(ValueError):
        ranks.Ranked([1.0]).remove(2.0)


def test_kernels_and_their_shares():
    assert models.KERNELS.shape == (84, 9) and set(models.KERNELS.sum(axis=1)) == {0.0}
    dilations = models.kernel_dilations(200)
    assert sum(n for _, n in dilations) == 119 and dilations[0][0] == 1 and 8 * dilations[-1][0] < 200
    x = np.random.default_rng(0).normal(size=50)
    biases = models.kernel_biases([x, x[::-1]], [(1, 2), (3, 1)])
    got = models.kernel_features(x, [(1, 2), (3, 1)], biases)
    want = []
    for d, b in zip((1, 3), biases, strict=True):
        for j, w in enumerate(models.KERNELS):
            r = [sum(w[k] * x[i + (k - 4) * d] for k in range(9) if 0 <= i + (k - 4) * d < 50) for i in range(50)]
            r = r[4 * d : -4 * d] if j % 2 else r
            want += [np.mean(np.array(r) > v) for v in b[j]]
    assert np.allclose(got, want)


def test_kernel_features_leave_in_small_batches(spark):
    """A row has 9,996 shares: a batch of Spark's 10,000 rows would take 800 MB in one piece."""
    rng = np.random.default_rng(0)
    series = [(k, rng.normal(size=24).tolist(), k % 2) for k in range(130)]
    series[7] = (7, [None if k % 5 == 0 else v for k, v in enumerate(series[7][1])], 1)
    rows = spark.createDataFrame(series, "case long, x array<double>, y_true int")
    samples = [models._series(v) for _, v, _ in series[:9]]
    dilations = models.kernel_dilations(24)
    biases = models.kernel_biases(samples, dilations)
    want = {case: models.kernel_features(models._series(v), dilations, biases) for case, v, _ in series}
    whole = pa.RecordBatch.from_pylist([{"case": case, "x": v} for case, v, _ in series])
    made = list(models._with_shares("x", dilations, biases)([whole]))
    assert max(b.nbytes for b in made) < 5e6 and sum(b.num_rows for b in made) == len(series)
    got = {r["case"]: r["features"] for b in made for r in b.to_pylist()}
    assert all(np.array_equal(got[case], want[case]) for case in want)
    got = {r.case: r.features for r in models.with_kernel_features(rows, 24, samples).collect()}
    assert sorted(got) == sorted(want) and all(np.array_equal(got[case], want[case]) for case in want)


def test_control_rows_reset_and_stop(spark):
    rows = live_samples(spark).withColumn("control", F.lit(None).cast("string"))
    reset = rows.withColumn("control", F.when(F.col("frame") == 340, "reset"))
    stopped = rows.withColumn("control", F.when(F.col("frame") == 340, "stop"))
    whole, again, short = (sorted(r.peak for r in sq.replay_reps(x).collect()) for x in (rows, reset, stopped))
    assert short == [p for p in whole if p < 340] and set(short) < set(again)


def test_best_models_and_order_of_datasets(spark):
    scores = spark.createDataFrame([("a", "x", 0.5), ("a", "m", 0.5), ("a", "z", float("nan")), ("b", "x", None), ("b", "z", 0.1)], "dataset string, model string, score double")
    assert sorted(map(tuple, evaluate.best_models(scores).collect())) == [("a", "m", 0.5), ("b", "z", 0.1)]
    names = spark.createDataFrame([("bb",), ("ab",), ("c",), ("c",)], "dataset string")
    assert [r.dataset for r in evaluate.dataset_order(names, ("b", "a")).orderBy("rank", "dataset").collect()] == ["bb", "ab", "c"]


def test_datasets_results_and_channels(spark, tmp_path):
    from pyspark.errors import PySparkException

    root = str(tmp_path / "folds")
    spark.createDataFrame([("b", 0, "train", 1), ("a", 0, "test", 1), ("a", 1, "train", 0)], "dataset string, fold int, split string, y int").write.partitionBy("dataset", "fold", "split").parquet(root)
    assert [tuple(r) for r in mf.list_datasets(spark, root).collect()] == [("a", 2), ("b", 1)]
    assert mf.n_folds(spark, root, "a") == 2 and mf.n_folds(spark, root + "-none", "q", {"q": 5}) == 5
    with pytest.raises(KeyError):
        mf.n_folds(spark, root, "zz")
    for d in ("a", "b"):
        mf.write_results(spark.createDataFrame([(d, 1.0)], "dataset string, f1 double"), spark.createDataFrame([(d, 1, 0)], "dataset string, y_true int, y_pred int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 2
    assert spark.range(1).select(F.size(pose.checked_features(F.array_repeat(F.lit(0.0), 109)))).first()[0] == 109
    with pytest.raises(PySparkException):
        spark.range(1).select(pose.checked_features(F.array(F.lit(0.0)))).collect()


def test_cooldown_changes_and_clock(spark):
    m = spark.createDataFrame([("s", "k", float(t)) for t in (0, 1, 3.9, 4, 7.9, 8.1)], "session string, key string, t double")
    assert sorted(r.t for r in sq.spoken(m).collect()) == [0.0, 4.0, 8.1]
    states = spark.createDataFrame([("s", t, p, c) for t, (p, c) in enumerate([("A", 0), ("A", 0), ("A", 1), ("B", 1), ("B", 1)])], "session string, t int, phase string, count int")
    assert [(r.t, r.streak) for r in sq.changes(states).orderBy("t").collect()] == [(0, 1), (2, 3), (3, 1)]
    times = spark.createDataFrame([("s", k, t) for k, t in enumerate([0.0, 0.0, 0.0005, 0.5])], "session string, frame int, t double")
    assert [r.ms for r in sq.increasing_ms(times).orderBy("frame").collect()] == [0, 1, 2, 500]
