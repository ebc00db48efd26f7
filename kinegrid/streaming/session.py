"""A live session: calibration, warm-up repetitions, then a verdict on every repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from statistics import fmean, median, pstdev

from .counter import CounterRules, DualState, advance_dual

SETUP, BASELINE, ACTIVE, DONE = "SETUP", "BASELINE", "ACTIVE", "DONE"


@dataclass(frozen=True)
class SessionRules:
    setup_s: float = 3.0
    setup_samples: int = 10
    warm_up: int = 3
    sigmas: float = 2.5
    least_gap: float = 0.004
    least_turn: float = 0.04
    fast_share: float = 0.60
    max_reps: int = 100
    #: Frames whose measures are remembered, for repetitions that reach back.
    memory_s: float = 30.0
    counter: CounterRules = field(default_factory=CounterRules)


@dataclass
class SessionState:
    phase: str = SETUP
    began: float | None = None
    gaps_at_rest: list[float] = field(default_factory=list)
    #: (frame, time, gap, turn) of recent frames.
    frames: list[list] = field(default_factory=list)
    counter: DualState = field(default_factory=DualState)
    warm_up: list[dict] = field(default_factory=list)
    baseline: dict[str, float | None] = field(default_factory=dict)
    judged: int = 0
    correct: int = 0
    error_counts: dict[str, int] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"counter": self.counter.to_dict()}

    @classmethod
    def from_dict(cls, data: dict) -> SessionState:
        return cls(**(data | {"counter": DualState.from_dict(data["counter"])}))


def _known(v: float | None) -> bool:
    return v is not None and math.isfinite(v)


def baseline_of(reps: list[dict], gaps_at_rest: list[float]) -> dict[str, float | None]:
    """Means and population deviations of the warm-up, its median extension, and the median gap at rest."""
    out: dict[str, float | None] = {"gap_rest": median(gaps_at_rest) if gaps_at_rest else None}
    for name in ("gap_peak", "turn_peak"):
        known = [r[name] for r in reps if _known(r[name])]
        out[f"{name}_mean"] = fmean(known) if known else None
        out[f"{name}_std"] = pstdev(known) if known else None
    tempo = [r["t_extend_s"] for r in reps if _known(r["t_extend_s"])]
    return out | {"t_extend_median": median(tempo) if tempo else None}


def trigger(mean: float | None, std: float | None, least: float, sigmas: float) -> float:
    """The value above which a measure is an error; infinite without a baseline."""
    return math.inf if not _known(mean) else max(mean + sigmas * (std if _known(std) else 0.0), mean + least)


def judge(rep: dict, baseline: dict[str, float | None], rules: SessionRules) -> list[str]:
    """The errors of a repetition, in the order in which they are told."""
    errors = []
    for error, name, least in (("lumbar_arch", "gap_peak", rules.least_gap), ("rotation", "turn_peak", rules.least_turn)):
        if _known(rep[name]) and rep[name] > trigger(baseline.get(f"{name}_mean"), baseline.get(f"{name}_std"), least, rules.sigmas):
            errors.append(error)
    usual = baseline.get("t_extend_median")
    if _known(usual) and _known(rep["t_extend_s"]) and rep["t_extend_s"] < rules.fast_share * usual:
        errors.append("too_fast")
    return errors


def reported(state: SessionState) -> dict:
    """What a session comes to: judged repetitions, those without error, the errors, the most frequent first, and the baseline."""
    ranked = sorted(state.error_counts.items(), key=lambda e: (-e[1], e[0]))
    return {
        "total_reps": state.judged,
        "correct_reps": state.correct,
        "accuracy": state.correct / state.judged if state.judged else None,
        "error_counts": dict(ranked),
        "counted_reps": state.counter.count,
        "baseline": dict(state.baseline),
    }


def live_z(gap: float | None, baseline: dict[str, float | None], rules: SessionRules) -> float | None:
    """The gap in baseline deviations; a deviation of 0 counts as the least trigger."""
    mean = baseline.get("gap_peak_mean")
    if not (_known(gap) and _known(mean)):
        return None
    return (gap - mean) / max(baseline.get("gap_peak_std") or rules.least_gap, 1e-9)


def step(state: SessionState, rules: SessionRules, frame: int, now: float, right: float | None, left: float | None, gap: float | None, turn: float | None) -> list[dict]:
    """One frame of a session; returns the repetitions that it confirms, judged once the session is active."""
    if state.began is None:
        state.began = now
    state.frames = [f for f in state.frames if now - f[1] <= rules.memory_s] + [[frame, now, gap, turn]]
    if state.phase == DONE:
        return []
    if state.phase == SETUP:
        if _known(gap):
            state.gaps_at_rest.append(gap)
        if now - state.began >= rules.setup_s and len(state.gaps_at_rest) >= rules.setup_samples:
            state.phase = BASELINE
            for side in state.counter.sides.values():
                side.clear()
        return []
    out = []
    for rep in advance_dual(state.counter, rules.counter, {"R": right, "L": left}, frame, now):
        span = [f for f in state.frames if rep["start"] <= f[0] <= rep["end"]]
        gaps, turns = [f[2] for f in span if _known(f[2])], [abs(f[3]) for f in span if _known(f[3])]
        rep |= {"gap_peak": max(gaps, default=None), "turn_peak": max(turns, default=None), "t_extend_s": rep["peak_s"] - rep["start_s"], "phase": state.phase, "errors": []}
        if state.phase == ACTIVE:
            rep["errors"] = judge(rep, state.baseline, rules)
            state.judged += 1
            state.correct += not rep["errors"]
            for error in rep["errors"]:
                state.error_counts[error] = state.error_counts.get(error, 0) + 1
            if state.judged >= rules.max_reps:
                state.phase = DONE
        elif state.phase == BASELINE:
            state.warm_up.append(rep)
        out.append(rep)
    if state.phase == BASELINE and len(state.warm_up) >= rules.warm_up:
        state.baseline = baseline_of(state.warm_up[: rules.warm_up], state.gaps_at_rest)
        state.phase = ACTIVE
    return out
