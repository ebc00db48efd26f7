"""A session that measures its own frames: floor and rotation are calibrated first, then frozen.

A sample is a frame: ``bottom``, the lowest occupied row of each image column
(NULL in empty ones, or altogether without a silhouette), the columns x0 to
x1 - 1 over which the gap is measured, the ``torso`` length, the ``proxy`` of the
rotation, the distances ``right`` and ``left``, and perhaps ``detected`` and
``still``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from ..operators.clips import consensus_line
from .machines import number
from .session import ACTIVE, DONE, SessionRules, SessionState, live_z, reported, step

FRAMES = "session string, frame long, gap double, turn double, z double, floor_ready boolean, phase string, reps_done long, reps_correct long, errors array<string>"


@dataclass(frozen=True)
class EngineRules:
    """How many silhouettes and proxies the calibration takes, and how the floor is fitted to the lowest points."""

    masks: int = 15
    proxies: int = 15
    method: str = "percentile"
    percentile: float = 95.0
    lowest: float = 20.0
    within: float = 3.0
    least: int = 8
    trials: int = 200
    session: SessionRules = field(default_factory=SessionRules)


def fitted_floor(bottoms: list[list[float | None]], still: list[bool], rules: EngineRules) -> dict:
    """{a, b, inlier_ratio, n_points}: of the still frames' points, or of all if these are too few, the lowest ones, and the line through them."""

    def points(some: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray]:
        found = [(x, y) for bottom in some for x, y in enumerate(bottom) if number(y) is not None]
        return tuple(np.array(found, float).reshape(-1, 2).T)

    x, y = points([b for b, s in zip(bottoms, still, strict=True) if s])
    if len(x) < rules.least:
        x, y = points(bottoms)
    if len(x) >= rules.least:
        low = y >= np.percentile(y, 100.0 - rules.lowest)
        if low.sum() >= rules.least:
            x, y = x[low], y[low]
    if len(x) < rules.least:
        return {"a": None, "b": None, "inlier_ratio": 0.0, "n_points": len(x)}
    if rules.method == "ransac":
        a, b, ratio = consensus_line(x, y, rules.trials, rules.within, rules.least)
    else:
        a, b = 0.0, float(np.percentile(y, rules.percentile))
        ratio = float(np.mean(np.abs(y - b) <= rules.within))
    return {"a": a, "b": b, "inlier_ratio": ratio, "n_points": len(x)}


def gap_area(bottom: list[float | None], floor: dict, x0: int, x1: int, torso: float | None) -> float | None:
    """Summed height of the silhouette over the floor in a window, over the torso squared; NULL for a torso of no length."""
    if torso is None or torso <= 1e-6:
        return None
    heights = (floor["a"] * x + floor["b"] - y for x in range(x0, min(x1, len(bottom))) if (y := number(bottom[x])) is not None)
    return sum(max(0.0, h) for h in heights) / (torso * torso)


@dataclass
class EngineState:
    #: Silhouettes and proxies of the calibration; empty once it is done.
    bottoms: list[list[float | None]] = field(default_factory=list)
    still: list[bool] = field(default_factory=list)
    proxies: list[float] = field(default_factory=list)
    floor: dict | None = None
    rotation: float | None = None
    session: SessionState = field(default_factory=SessionState)


class Engine:
    """A row per frame, from the first on; calibrated values are missing until they are ready."""

    schema = FRAMES

    def __init__(self, rules: EngineRules = EngineRules()):
        self.rules = rules

    def load(self, text: str | None) -> EngineState:
        if not text:
            return EngineState()
        data = json.loads(text)
        return EngineState(**(data | {"session": SessionState.from_dict(data["session"])}))

    def dump(self, state: EngineState) -> str:
        return json.dumps(vars(state) | {"session": state.session.to_dict()})

    def feed(self, state: EngineState, frame: int, now: float, sample: dict) -> list[dict]:
        rules, gap, turn = self.rules, None, None
        bottom, proxy = sample.get("bottom"), number(sample.get("proxy"))
        if bottom is not None and sample.get("detected", True) is not False:
            if state.floor is None:
                state.bottoms.append(bottom)
                state.still.append(bool(sample.get("still")))
                if len(state.bottoms) >= rules.masks:
                    state.floor = fitted_floor(state.bottoms, state.still, rules)
                    state.bottoms, state.still = [], []
            if state.floor is not None and state.floor["b"] is not None:
                gap = gap_area(bottom, state.floor, int(sample["x0"]), int(sample["x1"]), number(sample.get("torso")))
            if proxy is not None:
                if state.rotation is None:
                    state.proxies.append(proxy)
                    if len(state.proxies) >= rules.proxies:
                        state.rotation, state.proxies = float(np.median(state.proxies)), []
                else:
                    turn = proxy - state.rotation
        before = state.session.phase
        found = step(state.session, rules.session, frame, now, number(sample.get("right")), number(sample.get("left")), gap, turn)
        judged = [f for f in found if f["phase"] == ACTIVE]
        return [
            {
                "frame": frame,
                "gap": gap,
                "turn": turn,
                "z": live_z(gap, state.session.baseline, rules.session) if before == ACTIVE else None,
                "floor_ready": state.floor is not None,
                "phase": state.session.phase,
                "reps_done": state.session.judged,
                "reps_correct": state.session.correct,
                "errors": judged[-1]["errors"] if judged else None,
            }
        ]

    def over(self, state: EngineState) -> bool:
        return state.session.phase == DONE

    def report(self, state: EngineState, reason: str) -> dict:
        return {"reason": reason, **reported(state.session)}
