"""What a session does with its samples, as the stream and the replay both apply it.

A machine loads and dumps its state as text, takes one sample at a time in order
of event time, and tells the rows that it makes. It knows when its session is
over and what there is to report of it.
"""

from __future__ import annotations

import json
from typing import Any, Protocol

from .counter import CounterRules, DualState, advance_dual
from .session import DONE, SessionRules, SessionState, reported, step

REPS = "session string, side string, rep_index long, alternation_broken boolean, start long, peak long, end long, start_s double, peak_s double, end_s double, amplitude double"
VERDICTS = REPS + ", gap_peak double, turn_peak double, t_extend_s double, phase string, errors array<string>"
REPORTS = "session string, reason string, total_reps long, correct_reps long, accuracy double, error_counts map<string,long>, counted_reps long, baseline map<string,double>"


def number(v: Any) -> float | None:
    """A sample's number; NaN and texts that stand for it are missing."""
    return float(v) if isinstance(v, (int, float)) and v == v else None


class Machine(Protocol):
    #: Columns of the rows that are made; the first is the session.
    schema: str

    def load(self, text: str | None) -> Any: ...

    def dump(self, state: Any) -> str: ...

    def feed(self, state: Any, frame: int, now: float, sample: dict) -> list[dict]: ...

    def over(self, state: Any) -> bool: ...

    def report(self, state: Any, reason: str) -> dict: ...


class Counting:
    """Repetitions of both sides."""

    schema = REPS

    def __init__(self, rules: CounterRules = CounterRules()):
        self.rules = rules

    def load(self, text: str | None) -> DualState:
        return DualState.from_dict(json.loads(text)) if text else DualState()

    def dump(self, state: DualState) -> str:
        return json.dumps(state.to_dict())

    def feed(self, state: DualState, frame: int, now: float, sample: dict) -> list[dict]:
        return advance_dual(state, self.rules, {"R": number(sample.get("right")), "L": number(sample.get("left"))}, frame, now)

    def over(self, state: DualState) -> bool:
        return False

    def report(self, state: DualState, reason: str) -> dict:
        return {"reason": reason, "counted_reps": state.count, "total_reps": 0, "correct_reps": 0, "error_counts": {}}


class Judging:
    """Repetitions with the errors found in them."""

    schema = VERDICTS

    def __init__(self, rules: SessionRules = SessionRules()):
        self.rules = rules

    def load(self, text: str | None) -> SessionState:
        return SessionState.from_dict(json.loads(text)) if text else SessionState()

    def dump(self, state: SessionState) -> str:
        return json.dumps(state.to_dict())

    def feed(self, state: SessionState, frame: int, now: float, sample: dict) -> list[dict]:
        return step(state, self.rules, frame, now, *(number(sample.get(c)) for c in ("right", "left", "gap", "turn")))

    def over(self, state: SessionState) -> bool:
        return state.phase == DONE

    def report(self, state: SessionState, reason: str) -> dict:
        return {"reason": reason, **reported(state)}
