"""What is said aloud in a session: messages from its states, a pause per key, and a short queue that drops what it can't take."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from .machines import number

SAID = "session string, frame long, t double, key string, text string, start_s double"
#: Streaks of repetitions without error that are praised.
PRAISED = (5, 10, 15, 20)


@dataclass(frozen=True)
class SpeechRules:
    """Seconds between messages of one key, messages that may wait while one is spoken, and how long one takes."""

    cooldown_s: float = 4.0
    waiting: int = 2
    service_s: float = 1.5
    #: What is said for a key; a key without a text is said itself.
    texts: Mapping[str, str] = field(default_factory=dict)


@dataclass
class SpeechState:
    last: dict[str, float] = field(default_factory=dict)
    #: When the messages that wait will be spoken, and when the speaker is free again.
    starts: list[float] = field(default_factory=list)
    free_at: float = float("-inf")
    phase: str | None = None
    count: int = 0
    streak: int = 0


def say(state: SpeechState, rules: SpeechRules, now: float, key: str, forced: bool = False) -> float | None:
    """When a message is spoken; None if its key was heard too lately, unless it is forced, or if the queue is full.

    A message that is dropped doesn't count as heard.
    """
    if not forced and now - state.last.get(key, float("-inf")) < rules.cooldown_s:
        return None
    state.starts = [s for s in state.starts if s > now]
    if len(state.starts) >= rules.waiting:
        return None
    start = max(now, state.free_at)
    state.free_at = start + rules.service_s
    if start > now:
        state.starts.append(start)
    state.last[key] = now
    return start


class Coaching:
    """Messages of a session from its states: samples with phase, reps_done, reps_correct and errors.

    A new phase is told. A repetition without error is counted aloud, and
    praised at a streak of ``PRAISED``; of one with errors the first is told.
    """

    schema = SAID

    def __init__(self, rules: SpeechRules = SpeechRules()):
        self.rules = rules

    def load(self, text: str | None) -> SpeechState:
        return SpeechState(**json.loads(text)) if text else SpeechState()

    def dump(self, state: SpeechState) -> str:
        return json.dumps(asdict(state))

    def feed(self, state: SpeechState, frame: int, now: float, sample: dict) -> list[dict]:
        wanted: list[tuple[str, str | None, bool]] = []
        if sample.get("phase") != state.phase:
            state.phase = sample.get("phase")
            wanted.append((f"phase:{state.phase}", None, True))
        done = int(number(sample.get("reps_done")) or 0)
        if done != state.count:
            state.count = done
            errors = sample.get("errors")
            if errors:
                state.streak = 0
                wanted.append((errors[0], None, False))
            elif errors is not None:
                state.streak += 1
                wanted.append(("count", str(int(number(sample.get("reps_correct")) or 0)), True))
                if state.streak in PRAISED:
                    wanted.append(("praise", None, False))
        out = []
        for key, text, forced in wanted:
            start = say(state, self.rules, now, key, forced)
            if start is not None:
                out.append({"frame": frame, "t": now, "key": key, "text": text or self.rules.texts.get(key, key), "start_s": start})
        return out

    def over(self, state: SpeechState) -> bool:
        return False

    def report(self, state: SpeechState, reason: str) -> dict:
        return {"reason": reason, "counted_reps": state.count, "total_reps": 0, "correct_reps": 0, "error_counts": {}}
