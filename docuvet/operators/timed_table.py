"""The clock-driven blink challenge as a transition table over frame conditions and closure times."""

import numpy as np

from docuvet.operators.blink_table import CONFIRMED, STALLED
from docuvet.params import TimedLivenessParams

OPEN, CLOSING, CLOSED, OPENING = "EYES_OPEN", "EYES_CLOSING", "EYES_CLOSED", "EYES_OPENING"
NO_FACE, STABILIZING = "NO_FACE", "FACE_STABILIZING"
STATES = (OPEN, CLOSING, CLOSED, OPENING, CONFIRMED, STALLED)
# Conditions of a frame, one bit each: the smoothed ratio or both eyes against a threshold of the session.
CONDITIONS = ("begins_to_shut", "is_shut", "is_wide", "rises", "is_back", "mean_is_back")
# Classes of the time since the eyes began to close.
TOO_SHORT, BLINK, TOO_LONG, STALL = range(4)
ANY_TIME = (TOO_SHORT, BLINK, TOO_LONG, STALL)
ALWAYS = None
# Rows of (states, condition, closure times, next state, blinks); of several that apply the first counts, without any a state stays.
TRANSITIONS = (
    ((CLOSED, OPENING), ALWAYS, (STALL,), STALLED, 0),
    ((CLOSED, OPENING), "is_back", (BLINK,), CONFIRMED, 1),
    ((CLOSED, OPENING), "is_back", (TOO_SHORT, TOO_LONG), OPEN, 0),
    ((CLOSED, OPENING), "rises", ANY_TIME, OPENING, 0),
    ((OPEN,), "begins_to_shut", ANY_TIME, CLOSING, 0),
    ((CLOSING,), "is_shut", ANY_TIME, CLOSED, 0),
    ((CLOSING,), "is_wide", ANY_TIME, OPEN, 0),
    ((CONFIRMED,), ALWAYS, ANY_TIME, OPEN, 0),
    ((STALLED,), "mean_is_back", ANY_TIME, OPEN, 0),
)


def timed_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and completed blinks by (conditions, closure time, state)."""
    shape = (1 << len(CONDITIONS), len(ANY_TIME), len(STATES))
    following, blinks = np.broadcast_to(np.arange(len(STATES)), shape).copy(), np.zeros(shape, int)
    for states, condition, times, to, done in reversed(TRANSITIONS):
        met = np.ones(shape[0], bool) if condition is ALWAYS else np.arange(shape[0]) >> CONDITIONS.index(condition) & 1 == 1
        where = np.ix_(met, times, [STATES.index(s) for s in states])
        following[where], blinks[where] = STATES.index(to), done
    return following, blinks


def conditions(ear: float, left: float, right: float, baseline: float, params: TimedLivenessParams) -> int:
    """The conditions of one frame as a number."""
    below = np.array([baseline * params.closing_factor, max(params.closed_floor, baseline * params.closed_factor)])
    reopen = baseline * params.reopen_factor
    shut, back = min(ear, max(left, right)) <= below, max(ear, min(left, right))
    met = (*shut, ear >= baseline * params.open_factor, max(ear, left, right) >= below[0], back >= reopen, ear >= reopen)
    return sum(1 << i for i, bit in enumerate(met) if bit)


def closure_time(milliseconds: int | None, params: TimedLivenessParams) -> int:
    """Class of a closure of so many milliseconds; none is too short."""
    if milliseconds is None:
        return TOO_SHORT
    return int(np.searchsorted([params.min_blink_ms, params.max_blink_ms + 1, params.stall_ms + 1], milliseconds, "right"))
