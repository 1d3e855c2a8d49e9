"""The blink and head-turn challenges as transition tables over frame symbols.

A table turns a frame into a number and a step into a lookup, so that the batch job can
compose whole chunks of frames, and the stream can keep one small number per session.
"""

import numpy as np

from docuvet.params import LivenessParams

OPEN, CLOSING, CLOSED, OPENING, CONFIRMED, STALLED, LOST = (
    "EYES_OPEN", "EYE_CLOSING", "EYES_CLOSED", "EYE_OPENING", "BLINK_CONFIRMED", "STALLED_CLOSED", "FACE_NOT_DETECTED",
)
# Bits of a blink symbol, in this order.
BITS = ("le_closing", "le_closed", "both_le_closed", "ge_open", "any_ge_closing", "any_ge_reopen", "ge_reopen")
NO_CHANGE, FACE_LOST = 128, 129
TURN_NONE, TURN_UP, TURN_DOWN, TURN_SWITCH = 0, 1, 2, 3  # TURN_SWITCH is added to the others


def blink_states(params: LivenessParams = LivenessParams()) -> list[tuple[str, int]]:
    """All states; the three closing states also count closed frames up to the stall limit."""
    counted = [(name, k) for name in (CLOSING, CLOSED, OPENING) for k in range(params.stall_frames + 2)]
    return [(OPEN, 0), (CONFIRMED, 0), (STALLED, 0), (LOST, 0), *counted]


def _step(state: str, closed: int, bit: dict[str, bool], stall: int) -> tuple[str, int, int]:
    """Next state, its closed-frame count and the blinks completed by this frame."""
    if state == OPEN:
        return (CLOSING, 1, 0) if bit["le_closing"] else (OPEN, 0, 0)
    if state == CLOSING:
        if bit["le_closed"] or bit["both_le_closed"]:
            return CLOSED, closed + 1, 0
        return (OPEN, 0, 0) if bit["ge_open"] else (CLOSING, closed + 1, 0)
    if state == CLOSED:
        if bit["le_closed"]:
            return (STALLED, 0, 0) if closed + 1 > stall else (CLOSED, closed + 1, 0)
        return (OPENING, closed, 0) if bit["any_ge_closing"] else (CLOSED, closed, 0)
    if state == OPENING:
        if bit["any_ge_reopen"]:
            return CONFIRMED, 0, 1
        return (CLOSED, closed + 1, 0) if bit["le_closed"] else (OPENING, closed, 0)
    if state == CONFIRMED:
        return OPEN, 0, 0
    if state == STALLED:
        return (OPEN, 0, 0) if bit["ge_reopen"] else (STALLED, 0, 0)
    return state, closed, 0  # a lost face leaves the machine until the session is reset


def blink_tables(params: LivenessParams = LivenessParams()) -> tuple[np.ndarray, np.ndarray]:
    """Next state and completed blinks by (symbol, state)."""
    states = blink_states(params)
    index = {s: i for i, s in enumerate(states)}
    top = params.stall_frames + 1
    following = np.tile(np.arange(len(states)), (130, 1))
    blinks = np.zeros_like(following)
    for symbol in range(128):
        bit = {name: bool(symbol >> i & 1) for i, name in enumerate(BITS)}
        for i, (state, closed) in enumerate(states):
            to, count, done = _step(state, closed, bit, params.stall_frames)
            counted = to in (CLOSING, CLOSED, OPENING)
            following[symbol, i] = index[(to, min(count, top) if counted else 0)]
            blinks[symbol, i] = done
    following[FACE_LOST, :] = index[(LOST, 0)]
    return following, blinks


def turn_table(params: LivenessParams = LivenessParams()) -> np.ndarray:
    """Next state by (symbol, state): frames held so far, or the last state once held long enough."""
    done = params.turn_frames
    table = np.zeros((6, done + 1), dtype=int)
    for symbol in range(6):
        for held in range(done + 1):
            start = held if held == done else (0 if symbol >= TURN_SWITCH else held)
            move = symbol % 3
            after = start + 1 if move == TURN_UP else max(0, start - 1) if move == TURN_DOWN else start
            table[symbol, held] = done if held == done else min(done, after)
    return table


def compose_segments(
    segment: np.ndarray, segments: int, symbols: np.ndarray, following: np.ndarray, gains: np.ndarray | None, idle: int
) -> tuple[np.ndarray, np.ndarray]:
    """End state and total gain for every possible start state, of each run of frames.

    ``segment`` numbers the run of each frame, in order; ``idle`` is the symbol that changes nothing. Effects of neighbouring
    frames are joined two by two in all runs at once, so a run of n frames takes log2(n) rounds.
    """
    states = following.shape[1]
    active = symbols != idle
    segment, ends = segment[active], following[symbols[active]]
    total = np.zeros_like(ends) if gains is None else gains[symbols[active]]
    while True:
        same = segment[1:] == segment[:-1]
        if not same.any():
            break
        index = np.arange(len(segment))
        begins = np.maximum.accumulate(np.where(np.append(True, ~same), index, 0))
        first = np.flatnonzero(((index - begins) % 2 == 0) & np.append(same, False))
        after = first + 1
        total[first] += np.take_along_axis(total[after], ends[first], 1)
        ends[first] = np.take_along_axis(ends[after], ends[first], 1)
        kept = np.ones(len(segment), bool)
        kept[after] = False
        segment, ends, total = segment[kept], ends[kept], total[kept]
    all_ends, all_totals = np.tile(np.arange(states), (segments, 1)), np.zeros((segments, states), np.int64)
    all_ends[segment], all_totals[segment] = ends, total
    return all_ends, all_totals
