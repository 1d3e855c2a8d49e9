"""Effects of stretches of frames on the clock-driven challenges, as functions of state and clock.

A closure that begins inside a stretch has a known clock; only the one that is open when the stretch begins has not. For each
state in which a stretch may begin, its effect is therefore a step function of that clock, of at most five steps: the closure
has stalled before the eyes come back, stalls as they do, is too long, is a blink, or is too short. Effects of neighbouring
stretches join into one of the same form.
"""

from dataclasses import dataclass

import numpy as np

from docuvet.operators import timed_table as tt
from docuvet.params import TimedLivenessParams

OPEN, CLOSING, CLOSED, OPENING, CONFIRMED, STALLED = range(len(tt.STATES))
BEGINS, SHUT, WIDE, RISES, BACK, MEAN_BACK = (1 << i for i in range(len(tt.CONDITIONS)))
#: Stands for the clock with which the stretch began; bounds that no clock reaches.
KEPT, FAR = -(2**62), 2**62
STEPS, BOUNDS = 5, 4
#: A turn clock that does not run.
STOPPED = -(2**61)


@dataclass
class Frames:
    """Frames that count for the blink challenge, in order: run of each, its milliseconds, conditions, and fresh calibrations."""

    segment: np.ndarray
    at: np.ndarray
    conditions: np.ndarray
    fresh: np.ndarray


def _next(flags: np.ndarray, ends: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """First flagged frame at or after each position, or the end of the position's run; one place more for the last end."""
    n = len(flags)
    index = np.where(flags, np.arange(n), n)
    found = np.append(np.minimum.accumulate(index[::-1])[::-1], n)
    return np.append(np.minimum(found[:n], ends[segment]), n)


class _Walk:
    """Where the machine gets from any frame: tables over all positions of all runs at once."""

    def __init__(self, frames: Frames, begins: np.ndarray, params: TimedLivenessParams):
        n = len(frames.at)
        self.n, self.params, self.segment = n, params, frames.segment
        self.begins, self.ends = begins, np.append(begins[1:], n)
        self.at, self.bits, self.fresh = frames.at, frames.conditions, frames.fresh
        has = lambda bit: self.bits & bit > 0
        table = lambda flags: _next(flags, self.ends, self.segment)
        self.shutting, self.settled, self.back = table(has(BEGINS)), table(has(SHUT | WIDE)), table(has(BACK))
        self.mean, self.rising, self.renewed = table(has(MEAN_BACK)), table(has(RISES)), table(self.fresh)
        # One clock for all runs, so that one search finds the frame at which a closure stalls.
        low = self.at.min(initial=0)
        self.stride = int(self.at.max(initial=0) - low) + params.stall_ms + 2
        self.line = (self.at - low) + self.segment * self.stride
        self._cycles()

    def end_of(self, x: np.ndarray) -> np.ndarray:
        """End of the run of position x; x may be that end itself, so the run comes from the frame before."""
        return self.ends[self.segment[np.maximum(x - 1, 0)]]

    def _cycles(self) -> None:
        """From OPEN before each frame to the end of its run: state, clock and blinks, by doubling the jumps."""
        n = self.n
        x = np.arange(n)
        end = self.ends[self.segment]
        # Jump of one closure: next frame that meets open eyes (or END = n), state and clock where there is none, blinks.
        jump, state, since, gain = np.full(n, n), np.full(n, OPEN), np.zeros(n, np.int64), np.zeros(n, np.int64)
        i = self.shutting[x]
        live = np.flatnonzero(i < end)
        i, e = i[live], end[live]
        clock = self.at[i]
        settled, renewed = self.settled[i + 1], self.renewed[i + 1]
        settled, renewed = np.where(i + 1 < e, settled, e), np.where(i + 1 < e, renewed, e)

        def final(where, kind):
            state[live[where]], since[live[where]] = kind, clock[where]

        def go(where, to, blinks=0):
            jump[live[where]] = np.where(to >= e[where], n, to)
            gain[live[where]] = blinks

        left = np.minimum(settled, renewed) >= e
        final(left, CLOSING)
        again = ~left & (renewed <= settled)
        go(again, renewed[again])
        a = np.minimum(settled, n - 1)
        wide = ~left & ~again & (self.bits[a] & SHUT == 0)
        go(wide, a[wide] + 1)
        shut = np.flatnonzero(~left & ~again & ~wide)
        a, es = a[shut], e[shut]
        inside = a + 1 < es
        of = lambda table: np.where(inside, table[np.minimum(a + 1, n)], es)
        b, r = of(self.back), of(self.renewed)
        s = np.minimum(np.searchsorted(self.line, self.line[i[shut]] + self.params.stall_ms, "right"), es)
        s = np.where(inside, np.maximum(s, a + 1), es)
        first = np.minimum(np.minimum(b, s), r)
        open_still = first >= es
        risen = of(self.rising) < es
        final(shut[open_still & risen], OPENING)
        final(shut[open_still & ~risen], CLOSED)
        new = ~open_still & (r <= first)
        go(shut[new], r[new])
        stalled = ~open_still & ~new & (s <= b)
        to, ended = self._after_stall(s[stalled] + 1, es[stalled])
        final(shut[stalled][ended], STALLED)
        go(shut[stalled][~ended], to[~ended])
        back = np.flatnonzero(~open_still & ~new & ~stalled)
        took = self.at[b[back]] - clock[shut[back]]
        blink = (took >= self.params.min_blink_ms) & (took <= self.params.max_blink_ms)
        go(shut[back[~blink]], b[back[~blink]] + 1)
        done = back[blink]
        to, ended = self._after_blink(b[done] + 1, es[done])
        go(shut[done], np.where(ended, n, to), 1)
        state[live[shut[done][ended]]] = CONFIRMED
        # Doubling: ``stop`` is the position whose own entry is final.
        stop, to = np.arange(n), jump
        total = gain.copy()
        moving = to < n
        while moving.any():
            m = np.flatnonzero(moving)
            t = to[m]
            total[m] += total[t]
            stop[m] = stop[t]
            to = to.copy()
            to[m] = to[t]
            moving = to < n
        self.state, self.since, self.total = np.append(state[stop], OPEN), np.append(since[stop], 0), np.append(total, 0)

    def _after_stall(self, y: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From STALLED before frame y: where eyes are open again, and whether that is never."""
        inside = y < e
        at = np.minimum(y, self.n)
        m, r = np.where(inside, self.mean[at], e), np.where(inside, self.renewed[at], e)
        return np.where(r <= m, r, m + 1), np.minimum(m, r) >= e

    def _after_blink(self, y: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From CONFIRMED before frame y: open after it, or before it where it is freshly calibrated."""
        inside = y < e
        return np.where(inside & self.fresh[np.minimum(y, self.n - 1)], y, y + 1), ~inside

    def from_open(self, y: np.ndarray, e: np.ndarray, blinks: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = y < e
        at = np.where(inside, y, self.n)
        return self.state[at], self.since[at], self.total[at] + blinks

    def from_stall(self, y, e):
        to, never = self._after_stall(y, e)
        state, since, gain = self.from_open(to, e)
        return np.where(never, STALLED, state), np.where(never, 0, since), np.where(never, 0, gain)

    def from_blink(self, y, e):
        to, never = self._after_blink(y, e)
        state, since, gain = self.from_open(to, e, 1)
        return np.where(never, CONFIRMED, state), np.where(never, 0, since), np.where(never, 1, gain)


def blink_effects(frames: Frames, runs: int, params: TimedLivenessParams = TimedLivenessParams()) -> tuple[np.ndarray, ...]:
    """Effect of each run: bounds (run, state, 4), then state, clock and blinks (run, state, 5) of the steps between them.

    A run without frames changes nothing.
    """
    bounds = np.full((runs, len(tt.STATES), BOUNDS), FAR)
    state = np.tile(np.arange(len(tt.STATES))[:, None], (runs, 1, STEPS))
    since, gain = np.full_like(state, KEPT), np.zeros_like(state)
    if not len(frames.at):
        return bounds, state, since, gain
    runs_here, begins = np.unique(frames.segment, return_index=True)
    dense = Frames(np.searchsorted(runs_here, frames.segment), frames.at, frames.conditions, frames.fresh)
    walk = _Walk(dense, begins, params)
    p, e = begins, walk.ends
    every = lambda found: [np.repeat(x[:, None], STEPS, 1) for x in found]

    def put(which, found):
        state[runs_here, which], since[runs_here, which], gain[runs_here, which] = found

    put(OPEN, every(walk.from_open(p, e)))
    put(STALLED, every(walk.from_stall(p, e)))
    to, never = walk._after_blink(p, e)
    put(CONFIRMED, every(walk.from_open(to, e)))
    closed = {label: _closed_effect(walk, p, e, label) for label in (CLOSED, OPENING)}
    for label, (where, found) in closed.items():
        bounds[runs_here, label] = where
        put(label, found)
    # From CLOSING the eyes settle first; no clock counts until they are shut.
    settled, renewed = walk.settled[p], walk.renewed[p]
    later, found = _closed_effect(walk, settled + 1, e, CLOSED)
    left, again = np.minimum(settled, renewed) >= e, renewed <= settled
    wide = walk.bits[np.minimum(settled, walk.n - 1)] & SHUT == 0
    for condition, (s, c, g) in ((wide, walk.from_open(settled + 1, e)), (again, walk.from_open(renewed, e)), (left, (np.full(len(p), CLOSING), np.full(len(p), KEPT), np.zeros(len(p), np.int64)))):
        found = [np.where(condition[:, None], x[:, None], y) for x, y in zip((s, c, g), found, strict=True)]
    bounds[runs_here, CLOSING] = np.where((wide | again | left)[:, None], FAR, later)
    put(CLOSING, found)
    return bounds, state, since, gain


def _closed_effect(walk: _Walk, p: np.ndarray, e: np.ndarray, label: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds and steps for eyes that are shut before frame p, by the clock of their closure."""
    params, runs = walk.params, len(p)
    inside = p < e
    at = np.minimum(p, walk.n)
    b, r, up = (np.where(inside, table[at], e) for table in (walk.back, walk.renewed, walk.rising))
    bounds = np.full((runs, BOUNDS), FAR)
    steps = [np.zeros((runs, STEPS), np.int64) for _ in range(3)]

    def put(where, step, found):
        for array, value in zip(steps, found, strict=True):
            array[where, step] = value[where] if isinstance(value, np.ndarray) else value

    # Calibrated anew before the eyes are back: whatever the clock, they are open then.
    again = (r <= b) & (r < e)
    for step in range(STEPS):
        put(again, step, walk.from_open(r, e))
    never = ~again & (b >= e)
    last = np.maximum(e - 1, 0)
    bounds[never, 0] = np.where(inside, walk.at[last] - params.stall_ms, -FAR)[never]
    put(never, 0, (STALLED, 0, 0))
    for step in range(1, STEPS):
        put(never, step, (np.where(up < e, OPENING, label), KEPT, 0))
    back = ~again & ~never
    b = np.where(back, b, 0)
    when = walk.at[np.minimum(b, walk.n - 1)]
    before = np.where(b > p, walk.at[np.maximum(b - 1, 0)] - params.stall_ms, -FAR)
    bounds[back] = np.stack([before, when - params.stall_ms, when - params.max_blink_ms, when - params.min_blink_ms + 1], 1)[back]
    put(back, 0, walk.from_stall(b, e))
    put(back, 1, walk.from_stall(b + 1, e))
    put(back, 2, walk.from_open(b + 1, e))
    put(back, 3, walk.from_blink(b + 1, e))
    put(back, 4, walk.from_open(b + 1, e))
    return bounds, steps


Effect = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def joined(first: Effect, second: Effect) -> Effect:
    """Effect of one stretch (its arrays without the run axis) followed by another.

    While the closure that was open at the beginning stays open, the second's steps hold for the clocks that have not stalled
    in the first; a clock known to the first goes to one step of the second.
    """
    bounds, state, since, gain = (x.copy() for x in first)
    for q in range(len(tt.STATES)):
        clockless = q not in (CLOSING, CLOSED, OPENING)
        if not clockless and first[2][q, -1] == KEPT:
            # Step 0 holds stalled closures if they can stall here, the others the closure itself.
            to, waits = first[1][q, -1], first[0][q, 0] if first[1][q, 0] != first[1][q, -1] else -FAR
            bounds[q] = np.maximum(second[0][to], waits)
            if second[0][to, 0] == FAR:
                # The second does not ask for the clock.
                bounds[q, 0] = waits
            for own, theirs in ((state, second[1]), (since, second[2]), (gain, second[3])):
                own[q] = theirs[to]
                if waits > -FAR:
                    own[q, 0] = theirs[STALLED, 0]
            continue
        for step in range(STEPS):
            s, c, g = (int(x[q, step]) for x in first[1:])
            at = int((c >= second[0][s]).sum()) if s in (CLOSING, CLOSED, OPENING) else 0
            state[q, step], gain[q, step] = second[1][s, at], g + second[3][s, at]
            since[q, step] = c if second[2][s, at] == KEPT else second[2][s, at]
    return bounds, state, since, gain


#: Of frames that count for a turn: whether all are turned, first time, last time of each side in the leading hold, passed
#: sides by holds whose start is known, and the clock at the end.
TURN = ("all_turned", "first", "lead_left", "lead_right", "left", "right", "tail")


def turn_effects(segment: np.ndarray, at: np.ndarray, left: np.ndarray, turned: np.ndarray, runs: int, hold_ms: int) -> np.ndarray:
    """(run, 7) effects on the clock of a turned head. A run without frames is all turned and has no first time (``FAR``)."""
    out = np.tile(np.array([1, FAR, -FAR, -FAR, 0, 0, KEPT]), (runs, 1))
    if not len(at):
        return out
    here, begins = np.unique(segment, return_index=True)
    ends = np.append(begins[1:], len(at))
    dense = np.searchsorted(here, segment)
    index = np.arange(len(at))
    # The last frame before each that is not turned, in its own run: a hold starts behind it.
    stopped = np.maximum.accumulate(np.where(turned, -1, index))
    start = np.maximum(stopped + 1, begins[dense])
    held = turned & (at - at[np.minimum(start, len(at) - 1)] >= hold_ms)
    leading = turned & (stopped < begins[dense])
    for column, side in ((2, left), (3, ~left)):
        np.maximum.at(out[:, column], segment[leading & side], at[leading & side])
    for column, side in ((4, left), (5, ~left)):
        np.maximum.at(out[:, column], segment[held & side], 1)
    whole = np.logical_and.reduceat(turned, begins)
    out[here, 0] = whole
    out[here, 1] = np.where(turned[begins], at[begins], FAR)
    final = start[ends - 1]
    out[here, 6] = np.where(whole, KEPT, np.where(turned[ends - 1], at[np.minimum(final, len(at) - 1)], STOPPED))
    return out


def joined_turns(first: np.ndarray, second: np.ndarray, hold_ms: int) -> np.ndarray:
    """Effect of two stretches in a row on the turn clock."""
    out = first.copy()
    if first[0]:
        began = min(first[1], second[1])
        out[0], out[1] = second[0], began
        out[2:4] = np.maximum(first[2:4], second[2:4])
        out[6] = second[6]
    else:
        began = first[6]
        out[6] = second[6] if not second[0] else (first[6] if first[6] != STOPPED else (second[1] if second[1] != FAR else STOPPED))
    known = began if began != STOPPED else second[1]
    out[4:6] = first[4:6] | second[4:6] | (second[2:4] - known >= hold_ms)
    return out
