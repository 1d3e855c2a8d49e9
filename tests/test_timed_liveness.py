"""The clock-driven machine over recorded frames against the stream's own step, frame by frame."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from test_liveness import SCHEMA, START, run_stream

from docuvet.operators import liveness, timed_table
from docuvet.operators import timed_effects as te
from docuvet.params import TimedLivenessParams
from docuvet.streaming.liveness import TimedSession, _fresh, stream_summary

PARAMS = TimedLivenessParams()


def stepped(rows, params=PARAMS):
    """Summary of one session by the stream's step."""
    machine = TimedSession(params)
    machine.following, machine.gains = timed_table.timed_tables()
    s = _fresh(machine.LOST)
    for _, ts, event, challenge, faces, left, right, yaw in rows:
        machine.frame(Row(ts=ts, event_id=event, challenge=challenge, face_count=faces, ear_l=left, ear_r=right, yaw=yaw), s)
    passed = [c in s["passed"] for c in ("BLINK_TWICE", "TURN_LEFT", "TURN_RIGHT")]
    return len(rows), s["blinks"], *passed, all(passed), s["state"]


def recorded(seed, sessions=5, count=250):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        level, yaw, challenge, ms = 0.30, 0.0, "BLINK_TWICE", 0
        for i in range(count * (4 if s == 0 else 1)):
            ms += rng.choice([10, 20, 40, 40, 40, 300, 900]) if rng.random() > 0.01 else 2600
            if rng.random() < 0.3:
                level = rng.choice([0.30, 0.31, 0.10, 0.05, 0.22, 0.19])
            if rng.random() < 0.03:
                challenge = rng.choice(["BLINK_TWICE", "BLINK_TWICE", "TURN_LEFT", "TURN_RIGHT"])
            if rng.random() < 0.2:
                yaw = rng.choice([15.0, -15.0, 0.0])
            faces = 0 if rng.random() < 0.006 * s else 2 if rng.random() < 0.02 else 1
            rows.append((f"s{s}", START + datetime.timedelta(milliseconds=ms), len(rows), challenge, faces, level + rng.random() * 0.02, level + rng.random() * 0.02, yaw))
    return rows


def by_session(rows):
    return {s: [r for r in rows if r[0] == s] for s in dict.fromkeys(r[0] for r in rows)}


def summed(df):
    names = ("frames", "blink_count", "blink_passed", "left_passed", "right_passed", "all_passed", "last_state")
    return {r.session_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize(("seed", "parts", "batch"), [(1, 1, 10_000), (2, 7, 16), (3, 3, 3)])
def test_recorded_frames_equal_the_streams_step(spark, seed, parts, batch):
    rows = recorded(seed)
    want = {s: stepped(f) for s, f in by_session(rows).items()}
    assert max(w[1] for w in want.values()) > 3 and any(w[3] or w[4] for w in want.values())
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        # Small batches and many partitions, so that effects are joined in both ways.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert summed(liveness.timed_session_summary(spark.createDataFrame(rows, SCHEMA).repartition(4), 5)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_recorded_frames_equal_the_stream(spark, tmp_path):
    rows = recorded(9, sessions=3, count=120)
    streamed = summed(stream_summary(run_stream(spark, rows, tmp_path, 2, TimedSession())))
    assert summed(liveness.timed_session_summary(spark.createDataFrame(rows, SCHEMA))) == streamed


def test_short_and_faceless_sessions(spark):
    at = lambda n: START + datetime.timedelta(milliseconds=40 * n)
    rows = [("a", at(n), n, "BLINK_TWICE", 1, 0.3, 0.3, 0.0) for n in range(5)]
    rows += [("b", at(n), 100 + n, "BLINK_TWICE", 0, 0.3, 0.3, 0.0) for n in range(3)] + [("c", at(0), 200, "TURN_LEFT", 2, 0.3, 0.3, 0.0)]
    rows += [(None, at(n), 300 + n, "BLINK_TWICE", 1, 0.3, 0.3, 0.0) for n in range(6)]
    got = summed(liveness.timed_session_summary(spark.createDataFrame(rows, SCHEMA)))
    assert got == {s: stepped(f) for s, f in by_session(rows).items()}
    assert liveness.timed_session_summary(spark.createDataFrame([], SCHEMA)).collect() == []


def applied(effect, state, clock):
    """End state, clock and blinks of an effect from one state and clock."""
    bounds, to, since, gain = effect
    step = int((clock >= bounds[state]).sum()) if state in (te.CLOSING, te.CLOSED, te.OPENING) else 0
    return int(to[state, step]), int(clock if since[state, step] == te.KEPT else since[state, step]), int(gain[state, step])


def walked(frames, state, clock):
    """The transition table, one frame at a time."""
    following, gains = timed_table.timed_tables()
    blinks = 0
    for at, conditions, fresh in frames:
        if fresh:
            state = te.OPEN
        place = conditions, timed_table.closure_time(at - clock, PARAMS)
        before = state
        blinks += int(gains[place][before])
        state = int(following[place][before])
        if before == te.OPEN and state != te.OPEN:
            clock = at
    return state, clock, blinks


def possible(conditions):
    """Sets of conditions that a frame can meet: what the mean reaches, the eyes reach too."""
    shuts = {0, te.BEGINS, te.BEGINS | te.SHUT}
    rises = {0, te.RISES, te.RISES | te.BACK, te.RISES | te.BACK | te.MEAN_BACK, te.RISES | te.BACK | te.MEAN_BACK | te.WIDE}
    return sorted(a | b for a in shuts for b in rises)[conditions]


FRAME = st.tuples(st.sampled_from([0, 10, 40, 300, 700, 1500, 2600]), st.integers(0, 14), st.integers(0, 12).map(lambda n: n == 0))


@settings(max_examples=300, deadline=None)
@given(st.lists(FRAME, max_size=24), st.lists(st.integers(0, 24), max_size=4), st.integers(0, 5), st.sampled_from([0, 34, 35, 500, 1990, 2000, 2001, 2490, 2501, 9000]))
def test_effects_of_stretches_join_to_that_of_the_whole(steps, cuts, state, age):
    at, frames = 10_000, []
    for gap, conditions, fresh in steps:
        at += gap
        frames.append((at, possible(conditions), fresh))
    segment = np.zeros(len(frames), np.int64)
    for cut in cuts:
        segment[min(cut, len(frames)) :] += 1
    columns = [np.array([f[i] for f in frames], d) for i, d in ((0, np.int64), (1, np.int64), (2, bool))]
    runs = len(cuts) + 1
    found = te.blink_effects(te.Frames(segment, *columns), runs, PARAMS)
    clock = 10_000 - age
    # One after the other.
    s, c, blinks = state, clock, 0
    for r in range(runs):
        s, c, more = applied([x[r] for x in found], s, c)
        blinks += more
    want = walked(frames, state, clock)
    timed = lambda s, c, b: (s, c if s in (te.CLOSING, te.CLOSED, te.OPENING) else None, b)
    assert timed(s, c, blinks) == timed(*want)
    # Joined first, from the left and from the right.
    left = tuple(x[0] for x in found)
    for r in range(1, runs):
        left = te.joined(left, tuple(x[r] for x in found))
    assert timed(*applied(left, state, clock)) == timed(*want)
    right = tuple(x[-1] for x in found)
    for r in range(runs - 2, -1, -1):
        right = te.joined(tuple(x[r] for x in found), right)
    assert timed(*applied(right, state, clock)) == timed(*want)
