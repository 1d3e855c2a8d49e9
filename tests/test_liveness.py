"""Recorded frames and streams of frames against a frame-by-frame walk."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docuvet.operators import liveness, timed_table
from docuvet.params import LivenessParams, TimedLivenessParams
from docuvet.sources.readers import read_frames_stream
from docuvet.streaming.liveness import FRAME_SCHEMA, OUTPUT_SCHEMA, TimedSession, liveness_stream, stream_summary

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "session_id string, ts timestamp, event_id long, challenge string, face_count int, ear_l double, ear_r double, yaw double"


def make_frames(seed, sessions=6, count=160):
    """Realistic runs: open and closed stretches, turns, and a few lost or doubled faces."""
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        # The first session is far longer than the others, as a shared default id would be.
        level, yaw, challenge = 0.30, 0.0, "BLINK_TWICE"
        for i in range(count * (5 if s == 0 else 1)):
            if rng.random() < 0.25:
                level = rng.choice([0.30, 0.31, 0.10, 0.05, 0.22])
            if i % 50 == 49:
                challenge = rng.choice(["BLINK_TWICE", "TURN_LEFT", "TURN_RIGHT"])
            yaw = rng.choice([yaw, yaw, 15.0, -15.0, 0.0])
            faces = 0 if rng.random() < 0.004 * s else 2 if rng.random() < 0.02 else 1
            rows.append((f"s{s}", START + datetime.timedelta(milliseconds=40 * i), len(rows), challenge, faces,
                         level + rng.random() * 0.02, level + rng.random() * 0.02, yaw))
    return rows


def walk(rows, p=LivenessParams()):
    """The rules, one frame at a time."""
    st, base, calib, hist, blinks, closed, hold, ch, done = "FACE_NOT_DETECTED", None, [], [], 0, 0, 0, "BLINK_TWICE", set()
    for _, _, _, challenge, faces, left, right, yaw in rows:
        if challenge != ch:
            ch, hold = challenge, 0
        if faces > 1:
            continue
        if faces == 0:
            st, closed, calib = "FACE_NOT_DETECTED", 0, []
            continue
        now = (right + left) / 2
        hist = (hist + [now])[-p.smooth_frames:]
        ear = sum(hist) / len(hist)
        if base is None:
            calib.append(ear)
            if len(calib) < 3:
                st = "CALIBRATING"
                continue
            a, b = sorted(calib)[1:]
            base, st = max(0.20, min(0.38, b - (b - a) * 0.5)), "EYES_OPEN"
        shut = max(0.12, base * 0.55)
        if ch == "BLINK_TWICE":
            if st == "EYES_OPEN" and ear <= base * 0.70:
                st, closed = "EYE_CLOSING", 1
            elif st == "EYE_CLOSING":
                if ear <= shut or max(left, right) <= shut:
                    st, closed = "EYES_CLOSED", closed + 1
                elif ear >= base * 0.85:
                    st, closed = "EYES_OPEN", 0
                else:
                    closed += 1
            elif st == "EYES_CLOSED":
                if ear <= shut:
                    closed += 1
                    st = "STALLED_CLOSED" if closed > 12 else st
                elif max(ear, now) >= base * 0.70:
                    st = "EYE_OPENING"
            elif st == "EYE_OPENING":
                if max(ear, now) >= base * 0.80:
                    st, closed, blinks = "BLINK_CONFIRMED", 0, blinks + 1
                elif ear <= shut:
                    st, closed = "EYES_CLOSED", closed + 1
            elif st == "BLINK_CONFIRMED" or (st == "STALLED_CLOSED" and ear >= base * 0.80):
                st, closed = "EYES_OPEN", 0
            if blinks >= 2:
                done.add(ch)
        else:
            turned = yaw >= 12 if ch == "TURN_LEFT" else yaw <= -12
            hold = hold + 1 if turned else max(0, hold - 1)
            if turned and hold >= 2:
                done.add(ch)
    return blinks, "BLINK_TWICE" in done, "TURN_LEFT" in done, "TURN_RIGHT" in done, len(done) == 3, st


def expected(rows, params=LivenessParams()):
    return {s: (len(f),) + walk(f, params) for s in {r[0] for r in rows} for f in [[r for r in rows if r[0] == s]]}


def summary(df):
    names = ("frames", "blink_count", "blink_passed", "left_passed", "right_passed", "all_passed", "last_state")
    return {r.session_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("chunk_seconds", [1, 5, 3600])
def test_batch_equals_walk_for_any_chunk(spark, chunk_seconds):
    rows = make_frames(1)
    want = expected(rows)
    assert max(w[1] for w in want.values()) > 5
    got = summary(liveness.session_summary(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk_seconds))
    assert got == want


@pytest.mark.parametrize("smooth", [1, 3, 4])
def test_any_smoothing_equals_walk(spark, smooth):
    rows, params = make_frames(3, sessions=4, count=80), LivenessParams(smooth_frames=smooth)
    got = summary(liveness.session_summary(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, params))
    assert got == expected(rows, params)


def run_stream(spark, rows, tmp_path, files, processor=None):
    frames = spark.createDataFrame(rows, SCHEMA)
    source = tmp_path / f"in{files}"
    # One file per micro-batch, in the order of time.
    size = -(-len(rows) // files)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for i in range(files):
        part = spark.createDataFrame(ordered[i * size:(i + 1) * size] or [], frames.schema).coalesce(1)
        part.write.mode("append").json(str(source))
    out, state = str(tmp_path / f"out{files}"), str(tmp_path / f"cp{files}")
    stream = liveness_stream(read_frames_stream(spark, str(source), files_per_trigger=1), processor)
    run = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out)


def test_stream_equals_walk_in_two_cuts(spark, tmp_path):
    rows = make_frames(2, sessions=4, count=60)
    want = expected(rows)
    for files in (1, 3):
        assert summary(stream_summary(run_stream(spark, rows, tmp_path, files))) == want


def timed_rows(ears, step_ms, challenge="BLINK_TWICE", yaw=0.0):
    return [("t", START + datetime.timedelta(milliseconds=step_ms * i), i, challenge, 1, e, e, yaw) for i, e in enumerate(ears)]


def test_timed_blinks_and_turn(spark, tmp_path):
    blink = [0.30] * 3 + [0.05] * 6 + [0.30] * 6
    rows = timed_rows([0.30] * 6 + blink + blink, 40)
    rows += [("t", START + datetime.timedelta(milliseconds=5000 + 100 * i), 1000 + i, "TURN_LEFT", 1, 0.3, 0.3, 15.0) for i in range(5)]
    result = run_stream(spark, rows, tmp_path, 2, TimedSession())
    last = result.orderBy(F.desc("event_id")).first()
    assert last.blink_count == 2 and last.challenge_passed and last.progress == 100.0
    held = {r.event_id: r.challenge_passed for r in result.filter("challenge = 'TURN_LEFT'").collect()}
    assert held == {1000: False, 1001: False, 1002: False, 1003: True, 1004: True}


def test_replayed_frames_count_once(spark):
    rows = make_frames(4, sessions=2, count=30)
    twice = spark.createDataFrame(rows + rows, SCHEMA)
    assert summary(liveness.session_summary(liveness.dedupe_frames(twice), 5)) == expected(rows)


def test_timed_table_equals_rules():
    """The transition table against the rules in words, over every condition and closure time."""
    following, blinks = timed_table.timed_tables()
    name = timed_table.STATES
    for place in range(1 << len(timed_table.CONDITIONS)):
        bit = {c: bool(place >> i & 1) for i, c in enumerate(timed_table.CONDITIONS)}
        for time in timed_table.ANY_TIME:
            got = {name[i]: (name[following[place, time, i]], int(blinks[place, time, i])) for i in range(len(name))}
            closed = ("STALLED_CLOSED", 0) if time == 3 else (("BLINK_CONFIRMED", 1) if time == 1 else ("EYES_OPEN", 0)) if bit["is_back"] else None
            for state in ("EYES_CLOSED", "EYES_OPENING"):
                assert got[state] == (closed or (("EYES_OPENING", 0) if bit["rises"] else (state, 0)))
            assert got["EYES_OPEN"] == ("EYES_CLOSING" if bit["begins_to_shut"] else "EYES_OPEN", 0)
            assert got["EYES_CLOSING"] == ("EYES_CLOSED" if bit["is_shut"] else "EYES_OPEN" if bit["is_wide"] else "EYES_CLOSING", 0)
            assert got["BLINK_CONFIRMED"] == ("EYES_OPEN", 0)
            assert got["STALLED_CLOSED"] == ("EYES_OPEN" if bit["mean_is_back"] else "STALLED_CLOSED", 0)


@pytest.mark.parametrize(("ms", "time"), [(None, 0), (34, 0), (35, 1), (2000, 1), (2001, 2), (2500, 2), (2501, 3)])
def test_closure_times(ms, time):
    assert timed_table.closure_time(ms, TimedLivenessParams()) == time


def run_batches(spark, tmp_path, batches, processor=None):
    """Each list of frames is one micro-batch of the stream."""
    source, out = tmp_path / "src", str(tmp_path / "out")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAME_SCHEMA).coalesce(1).write.mode("append").json(str(source))
        stream = liveness_stream(read_frames_stream(spark, str(source)), processor)
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out)


def frame(session, seconds, event, ear=0.30, challenge="BLINK_TWICE", yaw=0.0, reset=False):
    return (session, START + datetime.timedelta(seconds=seconds), event, challenge, 1, ear, ear, yaw, reset)


def test_sessions_expire_reset_and_count_late_frames(spark, tmp_path):
    open_eyes = [frame("a", 0.1 * i, i) for i in range(5)]
    shut = [frame("a", 1 + 0.1 * i, 10 + i, e) for i, e in enumerate([0.2, 0.2, 0.05, 0.05, 0.05, 0.25, 0.3, 0.3])]
    late, replayed = frame("a", 0.95, 50), shut[-1]
    reset = [frame("a", 3, 60, reset=True), *[frame("a", 3.1 + 0.1 * i, 61 + i) for i in range(3)]]
    far = [frame("b", 100, 70)]
    farther = [frame("b", 101, 71)]
    rows = run_batches(spark, tmp_path, [open_eyes + shut, [late, replayed], reset, far, farther])
    by_event = {r.event_id: r for r in rows.filter("session_id = 'a'").collect()}
    assert by_event[17].blink_count == 1 and by_event[17].late_frames == 0
    assert 50 not in by_event and 60 not in by_event and by_event[61].late_frames == 1
    assert by_event[61].blink_count == 0 and by_event[61].state == "CALIBRATING" and by_event[63].state == "EYES_OPEN"
    ended = by_event[None]
    assert ended.state == "SESSION_EXPIRED" and not ended.challenge_passed
    summed = {r.session_id: r for r in stream_summary(rows).collect()}
    assert summed["a"].expired and summed["a"].frames == 16 and not summed["b"].expired


def test_batch_counts_from_the_last_reset(spark):
    """Recorded frames with control rows give what the walk over the frames behind the last of them gives."""
    rows = make_frames(6, sessions=3, count=90)
    resets = [("s1", START + datetime.timedelta(milliseconds=40 * n + 1), 10_000 + n) for n in (5, 40)] + [("gone", START, 1)]
    control = [(s, at, e, None, None, None, None, None, True) for s, at, e in resets]
    df = spark.createDataFrame([(*r, None if r[2] % 2 else False) for r in rows] + control, SCHEMA + ", reset boolean")
    kept = [r for r in rows if r[0] != "s1" or (r[1], r[2]) > (resets[1][1], resets[1][2])]
    assert 0 < len(rows) - len(kept) < 90
    assert summary(liveness.session_summary(liveness.since_reset(df), 5)) == expected(kept)
