"""Liveness queries over recorded frames."""

import dataclasses

from pyspark.sql import functions as F

from docuvet.functions import landmarks
from docuvet.operators import liveness
from docuvet.params import TimedLivenessParams
from docuvet.plans.derive import CHUNK_DAY
from docuvet.plans.registry import query

_FRAMES = """f AS (SELECT *, CAST(ear_l AS DOUBLE) AS l, CAST(ear_r AS DOUBLE) AS r, (CAST(ear_r AS DOUBLE) + CAST(ear_l AS DOUBLE)) / 2.0 AS inst,
  row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM <frames>),
one AS (SELECT session_id, event_id, inst, lag(inst) OVER w AS p1, lag(inst, 2) OVER w AS p2 FROM f WHERE face_count = 1 WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
sm AS (SELECT session_id, event_id, CASE WHEN p1 IS NULL THEN inst ELSE (p1 + inst) / 2.0 END AS s2,
  CASE WHEN p1 IS NULL THEN inst WHEN p2 IS NULL THEN (p1 + inst) / 2.0 ELSE (p2 + p1 + inst) / 3.0 END AS s3 FROM one)"""


@query("ear_smoothing", f"WITH {_FRAMES} SELECT session_id, event_id, round(s2, 6) AS smoothed_2, round(s3, 6) AS smoothed_3 FROM sm")
def ear_smoothing(t):
    two = liveness.smoothed_ear(t.frames, CHUNK_DAY, 2).select("session_id", "event_id", F.round("smoothed", 6).alias("smoothed_2"))
    three = liveness.smoothed_ear(t.frames, CHUNK_DAY, 3).select("session_id", "event_id", F.round("smoothed", 6).alias("smoothed_3"))
    return two.join(three, ["session_id", "event_id"])


@query("face_runs", """
SELECT session_id, face_run, count(*) AS frames FROM (SELECT session_id, sum(CASE WHEN face_count = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS face_run FROM <frames>) GROUP BY 1, 2""")
def face_runs(t):
    return liveness.face_runs(t.frames, CHUNK_DAY).groupBy("session_id", "face_run").agg(F.count("*").alias("frames"))


# One frame per step and session, as the camera would deliver them.
_MACHINE = f"""WITH RECURSIVE {_FRAMES},
g AS (SELECT f.*, CAST(f.yaw AS DOUBLE) AS y, sm.s2 AS s FROM f LEFT JOIN sm USING (session_id, event_id)),
m AS (
SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, 'FACE_NOT_DETECTED' AS st, CAST(NULL AS DOUBLE) AS b, CAST([] AS DOUBLE[]) AS calib, 0 AS blinks, 0 AS closed, 0 AS hold, 'BLINK_TWICE' AS ch, false AS db, false AS dl, false AS dr FROM f
UNION ALL
SELECT session_id, rn, CASE WHEN NOT act OR challenge <> 'BLINK_TWICE' THEN st1
    WHEN st1 IN ('EYES_OPEN', 'CALIBRATING', 'FACE_DETECTED') THEN CASE WHEN s <= b1 * 0.70::DOUBLE THEN 'EYE_CLOSING' ELSE st1 END
    WHEN st1 = 'EYE_CLOSING' THEN CASE WHEN s <= thc OR (r <= thc AND l <= thc) THEN 'EYES_CLOSED' WHEN s >= b1 * 0.85::DOUBLE THEN 'EYES_OPEN' ELSE st1 END
    WHEN st1 = 'EYES_CLOSED' THEN CASE WHEN s <= thc THEN CASE WHEN closed1 + 1 > 12 THEN 'STALLED_CLOSED' ELSE st1 END WHEN s >= b1 * 0.70::DOUBLE OR inst >= b1 * 0.70::DOUBLE THEN 'EYE_OPENING' ELSE st1 END
    WHEN st1 = 'EYE_OPENING' THEN CASE WHEN s >= b1 * 0.80::DOUBLE OR inst >= b1 * 0.80::DOUBLE THEN 'BLINK_CONFIRMED' WHEN s <= thc THEN 'EYES_CLOSED' ELSE st1 END
    WHEN st1 = 'BLINK_CONFIRMED' THEN 'EYES_OPEN'
    WHEN st1 = 'STALLED_CLOSED' THEN CASE WHEN s >= b1 * 0.80::DOUBLE THEN 'EYES_OPEN' ELSE st1 END ELSE st1 END,
  b1, calib1, blinks1, CASE WHEN NOT act OR challenge <> 'BLINK_TWICE' THEN closed1
    WHEN st1 IN ('EYES_OPEN', 'CALIBRATING', 'FACE_DETECTED') AND s <= b1 * 0.70::DOUBLE THEN 1
    WHEN st1 = 'EYE_CLOSING' THEN CASE WHEN s <= thc OR (r <= thc AND l <= thc) THEN closed1 + 1 WHEN s >= b1 * 0.85::DOUBLE THEN 0 ELSE closed1 + 1 END
    WHEN st1 = 'EYES_CLOSED' AND s <= thc THEN closed1 + 1
    WHEN st1 = 'EYE_OPENING' THEN CASE WHEN s >= b1 * 0.80::DOUBLE OR inst >= b1 * 0.80::DOUBLE THEN 0 WHEN s <= thc THEN closed1 + 1 ELSE closed1 END
    WHEN st1 = 'STALLED_CLOSED' AND s >= b1 * 0.80::DOUBLE THEN 0 ELSE closed1 END,
  hold2, challenge, db OR (act AND challenge = 'BLINK_TWICE' AND blinks1 >= 2), dl OR (act AND challenge = 'TURN_LEFT' AND y >= 12 AND hold2 >= 2), dr OR (act AND challenge = 'TURN_RIGHT' AND y <= -12 AND hold2 >= 2)
FROM (SELECT *, CASE WHEN act AND challenge = 'TURN_LEFT' THEN CASE WHEN y >= 12 THEN hold1 + 1 ELSE greatest(0, hold1 - 1) END
    WHEN act AND challenge = 'TURN_RIGHT' THEN CASE WHEN y <= -12 THEN hold1 + 1 ELSE greatest(0, hold1 - 1) END ELSE hold1 END AS hold2,
  blinks + CASE WHEN act AND challenge = 'BLINK_TWICE' AND st1 = 'EYE_OPENING' AND (s >= b1 * 0.80::DOUBLE OR inst >= b1 * 0.80::DOUBLE) THEN 1 ELSE 0 END AS blinks1
FROM (SELECT *, face_count = 1 AND b1 IS NOT NULL AS act, greatest(0.12::DOUBLE, b1 * 0.55::DOUBLE) AS thc,
  CASE WHEN face_count = 0 THEN 'FACE_NOT_DETECTED' WHEN face_count = 1 AND b IS NULL THEN CASE WHEN b1 IS NULL THEN 'CALIBRATING' ELSE 'EYES_OPEN' END ELSE st END AS st1
FROM (SELECT *, CASE WHEN face_count = 1 AND b IS NULL AND len(calib1) >= 3 THEN greatest(0.20::DOUBLE, least(0.38::DOUBLE, list_sort(calib1)[3] - (list_sort(calib1)[3] - list_sort(calib1)[2]) * 0.5::DOUBLE)) ELSE b END AS b1
FROM (SELECT m.session_id, g.rn, m.st, m.b, m.blinks, m.db, m.dl, m.dr, g.challenge, g.face_count, g.s, g.inst, g.l, g.r, g.y,
  CASE WHEN g.challenge <> m.ch THEN 0 ELSE m.hold END AS hold1, CASE WHEN g.face_count = 0 THEN 0 ELSE m.closed END AS closed1,
  CASE WHEN g.face_count = 0 THEN CAST([] AS DOUBLE[]) WHEN g.face_count = 1 AND m.b IS NULL THEN list_append(m.calib, g.s) ELSE m.calib END AS calib1
FROM m JOIN g ON g.session_id = m.session_id AND g.rn = m.rn + 1)))))"""


@query("liveness_sessions", f"""{_MACHINE}
SELECT session_id, rn AS frames, CAST(blinks AS BIGINT) AS blink_count, db AS blink_passed, dl AS left_passed, dr AS right_passed, db AND dl AND dr AS all_passed, st AS last_state
FROM m WHERE (session_id, rn) IN (SELECT (session_id, max(rn)) FROM f GROUP BY session_id)""")
def liveness_sessions(t):
    return liveness.session_summary(liveness.dedupe_frames(t.frames), CHUNK_DAY).select(
        "session_id", "frames", "blink_count", "blink_passed", "left_passed", "right_passed", "all_passed", "last_state")


_RESET = "(event_id % 61 = 0)"
_SINCE = f"""(SELECT f.* FROM <frames> f LEFT JOIN (SELECT session_id, max(struct_pack(ts := ts, event_id := event_id)) AS last FROM <frames> WHERE {_RESET} GROUP BY 1) r USING (session_id)
  WHERE NOT {_RESET} AND (last IS NULL OR struct_pack(ts := f.ts, event_id := f.event_id) > last))"""


@query("reset_sessions", f"""{_MACHINE.replace('<frames>', _SINCE)}
SELECT session_id, rn AS frames, CAST(blinks AS BIGINT) AS blink_count, db AS blink_passed, dl AS left_passed, dr AS right_passed, db AND dl AND dr AS all_passed, st AS last_state
FROM m WHERE (session_id, rn) IN (SELECT (session_id, max(rn)) FROM f GROUP BY session_id)""")
def reset_sessions(t):
    frames = liveness.dedupe_frames(t.frames).withColumn("reset", F.expr(_RESET))
    return liveness.session_summary(liveness.since_reset(frames), CHUNK_DAY).select(
        "session_id", "frames", "blink_count", "blink_passed", "left_passed", "right_passed", "all_passed", "last_state")


# The clock of the recorded frames runs so many times slower than a camera's.
SLOW = 250_000
SLOW_PARAMS = dataclasses.replace(
    TimedLivenessParams(), **{name: getattr(TimedLivenessParams(), name) * SLOW for name in ("stall_ms", "min_blink_ms", "max_blink_ms", "turn_hold_ms")}
)

# The clock-driven machine, one frame per step and session.
_TIMED = f"""WITH RECURSIVE {_FRAMES},
g AS (SELECT f.*, CAST(f.yaw AS DOUBLE) AS y, sm.s3 AS s, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM f LEFT JOIN sm USING (session_id, event_id)),
m AS (
SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS rn, 'NO_FACE' AS st, CAST(NULL AS DOUBLE) AS b, CAST([] AS DOUBLE[]) AS calib, 0 AS blinks, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS turn, false AS db, false AS dl, false AS dr FROM f
UNION ALL
SELECT session_id, rn, CASE WHEN NOT blinking THEN st1
    WHEN st1 = 'EYES_OPEN' THEN CASE WHEN shut <= b1 * 0.70::DOUBLE THEN 'EYES_CLOSING' ELSE st1 END
    WHEN st1 = 'EYES_CLOSING' THEN CASE WHEN shut <= greatest(0.12::DOUBLE, b1 * 0.52::DOUBLE) THEN 'EYES_CLOSED' WHEN s >= b1 * 0.85::DOUBLE THEN 'EYES_OPEN' ELSE st1 END
    WHEN st1 IN ('EYES_CLOSED', 'EYES_OPENING') THEN CASE WHEN ms - since > {2500 * SLOW} THEN 'STALLED_CLOSED' WHEN back >= b1 * 0.80::DOUBLE THEN CASE WHEN blinked THEN 'BLINK_CONFIRMED' ELSE 'EYES_OPEN' END
      WHEN greatest(s, l, r) >= b1 * 0.70::DOUBLE THEN 'EYES_OPENING' ELSE st1 END
    WHEN st1 = 'BLINK_CONFIRMED' THEN 'EYES_OPEN'
    WHEN st1 = 'STALLED_CLOSED' AND s >= b1 * 0.80::DOUBLE THEN 'EYES_OPEN' ELSE st1 END,
  b1, calib1, blinks + blinked::INT, CASE WHEN blinking AND st1 = 'EYES_OPEN' AND shut <= b1 * 0.70::DOUBLE THEN ms ELSE since END,
  CASE WHEN NOT turning THEN turn WHEN turned THEN coalesce(turn, ms) END, db OR (blinking AND blinks + blinked::INT >= 2),
  dl OR (turning AND turned AND challenge = 'TURN_LEFT' AND ms - coalesce(turn, ms) >= {300 * SLOW}), dr OR (turning AND turned AND challenge = 'TURN_RIGHT' AND ms - coalesce(turn, ms) >= {300 * SLOW})
FROM (SELECT *, blinking AND st1 IN ('EYES_CLOSED', 'EYES_OPENING') AND ms - since BETWEEN {35 * SLOW} AND {2000 * SLOW} AND back >= b1 * 0.80::DOUBLE AS blinked
FROM (SELECT *, face_count = 1 AND b1 IS NOT NULL AND challenge = 'BLINK_TWICE' AS blinking, face_count = 1 AND b1 IS NOT NULL AND challenge <> 'BLINK_TWICE' AS turning,
  CASE challenge WHEN 'TURN_LEFT' THEN y >= 12 ELSE y <= -12 END AS turned, least(s, greatest(l, r)) AS shut, greatest(s, least(l, r)) AS back,
  CASE WHEN face_count = 0 THEN 'NO_FACE' WHEN face_count = 1 AND b IS NULL THEN CASE WHEN b1 IS NULL THEN 'FACE_STABILIZING' ELSE 'EYES_OPEN' END ELSE st END AS st1
FROM (SELECT *, CASE WHEN face_count = 1 AND b IS NULL AND len(calib1) >= 6 THEN greatest(0.22::DOUBLE, least(0.40::DOUBLE, list_sort(calib1)[5])) WHEN face_count <> 0 THEN b END AS b1
FROM (SELECT m.session_id, g.rn, m.st, m.b, m.blinks, m.since, m.turn, m.db, m.dl, m.dr, g.challenge, g.face_count, g.s, g.l, g.r, g.y, g.ms,
  CASE WHEN g.face_count = 0 THEN CAST([] AS DOUBLE[]) WHEN g.face_count = 1 AND m.b IS NULL THEN list_append(m.calib, g.s) ELSE m.calib END AS calib1
FROM m JOIN g ON g.session_id = m.session_id AND g.rn = m.rn + 1)))))"""


@query("timed_liveness_sessions", f"""{_TIMED}
SELECT session_id, rn AS frames, CAST(blinks AS BIGINT) AS blink_count, db AS blink_passed, dl AS left_passed, dr AS right_passed, db AND dl AND dr AS all_passed, st AS last_state
FROM m WHERE (session_id, rn) IN (SELECT (session_id, max(rn)) FROM f GROUP BY session_id)""")
def timed_liveness_sessions(t):
    return liveness.timed_session_summary(liveness.dedupe_frames(t.frames), CHUNK_DAY, SLOW_PARAMS)


# The recorded frames lie minutes apart; a hold is judged on their own scale of time.
@query("turn_holds", """
WITH a AS (SELECT *, CASE WHEN yaw >= 12 THEN 'LEFT' WHEN yaw <= -12 THEN 'RIGHT' ELSE 'NONE' END AS side FROM <frames> WHERE face_count = 1),
b AS (SELECT *, CASE WHEN side <> coalesce(lag(side) OVER (PARTITION BY session_id ORDER BY ts, event_id), '') THEN 1 ELSE 0 END AS starts FROM a),
c AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS island FROM b)
SELECT session_id, island, side, count(*) AS frames, floor(epoch_us(max(ts)) / 1000) - floor(epoch_us(min(ts)) / 1000) AS held_ms,
  floor(epoch_us(max(ts)) / 1000) - floor(epoch_us(min(ts)) / 1000) >= 300 AS passed FROM c WHERE side <> 'NONE' GROUP BY 1, 2, 3""")
def turn_holds(t):
    return liveness.turn_holds(t.frames, CHUNK_DAY)


@query("session_windows", """
WITH a AS (SELECT session_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM <frames>),
b AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS attempt FROM a)
SELECT session_id, count(*) AS frames, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM b GROUP BY session_id, attempt""")
def session_windows(t):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return liveness.session_windows(t.frames, 6 * 3600).select("session_id", "frames", shown("started"), shown("expires"))


@query("challenge_sequence", """
SELECT challenge, CASE challenge WHEN 'BLINK_TWICE' THEN 'TURN_LEFT' WHEN 'TURN_LEFT' THEN 'TURN_RIGHT' ELSE 'COMPLETE' END AS following, count(*) AS frames FROM <frames> GROUP BY 1, 2""")
def challenge_sequence(t):
    following = liveness.next_challenge(F.col("challenge"))
    return t.frames.groupBy("challenge", following.alias("following")).agg(F.count("*").alias("frames"))


_X, _Y = "[CAST((event_id * i * 7 % 97) AS DOUBLE) / 97 FOR i IN range(1, 469)]", "[CAST((event_id * i * 11 % 89) AS DOUBLE) / 89 FOR i IN range(1, 469)]"
_dist = lambda a, b: f"sqrt((x[{a}] - x[{b}]) * (x[{a}] - x[{b}]) + (y[{a}] - y[{b}]) * (y[{a}] - y[{b}]))"


def _ear(outer, inner, up1, up2, low1, low2):
    width = _dist(outer + 1, inner + 1)
    return f"CASE WHEN {width} >= 0.001::DOUBLE THEN greatest(0.04::DOUBLE, least(0.5::DOUBLE, ({_dist(up1 + 1, low1 + 1)} + {_dist(up2 + 1, low2 + 1)}) / ({width} * 2.0::DOUBLE))) ELSE 0.28::DOUBLE END"


@query("landmark_metrics", f"""
SELECT event_id, round({_ear(33, 133, 160, 158, 144, 153)}, 6) AS ear_left, round({_ear(263, 362, 385, 387, 380, 373)}, 6) AS ear_right,
  round(CASE WHEN abs(x[455] - x[235]) >= 0.01::DOUBLE THEN greatest(-60.0::DOUBLE, least(60.0::DOUBLE, ((x[235] + x[455]) / 2.0::DOUBLE - x[2]) / (abs(x[455] - x[235]) * 0.5::DOUBLE) * 38.0::DOUBLE)) ELSE 0.0::DOUBLE END, 6) AS yaw,
  round(greatest(-60.0::DOUBLE, least(60.0::DOUBLE, (x[3] * 100 - (x[1] * 100 + x[2] * 100) / 2.0::DOUBLE) / (greatest(10.0::DOUBLE, abs(x[2] * 100 - x[1] * 100)) * 0.5::DOUBLE) * 30.0::DOUBLE)), 1) AS server_yaw
FROM (SELECT event_id, {_X} AS x, {_Y} AS y FROM events)""")
def landmark_metrics(t):
    i = F.sequence(F.lit(1), F.lit(468))
    point = lambda k: F.struct(
        ((F.col("event_id") * k * 7 % 97).cast("double") / 97).alias("x"), ((F.col("event_id") * k * 11 % 89).cast("double") / 89).alias("y"),
        F.lit(0.0).alias("z"))
    meshes = t.events.select("event_id", F.transform(i, point).alias("p"))
    p, x = F.col("p"), lambda k: F.get("p", k)["x"] * 100
    return meshes.select(
        "event_id", F.round(landmarks.eye_aspect_ratio(p), 6).alias("ear_left"),
        F.round(landmarks.eye_aspect_ratio(p, landmarks.fixed.RIGHT_EYE), 6).alias("ear_right"),
        F.round(landmarks.mesh_yaw(p), 6).alias("yaw"), landmarks.eye_line_yaw(x(0), x(1), x(2)).alias("server_yaw"))
