"""Liveness challenges over recorded camera frames.

Blink and turn challenges depend on the order of frames, but their rules form small finite
machines. Frames are dealt by ranges of session and time, every partition is reduced to its effect on each possible
start state, and a session's effects, one a partition, are chained. No session is gathered whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.operators import blink_table as bt
from docuvet.operators import timed_effects as te
from docuvet.operators import timed_table as tt
from docuvet.operators.ordered import time_chunk, with_carried
from docuvet.params import LivenessParams, TimedLivenessParams

KEY, ORDER = "session_id", ["ts", "event_id"]


def dedupe_frames(frames: DataFrame) -> DataFrame:
    """Replayed frames count once."""
    return frames.dropDuplicates([KEY, "event_id"])


def since_reset(frames: DataFrame) -> DataFrame:
    """Frames after the last reset of their session; rows with ``reset`` set are control rows, no frames.

    A reset leaves nothing of a session behind, so its challenges are judged on what comes after. One row per session that was
    reset is joined; a session that never was keeps all its frames.
    """
    control = F.coalesce(F.col("reset"), F.lit(False))
    last = frames.filter(control).groupBy(F.col(KEY).alias("_key")).agg(F.max(F.struct(*ORDER)).alias("_at"))
    joined = frames.filter(~control).join(last, F.col(KEY).eqNullSafe(F.col("_key")), "left")
    return joined.filter(F.col("_at").isNull() | (F.struct(*ORDER) > F.col("_at"))).drop("_key", "_at", "reset")


def smoothed_ear(frames: DataFrame, chunk_seconds: int, count: int = 2) -> DataFrame:
    """Frames with exactly one face, with the mean eye ratio of the last two or three of them."""
    single = frames.filter(F.col("face_count") == 1).withColumns(
        {
            "chunk": time_chunk(F.col("ts"), chunk_seconds),
            "ear_l": F.col("ear_l").cast("double"), "ear_r": F.col("ear_r").cast("double"), "yaw": F.col("yaw").cast("double"),
        }
    ).withColumn("ear", (F.col("ear_r") + F.col("ear_l")) / 2.0)
    names = ["ear"]
    for i in range(1, count):
        single = with_carried(single, KEY, ORDER, {f"ear_{i}": names[-1]})
        names.append(f"ear_{i}")
    # Oldest first, as the mean of a short history is summed.
    total = sum((F.coalesce(c, F.lit(0.0)) for c in reversed(names)), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return single.withColumn("smoothed", total / n.cast("double")).drop(*names[1:])


def face_runs(frames: DataFrame, chunk_seconds: int) -> DataFrame:
    """Number the uninterrupted stretches of a session: each frame without a face starts a new one."""
    chunked = frames.withColumn("chunk", time_chunk(F.col("ts"), chunk_seconds))
    return with_carried(chunked, KEY, ORDER, {}, {"face_run": F.col("face_count") == 0})


def baselines(rows: DataFrame, params: LivenessParams = LivenessParams()) -> DataFrame:
    """Open-eye baseline per session and the frame that completed its calibration.

    The samples are the first frames of a stretch; the first stretch long enough counts.
    """
    n = params.calibration_frames
    w = Window.partitionBy(KEY, "face_run").orderBy(*ORDER)
    samples = rows.filter(F.col("face_count") == 1).select(KEY, *ORDER, "face_run", "smoothed")
    first = samples.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= n)
    per_run = first.groupBy(KEY, "face_run").agg(
        F.count("*").alias("_n"), F.sort_array(F.collect_list("smoothed")).alias("_s"),
        F.max(F.struct(*ORDER)).alias("calibrated_at"),
    ).filter(F.col("_n") == n)
    place = 0.75 * (n - 1)
    low, high = F.get("_s", int(place)), F.get("_s", min(int(place) + 1, n - 1))
    share = place - int(place)
    level = high - (high - low) * (1 - share) if share >= 0.5 else low + (high - low) * share
    base = F.greatest(F.lit(params.baseline_min), F.least(F.lit(params.baseline_max), level))
    earliest = F.min_by(F.struct(base.alias("baseline"), "calibrated_at"), "face_run")
    return per_run.groupBy(KEY).agg(earliest.alias("b")).select(KEY, "b.baseline", "b.calibrated_at")


def blink_bits(base: Column, smoothed: Column, params) -> dict[str, Column]:
    """Comparisons of one frame with the thresholds of its session."""
    closing, reopen = base * params.closing_factor, base * params.reopen_factor
    closed = F.greatest(F.lit(params.closed_floor), base * params.closed_factor)
    ear, left, right = F.col("ear"), F.col("ear_l"), F.col("ear_r")
    return {
        "le_closing": smoothed <= closing,
        "le_closed": smoothed <= closed,
        "both_le_closed": (right <= closed) & (left <= closed),
        "ge_open": smoothed >= base * params.open_factor,
        "any_ge_closing": (smoothed >= closing) | (ear >= closing),
        "any_ge_reopen": (smoothed >= reopen) | (ear >= reopen),
        "ge_reopen": smoothed >= reopen,
    }


def carried_frames(frames: DataFrame, chunk_seconds: int, smooth_frames: int) -> DataFrame:
    """Frames with what earlier ones leave to them: the previous challenge, the stretch with a face, and the smoothed eye ratio."""
    number = lambda c: F.col(c).cast("double")
    timed = frames.withColumns(
        {"chunk": time_chunk(F.col("ts"), chunk_seconds), "ear_l": number("ear_l"), "ear_r": number("ear_r"), "yaw": number("yaw")}
    ).withColumn("ear", F.when(F.col("face_count") == 1, (F.col("ear_r") + F.col("ear_l")) / 2.0))
    # Earlier values of frames with one face are carried, one pass for each that the mean needs; the first pass carries the rest too.
    rows = with_carried(timed, KEY, ORDER, {"previous": "challenge", "ear_1": "ear"}, {"face_run": F.col("face_count") == 0})
    for i in range(2, smooth_frames):
        rows = with_carried(rows.withColumn("_own", F.when(F.col("ear").isNotNull(), F.col(f"ear_{i - 1}"))), KEY, ORDER, {f"ear_{i}": "_own"}).drop("_own")
    values = ["ear", *[f"ear_{i}" for i in range(1, smooth_frames)]]
    # Oldest first, as the mean of a short history is summed.
    total = sum((F.coalesce(c, F.lit(0.0)) for c in reversed(values)), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    return rows.withColumn("smoothed", F.when(F.col("ear").isNotNull(), total / known.cast("double"))).drop(*values[1:])


def frame_symbols(frames: DataFrame, chunk_seconds: int, params: LivenessParams = LivenessParams()) -> DataFrame:
    """One small number per frame and challenge machine."""
    rows = carried_frames(frames, chunk_seconds, params.smooth_frames)
    rows = rows.join(baselines(rows, params), KEY, "left")
    active = F.coalesce(
        (F.col("face_count") == 1) & (F.struct(*ORDER) >= F.col("calibrated_at")), F.lit(False)
    )
    # A face lost before calibration leaves nothing to lose.
    lost = F.coalesce((F.col("face_count") == 0) & (F.struct(*ORDER) > F.col("calibrated_at")), F.lit(False))
    bits = blink_bits(F.col("baseline"), F.col("smoothed"), params)
    code = sum((bits[name].cast("int") * (1 << i) for i, name in enumerate(bt.BITS)), F.lit(0))
    switch = F.when(F.col("challenge") != F.coalesce("previous", F.lit("BLINK_TWICE")), bt.TURN_SWITCH).otherwise(0)

    def turn(name: str, held: Column) -> Column:
        move = F.when(active & (F.col("challenge") == name), F.when(held, bt.TURN_UP).otherwise(bt.TURN_DOWN))
        return switch + F.coalesce(move, F.lit(bt.TURN_NONE))

    return rows.select(
        KEY, "chunk", *ORDER, "face_count",
        F.when(lost, bt.FACE_LOST).when(active & (F.col("challenge") == "BLINK_TWICE"), code).otherwise(bt.NO_CHANGE).alias("blink"),
        turn("TURN_LEFT", F.col("yaw") >= params.turn_yaw).alias("left"),
        turn("TURN_RIGHT", F.col("yaw") <= -params.turn_yaw).alias("right"),
        F.col("baseline").isNotNull().alias("calibrated"),
    )


EFFECTS = ("blink", "gain", "left", "right")


def frame_effects(symbols: DataFrame, params: LivenessParams = LivenessParams()) -> DataFrame:
    """Effect of consecutive frames on each possible state of the three machines: one row per session and partition.

    Frames are dealt by ranges of (session, time, frame), so a session of any length spreads over partitions; each partition
    joins the effects of its frames batch by batch and keeps one row per session.
    """
    following, gains = bt.blink_tables(params)
    turning = bt.turn_table(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            codes = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy()
            changed = np.append(True, codes[1:] != codes[:-1])
            segment, first = np.cumsum(changed) - 1, np.flatnonzero(changed)
            blink, left, right = (batch.column(i).to_numpy() for i in (3, 4, 5))
            found = bt.compose_segments(segment, len(first), blink, following, gains, bt.NO_CHANGE)
            sides = [bt.compose_segments(segment, len(first), s, turning, None, bt.TURN_NONE)[0] for s in (left, right)]
            effects = [found[0], found[1], *sides]
            rows = batch.take(pa.array(first)).select([0, 1, 2])
            if held is not None:
                if held[0].column(0)[0].as_py() == rows.column(0)[0].as_py():
                    before = held[1]
                    effects[1][0] = before[1] + effects[1][0][before[0]]
                    for i in (0, 2, 3):
                        effects[i][0] = effects[i][0][before[i]]
                    rows = pa.concat_batches([held[0], rows.slice(1)])
                else:
                    yield packed(held[0], [e[None, :] for e in held[1]])
            if len(rows) > 1:
                yield packed(rows.slice(0, len(rows) - 1), [e[:-1] for e in effects])
            held = rows.slice(len(rows) - 1), [e[-1].copy() for e in effects]
        if held is not None:
            yield packed(held[0], [e[None, :] for e in held[1]])

    def packed(rows: pa.RecordBatch, effects: list[np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array(list(e.astype(np.int32)), pa.list_(pa.int32())) for e in effects]
        return pa.RecordBatch.from_arrays([*rows.columns, *lists], names=[KEY, *ORDER, *EFFECTS])

    kinds = dict(symbols.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (KEY, *ORDER)], *[f"{c} array<int>" for c in EFFECTS]])
    ordered = symbols.select(KEY, *ORDER, *[F.col(c).cast("int") for c in ("blink", "left", "right")])
    return ordered.repartitionByRange(KEY, *ORDER).sortWithinPartitions(KEY, *ORDER).mapInArrow(run, schema)


def session_summary(frames: DataFrame, chunk_seconds: int = 60, params: LivenessParams = LivenessParams()) -> DataFrame:
    """Challenges passed, blinks and last state per session.

    The effects of a session's partitions, one row each, are chained from the first state. ``chunk_seconds`` bounds the windows
    that carry earlier values to a frame.
    """
    symbols = frame_symbols(frames, chunk_seconds, params)
    seen = F.col("face_count") < 2
    counted = symbols.groupBy(KEY).agg(
        F.count("*").alias("frames"), F.max("calibrated").alias("calibrated"), F.max(F.when(seen, F.struct(*ORDER, "face_count"))).alias("last_seen")
    )
    parts = F.sort_array(F.collect_list(F.struct(*ORDER, *EFFECTS)))
    start = F.struct(*[F.lit(0).alias(c) for c in EFFECTS])
    chained = F.aggregate(parts, start, lambda acc, e: F.struct(
        F.get(e["blink"], acc["blink"]).alias("blink"), (acc["gain"] + F.get(e["gain"], acc["blink"])).alias("gain"),
        F.get(e["left"], acc["left"]).alias("left"), F.get(e["right"], acc["right"]).alias("right"),
    ))
    ends = frame_effects(symbols, params).groupBy(KEY).agg(chained.alias("end"))
    names = F.array(*[F.lit(name) for name, _ in bt.blink_states(params)])
    uncalibrated = F.when(F.col("last_seen.face_count") == 1, "CALIBRATING").otherwise(bt.LOST)
    passed = {
        "blink_passed": F.col("end.gain") >= params.blinks,
        "left_passed": F.col("end.left") == params.turn_frames,
        "right_passed": F.col("end.right") == params.turn_frames,
    }
    return counted.join(ends.withColumnRenamed(KEY, "_key"), F.col(KEY).eqNullSafe(F.col("_key"))).select(
        KEY, "frames", F.col("end.gain").cast("long").alias("blink_count"), *[c.alias(n) for n, c in passed.items()],
        F.when(F.col("calibrated"), F.get(names, F.col("end.blink"))).otherwise(uncalibrated).alias("last_state"),
    ).withColumn("all_passed", F.col("blink_passed") & F.col("left_passed") & F.col("right_passed"))


def run_baselines(rows: DataFrame, params: TimedLivenessParams) -> DataFrame:
    """Open-eye baseline of every stretch with a face that is long enough, and the frame that completed its calibration."""
    n = params.calibration_frames
    order = Window.partitionBy(KEY, "face_run").orderBy(*ORDER)
    samples = rows.filter(F.col("face_count") == 1).select(KEY, *ORDER, "face_run", "smoothed")
    first = samples.withColumn("_pos", F.row_number().over(order)).filter(F.col("_pos") <= n)
    level = F.get(F.sort_array(F.collect_list("smoothed")), int(0.75 * n))
    bounded = F.greatest(F.lit(params.baseline_min), F.least(F.lit(params.baseline_max), level))
    return first.groupBy(F.col(KEY).alias("_key"), F.col("face_run").alias("_run")).agg(
        F.count("*").alias("_n"), bounded.alias("baseline"), F.max(F.struct(*ORDER)).alias("calibrated_at")
    ).filter(F.col("_n") == n).drop("_n")


def timed_symbols(frames: DataFrame, chunk_seconds: int, params: TimedLivenessParams = TimedLivenessParams()) -> DataFrame:
    """What the clock-driven machine needs of each frame: its milliseconds, conditions, fresh calibration, and turn.

    Every stretch with a face is calibrated anew, by its own first frames.
    """
    rows = carried_frames(frames, chunk_seconds, params.smooth_frames)
    same = F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("face_run") == F.col("_run"))
    rows = rows.join(run_baselines(rows, params), same, "left").drop("_key", "_run")
    here, base, eye = F.struct(*ORDER), F.col("baseline"), F.col("smoothed")
    active = F.coalesce((F.col("face_count") == 1) & (here >= F.col("calibrated_at")), F.lit(False))
    closing, closed, reopen = base * params.closing_factor, F.greatest(F.lit(params.closed_floor), base * params.closed_factor), base * params.reopen_factor
    shut, back = F.least(eye, F.greatest("ear_l", "ear_r")), F.greatest(eye, F.least("ear_l", "ear_r"))
    # The order of these is that of the conditions of the transition table.
    met = (shut <= closing, shut <= closed, eye >= base * params.open_factor, F.greatest(eye, "ear_l", "ear_r") >= closing, back >= reopen, eye >= reopen)
    code = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(met)), F.lit(0))
    blink, left, right = (active & (F.col("challenge") == c) for c in ("BLINK_TWICE", "TURN_LEFT", "TURN_RIGHT"))
    fresh = F.coalesce(active & (here == F.col("calibrated_at")), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        KEY, *ORDER, "face_count", F.unix_millis("ts").alias("at"), F.when(no(blink), code).otherwise(0).alias("conditions"), fresh.alias("fresh"),
        (no(blink) | fresh).alias("blinks"), no(left).alias("left"), (no(left) | no(right)).alias("turns"),
        no(F.when(left, F.col("yaw") >= params.turn_yaw).when(right, F.col("yaw") <= -params.turn_yaw)).alias("turned"), active.alias("active"),
    )


TIMED_EFFECTS = ("bounds", "state", "since", "gain", "turn")


def timed_effects(symbols: DataFrame, params: TimedLivenessParams = TimedLivenessParams()) -> DataFrame:
    """Effect of consecutive frames on the clock-driven machines: one row per session and partition, as in ``frame_effects``.

    Frames are dealt by ranges of (session, time, frame). A batch of frames is reduced to one effect per session at once, and a
    session's effects are joined from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            codes = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy()
            changed = np.append(True, codes[1:] != codes[:-1])
            segment, first = np.cumsum(changed) - 1, np.flatnonzero(changed)
            at, conditions, fresh, blinks, left, turns, turned = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 10))
            found = te.blink_effects(te.Frames(segment[blinks], at[blinks], conditions[blinks], fresh[blinks]), len(first), params)
            sides = te.turn_effects(segment[turns], at[turns], left[turns], turned[turns], len(first), params.turn_hold_ms)
            rows = batch.take(pa.array(first)).select([0, 1, 2])
            if held is not None:
                if held[0].column(0)[0].as_py() == rows.column(0)[0].as_py():
                    for array, value in zip(found, te.joined(held[1], tuple(x[0] for x in found)), strict=True):
                        array[0] = value
                    sides[0] = te.joined_turns(held[2], sides[0], params.turn_hold_ms)
                    rows = pa.concat_batches([held[0], rows.slice(1)])
                else:
                    yield packed(held[0], [x[None] for x in held[1]], held[2][None])
            if len(rows) > 1:
                yield packed(rows.slice(0, len(rows) - 1), [x[:-1] for x in found], sides[:-1])
            held = rows.slice(len(rows) - 1), tuple(x[-1].copy() for x in found), sides[-1].copy()
        if held is not None:
            yield packed(held[0], [x[None] for x in held[1]], held[2][None])

    def packed(rows: pa.RecordBatch, found: list[np.ndarray], sides: np.ndarray) -> pa.RecordBatch:
        lists = [pa.array(list(x.reshape(len(rows), -1)), pa.list_(pa.int64())) for x in (*found, sides)]
        return pa.RecordBatch.from_arrays([*rows.columns, *lists], names=[KEY, *ORDER, *TIMED_EFFECTS])

    kinds = dict(symbols.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (KEY, *ORDER)], *[f"`{c}` array<bigint>" for c in TIMED_EFFECTS]])
    ordered = symbols.select(KEY, *ORDER, "at", F.col("conditions").cast("long"), "fresh", "blinks", "left", "turns", "turned")
    return ordered.repartitionByRange(KEY, *ORDER).sortWithinPartitions(KEY, *ORDER).mapInArrow(run, schema)


def timed_session_summary(frames: DataFrame, chunk_seconds: int = 60, params: TimedLivenessParams = TimedLivenessParams()) -> DataFrame:
    """Challenges passed, blinks and last state per session by the clock-driven rules, as the stream's ``TimedSession`` gives them.

    Closures count by their duration, a turn by how long it is held, and a lost face means a new calibration. The effects of a
    session's partitions, one row each, are chained from open eyes; ``chunk_seconds`` is as in ``session_summary``. Missing eye
    ratios and angles meet no condition; a null session is a session of its own; no frames, no rows.
    """
    symbols = timed_symbols(frames, chunk_seconds, params)
    seen = F.col("face_count") < 2
    counted = symbols.groupBy(KEY).agg(
        F.count("*").alias("frames"), F.max(F.when(seen, F.struct(*ORDER, "face_count", "active"))).alias("last_seen")
    )
    zero = lambda n=0: F.lit(n).cast("long")
    start = F.struct(
        zero().alias("state"), zero().alias("since"), zero().alias("gain"), F.lit(False).alias("left"), F.lit(False).alias("right"), zero(te.STOPPED).alias("turn")
    )

    def chain(acc: Column, e: Column) -> Column:
        bounds = F.slice(e["bounds"], (acc["state"] * te.BOUNDS + 1).cast("int"), te.BOUNDS)
        shut = acc["state"].between(te.CLOSING, te.OPENING)
        step = F.when(shut, F.size(F.filter(bounds, lambda b: acc["since"] >= b))).otherwise(0)
        place = (acc["state"] * te.STEPS + step).cast("int")
        since, turn = F.get(e["since"], place), [F.get(e["turn"], n) for n in range(len(te.TURN))]
        began = F.when(acc["turn"] != te.STOPPED, acc["turn"]).otherwise(turn[1])
        passed = lambda known, lead: (known == 1) | (lead - began >= params.turn_hold_ms)
        running = F.when(acc["turn"] != te.STOPPED, acc["turn"]).when(turn[1] != te.FAR, turn[1]).otherwise(zero(te.STOPPED))
        return F.struct(
            F.get(e["state"], place).alias("state"), F.when(since == te.KEPT, acc["since"]).otherwise(since).alias("since"),
            (acc["gain"] + F.get(e["gain"], place)).alias("gain"), (acc["left"] | passed(turn[4], turn[2])).alias("left"),
            (acc["right"] | passed(turn[5], turn[3])).alias("right"), F.when(turn[0] == 1, running).otherwise(turn[6]).alias("turn"),
        )

    parts = F.sort_array(F.collect_list(F.struct(*ORDER, *TIMED_EFFECTS)))
    ends = timed_effects(symbols, params).groupBy(F.col(KEY).alias("_key")).agg(F.aggregate(parts, start, chain).alias("end"))
    names = F.array(*[F.lit(s) for s in tt.STATES])
    state = F.when(F.col("last_seen.active"), F.get(names, F.col("end.state").cast("int"))).when(F.col("last_seen.face_count") == 1, tt.STABILIZING).otherwise(tt.NO_FACE)
    return counted.join(ends, F.col(KEY).eqNullSafe(F.col("_key"))).select(
        KEY, "frames", F.col("end.gain").alias("blink_count"), (F.col("end.gain") >= params.blinks).alias("blink_passed"),
        F.col("end.left").alias("left_passed"), F.col("end.right").alias("right_passed"), state.alias("last_state"),
    ).withColumn("all_passed", F.col("blink_passed") & F.col("left_passed") & F.col("right_passed"))


def turn_holds(frames: DataFrame, chunk_seconds: int, params: TimedLivenessParams = TimedLivenessParams()) -> DataFrame:
    """Stretches in which the head stays turned to one side, with their duration and whether it suffices."""
    chunked = frames.filter(F.col("face_count") == 1).withColumn("chunk", time_chunk(F.col("ts"), chunk_seconds))
    side = F.when(F.col("yaw") >= params.turn_yaw, "LEFT").when(F.col("yaw") <= -params.turn_yaw, "RIGHT").otherwise("NONE")
    sided = with_carried(chunked.withColumn("side", side), KEY, ORDER, {"previous_side": "side"})
    starts = F.col("side") != F.coalesce("previous_side", F.lit(""))
    islands = with_carried(sided, KEY, ORDER, {}, {"island": starts})
    held = (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("held_ms")
    stretches = islands.filter(F.col("side") != "NONE").groupBy(KEY, "island", "side").agg(F.count("*").alias("frames"), held)
    return stretches.withColumn("passed", F.col("held_ms") >= params.turn_hold_ms)


def session_windows(frames: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """Attempts of a session, separated by pauses longer than the allowed time.

    Frames of one stretch of ``gap_seconds`` always belong together, so they are joined on the map side first; only one row
    per session and stretch is put in order.
    """
    stretch = F.floor(F.unix_micros("ts") / F.lit(gap_seconds * 1_000_000))
    parts = frames.groupBy(KEY, stretch.alias("_stretch")).agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    order = Window.partitionBy(KEY).orderBy("_stretch")
    pause = F.unix_micros("low") - F.unix_micros(F.lag("high").over(order))
    starts = (F.coalesce(pause, F.lit(2**62)) > gap_seconds * 1_000_000).cast("long")
    numbered = parts.withColumn("_starts", starts).withColumn("_attempt", F.sum("_starts").over(order))
    return numbered.groupBy(KEY, "_attempt").agg(
        F.min("low").alias("started"), (F.max("high") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("expires"), F.sum("n").alias("frames")
    ).drop("_attempt")


def next_challenge(current: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in fixed.NEXT_CHALLENGE.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, current), F.lit("COMPLETE"))
