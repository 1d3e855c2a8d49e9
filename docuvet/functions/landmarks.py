"""Eye aspect ratio and head yaw from face-mesh points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuvet import fixed


def _distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def eye_aspect_ratio(points: Column, eye: dict = fixed.LEFT_EYE) -> Column:
    """Mean lid distance over eye width, within 0.04 to 0.50; 0.28 where points are missing."""
    p = {name: F.get(points, index) for name, index in eye.items()}
    width = _distance(p["outer"], p["inner"])
    ratio = (_distance(p["up1"], p["low1"]) + _distance(p["up2"], p["low2"])) / (width * 2.0)
    return F.coalesce(F.when(width >= 0.001, F.greatest(F.lit(0.04), F.least(F.lit(0.50), ratio))), F.lit(0.28))


def mesh_yaw(points: Column) -> Column:
    """Yaw in degrees from nose tip and temples; positive towards the person's own left."""
    nose, left, right = (F.get(points, i)["x"] for i in (fixed.NOSE_TIP, fixed.LEFT_TEMPLE, fixed.RIGHT_TEMPLE))
    width = F.abs(right - left)
    yaw = ((left + right) / 2.0 - nose) / (width * 0.5) * 38.0
    return F.coalesce(F.when(width >= 0.01, F.greatest(F.lit(-60.0), F.least(F.lit(60.0), yaw))), F.lit(0.0))


def eye_line_yaw(right_eye_x: Column, left_eye_x: Column, nose_x: Column) -> Column:
    """Yaw in degrees from the eye centres and the nose of a detected face, to one decimal."""
    half = F.greatest(F.lit(10.0), F.abs(left_eye_x - right_eye_x)) * 0.5
    yaw = (nose_x - (right_eye_x + left_eye_x) / 2.0) / half * 30.0
    return F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), yaw)), 1)
