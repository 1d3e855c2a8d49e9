"""Thresholds and weights as frozen parameter sets (they become literals in the plan)."""

from dataclasses import dataclass
from decimal import Decimal as D


@dataclass(frozen=True)
class GateParams:
    min_width: int = 380
    min_height: int = 380
    recommended_width: int = 800
    recommended_height: int = 600
    min_blur: D = D("45")
    warning_blur: D = D("75")
    min_luminance: D = D("35")
    max_luminance: D = D("248")
    washed_out_contrast: D = D("20")
    max_glare: D = D("0.20")
    max_skew: D = D("18")
    edge_std: D = D("40")
    min_cropped_edges: int = 2


@dataclass(frozen=True)
class TamperParams:
    """Three capped shares; a share reaches its cap at its full-scale value."""

    ela_full: int = 42
    ela_cap: int = 20
    texture_full: int = 32
    texture_cap: int = 15
    edge_full: int = 80
    edge_cap: int = 15


TAMPER_V1 = TamperParams(ela_full=35, ela_cap=45, texture_full=25, texture_cap=35, edge_full=200, edge_cap=20)


@dataclass(frozen=True)
class FaceParams:
    pass_mark: D = D("70.0")
    cosine_pass: float = 0.363
    cosine_full: float = 0.80
    min_face_px: int = 40
    min_crop_blur: D = D("20")
    min_crop_luminance: D = D("25")
    max_crop_luminance: D = D("245")


@dataclass(frozen=True)
class RiskParams:
    document_weight: D = D("0.35")
    consistency_weight: D = D("0.25")
    face_weight: D = D("0.25")
    liveness_weight: D = D("0.15")
    verified_max: D = D("28.0")
    suspicious_max: D = D("58.0")


@dataclass(frozen=True)
class LivenessParams:
    """Frame-counting variant (camera frames handled on the server)."""

    smooth_frames: int = 2
    calibration_frames: int = 3
    baseline_min: float = 0.20
    baseline_max: float = 0.38
    open_factor: float = 0.85
    closing_factor: float = 0.70
    closed_factor: float = 0.55
    closed_floor: float = 0.12
    reopen_factor: float = 0.80
    stall_frames: int = 12
    turn_yaw: float = 12.0
    turn_frames: int = 2
    blinks: int = 2


@dataclass(frozen=True)
class TimedLivenessParams:
    """Clock-driven variant (landmarks handled in the browser)."""

    smooth_frames: int = 3
    calibration_frames: int = 6
    baseline_min: float = 0.22
    baseline_max: float = 0.40
    open_factor: float = 0.85
    closing_factor: float = 0.70
    closed_factor: float = 0.52
    closed_floor: float = 0.12
    reopen_factor: float = 0.80
    stall_ms: int = 2500
    min_blink_ms: int = 35
    max_blink_ms: int = 2000
    turn_yaw: float = 12.0
    turn_hold_ms: int = 300
    blinks: int = 2
