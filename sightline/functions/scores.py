"""Quality scores of detections as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.geometry import clamp


def sharpness_quality(sharpness: Column) -> Column:
    return sharpness / (sharpness + 150.0)


def frontality(yaw: Column, roll: Column) -> Column:
    return clamp(1 - (F.abs(yaw) / 50.0 + F.abs(roll) / 35.0))


def eyes_open(left: Column, right: Column) -> Column:
    return clamp(F.least(left, right))


def recognition_quality(sharpness: Column, yaw: Column, roll: Column, width: Column) -> Column:
    return clamp(0.45 * sharpness_quality(sharpness) + 0.35 * frontality(yaw, roll) + 0.20 * clamp(width / 160.0))


def rep_score(sharpness: Column, yaw: Column, roll: Column, left_eye: Column, right_eye: Column, smile: Column, width: Column, solo: Column) -> Column:
    """How well a detection represents its person; nearly closed eyes count a fifth."""
    eyes = eyes_open(left_eye, right_eye)
    eyes = F.when(eyes < 0.35, eyes * 0.2).otherwise(eyes)
    return 0.38 * sharpness_quality(sharpness) + 0.24 * frontality(yaw, roll) + 0.18 * eyes + 0.10 * clamp(smile) + 0.08 * clamp(width / 320.0) + F.when(solo, 0.08).otherwise(0.0)


def pose(yaw: Column, pitch: Column, roll: Column) -> Column:
    return clamp(1 - (0.5 * F.abs(yaw) / 45.0 + 0.3 * F.abs(pitch) / 35.0 + 0.2 * F.abs(roll) / 30.0))


def unclipped(b: Column, frame_width: Column, frame_height: Column, inset: float = 0.015) -> Column:
    x, y = frame_width * F.lit(inset), frame_height * F.lit(inset)
    return (b["left"] >= x) & (b["top"] >= y) & (b["right"] <= frame_width - x) & (b["bottom"] <= frame_height - y)


def fully_visible(b: Column, frame_width: Column, frame_height: Column) -> Column:
    """Within an inset of 1 %; false for a null box, true for an unknown frame."""
    return F.when(b.isNull(), False).when((frame_width <= 0) | (frame_height <= 0), True).otherwise(unclipped(b, frame_width, frame_height, 0.01))


def clearance(b: Column, frame_width: Column, frame_height: Column, landmarks: Column) -> Column:
    """landmarks: share of landmarks that were found."""
    return F.when(unclipped(b, frame_width, frame_height), 0.6).otherwise(0.1) + 0.4 * landmarks


def resolution(b: Column) -> Column:
    return clamp(F.least(b["right"] - b["left"], b["bottom"] - b["top"]) / 112.0)


def face_quality_fast(sharpness: Column, yaw: Column, pitch: Column, roll: Column, b: Column, frame_width: Column, frame_height: Column, landmarks: Column) -> Column:
    """Quality without embedding; 0 for an empty box."""
    score = 0.35 * clamp(sharpness_quality(sharpness)) + 0.30 * pose(yaw, pitch, roll) + 0.20 * resolution(b) + 0.15 * clearance(b, frame_width, frame_height, landmarks)
    return F.when((b["right"] <= b["left"]) | (b["bottom"] <= b["top"]), 0.0).otherwise(clamp(score))


def stability(has_base: Column, similarity: Column) -> Column:
    """From the similarity of an embedding to that of the perturbed crop: 0.2 without the first, 0.5 without the second."""
    return F.when(~has_base, 0.2).when(similarity.isNull(), 0.5).otherwise(clamp((similarity - 0.4) / 0.6))


def face_quality_full(stable: Column, sharpness: Column, yaw: Column, pitch: Column, roll: Column, b: Column, frame_width: Column, frame_height: Column, landmarks: Column) -> Column:
    score = (0.35 * stable + 0.30 * clamp(sharpness_quality(sharpness)) + 0.20 * pose(yaw, pitch, roll) + 0.15 * resolution(b)) * clearance(b, frame_width, frame_height, landmarks)
    return F.when((b["right"] <= b["left"]) | (b["bottom"] <= b["top"]), 0.0).otherwise(clamp(score))


def solo_portrait(b: Column, frame_width: Column, frame_height: Column, solo: Column, others: Column) -> Column:
    """others: number of other boxes in the frame. In upright frames the box is centred and straddles the middle."""
    cx = (b["left"] + b["right"]) / 2.0
    upright = (cx >= frame_width * 0.36) & (cx <= frame_width * 0.64) & (b["left"] < frame_width * 0.49) & (b["right"] > frame_width * 0.51)
    wide = (cx >= frame_width * 0.25) & (cx <= frame_width * 0.75)
    alone = solo & (others == 0)
    return F.when(~alone, False).when(b.isNull() | (frame_width <= 0) | (frame_height <= 0), True).otherwise(F.when(frame_height > frame_width, upright).otherwise(wide))


def high_frequency_ratio(laplacian_variance: Column) -> Column:
    return laplacian_variance / (laplacian_variance + 60.0)


def luma(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
