"""Boxes are structs of left, top, right, bottom; all helpers are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def centre_x(b: Column) -> Column:
    return (b["left"] + b["right"]) / F.lit(2.0)


def centre_y(b: Column) -> Column:
    return (b["top"] + b["bottom"]) / F.lit(2.0)


def area(b: Column) -> Column:
    return width(b) * height(b)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def intersection(a: Column, b: Column) -> Column:
    """Common area; 0 when the boxes don't meet."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def intersects(a: Column, b: Column) -> Column:
    return intersection(a, b) > 0


def contains(outer: Column, inner: Column) -> Column:
    return (outer["left"] <= inner["left"]) & (outer["top"] <= inner["top"]) & (outer["right"] >= inner["right"]) & (outer["bottom"] >= inner["bottom"])


def iou(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Intersection over union; 0 when disjoint, empty when the union is; null for a null box."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    ratio = F.when((common > 0) & (union > 0), common.cast("double") / union.cast("double")).when(union == 0, F.lit(empty)).otherwise(F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), ratio)


def over_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 when either is empty."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b).cast("double") / small.cast("double")).otherwise(F.lit(0.0))


def drift(a: Column, b: Column) -> Column:
    """Distance of the centres in widths of the wider box."""
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b)) / F.greatest(width(a), width(b), F.lit(1)).cast("double")


def scale_ratio(a: Column, b: Column) -> Column:
    return F.least(width(a), width(b)).cast("double") / F.greatest(width(a), width(b), F.lit(1)).cast("double")


def motion_score(a: Column, b: Column, reach: float = 1.5) -> Column:
    return clamp(1 - drift(a, b) / F.lit(reach))


def match_score(a: Column, b: Column, same_id: Column, appearance: Column, min_scale: float = 0.55, min_iou: float = 0.3, max_drift: float = 1.1, min_appearance: float = 0.25) -> Column:
    """How well a detection continues a track; 0 when a gate fails or a box is null."""
    overlap, away = iou(a, b), drift(a, b)
    near = (overlap >= min_iou) | (away <= max_drift) | (same_id & (overlap > 0.1))
    score = overlap + clamp(1 - away / F.lit(max_drift)) * 0.4 + F.when(same_id, 0.5).otherwise(0.0) + appearance * 0.25
    passes = a.isNotNull() & b.isNotNull() & (scale_ratio(a, b) >= min_scale) & near & (appearance >= min_appearance)
    return F.when(passes, score).otherwise(F.lit(0.0))


def association_score(a: Column, b: Column, appearance: Column) -> Column:
    """Tracker score of a predicted box and a detection; an unknown appearance counts one half."""
    return 0.5 * F.coalesce(appearance, F.lit(0.5)) + 0.3 * iou(a, b) + 0.2 * motion_score(a, b)


def continues(a: Column, b: Column, max_drift: float = 1.5, min_scale: float | None = None) -> Column:
    """Whether one box lies where the other could go on; false for null boxes."""
    ok = drift(a, b) <= max_drift
    if min_scale is not None:
        ok = ok & (scale_ratio(a, b) >= min_scale)
    return F.coalesce(ok, F.lit(False))


def scale_box(b: Column, factor: Column, frame_width: Column, frame_height: Column) -> Column:
    """A box in another resolution, clipped to its frame."""
    at = lambda x, most: F.least(F.greatest((x * factor).cast("int"), F.lit(0)), most)
    return box(at(b["left"], frame_width), at(b["top"], frame_height), at(b["right"], frame_width), at(b["bottom"], frame_height))


def fill_crop(source_w: Column, source_h: Column, target_w: Column, target_h: Column, bias: float = 0.35) -> Column:
    """The part of a source that fills a target's aspect: centred across, nearer to the top."""
    wide = source_w / source_h > target_w / target_h
    w = F.when(wide, source_h * target_w / target_h).otherwise(source_w)
    h = F.when(wide, source_h).otherwise(source_w * target_h / target_w)
    left, top = (source_w - w) / 2, (source_h - h) * F.lit(bias)
    return box(left, top, left + w, top + h)


def roll_degrees(left_eye: Column, right_eye: Column, most: float = 35.0) -> Column:
    """The roll that levels the eyes, of which the subject's left one is to the right in the image; 0 beyond the largest angle that is corrected."""
    angle = F.degrees(F.atan2(left_eye["y"] - right_eye["y"], left_eye["x"] - right_eye["x"]))
    return F.when(F.abs(angle) <= most, angle).otherwise(F.lit(0.0))


#: Tilt of the cards in degrees, by place.
TILT = (-4.5, 3.8, -2.6, 4.2, -3.4, 2.9, -4.0, 3.2)


def grid_slot(i: Column, n: Column, canvas_width: float = 1080.0, top: float = 370.0, bottom: float = 1790.0, aspect: float = 0.78) -> Column:
    """Place and size of card i of n: one, two, three or four columns for up to 1, 4, 9 and more cards; each row centred by itself."""
    columns = F.when(n == 1, 1).when(n <= 4, 2).when(n <= 9, 3).otherwise(4)
    rows = F.ceil(n / columns)
    margin = F.when(columns >= 4, 40.0).otherwise(60.0)
    gutter = F.when(columns >= 4, 14.0).otherwise(22.0)
    cell_w = (F.lit(canvas_width) - margin * 2 - gutter * (columns - 1)) / columns
    cell_h = (F.lit(bottom - top) - gutter * (rows - 1)) / rows
    w = F.least(cell_w, cell_h * aspect)
    h = F.least(w / aspect, cell_h)
    w = F.least(w, h * aspect)
    row = F.floor(i / columns)
    in_row = F.least(columns, n - row * columns)
    x = (F.lit(canvas_width) - (in_row * w + gutter * (in_row - 1))) / 2
    y = F.lit(top) + (F.lit(bottom - top) - (rows * h + gutter * (rows - 1))) / 2
    return F.struct((x + (i % columns) * (w + gutter) + w / 2).alias("cx"), (y + row * (h + gutter) + h / 2).alias("cy"), w.alias("w"), h.alias("h"))
