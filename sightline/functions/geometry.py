"""Column builders for boxes and points. A box is a tuple of four columns (x1, y1, x2, y2) in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", of: str | None = None) -> Box:
    """The columns x1, y1, x2, y2 with a prefix, or the fields of a struct column ``of``."""
    names = [f"{prefix}{k}" for k in ("x1", "y1", "x2", "y2")]
    return tuple(F.col(f"{of}.{n}" if of else n) for n in names)


def fields(s: Column) -> Box:
    return s["x1"], s["y1"], s["x2"], s["y2"]


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area; 0 for disjoint or empty boxes."""
    shared = overlap(a, b)
    return F.when(shared <= 0, 0.0).otherwise(F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0)))


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box that lies in the outer one; 0 for an empty inner box."""
    return F.coalesce(F.try_divide(overlap(inner, outer), area(inner)), F.lit(0.0))


def position_label(b: Box, frame_w: Column | float, frame_h: Column | float) -> Column:
    """Which of nine fields of the frame the centre is in, such as "top-left" or "middle-center"."""
    cx, cy = centre(b)
    third = lambda v, size, names: F.when(v < F.lit(size) / 3, names[0]).when(v < F.lit(size) * 2 / 3, names[1]).otherwise(names[2])
    return F.concat_ws("-", third(cy, frame_h, ("top", "middle", "bottom")), third(cx, frame_w, ("left", "center", "right")))


def to_pixels(cx: Column, cy: Column, w: Column, h: Column, frame_w: Column | float, frame_h: Column | float) -> Box:
    """A box given by normalised centre and size, in pixels and cut to the frame."""
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(most).cast("double"))
    return clip((cx - w / 2) * frame_w, frame_w), clip((cy - h / 2) * frame_h, frame_h), clip((cx + w / 2) * frame_w, frame_w), clip((cy + h / 2) * frame_h, frame_h)


def normalised(b: Box, frame_w: Column | float, frame_h: Column | float) -> tuple[Column, Column, Column, Column]:
    """Centre and size of a box as shares of the frame, each cut to 0..1."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    cx, cy = centre(b)
    return clip(cx / frame_w), clip(cy / frame_h), clip(width(b) / frame_w), clip(height(b) / frame_h)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, ax + t * dx, ay + t * dy)


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.degrees(F.atan2(by - ay, bx - ax))


def axis_difference(a: Column, b: Column) -> Column:
    """Degrees between two directions when a half turn makes no difference (0 to 90)."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def warp(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 homography (array of arrays); null where the scale is 0."""
    row = lambda k: h[k][0] * x + h[k][1] * y + h[k][2]
    return F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2))


def polyline_length(points: Column) -> Column:
    """Length of an array of (x, y) structs; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
