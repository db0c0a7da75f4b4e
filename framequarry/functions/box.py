"""Box algebra as Column expressions. A box is four columns x, y, w, h (top left corner, width, height)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four Column expressions."""

    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h


def box(prefix: str = "", of: Column | None = None) -> Box:
    """The box in columns <prefix>x, <prefix>y, ... or in the fields of a struct."""
    if of is not None:
        return Box(of["x"], of["y"], of["w"], of["h"])
    return Box(*[F.col(prefix + c) for c in "xywh"])


def area(b: Box) -> Column:
    return b.w * b.h


def center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / F.lit(2.0), b.y + b.h / F.lit(2.0)


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.hypot(ax - bx, ay - by)


def diagonal(b: Box) -> Column:
    return F.hypot(b.w, b.h)


def overlap(a: Box, b: Box) -> Column:
    """Shared area; 0 for boxes that only touch or lie apart."""
    zero = F.lit(0.0)
    wide = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    high = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(wide, zero) * F.greatest(high, zero)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without an intersection or a union."""
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def diou(a: Box, b: Box) -> Column:
    """IoU less the squared centre distance over the squared diagonal of the common hull."""
    least = F.lit(1e-9)
    shared = overlap(a, b)
    ratio = shared / F.greatest(area(a) + area(b) - shared, least)
    (ax, ay), (bx, by) = center(a), center(b)
    apart = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    wide = F.greatest(a.right, b.right) - F.least(a.x, b.x)
    high = F.greatest(a.bottom, b.bottom) - F.least(a.y, b.y)
    return ratio - apart / F.greatest(wide * wide + high * high, least)


def clip_corners(b: Box, width: Column, height: Column) -> Box:
    """Both corners moved into the image: what lies outside is cut off."""
    zero = F.lit(0.0)
    x1, y1 = F.greatest(zero, F.least(b.x, width)), F.greatest(zero, F.least(b.y, height))
    x2, y2 = F.greatest(zero, F.least(b.right, width)), F.greatest(zero, F.least(b.bottom, height))
    return Box(x1, y1, F.greatest(x2 - x1, zero), F.greatest(y2 - y1, zero))


def shift_clamp(b: Box, width: Column, height: Column) -> tuple[Box, Column]:
    """The corner moves into the image but the size shrinks only at the far edges; and whether anything changed.

    A box that starts left of the image keeps its width, other than under clip_corners().
    """
    zero = F.lit(0.0)
    x, y = F.least(F.greatest(b.x, zero), width), F.least(F.greatest(b.y, zero), height)
    w, h = F.greatest(F.least(b.w, width - x), zero), F.greatest(F.least(b.h, height - y), zero)
    moved = (x != b.x) | (y != b.y) | (w != b.w) | (h != b.h)
    return Box(x, y, w, h), moved


def to_corners(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x, b.y, b.right, b.bottom


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    return Box(x1, y1, x2 - x1, y2 - y1)


def as_struct(b: Box) -> Column:
    return F.struct(b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"))
