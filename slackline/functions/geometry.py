"""Plane geometry as column expressions. Boxes are (x, y, width, height); all values are doubles.

Every function takes and returns Columns, so plans stay inside generated code."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    width: Column
    height: Column


class Point(NamedTuple):
    x: Column
    y: Column


def box(prefix: str = "") -> Box:
    """The box held in columns <prefix>x, <prefix>y, <prefix>width and <prefix>height."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x", "y", "width", "height")))


def center(b: Box) -> Point:
    return Point(b.x + b.width / 2, b.y + b.height / 2)


def area(b: Box) -> Column:
    return b.width * b.height


def distance(a: Point, b: Point) -> Column:
    """Euclidean, by sqrt of sums: hypot rounds differently."""
    dx, dy = a.x - b.x, a.y - b.y
    return F.sqrt(dx * dx + dy * dy)


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def contains(b: Box, p: Point, margin: float = 0.0) -> Column:
    return p.x.between(b.x - margin, b.x + b.width + margin) & p.y.between(b.y - margin, b.y + b.height + margin)


def intersection_area(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x))
    high = F.greatest(F.lit(0.0), F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y))
    return wide * high


def overlaps(a: Box, b: Box, threshold: float = 0.0) -> Column:
    """The intersection covers threshold of the smaller box; boxes that only touch never do."""
    both, least = intersection_area(a, b), F.least(area(a), area(b))
    return (both > 0) & F.when(least > 0, both / least >= threshold).otherwise(False)


def iou(a: Box, b: Box) -> Column:
    """0 where the union has no area."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iou_floored(a: Box, b: Box) -> Column:
    """The variant that divides by one pixel at least."""
    both = intersection_area(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1.0))


def overlap_of_first(a: Box, b: Box) -> Column:
    return F.when(area(a) == 0, 0.0).otherwise(intersection_area(a, b) / area(a))


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    """From a point to the nearest place of a segment."""
    dx, dy = b.x - a.x, b.y - a.y
    squared = dx * dx + dy * dy
    t = clip(((p.x - a.x) * dx + (p.y - a.y) * dy) / F.nullif(squared, F.lit(0.0)), 0.0, 1.0)
    return F.when(squared == 0, distance(p, a)).otherwise(distance(p, Point(a.x + t * dx, a.y + t * dy)))


def boundary_distance(p: Point, b: Box) -> Column:
    """From a point to a box's boundary; inside, to its nearest edge."""
    right, bottom = b.x + b.width, b.y + b.height
    inner = F.least(p.x - b.x, right - p.x, p.y - b.y, bottom - p.y)
    return F.when(contains(b, p), inner).otherwise(outside_distance(p, b))


def outside_distance(p: Point, b: Box) -> Column:
    """From a point to a box as an area: 0 inside."""
    return distance(p, Point(F.greatest(b.x, F.least(p.x, b.x + b.width)), F.greatest(b.y, F.least(p.y, b.y + b.height))))


def ray_hits(p: Point, dx: Column, dy: Column, b: Box, slack: float = 1.0) -> Column:
    """array<struct<x, y, edge, t>> where the ray p + t (dx, dy), t >= 0, crosses the four edges, within slack of their ends."""
    right, bottom = b.x + b.width, b.y + b.height

    def hit(edge: str, along: Column, start: Column, step: Column, other_start: Column, other_step: Column, low: Column, high: Column, vertical: bool) -> Column:
        t = (along - start) / step
        across = other_start + t * other_step
        place = (along, across) if vertical else (across, along)
        found = F.struct(place[0].alias("x"), place[1].alias("y"), F.lit(edge).alias("edge"), t.alias("t"))
        return F.when((F.abs(step) > 1e-9) & (t >= 0) & across.between(low - slack, high + slack), found)

    hits = F.array(
        hit("left", b.x, p.x, F.nullif(dx, F.lit(0.0)), p.y, dy, b.y, bottom, True),
        hit("right", right, p.x, F.nullif(dx, F.lit(0.0)), p.y, dy, b.y, bottom, True),
        hit("top", b.y, p.y, F.nullif(dy, F.lit(0.0)), p.x, dx, b.x, right, False),
        hit("bottom", bottom, p.y, F.nullif(dy, F.lit(0.0)), p.x, dx, b.x, right, False),
    )
    return F.filter(hits, lambda h: h.isNotNull())


def nearest_hit(p: Point, dx: Column, dy: Column, b: Box) -> Column:
    """Smallest t of ray_hits(), null without any."""
    return F.array_min(F.transform(ray_hits(p, dx, dy, b), lambda h: h["t"]))


def slab_distance(p: Point, dx: Column, dy: Column, b: Box, pad: float = 0.0) -> Column:
    """t >= 0 where the ray enters the padded box; 0 inside; null when it misses."""
    low = {"x": b.x - pad, "y": b.y - pad}
    high = {"x": b.x + b.width + pad, "y": b.y + b.height + pad}
    enter, leave, miss = F.lit(0.0), F.lit(float("inf")), F.lit(False)
    for axis, start, step in (("x", p.x, dx), ("y", p.y, dy)):
        flat = F.abs(step) < 1e-9
        t1, t2 = (low[axis] - start) / F.nullif(step, F.lit(0.0)), (high[axis] - start) / F.nullif(step, F.lit(0.0))
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t1, t2)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t1, t2)))
        miss = miss | (flat & ~start.between(low[axis], high[axis]))
    return F.when(~miss & (enter <= leave), enter)


def scaled(p: Point, scale_x: Column, scale_y: Column, offset_x: Column, offset_y: Column) -> Point:
    """Processed to original coordinates."""
    return Point(p.x * scale_x + offset_x, p.y * scale_y + offset_y)


def unscaled(p: Point, scale_x: Column, scale_y: Column, offset_x: Column, offset_y: Column) -> Point:
    """Original to processed coordinates."""
    return Point((p.x - offset_x) / scale_x, (p.y - offset_y) / scale_y)


def endpoint_swap(a: Point, b: Point) -> Column:
    """True where the ends must change places for a to come first by (x, y)."""
    return (a.x > b.x) | ((a.x == b.x) & (a.y > b.y))


def near_border(b: Box, width: float, height: float, margin: float = 10.0) -> Column:
    """A box that reaches into the margin of an image."""
    return (b.x < margin) | (b.y < margin) | (b.x + b.width > width - margin) | (b.y + b.height > height - margin)


def rectangularity(size: Column, b: Box) -> Column:
    """Share of its box that a shape of this area fills."""
    return size / area(b)


def circularity(size: Column, perimeter: Column) -> Column:
    """1 for a circle, less for other outlines."""
    return 4 * math.pi * size / (perimeter * perimeter)
