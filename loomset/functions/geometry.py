"""Boxes, image sizes, video segments and colours as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct((x / width).alias("x"), (y / height).alias("y"), (w / width).alias("w"), (h / height).alias("h"))


def absolute(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct((x * width).alias("x"), (y * height).alias("y"), (w * width).alias("w"), (h * height).alias("h"))


def bounds(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, min_w: int = 32, min_h: int = 32, square: bool = False) -> Column:
    """struct<x1, y1, x2, y2>: a box grown around its centre to a least size (or square), then brought into the image.

    What overflows on the left or top shifts the box; on the right or bottom it is cut off.
    """
    new_w, new_h = F.greatest(w, F.lit(min_w)), F.greatest(h, F.lit(min_h))
    if square:
        new_w = new_h = F.greatest(new_w, new_h)
    x1, y1 = x + w / 2 - new_w / 2, y + h / 2 - new_h / 2
    left, top = F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0))
    right, bottom = F.least(left + new_w, width), F.least(top + new_h, height)
    return F.struct(left.cast("int").alias("x1"), top.cast("int").alias("y1"), right.cast("int").alias("x2"), bottom.cast("int").alias("y2"))


def outline(x: Column, y: Column, w: Column, h: Column, line: int, width: Column, height: Column) -> Column:
    """struct of the outer and inner rectangle of a box's border, clipped to the image: the data behind drawing it."""
    return F.struct(
        F.greatest(x - line, F.lit(0)).alias("ox1"), F.greatest(y - line, F.lit(0)).alias("oy1"), F.least(x + w + line, width).alias("ox2"), F.least(y + h + line, height).alias("oy2"),
        x.alias("ix1"), y.alias("iy1"), F.least(x + w, width).alias("ix2"), F.least(y + h, height).alias("iy2"),
    )


def smaller_side(w: Column, h: Column, side: int) -> Column:
    """Size with the smaller side as given; the other is rounded half to even."""
    return F.when(w <= h, F.struct(F.lit(side).alias("w"), F.rint(h * side / w).cast("int").alias("h"))).otherwise(F.struct(F.rint(w * side / h).cast("int").alias("w"), F.lit(side).alias("h")))


def bigger_side(w: Column, h: Column, side: int) -> Column:
    """Size with the larger side as given; the other is cut to a whole number."""
    return F.when(w >= h, F.struct(F.lit(side).alias("w"), (h * side / w).cast("int").alias("h"))).otherwise(F.struct((w * side / h).cast("int").alias("w"), F.lit(side).alias("h")))


def to_width(w: Column, h: Column, width: int) -> Column:
    return F.struct(F.lit(width).alias("w"), (h * width / w).cast("int").alias("h"))


def to_height(w: Column, h: Column, height: int) -> Column:
    return F.struct((w * height / h).cast("int").alias("w"), F.lit(height).alias("h"))


def centre_square(w: Column, h: Column) -> Column:
    side = F.least(w, h)
    return F.struct(F.floor((w - side) / 2).cast("int").alias("x"), F.floor((h - side) / 2).cast("int").alias("y"), side.cast("int").alias("side"))


def scale_filter(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """'area' if both sides shrink or stay, else 'bicubic'."""
    return F.when((to_w <= w) & (to_h <= h), "area").otherwise("bicubic")


def grown_segment(n: Column, least: Column, start: Column, stop: Column) -> Column:
    """struct<start, stop, changed>: [start, stop) of n frames grown to `least`, left and right in turn, within the video."""
    d = F.greatest(F.least(least, n) - (stop - start), F.lit(0)).cast("int")
    half_up, half_down = F.ceil(d / 2).cast("int"), F.floor(d / 2).cast("int")
    left = F.when(start < half_up, start).when(n - stop < half_down, d - (n - stop)).otherwise(half_up)
    return F.struct((start - left).cast("int").alias("start"), (stop + d - left).cast("int").alias("stop"), (d > 0).alias("changed"))


def cycle_color(i: Column, cycle: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(i, F.lit(len(cycle))) + 1).cast("int"))


def transition_color(i: Column, most: Column, base: float = 0.4) -> Column:
    """struct<r, g, b> from green over blue to red as i goes from 0 to most - 1; most = 1 gives the start."""
    t = F.when(most > 1, 2.0 * i / (most - 1)).otherwise(F.lit(0.0))
    u = t - 1
    early = F.struct((t * base).alias("r"), ((1 - t) * (1 - base) + base).alias("g"), t.alias("b"))
    late = F.struct((u * (1 - base) + base).alias("r"), ((1 - u) * base).alias("g"), (1 - u).alias("b"))
    return F.when(t <= 1, early).otherwise(late)


def color_map(value: Column, anchors: list[tuple[float, float, float, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """struct<r, g, b> in 0..1 by linear interpolation between (position, r, g, b) anchors in ascending order."""
    t = F.least(F.greatest((value - low) / (high - low), F.lit(anchors[0][0])), F.lit(anchors[-1][0]))
    parts = []
    for channel, name in ((1, "r"), (2, "g"), (3, "b")):
        out = F.lit(float(anchors[-1][channel]))
        for a, b in reversed(list(zip(anchors, anchors[1:]))):
            out = F.when(t <= b[0], a[channel] + (t - a[0]) / (b[0] - a[0]) * (b[channel] - a[channel])).otherwise(out)
        parts.append(out.alias(name))
    return F.struct(*parts)
