"""Column helpers over points, boxes and matrices (y grows upwards unless a name ends in ``_down``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Halves go towards plus infinity, unlike Spark's round()."""
    return F.floor(c + 0.5)


def box(xs: list[Column], ys: list[Column]) -> dict[str, Column]:
    """The upright box around some points."""
    return {"bx0": F.least(*xs), "by0": F.least(*ys), "bx1": F.greatest(*xs), "by1": F.greatest(*ys)}


def overlaps(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Strict overlap: boxes that only touch do not."""
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def matrix_box(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> dict[str, Column]:
    """Box of the unit square under a matrix."""
    return box([e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d])


def rotated_box(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> dict[str, Column]:
    """Box around both a box and itself turned about its centre."""
    cx, cy, r = x + w / 2, y + h / 2, F.radians(degrees)
    xs, ys = [x, x + w], [y, y + h]
    for sx in (-1, 1):
        for sy in (-1, 1):
            dx, dy = sx * w / 2, sy * h / 2
            xs.append(cx + dx * F.cos(r) - dy * F.sin(r))
            ys.append(cy + dx * F.sin(r) + dy * F.cos(r))
    return box(xs, ys)


def to_content_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """A point shown on a page turned clockwise by 0, 90, 180 or 270 degrees, in the page's own frame (y down); width and height are the page's own."""
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, y).when(turn == 180, width - x).when(turn == 270, width - y).otherwise(x),
        F.when(turn == 90, height - x).when(turn == 180, height - y).when(turn == 270, x).otherwise(y),
    )


def to_display_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """The inverse of :func:`to_content_point`."""
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, height - y).when(turn == 180, width - x).when(turn == 270, y).otherwise(x),
        F.when(turn == 90, x).when(turn == 180, height - y).when(turn == 270, width - x).otherwise(y),
    )


def decompose(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Scales along both axes and the clockwise angle in degrees of a matrix."""
    return {"scale_x": F.hypot(a, b), "scale_y": F.hypot(c, d), "angle": F.pmod(F.degrees(F.atan2(-b, a)), F.lit(360.0))}


def to_content_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, rotation: Column) -> dict[str, Column]:
    """The box around a shown box's corners in the page's own frame (y down)."""
    corners = [to_content_point(a, b, width, height, rotation) for a in (x, x + w) for b in (y, y + h)]
    return box([c[0] for c in corners], [c[1] for c in corners])


def to_display_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, rotation: Column) -> dict[str, Column]:
    """The inverse of :func:`to_content_box`."""
    corners = [to_display_point(a, b, width, height, rotation) for a in (x, x + w) for b in (y, y + h)]
    return box([c[0] for c in corners], [c[1] for c in corners])


def flipped(b: dict[str, Column], height: Column) -> dict[str, Column]:
    """A box with y down as one with y up, and the other way round."""
    return {"bx0": b["bx0"], "by0": height - b["by1"], "bx1": b["bx1"], "by1": height - b["by0"]}


def clamped(b: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The part of a box that is on the page."""
    held = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    return {k: held(v, width if "x" in k else height) for k, v in b.items()}


def multiplied(m: list[Column], n: list[Column]) -> list[Column]:
    """The matrix (a-f) that applies n first, then m."""
    a, b, c, d, e, f = m
    return [a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f]
