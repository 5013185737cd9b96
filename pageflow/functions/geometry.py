"""Box arithmetic on ``array<struct<x,y>>`` polygons and on rectangle columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageflow.rules import SKEW_MAX_DEGREES


def _corners(box: Column, axis: str) -> list[Column]:
    return [F.get(box, F.lit(i))[axis] for i in range(4)]


def low(box: Column, axis: str) -> Column:
    """Smallest coordinate. The usual four corners are read directly, without a lambda per point."""
    return F.when(F.size(box) <= 4, F.least(*_corners(box, axis))).otherwise(
        F.array_min(F.transform(box, lambda p: p[axis]))
    )


def high(box: Column, axis: str) -> Column:
    return F.when(F.size(box) <= 4, F.greatest(*_corners(box, axis))).otherwise(
        F.array_max(F.transform(box, lambda p: p[axis]))
    )


def extent(box: Column, axis: str) -> Column:
    return high(box, axis) - low(box, axis)


def unrotate(box: Column, angle: Column, width: Column, height: Column) -> Column:
    """Polygon seen at ``angle`` mapped back onto the page as it was scanned (width x height)."""

    def point(p: Column) -> Column:
        x = (
            F.when(angle == 90, p["y"]).when(angle == 180, width - p["x"])
            .when(angle == 270, width - p["y"]).otherwise(p["x"])
        )
        y = (
            F.when(angle == 90, height - p["x"]).when(angle == 180, height - p["y"])
            .when(angle == 270, p["x"]).otherwise(p["y"])
        )
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(box, point)


def display_rect(
    x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column, page_w: Column, page_h: Column
) -> dict[str, Column]:
    """Rectangle in the orientation the reader sees; ``page_w``/``page_h`` are unrotated."""

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        dx = (
            F.when(rotation == 90, page_h - y).when(rotation == 180, page_w - x)
            .when(rotation == 270, y).otherwise(x)
        )
        dy = (
            F.when(rotation == 90, x).when(rotation == 180, page_h - y)
            .when(rotation == 270, page_w - x).otherwise(y)
        )
        return dx, dy

    (ax, ay), (bx, by) = corner(x0, y0), corner(x1, y1)
    return {
        "x0": F.least(ax, bx), "y0": F.least(ay, by),
        "x1": F.greatest(ax, bx), "y1": F.greatest(ay, by),
    }


def tilt_degrees(box: Column) -> Column:
    """Slope of the edge from the first to the second corner; null for a (near) vertical edge or beyond 20 degrees."""
    dx = box[1]["x"] - box[0]["x"]
    dy = box[1]["y"] - box[0]["y"]
    tilt = F.degrees(F.atan2(dy, dx))
    return F.when((F.abs(dx) >= 1) & (F.abs(tilt) <= SKEW_MAX_DEGREES), tilt)
