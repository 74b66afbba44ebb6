"""Image and box sizes.  Boxes are arrays x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def resized(width: Column, height: Column, long_edge: int) -> Column:
    """Struct (width, height) scaled down so that the longer edge fits; never below 1."""
    scale = F.least(F.lit(1.0), F.lit(float(long_edge)) / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(1), F.bround(c * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def _clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, high))


def _sound(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def padded(box: Column, scale: Column, width: Column, height: Column, margin: float = 0.05) -> Column:
    """A detection in original pixels, widened by ``margin`` of its size and clamped; null if empty."""
    x1, y1, x2, y2 = (box[i] / scale for i in range(4))
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    low = lambda c: F.greatest(F.lit(0), c.cast("int"))
    high = lambda c, most: F.least(most.cast("int"), c.cast("int"))
    return _sound(low(x1 - dx), low(y1 - dy), high(x2 + dx, width), high(y2 + dy, height))


def face_crop(box: Column, width: Column, height: Column, margin: float = 0.3) -> Column:
    """Crop around a face: clamped first, then widened by ``margin`` of its size; null if empty."""
    whole = [box[i].cast("int") for i in range(4)]
    w, h = width.cast("int"), height.cast("int")
    x1, y1, x2, y2 = _clamp(whole[0], 0, w - 1), _clamp(whole[1], 0, h - 1), _clamp(whole[2], 0, w), _clamp(whole[3], 0, h)
    dx, dy = ((x2 - x1) * margin).cast("int"), ((y2 - y1) * margin).cast("int")
    wide = F.array(F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(w, x2 + dx), F.least(h, y2 + dy))
    return F.when((x2 > x1) & (y2 > y1), wide)
