"""Column functions on boxes: arrays [x1, y1, x2, y2] in units of a thousandth of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import has_cjk


def half_up(v: Column) -> Column:
    """Rounding with halves towards plus infinity; Spark's round takes them away from 0."""
    return F.floor(v + 0.5)


def swap_axes(b: Column) -> Column:
    """[y1, x1, y2, x2] of the model to [x1, y1, x2, y2]."""
    return F.array(F.get(b, 1), F.get(b, 0), F.get(b, 3), F.get(b, 2))


def is_malformed(b: Column, portrait: Column) -> Column:
    """No area, or a sliver: narrower than 40 and longer than 150 (landscape pages 30 and 200). Comparisons with NaN
    are false, so a box that is not finite passes here and is caught by not_finite."""
    w, h = F.get(b, 2) - F.get(b, 0), F.get(b, 3) - F.get(b, 1)
    narrow, long = F.when(portrait, 40.0).otherwise(30.0), F.when(portrait, 150.0).otherwise(200.0)
    less = lambda a, c: ~F.isnan(a) & (a < c)
    more = lambda a, c: ~F.isnan(a) & (a > c)
    return F.coalesce((~F.isnan(w) & (w <= 0)) | (~F.isnan(h) & (h <= 0)) | (less(w, narrow) & more(h, long)) | (less(h, narrow) & more(w, long)), F.lit(False))


def not_finite(b: Column) -> Column:
    """A side that is NaN or infinite, or fewer than four sides; null counts as 0."""
    return F.coalesce((F.size(b) < 4) | F.exists(b, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))), F.lit(True))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Left, top, width, height in pixels, halves rounded up."""
    x1, y1 = half_up(F.get(b, 0) / 1000 * width), half_up(F.get(b, 1) / 1000 * height)
    return F.array(x1, y1, half_up((F.get(b, 2) - F.get(b, 0)) / 1000 * width), half_up((F.get(b, 3) - F.get(b, 1)) / 1000 * height))


def from_pixels(p: Column, width: Column, height: Column) -> Column:
    """Left, top, width, height in pixels to a box, halves rounded up."""
    x = lambda v: half_up(v / width * 1000)
    y = lambda v: half_up(v / height * 1000)
    return F.array(x(F.get(p, 0)), y(F.get(p, 1)), x(F.get(p, 0) + F.get(p, 2)), y(F.get(p, 1) + F.get(p, 3)))


def text_edges(text: Column, y: Column, h: Column, bottom: Column) -> dict[str, Column]:
    """How far the ink of an item reaches: its bottom with descenders, its visual top and bottom."""
    cjk = has_cjk(text)
    return {
        "overlap_bottom": bottom + h * F.when(cjk, 0.10).otherwise(0.20),
        "visual_top": y + h * F.when(cjk, 0.10).otherwise(0.25),
        "visual_bottom": bottom + h * 0.05,
    }


def deltas(before: Column, after: Column) -> Column:
    """Change of each side to one decimal, halves up."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: half_up((F.get(after, i) - F.get(before, i)) * 10) / 10)
