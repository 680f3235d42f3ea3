"""Lines of a page, region or column that is packed into one row: one exchange for the whole text of a column.

Lines and their fragments are found over the pages of an Arrow batch (arrays.py); what is told of them is column functions on the
lines of a page, and nothing is exploded and put together again.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.metadata import bound
from foliospark.functions.text import sanitize_pua
from foliospark.operators import arrays
from foliospark.operators.lines import PAGE, PARA_RATIO, PARA_WINDOW, adaptive_lines, inline_separator, packed, spacings

#: A line is a fragment if it spans less than FRAGMENT of the reference line, which must be wider than LEAST_SPAN.
FRAGMENT, LEAST_SPAN = 0.7, 50.0
#: Fragments are put together over so many lines, so many thresholds apart, if they grow by this much.
REACH, APART, GROWTH = 3, 2.5, 1.2
#: Fields of the items of a line from left to right.
ACROSS = "xbirs"


def _take_up(lo: list[float], hi: list[float], b: list[float], limit: float, reference: float) -> list[list[int]]:
    """Lines of a page that are put together: a fragment takes up those of the next REACH lines that are fragments as well, are
    near by their left-most items and make it wider. Lines that are taken up are out."""
    rows = [(*line, [k]) for k, line in enumerate(zip(lo, b, hi, strict=True))]
    short = lambda a: a[2] - a[0] < FRAGMENT * reference
    i = 0
    while i < len(rows):
        j = i + 1 if short(rows[i]) else len(rows)
        while j <= min(i + REACH, len(rows) - 1):
            a, c = rows[i], rows[j]
            left, right = min(a[0], c[0]), max(a[2], c[2])
            if short(c) and abs(a[1] - c[1]) <= APART * limit and right - left >= GROWTH * max(a[2] - a[0], c[2] - c[0]):
                rows[i] = (*min(a[:2], c[:2]), right, a[3] + c[3])
                del rows[j]
            else:
                j += 1
        i += 1
    return [row[3] for row in rows]


def _across(t: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Items line by line from left to right, and where each line begins."""
    o = arrays.order((t.line, t.x, t.b, t.i), (t.r, t.s))
    return o, np.flatnonzero(np.concatenate([[True], np.diff(t.line[o]) > 0]))


def _put_together(t: SimpleNamespace) -> SimpleNamespace:
    """The pages with the fragments of one line put together, where there are two at least beside three lines that are wide enough;
    line, of and number tell of whole lines, items stand line by line from left to right: across, begins, lo, hi."""
    o, begins = _across(t)
    lo, hi, b, n = t.x[o][begins], np.maximum.reduceat(t.r[o], begins), t.b[o][begins], np.bincount(t.of, minlength=len(t.per))
    first = np.cumsum(n) - n
    reference = (hi - lo)[np.lexsort((hi - lo, t.of))][first + n * 3 // 4]
    short = np.bincount(t.of, hi - lo < FRAGMENT * reference[t.of], len(n))
    into = np.arange(len(lo))
    for p in np.flatnonzero((n >= 3) & (reference > LEAST_SPAN) & (short >= 2)):
        own = slice(first[p], first[p] + n[p])
        for group in _take_up(lo[own].tolist(), hi[own].tolist(), b[own].tolist(), t.limit[p], reference[p]):
            into[first[p] + np.array(group)] = first[p] + group[0]
    kept = np.flatnonzero(into == np.arange(len(into)))
    of = t.of[kept]
    whole = SimpleNamespace(**vars(t) | {"line": np.searchsorted(kept, into)[t.line], "of": of, "number": arrays.places(of)})
    o, begins = _across(whole)
    return SimpleNamespace(**vars(whole), across=o, begins=begins, lo=t.x[o][begins], hi=np.maximum.reduceat(t.r[o], begins))


def whole_lines(items: DataFrame, keys: Sequence[str], any_overlap: bool = False) -> DataFrame:
    """keys, limit (the adaptive threshold), lines: lo, hi (how far a line spans), g (its items from left to right); fragments are
    put together."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = _put_together(adaptive_lines(t, any_overlap))
        g = arrays.lists(arrays.structs(t, ACROSS, t.across), np.diff([*t.begins, len(t.b)]))
        lines = pa.StructArray.from_arrays([pa.array(t.lo), pa.array(t.hi), g], ["lo", "hi", "g"])
        return np.arange(len(t.per)), [pa.array(t.limit), arrays.lists(lines, np.bincount(t.of, minlength=len(t.per)))]

    return arrays.each_page(packed(items, keys), keys, {"limit": "double", "lines": f"array<struct<lo: double, hi: double, g: array<{arrays.struct_of(ACROSS)}>>>"}, of)


def joined(lines: Column) -> Column:
    """Text of lines: a break before each, two before a paragraph."""
    before = lambda g, t, m: F.when(m == 0, "").otherwise(inline_separator(t["x"] - F.get(g, m - 1)["r"]))
    line = lambda a: F.array_join(F.transform(a["g"], lambda t, m: F.concat(before(a["g"], t, m), t["s"])), "")

    def marked(gaps: Column) -> Column:
        n = F.size(gaps)
        median = F.when(n >= 2, F.get(F.sort_array(gaps), F.floor(n / 2).cast("int"))).otherwise(0.0)
        lower = lambda around: F.get(around, F.floor(F.size(around) * 0.3).cast("int"))

        def mark(k: Column) -> Column:
            first = F.greatest(k - PARA_WINDOW, F.lit(1))
            local = lower(F.sort_array(F.slice(gaps, first, k + PARA_WINDOW + 1 - first)))
            reference = F.when(n >= 5, local).otherwise(median)
            wide = (reference > 0) & (F.get(gaps, k - 1) > reference * PARA_RATIO)
            return F.when(k == 0, "").when(F.coalesce(wide, F.lit(False)), "\n\n").otherwise("\n")

        return F.array_join(F.transform(lines, lambda a, k: F.concat(mark(k), line(a))), "")

    return bound(spacings(F.transform(lines, lambda a: F.get(a["g"], 0)["b"])), marked)


def column_text(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, text: lines with their fragments put together, joined by a break, paragraphs by two; private-use characters
    as symbols."""
    return whole_lines(items, keys).select(*keys, sanitize_pua(joined(F.col("lines"))).alias("text"))


def merge_line_fragments(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, line (from 0), lo, hi, item_idxs: lines with their fragments put together, items from left to right."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = _put_together(adaptive_lines(t))
        idxs = arrays.lists(pa.array(t.i[t.across], pa.int32()), np.diff([*t.begins, len(t.b)]))
        return t.of, [pa.array(t.number, pa.int32()), pa.array(t.lo), pa.array(t.hi), idxs]

    return arrays.each_page(packed(items, keys), keys, {"line": "int", "lo": "double", "hi": "double", "item_idxs": "array<int>"}, of)


def display_lines(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, line (from 1), b_min, b_max, x_min, x_max (rounded), n_items, text (items without anything between), gap (of the
    left-most items), merged (items that are on the line by overlap alone): the listing of the diagnostics, which takes any
    overlap with a line's core for the same line."""
    page = whole_lines(items, keys, True)
    flat = page.select(*keys, "limit", F.posexplode(F.transform("lines", lambda a, k: F.struct(a.alias("a"), F.get("lines", k - 1).alias("before")))).alias("k", "l")).select(*keys, "limit", "k", "l.*")
    half_up = lambda v: F.floor(v + 0.5).cast("double")
    of = lambda f: F.transform("a.g", f)
    first = F.array_min(of(lambda t: t["b"]))
    return flat.select(
        *keys, (F.col("k") + 1).alias("line"), F.array_min(of(lambda t: half_up(t["b"]))).alias("b_min"), F.array_max(of(lambda t: half_up(t["b"]))).alias("b_max"),
        F.array_min(of(lambda t: half_up(t["x"]))).alias("x_min"), F.array_max(of(lambda t: half_up(t["r"]))).alias("x_max"), F.size("a.g").alias("n_items"), F.array_join(of(lambda t: t["s"]), "").alias("text"),
        (F.get("a.g", 0)["b"] - F.get("before.g", 0)["b"]).alias("gap"), F.size(F.filter("a.g", lambda t: t["b"] - first >= F.col("limit"))).alias("merged"),
    )
