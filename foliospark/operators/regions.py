"""Boxes against items and boxes against boxes, always within a page.

Regions: file_id, page, ord, x1, y1, x2, y2. Joins are equi joins on the page with the geometry as a residual, so no
pair of different pages is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.metadata import bound
from foliospark.functions.text import CJK, has_cjk
from foliospark.operators import arrays

PAGE = ["file_id", "page"]
CONTAINED = 0.95
MIN_GAP = 5.0
DESCENDER, CJK_DESCENDER = 0.20, 0.10
_CJK = CJK.encode().decode("unicode_escape")
#: Lines of two boxes are the same row up to ROW apart; from this share of shared rows on the boxes are parts of one block.
ROW, SUBSET = 15.0, 0.8


def _meets() -> Column:
    right = F.col("norm_x") + F.col("norm_w")
    return (F.col("norm_x") < F.col("x2")) & (right > F.col("x1")) & (F.col("norm_y") < F.col("y2")) & (F.col("norm_baseline") > F.col("y1"))


def region_hits(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Items of each region: they overlap it across and down, edges not counted."""
    return items.join(regions.select(*PAGE, "ord", "x1", "y1", "x2", "y2"), PAGE).filter(_meets())


def tag_first_region(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Items with the first region that they hit, null for none."""
    first = region_hits(items, regions).groupBy(*PAGE, "item_idx").agg(F.min("ord").alias("first_ord"))
    return items.join(first, [*PAGE, "item_idx"], "left")


def _page_boxes(regions: DataFrame) -> DataFrame:
    return regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2"))).alias("boxes"))


def contained_orders(boxes: Column) -> Column:
    """Orders of boxes that lie within another: pairs are gone through in order, a dropped box drops no other; of two
    that lie in each other the earlier goes."""
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    side = lambda a, b, lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    shared = lambda a, b: side(a, b, "x1", "x2") * side(a, b, "y1", "y2")
    share = lambda a, b, of: F.when(area(of) > 0, shared(a, b) / area(of)).otherwise(0.0)
    pairs = F.flatten(F.transform(boxes, lambda a: F.transform(F.filter(boxes, lambda b: b["ord"] > a["ord"]), lambda b: F.struct(a["ord"].alias("i"), b["ord"].alias("j"), (share(a, b, a) >= CONTAINED).alias("first"), (share(a, b, b) >= CONTAINED).alias("second")))))

    def step(gone: Column, p: Column) -> Column:
        out = F.array_contains(gone, p["i"]) | F.array_contains(gone, p["j"])
        return F.when(out, gone).when(p["first"], F.concat(gone, F.array(p["i"]))).when(p["second"], F.concat(gone, F.array(p["j"]))).otherwise(gone)

    return F.aggregate(pairs, F.expr("cast(array() as array<int>)"), step)


def drop_contained_regions(regions: DataFrame) -> DataFrame:
    gone = _page_boxes(regions).select(*PAGE, F.explode(contained_orders(F.col("boxes"))).alias("ord"))
    return regions.join(gone, [*PAGE, "ord"], "left_anti")


def enforce_min_gap(regions: DataFrame) -> DataFrame:
    """Boxes above each other that are nearer than MIN_GAP give half of what is missing each; pairs in order, each
    seeing what the pairs before have changed."""
    page = _page_boxes(regions)
    n = F.size("boxes")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def step(boxes: Column, p: Column) -> Column:
        a, b = F.get(boxes, p["i"]), F.get(boxes, p["j"])
        across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) > 0
        a_upper = a["y1"] <= b["y1"]
        gap = F.when(a_upper, b["y1"] - a["y2"]).otherwise(a["y1"] - b["y2"])
        half = F.when(across & (gap < MIN_GAP), (MIN_GAP - gap) / 2).otherwise(0.0)
        upper, lower = F.when(a_upper, p["i"]).otherwise(p["j"]), F.when(a_upper, p["j"]).otherwise(p["i"])
        return F.transform(boxes, lambda x, k: F.struct(x["ord"].alias("ord"), x["x1"].alias("x1"), (x["y1"] + F.when(k == lower, half).otherwise(0.0)).alias("y1"), x["x2"].alias("x2"), (x["y2"] - F.when(k == upper, half).otherwise(0.0)).alias("y2")))

    return page.select(*PAGE, F.explode(F.aggregate(pairs, F.col("boxes"), step)).alias("b")).select(*PAGE, "b.*")


def next_box_below(regions: DataFrame) -> DataFrame:
    """Regions with next_y: the smallest top below their own among boxes that overlap across, 1000 without one."""
    other = regions.select(*PAGE, F.col("x1").alias("ox1"), F.col("x2").alias("ox2"), F.col("y1").alias("oy1"))
    below = regions.join(other, PAGE).filter((F.col("oy1") > F.col("y1")) & (F.least("x2", "ox2") > F.greatest("x1", "ox1")))
    nearest = below.groupBy(*PAGE, "ord").agg(F.min("oy1").alias("next_y"))
    return regions.join(nearest, [*PAGE, "ord"], "left").withColumn("next_y", F.coalesce("next_y", F.lit(1000.0)))


def apply_descender(regions: DataFrame, items: DataFrame) -> DataFrame:
    """Room for descenders below the tallest item near the bottom edge, less if any of them is Chinese, and never
    nearer than MIN_GAP to the next box."""
    near = items.join(regions.select(*PAGE, "ord", "x1", "x2", "y2"), PAGE).filter((F.col("norm_x") < F.col("x2")) & (F.col("norm_x") + F.col("norm_w") > F.col("x1")) & (F.abs(F.col("norm_baseline") - F.col("y2")) < 15.0))
    tall = near.groupBy(*PAGE, "ord").agg(F.max("norm_h").alias("h"), F.bool_or(has_cjk(F.col("str"))).alias("cjk"))
    out = next_box_below(regions).join(tall, [*PAGE, "ord"], "left")
    room = F.col("y2") + F.col("h") * F.when(F.col("cjk"), CJK_DESCENDER).otherwise(DESCENDER)
    return out.withColumn("y2", F.when(F.col("h").isNull(), F.col("y2")).otherwise(F.least(F.col("next_y") - MIN_GAP, room))).drop("next_y", "h", "cjk")


def sweep(left: np.ndarray, right: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each item the nearest one above it that overlaps it across, -1 for none; of equals the first.

    Items are gone through from above. What lies below all others covers them, so for each cell between two edges the last
    item laid over it is kept, and an item looks at the cells that it spans. An item without width is a point, which
    others overlap that have it inside. Memory grows with the number of items alone."""
    n = len(left)
    edges = np.unique(np.concatenate([left, right]))
    a, z = np.searchsorted(edges, left), np.searchsorted(edges, right)
    order = np.lexsort((-np.arange(n), base))
    cells, points = np.full(2 * len(edges) + 1, -1), np.full(len(edges) + 1, -1)
    out = np.full(n, -1)
    cut = np.flatnonzero(np.diff(base[order])) + 1
    for level in np.split(np.arange(n), cut):
        for k in order[level].tolist():
            if a[k] < z[k]:
                best = cells[2 * a[k] + 1 : 2 * z[k]].max()
                if z[k] > a[k] + 1:
                    best = max(best, points[a[k] + 1 : z[k]].max())
            else:
                best = cells[2 * a[k]]
            out[k] = order[best] if best >= 0 else -1
        for rank, k in zip(level.tolist(), order[level].tolist(), strict=True):
            if a[k] < z[k]:
                cells[2 * a[k] + 1 : 2 * z[k]] = rank
            else:
                points[a[k]] = rank
    return out


#: Items gone through one by one, from each, to the nearest; pages where that is not enough are swept.
STEPS = 128


def sweep_pages(page: np.ndarray, left: np.ndarray, right: np.ndarray, base: np.ndarray) -> np.ndarray:
    """sweep of each page of arrays in which the items of a page stand together: places in these arrays. All items look at the one
    before them by baseline, then those that found none at the one before that, and so on."""
    n = len(page)
    order, out = np.lexsort((-np.arange(n), base, page)), np.full(n, -1)
    p, x, r, b = page[order], left[order], right[order], base[order]
    begins = np.flatnonzero(np.concatenate([[True] * min(1, n), p[1:] != p[:-1]]))
    size = np.diff([*begins, n])
    first, still = np.repeat(begins, size), np.arange(n)
    for step in range(1, STEPS + 1):
        still = still[still - step >= first[still]]
        if not len(still):
            return out
        at = still - step
        met = (b[at] < b[still]) & (x[at] < r[still]) & (r[at] > x[still])
        out[order[still[met]]] = order[at[met]]
        still = still[~met]
    for a in np.unique(first[still]).tolist():
        z = slice(a, a + int(size[np.searchsorted(begins, a)]))
        found = sweep(left[z], right[z], base[z])
        out[z] = np.where(found >= 0, found + a, -1)
    return out


def nearer_top(page: np.ndarray, left: np.ndarray, right: np.ndarray, top: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Top of the nearer of each item's neighbours above and below, nan where neither is nearer."""
    if not len(page):
        return np.zeros(0)

    def near(sign: int) -> tuple[np.ndarray, np.ndarray]:
        at = sweep_pages(page, left, right, sign * base)
        return np.where(at >= 0, np.abs(base - base[at]), np.inf), np.where(at >= 0, top[at], np.nan)

    (up, up_top), (down, down_top) = near(1), near(-1)
    return np.where(up < down, up_top, np.where(down < up, down_top, np.nan))


def _fields(flat: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [flat.field(f"norm_{n}").to_numpy(zero_copy_only=False).astype(float) for n in names]


def _numbered(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """Items of the pages of a batch by their numbers, the page of each, and how many a page has."""
    per = pc.fill_null(pc.list_value_length(batch.column("items")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, page = batch.column("items").flatten(), np.repeat(np.arange(len(per)), per)
    rest = [flat.field(f.name) for f in flat.type if f.name != "item_idx"]
    return flat.take(pa.array(arrays.order((page, flat.field("item_idx").to_numpy(zero_copy_only=False)), rest))), page, per


def _packed(items: DataFrame) -> DataFrame:
    """PAGE, items: one row for each page."""
    if "item_idx" not in items.columns:
        return items
    return items.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in items.columns if c not in PAGE])).alias("items"))


NEIGHBOUR = {"gap": pa.float64(), "idx": pa.int32(), "top": pa.float64()}


def nearest_lines(items: DataFrame, own: Sequence[str] | None = None) -> DataFrame:
    """Items with the nearest item above and below that overlaps across: gap, idx and top of each, null for none; of
    equals the first. own: columns of the items that are kept, all if not told. Items of a page meet in one shuffle, and the pages of
    an Arrow batch are gone through side by side in each direction; widths are not negative."""
    pages = _packed(items).select(*PAGE, "items")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema["items"].dataType.elementType}
    own = list(kinds) if own is None else list(own)
    told = [*(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema[:-1]), *(f"`{c}` {kinds[c]}" for c in own), *(f"{side} struct<gap: double, idx: int, top: double>" for side in ("above", "below"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, arrays.ABREAST):
                part = batch.slice(k, arrays.ABREAST)
                flat, page, _ = _numbered(part)
                x, w, y, base = _fields(flat, "x", "w", "y", "baseline")

                def near(sign: int, page=page, x=x, w=w, y=y, base=base, flat=flat) -> pa.StructArray:
                    at = sweep_pages(page, x, x + w, sign * base)
                    o = np.maximum(at, 0)
                    values = (np.abs(base - base[o]), flat.field("item_idx").take(pa.array(o)), y[o]) if len(o) else ([], [], [])
                    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, NEIGHBOUR.values(), strict=True)], list(NEIGHBOUR), mask=pa.array(at < 0))

                key = pa.array(page)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(key) for c in PAGE), *(flat.field(c) for c in own), near(1), near(-1)], [*PAGE, *own, "above", "below"])

    return pages.mapInArrow(run, ", ".join(told))


def resolve_x_overlaps(regions: DataFrame, items: DataFrame) -> DataFrame:
    """Boxes side by side that overlap: the one with less text in the overlap gives way, the right one on ties. Pairs are
    gone through in order, each seeing what those before have changed; boxes of which one has no line of its own beside the
    overlap stay as they are. Where SUBSET of the lines of one side go on in the other, the overlap is halved first."""
    row = F.struct(F.col("norm_x").alias("x"), (F.col("norm_x") + F.col("norm_w")).alias("r"), (F.col("norm_x") + F.col("norm_w") / 2).alias("c"), F.col("norm_y").alias("y"), F.col("norm_baseline").alias("b"))
    text = items.groupBy(*PAGE).agg(F.collect_list(row).alias("items"))
    page = _page_boxes(regions).join(text, PAGE, "left")
    places = F.sequence(F.lit(0), F.size("boxes") - 1)
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def step(boxes: Column, p: Column) -> Column:
        swapped = F.get(boxes, p["i"])["x1"] > F.get(boxes, p["j"])["x1"]
        left_at, right_at = F.when(swapped, p["j"]).otherwise(p["i"]), F.when(swapped, p["i"]).otherwise(p["j"])
        frame = lambda a, z: F.struct(a.alias("a"), z.alias("z"), F.greatest(a["x1"], z["x1"]).alias("x0"), F.least(a["x2"], z["x2"]).alias("x1"), F.greatest(a["y1"], z["y1"]).alias("y0"), F.least(a["y2"], z["y2"]).alias("y1"))

        def settle(f: Column) -> Column:
            rows = lambda side: F.array_distinct(F.transform(side, lambda t: F.floor(t["b"] + 0.5)))

            def with_level(level: Column) -> Column:
                own_left = rows(F.filter(level, lambda t: (t["c"] < f["x0"]) & (t["c"] > f["a"]["x1"]) & (t["c"] < f["a"]["x2"])))
                own_right = rows(F.filter(level, lambda t: (t["c"] > f["x1"]) & (t["c"] > f["z"]["x1"]) & (t["c"] < f["z"]["x2"])))
                inside = F.filter(level, lambda t: (t["r"] > f["x0"]) & (t["x"] < f["x1"]))
                middle = (f["x0"] + f["x1"]) / 2

                def moved(s: Column) -> Column:
                    fewer = F.size(s["l"]) <= F.size(s["r"])
                    few, many = F.when(fewer, s["l"]).otherwise(s["r"]), F.when(fewer, s["r"]).otherwise(s["l"])
                    shared = F.size(F.filter(few, lambda v: F.exists(many, lambda o: F.abs(v - o) < ROW)))
                    parted = shared >= SUBSET * F.size(few)
                    cover = lambda of, lo, hi: F.aggregate(F.filter(s["inside"], of), F.lit(0.0), lambda acc, t: acc + F.least(t["r"], hi) - F.greatest(t["x"], lo))
                    on_left = cover(lambda t: t["c"] < middle, f["x0"], F.when(parted, middle).otherwise(f["x1"]))
                    on_right = cover(lambda t: t["c"] >= middle, F.when(parted, middle).otherwise(f["x0"]), f["x1"])
                    keep_left = on_left >= on_right
                    side = lambda b, k: F.struct(b["ord"].alias("ord"), F.when((k == right_at) & keep_left, f["a"]["x2"]).otherwise(b["x1"]).alias("x1"), b["y1"].alias("y1"), F.when((k == left_at) & ~keep_left, f["z"]["x1"]).otherwise(b["x2"]).alias("x2"), b["y2"].alias("y2"))
                    return F.when((F.size(s["l"]) == 0) | (F.size(s["r"]) == 0), boxes).otherwise(F.transform(boxes, side))

                return bound(F.struct(own_left.alias("l"), own_right.alias("r"), inside.alias("inside")), moved)

            cross = (f["x1"] > f["x0"]) & (f["y1"] > f["y0"])
            return F.when(cross, bound(F.filter("items", lambda t: (t["b"] >= f["y0"]) & (t["y"] <= f["y1"])), with_level)).otherwise(boxes)

        return bound(frame(F.get(boxes, left_at), F.get(boxes, right_at)), settle)

    none = F.expr("cast(array() as array<struct<x:double,r:double,c:double,y:double,b:double>>)")
    page = page.withColumn("items", F.coalesce("items", none))
    return page.select(*PAGE, F.explode(F.when(F.size("boxes") > 1, F.aggregate(pairs, F.col("boxes"), step)).otherwise(F.col("boxes"))).alias("b")).select(*PAGE, "b.*")


def boxed(items: DataFrame, regions: DataFrame | None) -> DataFrame:
    """PAGE, items, boxes: pages that have both. Without regions the rows of items hold boxes already."""
    return items if regions is None else _packed(items).join(_page_boxes(regions), PAGE)


#: Pairs of boxes, and pairs with an item, that are laid out at a time.
PAIRS = 1 << 19


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of PAIRS in all at most, of one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PAIRS, side="right")))
        yield slice(at, to)
        at = to


def judged(n_t: np.ndarray, t0: np.ndarray, page: np.ndarray, sides: np.ndarray, order: np.ndarray, y: np.ndarray, base: np.ndarray, ink: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether each box may have each item of its page, box by box: items of pages (their number, where they begin) against boxes,
    page by page (their pages, sides and numbers). told: nearer_top."""
    n_b = np.bincount(page, minlength=len(n_t))
    b0, per_box = np.cumsum(n_b) - n_b, n_t[page]
    begins, owned = np.cumsum(per_box) - per_box, np.ones(int(per_box.sum()), bool)
    within = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    for some in _runs(np.where(per_box > 0, n_b[page], 0)):
        box = np.arange(some.start, some.stop)
        box = box[per_box[box] > 0]
        mine = np.repeat(box, n_b[page[box]])
        other = b0[page[mine]] + within(n_b[page[box]])
        against = (order[mine] != order[other]) & (np.minimum(sides[mine, 2], sides[other, 2]) > np.maximum(sides[mine, 0], sides[other, 0]))
        mine, other = mine[against], other[against]
        for part in _runs(per_box[mine]):
            a, c = mine[part], other[part]
            (p1, p2), (q1, q2) = sides[a][:, [1, 3]].T, sides[c][:, [1, 3]].T
            hi, lo, upper = np.maximum(p1, q1), np.minimum(p2, q2), p1 <= q1
            cross, middle = lo > hi, (hi + lo) / 2
            ends = lambda e1, e2, up: (np.where(cross & ~up, np.maximum(e1, middle), e1), np.where(cross & up, np.minimum(e2, middle), e2))  # noqa: B023, E731
            rows = per_box[a]
            wide, slot = lambda v: np.repeat(v, rows), within(rows)  # noqa: B023, E731
            k = wide(t0[page[a]]) + slot
            ky, kb, ki, kt = y[k], base[k], ink[k], told[k]
            m1, m2, o1, o2 = wide(p1), wide(p2), wide(q1), wide(q2)
            cover = lambda e: np.maximum(np.minimum(ki, wide(e[1])) - np.maximum(ky, wide(e[0])), 0.0)  # noqa: B023, E731
            free = ((ky >= m1) & (kb <= m2) & ~((ky >= o1) & (kb <= o2))) | (~wide(cross) & ~((ky < o2) & (ki > o1)))
            own, theirs = (kt >= m1) & (kt < m2), (kt >= o1) & (kt < o2)
            won = free | np.where(own == theirs, cover(ends(p1, p2, upper)) >= cover(ends(q1, q2, ~upper)), own)
            owned[(wide(begins[a]) + slot)[~won]] = False
    return owned


def item_ownership(items: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """file_id, page, ord, item_idx, owned: whether an item is the region's against all other boxes of its page. Items and
    boxes of a page are one row; pairs are judged for the pages of an Arrow batch side by side, and only what is told leaves a task."""
    pages = boxed(items, regions).select(*PAGE, "items", F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("ord", "x1", "y1", "x2", "y2")])).alias("boxes"))
    told = [f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*PAGE).schema] + ["ord int", "item_idx int", "owned boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("items", "boxes")]
            for some in _runs((1 + size[0]) * (1 + size[1])):
                yield _owned(batch.slice(some.start, some.stop - some.start), size[1][some])

    return pages.mapInArrow(run, ", ".join(told))


def _owned(batch: pa.RecordBatch, n_b: np.ndarray) -> pa.RecordBatch:
    """Rows of item_ownership of some pages with n_b boxes each."""
    flat, at, n_t = _numbered(batch)
    t0, boxes, page = np.cumsum(n_t) - n_t, batch.column("boxes").flatten(), np.repeat(np.arange(len(n_b)), n_b)
    x, w, y, h, base = _fields(flat, "x", "w", "y", "h", "baseline")
    chinese = pc.match_substring_regex(pc.fill_null(flat.field("str"), ""), _CJK).to_numpy(zero_copy_only=False).astype(bool)
    ink, sides = base + h * np.where(chinese, CJK_DESCENDER, DESCENDER), np.stack([boxes.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")], 1)
    order = boxes.field("ord").to_numpy(zero_copy_only=False)
    owned = judged(n_t, t0, page, sides, order, y, base, ink, nearer_top(at, x, x + w, y, base))
    # a row for each box and item
    per_box = n_t[page]
    box = np.repeat(np.arange(len(page)), per_box)
    idx = flat.field("item_idx").to_numpy(zero_copy_only=False)[np.repeat(t0[page], per_box) + np.arange(len(box)) - np.repeat(np.cumsum(per_box) - per_box, per_box)]
    if len(idx):  # items of one number are owned together
        new = np.flatnonzero(np.concatenate([[True], (np.diff(idx) != 0) | (np.diff(box) != 0)]))
        owned = np.repeat(np.logical_and.reduceat(owned, new), np.diff(np.concatenate([new, [len(idx)]])))
    key = pa.array(page[box])
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(key) for c in PAGE), pa.array(order[box].astype(np.int32)), pa.array(idx.astype(np.int32)), pa.array(owned)], [*PAGE, "ord", "item_idx", "owned"])


def baseline_subset(items: DataFrame, regions: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Regions with subset: every baseline beside the box (same height, outside across) is within tolerance of one of
    the items in it."""
    rows = items.join(regions.select(*PAGE, "ord", "x1", "y1", "x2", "y2"), PAGE).filter((F.col("norm_y") < F.col("y2")) & (F.col("norm_baseline") > F.col("y1")))
    inside = (F.col("norm_x") < F.col("x2")) & (F.col("norm_x") + F.col("norm_w") > F.col("x1"))
    sets = rows.groupBy(*PAGE, "ord").agg(F.collect_set(F.when(inside, F.col("norm_baseline"))).alias("own"), F.collect_set(F.when(~inside, F.col("norm_baseline"))).alias("out"))
    test = F.forall("out", lambda b: F.exists("own", lambda a: F.abs(a - b) <= tolerance))
    return regions.join(sets.select(*PAGE, "ord", test.alias("subset")), [*PAGE, "ord"], "left").withColumn("subset", F.coalesce("subset", F.lit(True)))


def baseline_share(items: DataFrame, regions: DataFrame) -> DataFrame:
    """file_id, page, ord, other, n_own, n_other, share: for boxes (ord < other) that overlap across and down, the rounded
    baselines that each has beside the overlap alone, and which share of the fewer go on within ROW in the other; null where
    a side has none. ord is the left box of the two."""
    one = regions.select(*PAGE, "ord", "x1", "y1", "x2", "y2")
    two = regions.select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("ord", "x1", "y1", "x2", "y2")])
    left_first = (F.col("x1") < F.col("o_x1")) | ((F.col("x1") == F.col("o_x1")) & (F.col("ord") < F.col("o_ord")))
    pairs = one.join(two, PAGE).filter((F.col("ord") != F.col("o_ord")) & left_first & (F.least("x2", "o_x2") > F.greatest("x1", "o_x1")) & (F.least("y2", "o_y2") > F.greatest("y1", "o_y1")))
    centre = F.col("norm_x") + F.col("norm_w") / 2
    level = (F.col("norm_baseline") >= F.greatest("y1", "o_y1")) & (F.col("norm_y") <= F.least("y2", "o_y2"))
    row = F.floor(F.col("norm_baseline") + 0.5)
    own = F.when(level & (centre < F.greatest("x1", "o_x1")) & (centre > F.col("x1")) & (centre < F.col("x2")), row)
    theirs = F.when(level & (centre > F.least("x2", "o_x2")) & (centre > F.col("o_x1")) & (centre < F.col("o_x2")), row)
    sets = pairs.join(items, PAGE, "left").groupBy(*PAGE, "ord", F.col("o_ord").alias("other")).agg(F.collect_set(own).alias("a"), F.collect_set(theirs).alias("z"))
    fewer = F.size("a") <= F.size("z")
    few, many = F.when(fewer, F.col("a")).otherwise(F.col("z")), F.when(fewer, F.col("z")).otherwise(F.col("a"))
    shared = F.size(F.filter(few, lambda v: F.exists(many, lambda o: F.abs(v - o) < ROW)))
    return sets.select(*PAGE, "ord", "other", F.size("a").alias("n_own"), F.size("z").alias("n_other"), F.when(F.least(F.size("a"), F.size("z")) > 0, shared / F.size(few)).alias("share"))


def drawable(regions: DataFrame) -> DataFrame:
    return regions.filter((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def region_summary(items: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Hits, lines, threshold, its path and median line gap of each region that has hits. A region and its hits are one row."""
    from foliospark.operators import lines

    meets = lambda t, b: (t["norm_x"] < b["x2"]) & (t["norm_x"] + t["norm_w"] > b["x1"]) & (t["norm_y"] < b["y2"]) & (t["norm_baseline"] > b["y1"])
    held = lambda b: F.struct(b["ord"].alias("ord"), F.filter("items", lambda t: meets(t, b)).alias("items"))
    hits = boxed(items, regions).select(*PAGE, F.inline(F.filter(F.transform("boxes", held), lambda r: F.size(r["items"]) > 0)))
    return lines.line_summary(hits, (*PAGE, "ord")).withColumnRenamed("n_items", "n_hits")
