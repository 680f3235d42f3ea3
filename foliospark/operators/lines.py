"""Lines, columns and gaps of positioned text items, in DataFrame functions.

Items: file_id, page, item_idx, str, norm_x, norm_y, norm_w, norm_h, norm_baseline (thousandths of the page, y down).
Items may also come packed, as keys and an array of them called items: then nothing is shuffled. Flat items meet in one
shuffle; from then on a page or region is one row, in baseline order (ties by item_idx), so that a line is a slice.
Clusters that compare with their first member are folds, those that compare with the previous member are cut between two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.metadata import bound
from foliospark.operators import arrays

SAME_LINE = 15.0
MICRO = 3.0
GAP_MIN = 5.0
CLUSTER_RANGE = 50.0
BUCKET = 2.0
COVERAGE, BAND_WIDTH = 0.8, 6.0
PARA_RATIO, PARA_WINDOW = 1.3, 3
EXCLUSIVE, STRICT_COVERAGE, STRICT_WIDTH, STRICT_GAP = 0.3, 0.5, 10.0, 15.0
TAB_GAP, BLANK_GAP, WRAP = 30.0, 3.0, -50.0
PAGE = ("file_id", "page")
#: Fields of the items of a line.
LINE = "bixryn"


def is_packed(items: DataFrame) -> bool:
    return "item_idx" not in items.columns


def packed_rows(items: DataFrame, keys: Sequence[str], row: Callable[[Column | DataFrame], Column]) -> DataFrame:
    """keys, items: what row makes of each item, sorted."""
    if is_packed(items):
        return items.select(*keys, F.sort_array(F.transform("items", row)).alias("items"))
    named = {c: F.col(c) for c in items.columns}
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(row(named))).alias("items"))


def in_order(items: DataFrame, keys: Sequence[str] = PAGE, text: bool = False) -> DataFrame:
    """One row for each key: items in baseline order, ties in input order; text: with their texts."""

    def row(t) -> Column:
        said = [t["str"].alias("s")] if text else []
        return F.struct(t["norm_baseline"].alias("b"), t["item_idx"].alias("i"), t["norm_x"].alias("x"), (t["norm_x"] + t["norm_w"]).alias("r"), t["norm_y"].alias("y"), F.length(t["str"]).alias("n"), *said)

    return packed_rows(items, keys, row)


def anchor_starts(baselines: Column, threshold: Column | float) -> Column:
    """Baselines that begin a cluster: each that is threshold or more from the first of the cluster so far."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    empty = F.expr("cast(array() as array<double>)")
    return F.aggregate(baselines, empty, lambda acc, b: F.when((F.size(acc) == 0) | (F.abs(b - F.element_at(acc, -1)) >= limit), F.concat(acc, F.array(b))).otherwise(acc))


def line_of(starts: Column, b: Column) -> Column:
    """Number from 0 of the cluster that a baseline is in: of the last start that is not above it."""
    return F.size(F.filter(starts, lambda s: s <= b)) - 1


def slices(items: Column, places: Column) -> Column:
    """Array of the parts of items that begin at places, from 1."""
    return F.transform(places, lambda p, k: F.slice(items, p, F.coalesce(F.get(places, k + 1), F.size(items) + 1) - p))


def lines_by_first(items: Column, threshold: float = SAME_LINE) -> Column:
    """Items in baseline order, parted into lines by the baseline of each line's first item."""
    places = lambda bs: F.transform(anchor_starts(bs, threshold), lambda s: F.array_position(bs, s).cast("int"))
    return bound(bound(F.transform(items, lambda t: t["b"]), places), lambda at: slices(items, at))


def each(values: Column) -> Column:
    """values for explode: from a plain column Spark infers a filter, which computes the column once more."""
    return F.transform(values, lambda v: v)


def _each_line(page: DataFrame, keys: Sequence[str], lines: Column, of: Callable[[Column], Column]) -> DataFrame:
    """A row for each line: keys, line (from 0) and what of makes of its items."""
    return page.select(*keys, F.posexplode(F.transform(lines, of)).alias("line", "l")).select(*keys, "line", "l.*")


def _across(line: Column, *fields: str) -> Column:
    """Items of a line from left to right; ties by the other fields."""
    return F.sort_array(F.transform(line, lambda t: F.struct(*[t[f].alias(f) for f in fields])))


def group_lines(items: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Lines with the baseline of their first item, smallest top and largest bottom. boxes: only items that overlap
    one of their page's boxes across."""
    if boxes is not None:
        near = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x1", "x2")).alias("spans"))
        meets = lambda t: F.exists("spans", lambda s: (t["norm_x"] < s["x2"]) & (t["norm_x"] + t["norm_w"] > s["x1"]))
        items = items.join(near, list(PAGE))
        items = items.withColumn("items", F.filter("items", meets)).filter(F.size("items") > 0) if is_packed(items) else items.filter(meets({c: F.col(c) for c in ("norm_x", "norm_w")}))
    found = lambda g: F.struct(g[0]["b"].alias("baseline"), F.array_min(F.transform(g, lambda t: t["y"])).alias("top"), F.element_at(g, -1)["b"].alias("bottom"), F.size(g).cast("long").alias("n_items"))
    return _each_line(in_order(items), PAGE, lines_by_first(F.col("items")), found)


def count_lines(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    return in_order(items, keys).select(*keys, F.size(anchor_starts(F.transform("items", lambda x: x["b"]), SAME_LINE)).alias("n_lines"))


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("double")


def clusters_of(bs: Column) -> Column:
    """Array of (baseline, count): sorted baselines in clusters with anchors less than MICRO away."""

    def count(starts: Column) -> Column:
        place = lambda s: F.array_position(bs, s)
        return F.transform(starts, lambda s, i: F.struct(s.alias("baseline"), (F.coalesce(place(F.get(starts, i + 1)), F.size(bs) + 1) - place(s)).cast("int").alias("count")))

    return bound(anchor_starts(bs, MICRO), count)


def micro_clusters(items: DataFrame, keys: Sequence[str] = PAGE, rounded: bool = False) -> DataFrame:
    """keys, clusters: array of (baseline, count) with anchors less than MICRO away. rounded: baselines are rounded first."""
    page = packed_rows(items, keys, lambda t: half_up(t["norm_baseline"]) if rounded else t["norm_baseline"])
    return page.select(*keys, F.size("items").alias("n_items"), clusters_of(F.col("items")).alias("clusters"))


def spacings(values: Column) -> Column:
    """Differences of neighbours; empty for fewer than two."""
    gaps = lambda vs: F.when(F.size(vs) >= 2, F.transform(F.sequence(F.lit(1), F.size(vs) - 1), lambda i: F.get(vs, i) - F.get(vs, i - 1))).otherwise(F.expr("cast(array() as array<double>)"))
    return bound(values, gaps)


def threshold_of(clusters: Column, n_items: Column) -> Column:
    """threshold, path: how far baselines of one line may be apart."""
    fits = lambda v: F.coalesce((v > MICRO) & (v < SAME_LINE), F.lit(False))
    near = lambda v: F.greatest(F.lit(MICRO), v * 0.7)
    told = lambda v, path: F.struct(v.alias("threshold"), F.lit(path).alias("path"))
    at = lambda cs: F.transform(cs, lambda c: c["baseline"])
    stable = F.array_min(spacings(at(F.filter(clusters, lambda c: c["count"] >= 2))))
    middle = bound(F.sort_array(spacings(at(clusters))), lambda gaps: F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")))
    none = told(F.lit(SAME_LINE), "none")
    by_middle = lambda m: F.when((F.size(clusters) >= 3) & fits(m), told(near(m), "fallback")).otherwise(none)
    by_stable = lambda v: F.when(fits(v), told(near(v), "stable")).otherwise(bound(middle, by_middle))
    return F.when(n_items >= 4, bound(stable, by_stable)).otherwise(none)


def adaptive_threshold(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, threshold, path (stable, fallback or none): how far baselines of one line may be apart."""
    page = micro_clusters(items, keys).withColumn("t", threshold_of(F.col("clusters"), F.col("n_items")))
    return page.select(*keys, "n_items", F.size("clusters").alias("n_clusters"), "t.threshold", "t.path")


def _widest_gaps(lines: Column) -> Column:
    """The widest gap of each line of two items or more (the first of equals), if over GAP_MIN: gap, back, gap_left, gap_right, line."""

    def widest(line: Column, n: Column) -> Column:
        gap = lambda g: F.transform(g, lambda t, k: bound(F.get(g, k - 1)["r"], lambda left: F.struct((t["x"] - left).alias("gap"), (-k).alias("back"), left.alias("gap_left"), t["x"].alias("gap_right"), n.alias("line"))))
        return F.array_max(bound(_across(line, "x", "b", "i", "r"), gap))

    return F.filter(F.transform(lines, widest), lambda g: g["gap"] > GAP_MIN)


def line_gap_candidates(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """The widest gap of each line of two items or more (the first of equals), if over GAP_MIN."""
    gaps = in_order(items, keys).select(*keys, F.inline(_widest_gaps(lines_by_first(F.col("items")))))
    return gaps.select(*keys, "line", "gap", "gap_left", "gap_right")


def _agreed(lines: Column) -> Column:
    """separator, cluster_size: where gaps of lines agree, null where they do not."""
    by_right = lambda gaps: F.sort_array(F.transform(gaps, lambda g: F.struct(g["gap_right"].alias("right"), g["line"].alias("line"), ((g["gap_left"] + g["gap_right"]) / 2).alias("centre"))))

    def cluster(gaps: Column) -> Column:
        far = lambda k: F.coalesce(F.get(gaps, k - 1)["right"] - F.get(gaps, k - 2)["right"] >= CLUSTER_RANGE, k == 1)
        groups = slices(gaps, F.filter(F.sequence(F.lit(1), F.size(gaps)), far))
        best = F.array_max(F.transform(groups, lambda g, k: F.struct(F.size(g).cast("long").alias("n"), (-k).alias("back"), F.sort_array(F.transform(g, lambda t: t["centre"])).alias("centres"))))
        told = lambda b: F.when(b["n"] >= F.ceil(0.3 * F.size(lines)), F.struct(F.get(b["centres"], F.floor(F.size(b["centres"]) / 2).cast("int")).alias("separator"), b["n"].alias("cluster_size")))
        return F.when(F.size(gaps) >= 2, bound(best, told))

    return bound(by_right(_widest_gaps(lines)), cluster)


def cluster_gap_edges(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Where gaps line up: right edges in order, a new cluster at CLUSTER_RANGE or more from the previous; the largest
    cluster (first of equals) with at least 0.3 of the lines gives the median of its gap centres."""
    page = _line_pages(items, keys)
    fit = bound(_agreed(F.col("lines")), lambda a: F.when(a.isNotNull(), F.array(a)))
    return page.select(*keys, F.inline(fit), F.size("lines").alias("n_lines"))


def packed(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, items: one array for each key."""
    return items if is_packed(items) else items.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in items.columns if c not in keys])).alias("items"))


def _by_first(t: SimpleNamespace) -> SimpleNamespace:
    return arrays.numbered(t, arrays.anchors(t, SAME_LINE))


def _line_pages(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lines: the items of each line by its first baseline."""
    of = lambda t: (np.arange(len(t.per)), [arrays.lines_of_pages(_by_first(t), LINE)])
    return arrays.each_page(packed(items, keys), keys, {"lines": f"array<array<{arrays.struct_of(LINE)}>>"}, of)


def merge_line_intervals(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Unions of touching item spans on each line."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = _by_first(t)
        found = arrays.spans(t)
        return t.of[found.line], [pa.array(t.number[found.line], pa.int32()), pa.array(arrays.places(found.line) + 1), pa.array(found.left), pa.array(found.right)]

    return arrays.each_page(packed(items, keys), keys, {"line": "int", "span": "long", "left": "double", "right": "double"}, of)


def _covered(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line pages with x0 and coverage: an array by bucket."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = _by_first(t)
        x0, n, found = arrays.coverage(t, BUCKET)
        return np.arange(len(t.per)), [arrays.lines_of_pages(t, LINE), pa.array(x0), arrays.lists(pa.array(found), n)]

    return arrays.each_page(packed(items, keys), keys, {"lines": f"array<array<{arrays.struct_of(LINE)}>>", "x0": "double", "coverage": "array<long>"}, of)


def x_coverage(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """How many lines cover each bucket of BUCKET units from the page's left-most item on; uncovered buckets are 0."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        x0, n, found = arrays.coverage(_by_first(t), BUCKET)
        page = np.repeat(np.arange(len(n)), n)
        return page, [pa.array(x0[page]), pa.array(arrays.places(page), pa.int32()), pa.array(found)]

    return arrays.each_page(packed(items, keys), keys, {"x0": "double", "bucket": "int", "coverage": "long"}, of)


def _low_bands(lines: Column, coverage: Column, x0: Column) -> Column:
    """Array of bands: start_x, end_x, least, centre."""
    n = F.size(coverage)
    limit = F.greatest(F.lit(1), F.ceil(COVERAGE * F.size(lines)))

    def bands(low: Column) -> Column:
        is_low = lambda b: F.coalesce(F.get(low, b), F.lit(False))
        edges = lambda step: F.filter(F.sequence(F.lit(0), n - 1), lambda b: F.get(low, b) & ~is_low(b + step))
        runs = F.filter(F.arrays_zip(edges(-1).alias("b0"), edges(1).alias("b1")), lambda r: (r["b1"] < n - 1) & ((r["b1"] + 1 - r["b0"]) * BUCKET >= BAND_WIDTH))

        def band(r: Column) -> Column:
            own = F.slice(coverage, r["b0"] + 1, r["b1"] + 1 - r["b0"])

            def told(least: Column) -> Column:
                lowest = F.filter(F.transform(own, lambda c, k: F.when(c == least, (k + r["b0"]).cast("long"))), lambda b: b.isNotNull())
                mean = bound(lowest, lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda a, b: a + b) / F.size(bs))
                return F.struct((x0 + r["b0"] * BUCKET).alias("start_x"), (x0 + (r["b1"] + 1) * BUCKET).alias("end_x"), least.alias("least"), (x0 + (mean + 0.5) * BUCKET).alias("centre"))

            return bound(F.array_min(own), told)

        return F.transform(runs, band)

    return bound(F.transform(coverage, lambda c: c < limit), bands)


def low_coverage_bands(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Runs of buckets that fewer than 0.8 of the lines cover, BAND_WIDTH wide at least; a run that reaches the last
    bucket is not a band. The centre is the mean of the least covered buckets."""
    return _covered(items, keys).select(*keys, F.inline(_low_bands(F.col("lines"), F.col("coverage"), F.col("x0"))))


def separator_verdict(lines: Column, separator: Column, cut_gap: float) -> Column:
    """ok, exclusive_ratio: whether a line down the page parts lines (their items from left to right) into two columns."""
    left_side = lambda t: (t["x"] + t["r"]) / 2 <= separator

    def judge(every: Column) -> Column:
        part = lambda side: F.filter(every, left_side if side else lambda t: ~left_side(t))
        told = lambda g: F.struct((F.array_max(F.transform(g, lambda t: t["r"])) - F.array_min(F.transform(g, lambda t: t["x"]))).alias("span"), F.aggregate(g, F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("chars"))
        clear = lambda g: F.exists(F.transform(g, lambda t, k: bound(F.get(g, k - 1)["r"], lambda before: F.coalesce((before <= separator) & (t["x"] >= separator) & (t["x"] - before > cut_gap), F.lit(False)))), lambda c: c)
        crossing = F.filter(lines, lambda g: (g[0]["x"] < separator) & (F.array_max(F.transform(g, lambda t: t["r"])) > separator))
        bad = lambda cuts: F.size(F.filter(cuts, lambda g: ~clear(g)))
        clean = bound(crossing, lambda cuts: (F.size(cuts) == 0) | (bad(cuts) / F.size(cuts) <= 0.2))
        own = F.size(F.filter(lines, lambda g: F.exists(g, left_side) != F.exists(g, lambda t: ~left_side(t))))

        def weigh(v: Column) -> Column:
            a, left, right = v["a"], v["l"], v["r"]
            wide = (a["span"] <= 0) | (F.least(left["span"], right["span"]) / a["span"] >= 0.10)
            full = (a["chars"] <= 0) | (F.least(left["chars"], right["chars"]) / a["chars"] >= 0.05)
            return F.coalesce(left["span"].isNotNull() & right["span"].isNotNull() & wide & full & clean, F.lit(False))

        return F.struct(bound(F.struct(told(every).alias("a"), told(part(True)).alias("l"), told(part(False)).alias("r")), weigh).alias("ok"), (own / F.size(lines)).alias("exclusive_ratio"))

    return bound(F.flatten(lines), judge)


def _sorted_lines(lines: Column) -> Column:
    return F.transform(lines, lambda g: _across(g, "x", "i", "r", "n"))


def test_separator(items: DataFrame, separators: DataFrame | Column, cut_gap: float = GAP_MIN, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, separator, ok, exclusive_ratio: whether a line down the page parts it into two columns. separators: a table
    by keys, or an array of them for all pages."""
    page = _line_pages(items, keys).withColumn("lines", _sorted_lines(F.col("lines")))
    tried = page.select("*", F.explode(separators).alias("separator")) if isinstance(separators, Column) else page.join(separators, list(keys))
    return tried.select(*keys, "separator", separator_verdict(F.col("lines"), F.col("separator"), cut_gap).alias("v")).select(*keys, "separator", "v.ok", "v.exclusive_ratio")


def split_columns(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Items with column (1, or 2 right of the separator) and separator (null where there is one column).

    Separators are tried from two sources: where the gaps of lines agree, then the centres of low bands that are not within
    CLUSTER_RANGE of one tried before. Of those that part the items the one with the most lines on one side alone is
    taken (the first of equals), if these are over EXCLUSIVE of all. Else the widest band may part them by stricter rules.
    Where no separator parts them, there is one column."""
    items = packed(items, keys)
    own = items.withColumnRenamed("items", "own").withColumn("items", F.col("own"))
    page = _covered(own, [*keys, "own"]).withColumn("bands", _low_bands(F.col("lines"), F.col("coverage"), F.col("x0"))).withColumn("agreed", _agreed(F.col("lines"))["separator"])
    far = lambda acc, v: F.forall(acc, lambda t: F.abs(t - v) >= CLUSTER_RANGE)
    first = F.filter(F.array("agreed"), lambda v: v.isNotNull())
    tries = F.aggregate(F.transform("bands", lambda b: b["centre"]), first, lambda acc, v: F.when(far(acc, v), F.concat(acc, F.array(v))).otherwise(acc))
    page = page.select(*keys, "own", "bands", F.size("lines").alias("n_lines"), tries.alias("tries"), _sorted_lines(F.col("lines")).alias("lines"))
    verdicts = F.transform("tries", lambda t, k: bound(separator_verdict(F.col("lines"), t, GAP_MIN), lambda v: F.struct(v["ok"].alias("ok"), v["exclusive_ratio"].alias("ratio"), (-k).alias("back"), t.alias("separator"))))
    best = F.array_max(F.filter(verdicts, lambda v: v["ok"]))
    widest = F.get(F.sort_array(F.transform("bands", lambda b: F.struct((b["start_x"] - b["end_x"]).alias("back"), b["start_x"].alias("at"), b["least"].alias("least"), b["centre"].alias("separator")))), 0)
    fits = lambda w: (w["least"] < F.greatest(F.lit(1), F.ceil(STRICT_COVERAGE * F.col("n_lines")))) & (-w["back"] >= STRICT_WIDTH)
    strict = lambda w: F.when(fits(w), F.when(separator_verdict(F.col("lines"), w["separator"], STRICT_GAP)["ok"], w["separator"]))
    chosen = bound(best, lambda b: F.when(b["ratio"] > EXCLUSIVE, b["separator"]).when(b.isNotNull(), bound(widest, strict)))
    flat = page.select(*keys, "own", chosen.alias("separator")).select(*keys, "separator", F.inline("own"))
    right = F.col("norm_x") + F.col("norm_w") / 2 > F.col("separator")
    return flat.withColumn("column", F.when(F.coalesce(right, F.lit(False)), 2).otherwise(1))


def adaptive_limit(items: Column) -> Column:
    """adaptive_threshold of packed items in baseline order."""
    return bound(F.transform(items, lambda t: t["b"]), lambda bs: bound(clusters_of(bs), lambda cs: threshold_of(cs, F.size(bs))))["threshold"]


def line_starts(items: Column, limit: Column, any_overlap: bool = False) -> Column:
    """Places, from 1, where lines begin: within limit of a line's first baseline an item joins and widens the line's core;
    beyond, it joins without widening if it overlaps the core by 2 or more (any_overlap: at all), else it begins a line."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("first"), none.alias("top"), none.alias("bottom"), F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(acc: Column, t: Column) -> Column:
        near = F.coalesce(t["b"] - acc["first"] < limit, F.lit(False))
        overlap = F.least(acc["bottom"], t["b"]) - F.greatest(acc["top"], t["y"])
        touch = F.coalesce((overlap > 0) if any_overlap else (overlap >= 2.0), F.lit(False)) & acc["first"].isNotNull()
        state = lambda first, top, bottom, starts: F.struct(first.alias("first"), top.alias("top"), bottom.alias("bottom"), (acc["at"] + 1).alias("at"), starts.alias("starts"))
        return (
            F.when(near, state(acc["first"], F.least(acc["top"], t["y"]), F.greatest(acc["bottom"], t["b"]), acc["starts"]))
            .when(touch, state(acc["first"], acc["top"], acc["bottom"], acc["starts"])).otherwise(state(t["b"], t["y"], t["b"], F.concat(acc["starts"], F.array(acc["at"]))))
        )

    return F.aggregate(items, start, step, lambda acc: acc["starts"])


def adaptive_lines(t: SimpleNamespace, any_overlap: bool = False) -> SimpleNamespace:
    """Lines by the adaptive threshold (limit, of each page)."""
    limit = arrays.thresholds(t, MICRO, SAME_LINE)
    return arrays.numbered(SimpleNamespace(**vars(t), limit=limit), arrays.line_starts(t, limit, any_overlap))


def _assigned(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lines: the items of each line, by the adaptive threshold."""
    of = lambda t: (np.arange(len(t.per)), [arrays.lines_of_pages(adaptive_lines(t), LINE)])
    return arrays.each_page(packed(items, keys), keys, {"lines": f"array<array<{arrays.struct_of(LINE)}>>"}, of)


def assign_lines(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Items with their line, by the adaptive threshold: near the line's first baseline an item joins and widens the
    line's core; beyond, it joins without widening if it overlaps the core by 2 or more, else it begins a line."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = adaptive_lines(t)
        return t.page, [pa.array(t.limit[t.page]), pa.array(t.number[t.line], pa.int32()), *arrays.structs(t, LINE).flatten()]

    return arrays.each_page(packed(items, keys), keys, {"threshold": "double", "line": "int"} | {f: arrays.FIELDS[f] for f in LINE}, of)


def _left_most(line: Column) -> Column:
    """Baseline of a line's left-most item."""
    return F.array_min(F.transform(line, lambda t: F.struct(t["x"].alias("x"), t["b"].alias("b"), t["i"].alias("i"))))["b"]


def _median(gaps: Column) -> Column:
    return F.when(F.size(gaps) >= 2, F.get(F.sort_array(gaps), F.floor(F.size(gaps) / 2).cast("int"))).otherwise(0.0)


def _gapped(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, firsts (baseline of each line's left-most item), gaps, median_gap."""
    page = _assigned(items, keys).select(*keys, F.transform("lines", _left_most).alias("firsts"))
    page = page.withColumn("gaps", spacings(F.col("firsts")))
    return page.withColumn("median_gap", _median(F.col("gaps")))


def line_summary(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, n_items, n_lines, threshold, path, median_gap: adaptive_threshold and the lines that it gives."""
    told = lambda bs: bound(clusters_of(bs), lambda cs: threshold_of(cs, F.size(bs)))
    firsts = lambda items, t: bound(line_starts(items, t["threshold"]), lambda at: F.transform(slices(items, at), _left_most))
    of = lambda items, t, fs: F.struct(F.size(items).alias("n_items"), F.size(fs).cast("long").alias("n_lines"), t["threshold"].alias("threshold"), t["path"].alias("path"), bound(spacings(fs), _median).alias("median_gap"))
    summary = lambda items: bound(bound(F.transform(items, lambda t: t["b"]), told), lambda t: bound(firsts(items, t), lambda fs: of(items, t, fs)))
    return in_order(items, keys).select(*keys, F.inline(F.transform(F.array("items"), summary)))


def line_gaps(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, line, baseline (of the left-most item), gap to the line before, median_gap (from two gaps on)."""
    flat = _gapped(items, keys).select(*keys, F.posexplode(each(F.col("firsts"))).alias("line", "baseline"), "gaps", "median_gap")
    return flat.select(*keys, "line", "baseline", F.get("gaps", F.col("line") - 1).alias("gap"), "median_gap", F.size("gaps").alias("n_gaps"))


def paragraph_breaks(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Lines with break: the gap before is over 1.3 of its reference, the lower third of the gaps around it (of all, if
    fewer than five)."""
    n = F.size("gaps")

    def told(median: Column, k: Column) -> Column:
        first = F.greatest(k - PARA_WINDOW, F.lit(1))
        local = bound(F.sort_array(F.slice("gaps", first, k + PARA_WINDOW + 1 - first)), lambda around: F.get(around, F.floor(F.size(around) * 0.3).cast("int")))
        gap = F.get("gaps", k - 1)
        wide = bound(F.when(n >= 5, local).otherwise(median), lambda reference: F.coalesce((reference > 0) & (gap > reference * PARA_RATIO), F.lit(False)))
        return F.struct(gap.alias("gap"), wide.alias("break"))

    flat = _gapped(items, keys).select(*keys, F.posexplode(bound(F.col("median_gap"), lambda median: F.transform("firsts", lambda f, k: told(median, k)))).alias("line", "l"))
    return flat.select(*keys, "line", "l.gap", "l.break")


def inline_separator(gap: Column) -> Column:
    """What stands before an item, by its distance from the one before: tab, blank, line break or nothing."""
    return F.when(gap > TAB_GAP, "\t").when(gap > BLANK_GAP, " ").when(gap < WRAP, "\n").otherwise("")


def _inline_separators(gap: np.ndarray) -> np.ndarray:
    """inline_separator of an array."""
    return np.select([gap > TAB_GAP, gap > BLANK_GAP, gap < WRAP], ["\t", " ", "\n"], "").astype(object)


def line_texts(items: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, line, text: items from left to right with what stands between."""

    def of(t: SimpleNamespace) -> tuple[np.ndarray, list[pa.Array]]:
        t = adaptive_lines(t)
        o = arrays.order((t.line, t.x, t.b, t.i), (t.r, t.s))
        return t.of, [pa.array(t.number, pa.int32()), arrays.texts(t.line[o], t.x[o], t.r[o], t.s.take(pa.array(o)), len(t.of), _inline_separators)]

    return arrays.each_page(packed(items, keys), keys, {"line": "int", "text": "string"}, of)


# --- diagnostics -----------------------------------------------------------------------------------------------


def layout_scan(items: DataFrame) -> DataFrame:
    """For each page: items, threshold, least, middle and largest gap of rounded micro clusters, and how many gaps fall
    between MICRO and the threshold; a page passes without any."""
    rounded = clusters_of(F.transform("items", lambda t: half_up(t["b"])))
    gaps = F.sort_array(spacings(F.transform(rounded, lambda c: c["baseline"])))

    def told(limit: Column, g: Column) -> Column:
        danger = F.size(F.filter(g, lambda v: (v > MICRO) & (v < limit)))
        middle = F.get(g, F.floor(F.size(g) / 2).cast("int"))
        judge = lambda n: F.struct(limit.alias("threshold"), F.array_min(g).alias("least"), middle.alias("middle"), F.array_max(g).alias("largest"), n.alias("n_danger"), (n == 0).alias("passed"))
        return bound(danger, judge)

    page = in_order(items).select(*PAGE, F.size("items").alias("n_items"), bound(adaptive_limit(F.col("items")), lambda limit: bound(gaps, lambda g: told(limit, g))).alias("v"))
    return page.select(*PAGE, "n_items", "v.*")


def danger_gaps(items: DataFrame) -> DataFrame:
    """Neighbouring clusters closer than the threshold, with the texts of both. Items stand in order, so a cluster is a slice
    of them and its text is made once."""
    said = lambda g: F.array_join(F.transform(F.sort_array(F.transform(g, lambda t: F.struct(t["i"].alias("i"), t["s"].alias("s")))), lambda t: t["s"]), " ")

    def near(cs: Column, limit: Column) -> Column:
        gap = lambda k: F.get(cs, k + 1)["at"] - F.get(cs, k)["at"]
        pairs = F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda k: (gap(k) > MICRO) & (gap(k) < limit))
        wanted = lambda ks: F.transform(cs, lambda c, k: F.when(F.array_contains(ks, k) | F.array_contains(ks, k - 1), said(c["g"])))
        pair = lambda ts, k: F.struct(F.get(cs, k)["at"].alias("upper"), F.get(cs, k + 1)["at"].alias("lower"), F.get(ts, k).alias("upper_text"), F.get(ts, k + 1).alias("lower_text"))
        return bound(pairs, lambda ks: bound(wanted(ks), lambda ts: F.transform(ks, lambda k: pair(ts, k))))

    def clusters(items: Column) -> Column:
        places = lambda bs: F.transform(anchor_starts(bs, MICRO), lambda s: F.array_position(bs, s).cast("int"))
        parts = bound(bound(F.transform(items, lambda t: half_up(t["b"])), places), lambda at: slices(items, at))
        return F.transform(parts, lambda g: F.struct(half_up(g[0]["b"]).alias("at"), g.alias("g")))

    found = lambda items: bound(adaptive_limit(items), lambda limit: bound(clusters(items), lambda cs: near(cs, limit)))
    return in_order(items, text=True).select(*PAGE, F.inline(F.flatten(F.transform(F.array("items"), found))))


def smallest_gaps(items: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest gaps between micro clusters of each page."""
    gaps = F.array_sort(spacings(F.transform("clusters", lambda c: c["baseline"])))
    return micro_clusters(items, rounded=True).select(*PAGE, F.slice(gaps, 1, n).alias("smallest"))


def line_listing(items: DataFrame) -> DataFrame:
    """Per line: baseline and x range, number of items, text from left to right, and the gap to the line before."""
    page = in_order(items, text=True).select(*PAGE, lines_by_first(F.col("items")).alias("lines"))

    def told(g: Column, k: Column) -> Column:
        text = F.array_join(F.transform(_across(g, "x", "i", "s"), lambda t: t["s"]), " ")
        ends = (F.array_min(F.transform(g, lambda t: t["x"])).alias("x_min"), F.array_max(F.transform(g, lambda t: t["r"])).alias("x_max"))
        return F.struct(g[0]["b"].alias("b_min"), F.element_at(g, -1)["b"].alias("b_max"), *ends, F.size(g).cast("long").alias("n_items"), text.alias("text"), (g[0]["b"] - F.get("lines", k - 1)[0]["b"]).alias("gap"))

    return _each_line(page, PAGE, F.col("lines"), told)


def sort_items(items: DataFrame) -> DataFrame:
    """Items of each page numbered by baseline, then x, then input order."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("norm_baseline", "norm_x", "item_idx")))
