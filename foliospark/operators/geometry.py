"""Page geometry whose steps depend on each other: one row per page, many pages per Arrow batch.

Snapping a box to its text, settling overlaps across, parting columns, joining fragments of a line and putting the text
together. Items keep their input order; boxes are [x1, y1, x2, y2] in thousandths of the page. Everything that can be
told from items and original boxes alone (neighbours, who owns an item) is told once per page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import CJK, PUA_MAP
from foliospark.operators.lines import BAND_WIDTH, BUCKET, CLUSTER_RANGE, COVERAGE, EXCLUSIVE, GAP_MIN, MICRO, PARA_RATIO, PARA_WINDOW, SAME_LINE, BLANK_GAP, is_packed, STRICT_COVERAGE, STRICT_GAP, STRICT_WIDTH, TAB_GAP, WRAP
from foliospark.operators.regions import CJK_DESCENDER, CONTAINED, DESCENDER, MIN_GAP, sweep

PASSES = 6
TOLERANCE = 3.0
_cjk = re.compile(CJK)
_pua = str.maketrans({c: PUA_MAP.get(chr(c), "●") for c in range(0xE000, 0xF900)})


@dataclass
class Page:
    """Items of a page as arrays, in input order."""

    text: list[str]
    x: np.ndarray
    y: np.ndarray
    right: np.ndarray
    base: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, items) -> Page:
        rows = sorted(items, key=lambda r: r["item_idx"])
        a = lambda k: np.array([r[k] for r in rows], float)
        return cls([r["str"] for r in rows], a("norm_x"), a("norm_y"), a("norm_x") + a("norm_w"), a("norm_baseline"), a("norm_h"))

    @classmethod
    def each(cls, items: pa.Array) -> Iterator[Page]:
        """The pages of a list array of items, taken from flat columns; null is a page without items."""
        flat = items.flatten()
        text = flat.field("str").to_pylist()
        at = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("item_idx", "norm_x", "norm_y", "norm_w", "norm_h", "norm_baseline")}
        ends = np.cumsum(pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False))
        for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            k = a + np.argsort(at["item_idx"][a:z], kind="stable")
            v = {n: c[k].astype(float) for n, c in at.items()}
            yield cls([text[j] for j in k], v["norm_x"], v["norm_y"], v["norm_x"] + v["norm_w"], v["norm_baseline"], v["norm_h"])

    def __post_init__(self) -> None:
        cjk = np.array([bool(_cjk.search(t)) for t in self.text], bool)
        self.cjk = cjk
        self.ink = self.base + self.h * np.where(cjk, CJK_DESCENDER, DESCENDER)
        self.top = self.y + self.h * np.where(cjk, 0.10, 0.25)
        self.bottom = self.base + self.h * 0.05

    def neighbours(self) -> tuple[np.ndarray, ...]:
        """Gap to and top of the nearest item above and below that overlaps across; inf and nan without one."""
        out = []
        for sign in (1, -1):
            at = sweep(self.x, self.right, sign * self.base)
            has = at >= 0
            out += [np.where(has, np.abs(self.base - self.base[at]), np.inf), np.where(has, self.y[at], np.nan)] if len(at) else [np.zeros(0)] * 2
        return tuple(out)

    def owned(self, boxes: np.ndarray) -> np.ndarray:
        """(boxes x items): whether each original box may have each item against all the others."""
        out = np.ones((len(boxes), len(self.x)), bool)
        if len(boxes) < 2:
            return out
        above_gap, above_top, below_gap, below_top = self.neighbours()
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if i == j or min(a[2], b[2]) <= max(a[0], b[0]):
                    continue
                within = lambda c: (self.y >= c[1]) & (self.base <= c[3])
                holds = lambda top, c: (top >= c[1]) & (top < c[3])
                hi, lo = max(a[1], b[1]), min(a[3], b[3])
                free = (within(a) & ~within(b)) | ((lo <= hi) & ~((self.y < b[3]) & (self.ink > b[1])))
                top = np.where(above_gap < below_gap, above_top, np.where(below_gap < above_gap, below_top, np.nan))
                mine, theirs = holds(top, a), holds(top, b)
                ea, eb = list(a[[1, 3]]), list(b[[1, 3]])
                if lo > hi:
                    upper, lower = (ea, eb) if a[1] <= b[1] else (eb, ea)
                    upper[1], lower[0] = min(upper[1], (hi + lo) / 2), max(lower[0], (hi + lo) / 2)
                cover = lambda e: np.maximum(0, np.minimum(self.ink, e[1]) - np.maximum(self.y, e[0]))
                out[i] &= free | np.where(mine & ~theirs, True, np.where(theirs & ~mine, False, cover(ea) >= cover(eb)))
        return out


def snap(page: Page, box: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """Grow a box to the items that it touches and owns, then shrink it to them."""
    b = box.copy()
    width = page.right - page.x
    for _ in range(PASSES):
        before = b.copy()
        across = np.minimum(page.right, b[2]) - np.maximum(page.x, b[0])
        touching = (across > 0) & (page.y < b[3]) & (page.ink > b[1])
        inside = page.base[touching]
        strong = touching & (np.divide(across, width, out=np.zeros_like(across), where=width > 0) >= 0.5)
        strong_base, strong_left, strong_right = page.base[strong], page.x[strong], page.right[strong]
        on_line = lambda v, of: bool(len(of)) and bool((np.abs(of - v) <= SAME_LINE).any())

        def fits(side: int, edge: float, b=b, strong_base=strong_base) -> bool:
            """Whether what lies beyond this side, up to the edge, stands on lines of the box."""
            lo, hi = (edge, b[0]) if side == 0 else (b[2], edge)
            if not len(strong_base) or hi <= lo:
                return True
            level = (page.y < b[3]) & (page.ink > b[1])
            crossing = page.right > b[0] if side == 0 else page.x < b[2]
            strip = level & (page.x < hi) & (page.right > lo) & ~crossing
            return all((np.abs(strong_base - v) <= TOLERANCE).any() for v in page.base[strip])

        def widen(k: int, b=b, fits=fits) -> None:
            if page.x[k] < b[0] and fits(0, page.x[k]):
                b[0] = page.x[k]
            if page.right[k] > b[2] and fits(2, page.right[k]):
                b[2] = page.right[k]

        for k in range(len(page.x)):
            if not (page.y[k] < b[3] and page.ink[k] > b[1]):
                continue
            overlap = min(page.right[k], b[2]) - max(page.x[k], b[0])
            tall = page.h[k]
            if overlap <= 0:
                if 0 <= -overlap <= tall and owned[k] and on_line(page.base[k], inside):
                    widen(k)
                continue
            share = overlap / width[k] if width[k] > 0 else 0.0
            if share >= 0.5:
                if not owned[k]:
                    continue
                widen(k)
            elif overlap <= tall:
                if owned[k] and on_line(page.base[k], inside):
                    widen(k)
            else:
                after, before_ = page.x[k] - strong_right, strong_left - page.right[k]
                beside = ((after >= 0) & (after <= tall)) | ((before_ >= 0) & (before_ <= tall))
                if (beside & (np.abs(strong_base - page.base[k]) <= SAME_LINE)).any() and owned[k]:
                    widen(k)
            if owned[k]:
                b[1], b[3] = min(b[1], page.top[k]), max(b[3], page.bottom[k])
        if (b == before).all():
            break
    across = np.minimum(page.right, b[2]) - np.maximum(page.x, b[0])
    held = owned & (across > 0) & (page.y < b[3]) & (page.ink > b[1])
    if held.any():
        b[1], b[3] = max(b[1], page.top[held].min()), min(b[3], page.bottom[held].max())
        wide = held & (np.divide(across, width, out=np.zeros_like(across), where=width > 0) >= 0.5)
        if wide.any():
            b[0], b[2] = max(b[0], page.x[wide].min()), min(b[2], page.right[wide].max())
    return b


def contained(boxes: np.ndarray) -> list[int]:
    """Places of boxes that stay."""
    gone: set[int] = set()
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    for i in range(len(boxes)):
        for j in range(i + 1, len(boxes)):
            if i in gone or j in gone:
                continue
            a, b = boxes[i], boxes[j]
            shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if area(a) > 0 and shared / area(a) >= CONTAINED:
                gone.add(i)
            elif area(b) > 0 and shared / area(b) >= CONTAINED:
                gone.add(j)
    return [i for i in range(len(boxes)) if i not in gone]


def resolve_x_overlaps(page: Page, boxes: np.ndarray) -> np.ndarray:
    """Boxes side by side that overlap: the one with less text in the overlap gives way, the right one on ties."""
    out = boxes.copy()
    centre = (page.x + page.right) / 2
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            left, right = (out[i], out[j]) if out[i][0] <= out[j][0] else (out[j], out[i])
            x0, x1 = max(left[0], right[0]), min(left[2], right[2])
            y0, y1 = max(left[1], right[1]), min(left[3], right[3])
            if x1 <= x0 or y1 <= y0:
                continue
            level = (page.base >= y0) & (page.y <= y1)
            lines = lambda m: np.unique(np.floor(page.base[m] + 0.5))
            own_left = lines(level & (centre < x0) & (centre > left[0]) & (centre < left[2]))
            own_right = lines(level & (centre > x1) & (centre > right[0]) & (centre < right[2]))
            if not len(own_left) or not len(own_right):
                continue
            few, many = (own_left, own_right) if len(own_left) <= len(own_right) else (own_right, own_left)
            match = (np.abs(few[:, None] - many[None, :]) < SAME_LINE).any(1).mean()
            inside = level & (page.right > x0) & (page.x < x1)
            middle = (x0 + x1) / 2
            to_left = inside & (centre < middle)
            to_right = inside & ~to_left
            parted = match >= 0.8
            span = lambda m, a, z: (np.minimum(page.right[m], z) - np.maximum(page.x[m], a)).sum()
            left_cover = span(to_left, x0, middle if parted else x1)
            right_cover = span(to_right, middle if parted else x0, x1)
            if left_cover >= right_cover:
                right[0] = left[2]
            else:
                left[2] = right[0]
    return out


def enforce_gap(boxes: np.ndarray) -> np.ndarray:
    out = boxes.copy()
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            upper, lower = (out[i], out[j]) if out[i][1] <= out[j][1] else (out[j], out[i])
            lack = MIN_GAP - (lower[1] - upper[3])
            if min(upper[2], lower[2]) > max(upper[0], lower[0]) and lack > 0:
                upper[3] -= lack / 2
                lower[1] += lack / 2
    return out


def descend(page: Page, boxes: np.ndarray) -> np.ndarray:
    out = boxes.copy()
    for i, b in enumerate(boxes):
        near = (page.x < b[2]) & (page.right > b[0]) & (np.abs(page.base - b[3]) < SAME_LINE)
        if near.any():
            below = [c[1] for c in boxes if c[1] > b[1] and min(b[2], c[2]) > max(b[0], c[0])]
            room = page.h[near].max() * (CJK_DESCENDER if page.cjk[near].any() else DESCENDER)
            out[i][3] = min(min(below, default=1000.0) - MIN_GAP, b[3] + room)
    return out


def correct(page: Page, boxes: np.ndarray) -> list[np.ndarray]:
    """Boxes after snapping, overlaps, gaps and descenders: all four, the last is the result."""
    owned = page.owned(boxes)
    snapped = np.array([snap(page, b, o) for b, o in zip(boxes, owned, strict=True)]) if len(boxes) else boxes
    apart = resolve_x_overlaps(page, snapped)
    spaced = enforce_gap(apart)
    return [snapped, apart, spaced, descend(page, spaced)]


def shared_lines(page: Page, boxes: np.ndarray) -> np.ndarray:
    """A line that two boxes cover goes to the side with the smaller gap (a diagnostic step; not part of correct)."""
    out = boxes.copy()
    near = np.array([((page.x[k] < out[:, 2]) & (page.right[k] > out[:, 0])).any() for k in range(len(page.x))], bool)
    lines = [np.array(g) for g in by_anchor([k for k in np.argsort(page.base, kind="stable") if near[k]], page.base, SAME_LINE)]
    edges = [(page.y[g].min(), page.base[g].max()) for g in lines]
    for k, (top, bottom) in enumerate(edges):
        covering = sorted((i for i in range(len(out)) if top < out[i][3] and bottom > out[i][1]), key=lambda i: out[i][1])
        above = top - edges[k - 1][1] if k else math.inf
        below = edges[k + 1][0] - bottom if k + 1 < len(edges) else math.inf
        if len(covering) < 2 or above == below:
            continue
        upper, lower = out[covering[0]], out[covering[-1]]
        if min(upper[2], lower[2]) <= max(upper[0], lower[0]):
            continue
        if below < above:
            upper[3] = min(upper[3], top)
        else:
            lower[1] = max(lower[1], bottom)
    return out


# --- text ------------------------------------------------------------------------------------------------------


def by_anchor(order, base: np.ndarray, limit: float) -> list[list[int]]:
    """Items in order, a new group when limit or more from the first of the group."""
    out: list[list[int]] = []
    for k in order:
        if out and abs(base[k] - base[out[-1][0]]) < limit:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def separator_test(page: Page, hits: np.ndarray, at: float, cut_gap: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Hits left and right of a line down the page and the share of lines on one side only; None if it parts no columns."""
    x, r = page.x[hits], page.right[hits]
    is_left = (x + r) / 2 <= at
    if is_left.all() or not is_left.any():
        return None
    span = r.max() - x.min()
    width = lambda m: r[m].max() - x[m].min()
    if span > 0 and min(width(is_left), width(~is_left)) / span < 0.10:
        return None
    chars = np.array([len(page.text[k]) for k in hits])
    if chars.sum() and min(chars[is_left].sum(), chars[~is_left].sum()) / chars.sum() < 0.05:
        return None
    side = dict(zip(hits.tolist(), is_left.tolist(), strict=True))
    cuts = bad = own = 0
    lines = by_anchor(hits[np.argsort(page.base[hits], kind="stable")], page.base, SAME_LINE)
    for line in lines:
        row = sorted(line, key=lambda k: page.x[k])
        if page.x[row].min() < at < page.right[row].max():
            cuts += 1
            bad += not any(page.right[a] <= at <= page.x[b] and page.x[b] - page.right[a] > cut_gap for a, b in zip(row, row[1:], strict=False))
        own += len({side[k] for k in line}) == 1
    if cuts and bad / cuts > 0.2:
        return None
    return hits[is_left], hits[~is_left], own / len(lines)


def gap_separator(page: Page, lines: list[list[int]]) -> float | None:
    """Where the widest gaps of many lines agree."""
    gaps = []
    for line in lines:
        row = sorted(line, key=lambda k: page.x[k])
        found = [(page.x[b] - page.right[a], page.right[a], page.x[b]) for a, b in zip(row, row[1:], strict=False)]
        widest = max(found, key=lambda g: g[0], default=(0, 0, 0))
        if widest[0] > GAP_MIN:
            gaps.append(widest[1:])
    if len(gaps) < 2:
        return None
    gaps.sort(key=lambda g: g[1])
    clusters = [[gaps[0]]]
    for g in gaps[1:]:
        if g[1] - clusters[-1][-1][1] < CLUSTER_RANGE:
            clusters[-1].append(g)
        else:
            clusters.append([g])
    best = max(clusters, key=len)
    return sorted((a + z) / 2 for a, z in best)[len(best) // 2] if len(best) >= math.ceil(0.3 * len(lines)) else None


def low_bands(page: Page, hits: np.ndarray, lines: list[list[int]]) -> list[tuple[float, float, int, float]]:
    """(start, end, least coverage, centre of the least covered) of stretches that few lines cover."""
    x0, x9 = page.x[hits].min(), page.right[hits].max()
    n = math.ceil((x9 - x0) / BUCKET) + 1
    cover = np.zeros(n, int)
    for line in lines:
        row = np.zeros(n, bool)
        reach = None
        for k in sorted(line, key=lambda k: page.x[k]):  # touching items are one span
            if reach is None or page.x[k] > reach[1]:
                reach = [page.x[k], page.right[k]]
            reach[1] = max(reach[1], page.right[k])
            row[max(0, int((reach[0] - x0) // BUCKET)) : min(n - 1, int((reach[1] - x0) // BUCKET)) + 1] = True
        cover += row
    low = cover < max(1, math.ceil(COVERAGE * len(lines)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(int), [0]])))
    out = []
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        if z < n and (z - a) * BUCKET >= BAND_WIDTH:
            least = cover[a:z].min()
            centre = x0 + (np.flatnonzero(cover[a:z] == least).mean() + a + 0.5) * BUCKET
            out.append((x0 + a * BUCKET, x0 + z * BUCKET, int(least), float(centre)))
    return out


def split_columns(page: Page, hits: np.ndarray) -> list[np.ndarray]:
    """One column or two."""
    if len(hits) <= 1:
        return [hits]
    lines = by_anchor(hits[np.argsort(page.base[hits], kind="stable")], page.base, SAME_LINE)
    first = gap_separator(page, lines)
    tries = [] if first is None else [first]
    bands = low_bands(page, hits, lines)
    for band in bands:
        if all(abs(t - band[3]) >= CLUSTER_RANGE for t in tries):
            tries.append(band[3])
    tested = [t for t in (separator_test(page, hits, s, GAP_MIN) for s in tries) if t]
    if not tested:
        return [hits]
    best = max(tested, key=lambda t: t[2])
    if best[2] > EXCLUSIVE:
        return [best[0], best[1]]
    if bands:
        wide = max(bands, key=lambda b: b[1] - b[0])
        if wide[2] < max(1, math.ceil(STRICT_COVERAGE * len(lines))) and wide[1] - wide[0] >= STRICT_WIDTH:
            strict = separator_test(page, hits, wide[3], STRICT_GAP)
            if strict:
                return [strict[0], strict[1]]
    return [hits]


def threshold_of(base: np.ndarray) -> float:
    """base: sorted. How far baselines of one line may be apart."""
    if len(base) < 4:
        return SAME_LINE
    starts, counts = [base[0]], [1]
    for v in base[1:]:
        if v - starts[-1] < MICRO:
            counts[-1] += 1
        else:
            starts.append(v)
            counts.append(1)
    stable = [s for s, n in zip(starts, counts, strict=True) if n >= 2]
    all_gaps = sorted(np.diff(starts).tolist())
    for gap in ([min(np.diff(stable))] if len(stable) >= 2 else []) + ([all_gaps[len(all_gaps) // 2]] if len(starts) >= 3 else []):
        if MICRO < gap < SAME_LINE:
            return max(MICRO, 0.7 * gap)
    return SAME_LINE


def assigned_lines(page: Page, order: np.ndarray, limit: float) -> list[list[int]]:
    lines: list[list[int]] = []
    top = bottom = 0.0
    for k in order.tolist():
        if lines and page.base[k] - page.base[lines[-1][0]] < limit:
            top, bottom = min(top, page.y[k]), max(bottom, page.base[k])
        elif not (lines and min(bottom, page.base[k]) - max(top, page.y[k]) >= 2.0):
            lines.append([])
            top, bottom = page.y[k], page.base[k]
        lines[-1].append(k)
    return [sorted(line, key=lambda k: page.x[k]) for line in lines]


def merge_fragments(page: Page, lines: list[list[int]], limit: float) -> list[list[int]]:
    """Short lines near each other that together span more than either are one."""
    spans = [(page.x[g].min(), page.right[g].max()) for g in lines]
    width = lambda s: s[1] - s[0]
    reference = sorted(map(width, spans))[int(len(spans) * 0.75)] if len(lines) >= 3 else 0
    if reference <= 50:
        return lines
    lines, i = list(lines), 0
    while i < len(lines):
        j = i + 1 if width(spans[i]) < 0.7 * reference else len(lines)
        while j < min(i + 4, len(lines)):
            both = (min(spans[i][0], spans[j][0]), max(spans[i][1], spans[j][1]))
            near = abs(page.base[lines[i][0]] - page.base[lines[j][0]]) <= 2.5 * limit
            if width(spans[j]) < 0.7 * reference and near and width(both) >= 1.2 * max(width(spans[i]), width(spans[j])):
                lines[i] = sorted(lines[i] + lines.pop(j), key=lambda k: page.x[k])
                spans[i] = both
                spans.pop(j)
            else:
                j += 1
        i += 1
    return lines


def column_text(page: Page, hits: np.ndarray) -> str:
    if not len(hits):
        return ""
    order = hits[np.argsort(page.base[hits], kind="stable")]
    limit = threshold_of(page.base[order])
    lines = merge_fragments(page, assigned_lines(page, order, limit), limit)
    gaps = [page.base[b[0]] - page.base[a[0]] for a, b in zip(lines, lines[1:], strict=False)]
    middle = sorted(gaps)[len(gaps) // 2] if len(gaps) >= 2 else 0.0
    out = []
    for n, line in enumerate(lines):
        if n:
            near = sorted(gaps[max(0, n - 1 - PARA_WINDOW) : n + PARA_WINDOW])
            reference = near[int(len(near) * 0.3)] if len(gaps) >= 5 else middle
            out.append("\n\n" if reference > 0 and gaps[n - 1] > reference * PARA_RATIO else "\n")
        for m, k in enumerate(line):
            if m:
                gap = page.x[k] - page.right[line[m - 1]]
                out.append("\t" if gap > TAB_GAP else " " if gap > BLANK_GAP else "\n" if gap < WRAP else "")
            out.append(page.text[k])
    return "".join(out).translate(_pua)


def region_text(page: Page, box: np.ndarray) -> tuple[str, int, int]:
    """Text, number of hits and of columns."""
    hits = np.flatnonzero((page.x < box[2]) & (page.right > box[0]) & (page.y < box[3]) & (page.base > box[1]))
    columns = split_columns(page, hits)
    return "\n\n".join(t for t in (column_text(page, c) for c in columns) if t), len(hits), len(columns)


# --- jobs ------------------------------------------------------------------------------------------------------

RESULT = "file_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double, original_bbox array<double>, text string, n_hits int, n_columns int, phases array<array<double>>"


#: Pages of an Arrow batch that are taken apart at a time.
AT_ONCE = 256


def pack_pages(items: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row per page with regions: its items and boxes. A page without items keeps its boxes. Items and boxes are of
    one page only, so a row is as large as a page; this is the one large shuffle. Without regions the rows of items are
    pages that hold boxes already, and nothing is shuffled."""
    if regions is None:
        return items
    packed = items if is_packed(items) else items.groupBy("file_id", "page").agg(F.collect_list(F.struct("item_idx", "str", "norm_x", "norm_y", "norm_w", "norm_h", "norm_baseline")).alias("items"))
    told = [c for c in ("text",) if c in regions.columns]
    boxes = regions.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2", *told))).alias("boxes"))
    return boxes.join(packed, ["file_id", "page"], "left").select("file_id", "page", "items", "boxes")


def _sent(pages: DataFrame) -> DataFrame:
    """Pages with their boxes in order; of texts of boxes only those that are kept are sent."""
    has = "text" in pages.schema["boxes"].dataType.elementType.names
    kept = lambda b: [F.when(b["text"].startswith("⏳"), b["text"]).alias("kept")] if has else []
    return pages.select("file_id", "page", "items", F.array_sort(F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("ord", "x1", "y1", "x2", "y2")], *kept(b)))).alias("boxes"))


def _fields(schema: str) -> pa.Schema:
    return pa.schema([pa.field(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])


def _each_page(pages: DataFrame, of: Callable[[Page, list[dict], np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that of makes of each page, its boxes in their order and their sides, behind file_id and page."""
    kinds = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                file_id, number, boxes = (part.column(c).to_pylist() for c in ("file_id", "page", "boxes"))
                rows = []
                for f, p, bs, page in zip(file_id, number, boxes, Page.each(part.column("items")), strict=True):
                    sides = np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in bs], float).reshape(-1, 4)
                    rows += [(f, p, *r) for r in of(page, bs, sides)]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return _sent(pages).mapInArrow(run, schema)


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def _extract(pages: DataFrame, alone: bool) -> DataFrame:
    """RESULT of pages, those of an Arrow batch side by side (abreast.py)."""
    from foliospark.operators.abreast import extracted

    sent, kinds = _sent(pages), _fields(RESULT)
    return sent.mapInArrow(lambda batches: (out for batch in batches for out in extracted(batch, kinds, alone)), RESULT)


def extract_text_for_regions(items: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Contained boxes dropped, the others corrected, and the text of each in reading order."""
    return _extract(pack_pages(items, regions), False)


def reextract_region(items: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Each box by itself, no other box considered; text that tells of progress (⏳) is kept. A page's items are there once,
    whatever the number of its boxes."""
    out = _extract(pack_pages(items, boxes), True)
    return out.select("file_id", "page", "ord", "x1", "y1", "x2", "y2", "original_bbox", "text")


def _shared(page: Page, boxes: list[dict], sides: np.ndarray) -> Iterator[tuple]:
    return ((b["ord"], *v.tolist()) for b, v in zip(boxes, shared_lines(page, sides), strict=True))


def resolve_shared_lines(items: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    return _each_page(pack_pages(items, regions), _shared, "file_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double")
