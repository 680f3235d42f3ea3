"""The page helper (geometry.py) over the pages of an Arrow batch side by side.

Items of all pages lie in flat arrays, page by page in input order. Steps in which a box moves item by item take the first item
of every page, then the second, and so on, in grids of (item, box); steps that only ask lie over all items of all boxes. What comes
out is what geometry.py makes of each page by itself; the tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliospark.operators import arrays, geometry, lines, regions

#: Cells of a grid of items and boxes, and of rows laid out at a time.
CELLS = 1 << 18
#: Pages with more boxes settle those pair by pair by themselves.
MANY = 12


def runs(sizes: np.ndarray, most: int = CELLS) -> Iterator[slice]:
    """Slices of at most so much in all, of one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right")))
        yield slice(at, to)
        at = to


def pages_of(items: pa.ListArray) -> SimpleNamespace:
    """Items of pages in flat arrays; a page that is null has none."""
    per = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, page = items.flatten(), np.repeat(np.arange(len(per)), per)
    idx = flat.field("item_idx").to_numpy(zero_copy_only=False)
    if not ((idx[1:] >= idx[:-1]) | (page[1:] != page[:-1])).all():
        flat = flat.take(pa.array(np.lexsort((idx, page))))
    x, y, w, h, base = (flat.field(f"norm_{n}").to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y", "w", "h", "baseline"))
    text = pc.fill_null(flat.field("str"), "")
    cjk = pc.match_substring_regex(text, regions._CJK).to_numpy(zero_copy_only=False).astype(bool)
    ink = base + h * np.where(cjk, regions.CJK_DESCENDER, regions.DESCENDER)
    top, bottom = y + h * np.where(cjk, 0.10, 0.25), base + h * 0.05
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    return SimpleNamespace(page=page, per=per, first=np.cumsum(per) - per, x=x, y=y, right=x + w, base=base, h=h, cjk=cjk, ink=ink, top=top, bottom=bottom, text=text, chars=chars)


def grid(t: SimpleNamespace, pages: np.ndarray, *fields: str) -> SimpleNamespace:
    """Fields of the items of pages as grids (item, page), nan behind a page's last item; at: their places."""
    n = t.per[pages]
    rank = np.arange(n.max(initial=0))[:, None]
    at = np.where(rank < n, t.first[pages] + rank, len(t.x))
    padded = lambda v: np.append(v, False if v.dtype == bool else np.nan)[at]
    return SimpleNamespace(at=at, **{f: padded(vars(t)[f]) for f in fields})


def by_size(t: SimpleNamespace, pages: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pages, those of like size together, as many as a grid holds."""
    order = np.argsort(-t.per[pages], kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, CELLS // max(1, int(t.per[pages[order[at]]])))
        yield order[at:to]
        at = to


def boxes_of(page: np.ndarray, sides: np.ndarray, group: np.ndarray) -> SimpleNamespace:
    """Boxes (their pages, sides) in groups that are told apart; the boxes of a group stand together."""
    per = np.bincount(group, minlength=1)
    return SimpleNamespace(page=page, sides=sides, group=group, per=per, first=np.cumsum(per) - per)


def ownership(t: SimpleNamespace, b: SimpleNamespace) -> np.ndarray:
    """Whether each box may have each item of its page against the other boxes of its group, box by box. A group of several boxes is a page."""
    alone = b.per[b.group] < 2
    if alone.all():
        return np.ones(int(t.per[b.page].sum()), bool)
    several = np.zeros(len(t.per), bool)
    several[b.page[~alone]] = True
    n = np.where(several, t.per, 0)  # pages of one box need no neighbours
    held = np.flatnonzero(several[t.page])
    told = np.full(len(t.x), np.nan)
    told[held] = regions.nearer_top(t.page[held], *(v[held] for v in (t.x, t.right, t.y, t.base)))
    judged = regions.judged(n, t.first, b.page, b.sides, np.arange(len(b.page)), t.y, t.base, t.ink, told)
    out, per_box = np.ones(int(t.per[b.page].sum()), bool), t.per[b.page]
    out[np.repeat(~alone, per_box)] = judged
    return out


def _near(base: np.ndarray, marked: np.ndarray, reach: float) -> np.ndarray:
    """Whether a marked item is within reach of each, along the first axis; base stands in order."""
    before = np.maximum.accumulate(np.where(marked, base, -np.inf), axis=0)
    after = np.minimum.accumulate(np.where(marked, base, np.inf)[::-1], axis=0)[::-1]
    return (np.abs(before - base) <= reach) | (np.abs(after - base) <= reach)


def _widen(g: SimpleNamespace, b: np.ndarray, k: int, rows: np.ndarray) -> None:
    """Sides of boxes (rows) that grow to item k, where what lies between stands on lines of the box."""
    for side, edge in ((0, g.x[k]), (2, g.right[k])):
        out = rows[edge[rows] < b[0, rows] if side == 0 else edge[rows] > b[2, rows]]
        asked = out[g.strong[:, out].any(0)] if len(out) else out
        if len(asked):
            x, right, now, to = g.x[:, asked], g.right[:, asked], b[:, asked], edge[asked]
            strip = (g.y[:, asked] < now[3]) & (g.ink[:, asked] > now[1])
            # what reaches over the side does not lie between
            strip &= (x < now[0]) & (right > to) & ~(right > now[0]) if side == 0 else (x < to) & (right > now[2]) & ~(x < now[2])
            out = np.setdiff1d(out, asked[(strip & ~g.firm[:, asked]).any(0)], assume_unique=True)
        b[side, out] = edge[out]


def _pass(g: SimpleNamespace, b: np.ndarray) -> None:
    """One pass of snap over boxes b (side, box) and the items of their pages."""
    across = np.minimum(g.right, b[2]) - np.maximum(g.x, b[0])
    touching = (across > 0) & (g.y < b[3]) & (g.ink > b[1])
    g.strong = touching & (across >= g.half)
    column = np.arange(b.shape[1])
    lay = lambda v: v[g.order, column]
    base = lay(g.base)
    on_line, g.firm = np.empty_like(touching), np.empty_like(touching)
    on_line[g.order, column] = _near(base, lay(touching), lines.SAME_LINE)
    g.firm[g.order, column] = _near(base, lay(g.strong), geometry.TOLERANCE)
    for k in range(len(g.x)):
        level = (g.y[k] < b[3]) & (g.ink[k] > b[1])
        if not level.any():
            continue
        x, right, tall, owned = g.x[k], g.right[k], g.h[k], g.owned[k]
        overlap = np.minimum(right, b[2]) - np.maximum(x, b[0])
        outside = overlap <= 0
        most = ~outside & (overlap >= g.half[k])
        taken = level & owned
        line = taken & on_line[k]
        grow = (taken & most) | (line & outside & (-overlap <= tall)) | (line & ~outside & ~most & (overlap <= tall))
        rest = np.flatnonzero(taken & ~outside & ~most & ~(overlap <= tall))
        if len(rest):
            s = g.strong[:, rest]
            after, before = x[rest] - g.right[:, rest], g.x[:, rest] - right[rest]
            beside = ((after >= 0) & (after <= tall[rest])) | ((before >= 0) & (before <= tall[rest]))
            grow[rest[(s & beside & (np.abs(g.base[:, rest] - g.base[k, rest]) <= lines.SAME_LINE)).any(0)]] = True
        rows = np.flatnonzero(grow & ((x < b[0]) | (right > b[2])))
        if len(rows):
            _widen(g, b, k, rows)
        deep = taken & ~outside
        b[1] = np.where(deep & (g.top[k] < b[1]), g.top[k], b[1])
        b[3] = np.where(deep & (g.bottom[k] > b[3]), g.bottom[k], b[3])


def snap(t: SimpleNamespace, page: np.ndarray, sides: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """geometry.snap of boxes (box, side); owned: box by box."""
    out, begins = sides.copy(), np.cumsum(t.per[page]) - t.per[page]
    for rows in by_size(t, page):
        g = grid(t, page[rows], "x", "y", "right", "base", "h", "ink", "top", "bottom")
        width = g.right - g.x
        g.half, g.order = np.where(width > 0, width / 2, np.inf), np.argsort(g.base, axis=0, kind="stable")  # half of an item's width
        rank = np.arange(len(g.x))[:, None]
        g.owned = np.append(owned, False)[np.where(rank < t.per[page[rows]], begins[rows] + rank, len(owned))]
        b, live = out[rows].T.copy(), np.arange(len(rows))
        for _ in range(geometry.PASSES):
            of = g if len(live) == len(rows) else SimpleNamespace(**{n: v[:, live] for n, v in vars(g).items() if n not in ("strong", "firm")})
            now = b[:, live]
            _pass(of, now)
            moved = ~(now == b[:, live]).all(0)
            b[:, live] = now
            live = live[moved]
            if not len(live):
                break
        across = np.minimum(g.right, b[2]) - np.maximum(g.x, b[0])
        held = g.owned & (across > 0) & (g.y < b[3]) & (g.ink > b[1])
        wide = held & (across >= g.half)
        low = lambda v, m: np.where(m, v, np.inf).min(0, initial=np.inf)
        high = lambda v, m: np.where(m, v, -np.inf).max(0, initial=-np.inf)
        some, broad = held.any(0), wide.any(0)
        b[1], b[3] = np.where(some, np.maximum(b[1], low(g.top, held)), b[1]), np.where(some, np.minimum(b[3], high(g.bottom, held)), b[3])
        b[0], b[2] = np.where(broad, np.maximum(b[0], low(g.x, wide)), b[0]), np.where(broad, np.minimum(b[2], high(g.right, wide)), b[2])
        out[rows] = b.T
    return out


def contained(b: SimpleNamespace) -> np.ndarray:
    """Whether each box stays: boxes of a page in turn, each against those behind it."""
    gone, area = np.zeros(len(b.page), bool), (b.sides[:, 2] - b.sides[:, 0]) * (b.sides[:, 3] - b.sides[:, 1])
    for i in range(int(b.per.max(initial=0)) - 1):
        groups = np.flatnonzero(b.per > i + 1)
        groups = groups[~gone[b.first[groups] + i]]
        n = b.per[groups] - i - 1
        one = np.repeat(b.first[groups] + i, n)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        one, two = one[~gone[two]], two[~gone[two]]
        p, q = b.sides[one].T, b.sides[two].T
        shared = np.maximum(0, np.minimum(p[2], q[2]) - np.maximum(p[0], q[0])) * np.maximum(0, np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]))
        within = lambda of: (of > 0) & (np.divide(shared, of, out=np.zeros_like(shared), where=of > 0) >= regions.CONTAINED)  # noqa: B023, E731
        first, second = within(area[one]), within(area[two])
        until = np.full(len(gone), len(gone))  # the box that a box lies in ends its turn
        np.minimum.at(until, one[first], two[first])
        gone[two[second & ~first & (two < until[one])]] = True
        gone[one[first]] = True
    return ~gone


def _pairs(b: SimpleNamespace) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes that a page holds in turn, the pages with few boxes side by side."""
    few = np.where(b.per <= MANY, b.per, 0)
    for i in range(int(few.max(initial=0))):
        for j in range(i + 1, int(few.max())):
            first = b.first[few > j]
            yield first + i, first + j


def _many(b: SimpleNamespace) -> Iterator[tuple[int, slice]]:
    """Pages with many boxes, and the places of these."""
    for g in np.flatnonzero(b.per > MANY).tolist():
        yield int(b.page[b.first[g]]), slice(int(b.first[g]), int(b.first[g] + b.per[g]))


def resolve_x_overlaps(t: SimpleNamespace, b: SimpleNamespace, sides: np.ndarray) -> np.ndarray:
    """geometry.resolve_x_overlaps of the boxes of all pages."""
    out = sides.copy()
    for p, own in _many(b):
        z = slice(int(t.first[p]), int(t.first[p] + t.per[p]))
        out[own] = geometry.resolve_x_overlaps(SimpleNamespace(x=t.x[z], y=t.y[z], right=t.right[z], base=t.base[z]), sides[own])
    for one, two in _pairs(b):
        swap = ~(out[one, 0] <= out[two, 0])
        left, right = np.where(swap, two, one), np.where(swap, one, two)
        meets = (np.minimum(out[left, 2], out[right, 2]) > np.maximum(out[left, 0], out[right, 0])) & (np.minimum(out[left, 3], out[right, 3]) > np.maximum(out[left, 1], out[right, 1]))
        left, right = left[meets], right[meets]
        for some in by_size(t, b.page[left]):
            _part(t, b.page[left[some]], out, left[some], right[some])
    return out


def _part(t: SimpleNamespace, page: np.ndarray, out: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Settle boxes left and right of pages that overlap, one pair to a page."""
    g, a, z = grid(t, page, "x", "y", "right", "base"), out[left].T, out[right].T
    x0, x1, y0, y1 = np.maximum(a[0], z[0]), np.minimum(a[2], z[2]), np.maximum(a[1], z[1]), np.minimum(a[3], z[3])
    centre, column = (g.x + g.right) / 2, np.arange(len(page))
    level = (g.base >= y0) & (g.y <= y1)
    order = np.argsort(g.base, axis=0, kind="stable")
    row = np.floor(g.base + 0.5)[order, column]
    beside = ((level & (centre < x0) & (centre > a[0]) & (centre < a[2]))[order, column], (level & (centre > x1) & (centre > z[0]) & (centre < z[2]))[order, column])

    def rows(mask: np.ndarray) -> np.ndarray:
        """The first item of each row."""
        last = np.maximum.accumulate(np.where(mask, row, -np.inf), axis=0)
        return mask & (row > np.concatenate([np.full((1, len(page)), -np.inf), last[:-1]])) if len(mask) else mask

    def near(mask: np.ndarray) -> np.ndarray:
        before = np.maximum.accumulate(np.where(mask, row, -np.inf), axis=0)
        after = np.minimum.accumulate(np.where(mask, row, np.inf)[::-1], axis=0)[::-1]
        return (row - before < lines.SAME_LINE) | (after - row < lines.SAME_LINE)

    own = [rows(m) for m in beside]
    n = [m.sum(0) for m in own]
    few = np.where(n[0] <= n[1], own[0], own[1])
    match = (few & np.where(n[0] <= n[1], near(beside[1]), near(beside[0]))).sum(0) / np.maximum(1, np.minimum(*n))
    inside, middle, parted = level & (g.right > x0) & (g.x < x1), (x0 + x1) / 2, match >= 0.8
    to_left = inside & (centre < middle)
    span = lambda m, lo, hi: np.where(m, np.minimum(g.right, hi) - np.maximum(g.x, lo), 0.0).sum(0)
    keep_left = span(to_left, x0, np.where(parted, middle, x1)) >= span(inside & ~to_left, np.where(parted, middle, x0), x1)
    settled = (n[0] > 0) & (n[1] > 0)
    out[right, 0] = np.where(settled & keep_left, a[2], z[0])
    out[left, 2] = np.where(settled & ~keep_left, z[0], a[2])


def enforce_gap(b: SimpleNamespace, sides: np.ndarray) -> np.ndarray:
    """geometry.enforce_gap of the boxes of all pages."""
    out = sides.copy()
    for _, own in _many(b):
        out[own] = geometry.enforce_gap(sides[own])
    for one, two in _pairs(b):
        swap = ~(out[one, 1] <= out[two, 1])
        upper, lower = np.where(swap, two, one), np.where(swap, one, two)
        lack = regions.MIN_GAP - (out[lower, 1] - out[upper, 3])
        near = (np.minimum(out[upper, 2], out[lower, 2]) > np.maximum(out[upper, 0], out[lower, 0])) & (lack > 0)
        upper, lower, lack = upper[near], lower[near], lack[near]
        out[upper, 3] -= lack / 2
        out[lower, 1] += lack / 2
    return out


def descend(t: SimpleNamespace, b: SimpleNamespace, sides: np.ndarray) -> np.ndarray:
    """geometry.descend of the boxes of all pages."""
    out, below = sides.copy(), np.full(len(sides), np.inf)
    for j in range(int(b.per.max(initial=0))):
        rows = np.flatnonzero(b.per[b.group] > j)
        other, own = sides[b.first[b.group[rows]] + j].T, sides[rows].T
        under = (other[1] > own[1]) & (np.minimum(own[2], other[2]) > np.maximum(own[0], other[0]))
        below[rows] = np.where(under, np.minimum(below[rows], other[1]), below[rows])
    below = np.where(np.isinf(below), 1000.0, below)
    for rows in by_size(t, b.page):
        g, s = grid(t, b.page[rows], "x", "right", "base", "h", "cjk"), sides[rows].T
        near = (g.x < s[2]) & (g.right > s[0]) & (np.abs(g.base - s[3]) < lines.SAME_LINE)
        room = np.where(near, g.h, -np.inf).max(0, initial=-np.inf) * np.where((near & g.cjk).any(0), regions.CJK_DESCENDER, regions.DESCENDER)
        least, room = below[rows] - regions.MIN_GAP, s[3] + room
        out[rows, 3] = np.where(near.any(0), np.where(room < least, room, least), s[3])
    return out


def corrected(t: SimpleNamespace, b: SimpleNamespace) -> list[np.ndarray]:
    """geometry.correct of the boxes of all pages."""
    snapped = snap(t, b.page, b.sides, ownership(t, b))
    apart = resolve_x_overlaps(t, b, snapped)
    spaced = enforce_gap(b, apart)
    return [snapped, apart, spaced, descend(t, b, spaced)]


# --- text ------------------------------------------------------------------------------------------------------


def hits(t: SimpleNamespace, page: np.ndarray, sides: np.ndarray) -> SimpleNamespace:
    """Items of each box in baseline order, as arrays.in_order gives those of pages; k: their places. Boxes without items have none."""
    found = []
    for rows in by_size(t, page):
        g, s = grid(t, page[rows], "x", "y", "right", "base"), sides[rows].T
        row, k = np.nonzero(((g.x < s[2]) & (g.right > s[0]) & (g.y < s[3]) & (g.base > s[1])).T)
        found.append((rows[row], g.at[k, row]))
    row, k = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (zip(*found, strict=True) if found else ((), ())))
    at = np.lexsort((k, t.base[k], row))
    return _flat(t, row[at], k[at])


def _flat(t: SimpleNamespace, group: np.ndarray, k: np.ndarray) -> SimpleNamespace:
    """Items k in groups that stand together; own: the group of each number."""
    own, page = np.unique(group, return_inverse=True)
    per = np.bincount(page, minlength=len(own))
    return SimpleNamespace(own=own, page=page, per=per, first=np.cumsum(per) - per, k=k, i=k, b=t.base[k], x=t.x[k], r=t.right[k], y=t.y[k], n=t.chars[k])


def _first_of(groups: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Place of the first of each group in the order of keys, of equals the first."""
    order = np.lexsort((*keys[::-1], groups))
    return order[np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0]))] if len(order) else order


def _across(t: SimpleNamespace) -> SimpleNamespace:
    """Lines by their first baseline, their items from left to right: xs, rs, ns, mid, gap (to the item before), opens (a line)."""
    t = arrays.numbered(t, arrays.anchors(t, lines.SAME_LINE))
    o = np.lexsort((t.x, t.line))
    xs, rs = t.x[o], t.r[o]
    opens = np.zeros(len(xs), bool)
    opens[t.at] = True
    gap = np.where(opens, -np.inf, xs - np.concatenate([[0.0], rs[:-1]]))
    return SimpleNamespace(**vars(t), xs=xs, rs=rs, ns=t.n[o], mid=((t.x + t.r) / 2)[o], gap=gap, opens=opens, left=np.minimum.reduceat(xs, t.at), right=np.maximum.reduceat(rs, t.at), n_lines=np.bincount(t.of, minlength=len(t.per)))


def gap_separators(t: SimpleNamespace) -> np.ndarray:
    """geometry.gap_separator of each box, nan for none."""
    out = np.full(len(t.per), np.nan)
    widest = np.maximum.reduceat(t.gap, t.at)
    place = np.minimum.reduceat(np.where(t.gap == np.repeat(widest, np.diff([*t.at, len(t.xs)])), np.arange(len(t.xs)), len(t.xs)), t.at)
    wide = widest > lines.GAP_MIN
    box, place = t.of[wide], place[wide]
    if not len(box):
        return out
    left, right = t.rs[place - 1], t.xs[place]
    o = np.lexsort((right, box))
    box, left, right = box[o], left[o], right[o]
    begins = np.flatnonzero(np.concatenate([[True], (box[1:] != box[:-1]) | ~(np.diff(right) < lines.CLUSTER_RANGE)]))
    size, of = np.diff([*begins, len(box)]), box[begins]
    centre = ((left + right) / 2)[np.lexsort(((left + right) / 2, np.repeat(np.arange(len(begins)), size)))]
    best = _first_of(of, -size)
    best = best[(np.bincount(box, minlength=len(out))[of[best]] >= 2) & (size[best] >= np.ceil(0.3 * t.n_lines[of[best]]))]
    out[of[best]] = centre[begins[best] + size[best] // 2]
    return out


def low_bands(t: SimpleNamespace) -> SimpleNamespace:
    """geometry.low_bands of all boxes: box, start, end, least, centre, in their order."""
    x0, x9 = np.minimum.reduceat(t.x, t.first), np.maximum.reduceat(t.r, t.first)
    n = np.ceil((x9 - x0) / lines.BUCKET).astype(np.int64) + 1
    first, total = np.cumsum(n + 1) - (n + 1), int((n + 1).sum())
    found = arrays.spans(t)
    box = t.of[found.line]
    place = lambda v: ((v - x0[box]) // lines.BUCKET).astype(np.int64)
    a, z = np.maximum(0, place(found.left)), np.minimum(n[box] - 1, place(found.right))
    own = z >= a
    a, z, box, line = a[own], z[own], box[own], found.line[own]
    a[1:] = np.where(line[1:] == line[:-1], np.maximum(a[1:], z[:-1] + 1), a[1:])  # a line covers a bucket once
    change = np.bincount(first[box] + a, minlength=total) - np.bincount(first[box] + z + 1, minlength=total)
    cover = np.cumsum(change)
    cover[first + n] = np.iinfo(np.int64).max  # behind the last bucket
    low = cover < np.repeat(np.maximum(1, np.ceil(lines.COVERAGE * t.n_lines)), n + 1)
    edge = np.diff(np.concatenate([[0], low.astype(np.int8), [0]]))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    box = np.searchsorted(first, a, side="right") - 1
    kept = (z - first[box] < n[box]) & ((z - a) * lines.BUCKET >= lines.BAND_WIDTH)
    a, z, box = a[kept], z[kept], box[kept]
    if not len(a):
        return SimpleNamespace(box=box, start=np.zeros(0), end=np.zeros(0), least=a, centre=np.zeros(0))
    least = np.minimum.reduceat(cover, np.stack([a, z], 1).ravel())[::2]
    band, within = np.repeat(np.arange(len(a)), z - a), arrays.places(np.repeat(np.arange(len(a)), z - a))
    lowest = cover[a[band] + within] == least[band]
    mean = np.bincount(band, np.where(lowest, within, 0)) / np.bincount(band, lowest)
    a, z = a - first[box], z - first[box]
    return SimpleNamespace(box=box, start=x0[box] + a * lines.BUCKET, end=x0[box] + z * lines.BUCKET, least=least, centre=x0[box] + (mean + a + 0.5) * lines.BUCKET)


def separator_tests(t: SimpleNamespace, box: np.ndarray, at: np.ndarray, cut_gap: float) -> tuple[np.ndarray, np.ndarray]:
    """geometry.separator_test of lines down boxes: whether each parts columns, and its share of lines on one side only."""
    ok, ratio = np.zeros(len(box), bool), np.zeros(len(box))
    for some in runs(t.per[box]):
        ok[some], ratio[some] = _tested(t, box[some], at[some], cut_gap)
    return ok, ratio


def _tested(t: SimpleNamespace, box: np.ndarray, at: np.ndarray, cut_gap: float) -> tuple[np.ndarray, np.ndarray]:
    n = t.per[box]
    begins, test = np.cumsum(n) - n, np.repeat(np.arange(len(box)), n)
    k = np.arange(len(test)) + np.repeat(t.first[box] - begins, n)
    x, r, v, of_left = t.xs[k], t.rs[k], at[test], t.mid[k] <= at[test]
    n_left = np.add.reduceat(of_left, begins, dtype=np.int64)
    low = lambda u, m: np.minimum.reduceat(np.where(m, u, np.inf), begins)
    high = lambda u, m: np.maximum.reduceat(np.where(m, u, -np.inf), begins)
    part = lambda of, whole: np.divide(of, whole, out=np.ones(len(of)), where=whole > 0)
    width = np.minimum(high(r, of_left) - low(x, of_left), high(r, ~of_left) - low(x, ~of_left))
    chars = np.add.reduceat(t.ns[k], begins)
    left_chars = np.add.reduceat(np.where(of_left, t.ns[k], 0), begins)
    ok = (n_left > 0) & (n_left < n) & (part(width, high(r, True) - low(x, True)) >= 0.10) & (part(np.minimum(left_chars, chars - left_chars), chars) >= 0.05)
    # lines of each test
    heads = np.flatnonzero(t.opens[k])
    of, line = test[heads], np.searchsorted(t.at, k[heads])
    clear = ~t.opens[k] & (t.rs[k - 1] <= v) & (v <= x) & (t.gap[k] > cut_gap)
    crossing = (t.left[line] < at[of]) & (at[of] < t.right[line])
    count = lambda m: np.bincount(of, m, len(box))
    cuts, bad = count(crossing), count(crossing & ~np.logical_or.reduceat(clear, heads))
    on_left, size = np.add.reduceat(of_left, heads, dtype=np.int64), np.diff([*heads, len(k)])
    return ok & ~(part(bad, cuts) * (cuts > 0) > 0.2), count((on_left == 0) | (on_left == size)) / t.n_lines[box]


def separators(t: SimpleNamespace) -> np.ndarray:
    """Where each box is parted into two columns (geometry.split_columns), nan for one column."""
    t = _across(t)
    first, bands = gap_separators(t), low_bands(t)
    n_bands = np.bincount(bands.box, minlength=len(t.per))
    tries, n = np.full((len(t.per), 1 + int(n_bands.max(initial=0))), np.nan), (~np.isnan(first)).astype(np.int64)
    tries[:, 0], begins = first, np.cumsum(n_bands) - n_bands
    for q in range(tries.shape[1] - 1):
        rows = np.flatnonzero(n_bands > q)
        centre = bands.centre[begins[rows] + q]
        far = ~(np.abs(tries[rows] - centre[:, None]) < lines.CLUSTER_RANGE).any(1)
        tries[rows[far], n[rows[far]]] = centre[far]
        n[rows[far]] += 1
    box = np.repeat(np.arange(len(n)), n)
    at, chosen = tries[box, arrays.places(box)] if len(box) else np.zeros(0), np.full(len(n), np.nan)
    ok, ratio = separator_tests(t, box, at, lines.GAP_MIN)
    box, at, ratio = box[ok], at[ok], ratio[ok]
    best = _first_of(box, -ratio)
    clear = best[ratio[best] > lines.EXCLUSIVE]
    chosen[box[clear]] = at[clear]
    widest = _first_of(bands.box, bands.start - bands.end)
    of = bands.box[widest]
    strict = np.isin(of, box[best[~(ratio[best] > lines.EXCLUSIVE)]]) & (bands.least[widest] < np.maximum(1, np.ceil(lines.STRICT_COVERAGE * t.n_lines[of]))) & (bands.end[widest] - bands.start[widest] >= lines.STRICT_WIDTH)
    widest = widest[strict]
    ok, _ = separator_tests(t, bands.box[widest], bands.centre[widest], lines.STRICT_GAP)
    chosen[bands.box[widest[ok]]] = bands.centre[widest[ok]]
    return chosen


def _take_up(lo: list[float], hi: list[float], b: list[float], limit: float, reference: float) -> list[int]:
    """The line that each line of a column goes into, as geometry.merge_fragments puts fragments together."""
    rows, into, i = [[*r, k] for k, r in enumerate(zip(lo, hi, b, strict=True))], list(range(len(lo))), 0
    while i < len(rows):
        a = rows[i]
        j = i + 1 if a[1] - a[0] < 0.7 * reference else len(rows)
        while j < min(i + 4, len(rows)):
            c = rows[j]
            left, right = min(a[0], c[0]), max(a[1], c[1])
            if c[1] - c[0] < 0.7 * reference and abs(a[2] - c[2]) <= 2.5 * limit and right - left >= 1.2 * max(a[1] - a[0], c[1] - c[0]):
                a[2] = c[2] if c[0] < a[0] else a[2]
                a[0], a[1], into[c[3]] = left, right, a[3]
                rows.pop(j)
            else:
                j += 1
        i += 1
    return into


def _whole(t: SimpleNamespace, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items line by line from left to right, fragments put together: their order, where lines begin, and the lines' columns."""
    o = np.lexsort((t.x, t.line))
    lo, hi, b, n = t.x[o][t.at], np.maximum.reduceat(t.r, t.at), t.b[o][t.at], np.bincount(t.of, minlength=len(t.per))
    first, width = np.cumsum(n) - n, hi - lo
    reference = width[np.lexsort((width, t.of))][first + n * 3 // 4]
    short, begun = width < 0.7 * reference[t.of], np.zeros(len(n), bool)
    for reach in (1, 2, 3):  # the first two lines that go together are so near
        near = short[reach:] & short[:-reach] & (t.of[reach:] == t.of[:-reach]) & (np.abs(b[reach:] - b[:-reach]) <= 2.5 * limit[t.of[reach:]])
        near &= np.maximum(hi[reach:], hi[:-reach]) - np.minimum(lo[reach:], lo[:-reach]) >= 1.2 * np.maximum(width[reach:], width[:-reach])
        begun[t.of[reach:][near]] = True
    into, found = np.arange(len(lo)), np.flatnonzero((n >= 3) & (reference > 50) & begun)
    for p in found.tolist():
        z = slice(first[p], first[p] + n[p])
        into[z] = first[p] + np.array(_take_up(lo[z].tolist(), hi[z].tolist(), b[z].tolist(), float(limit[p]), float(reference[p])))
    line = into[t.line]
    o = np.lexsort((t.x, line))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(line[o]) != 0]))
    return o, begins, t.page[o][begins]


def column_texts(t: SimpleNamespace, text: pa.Array) -> list[str]:
    """geometry.column_text of each column."""
    limit = arrays.thresholds(t, lines.MICRO, lines.SAME_LINE)
    t = arrays.numbered(t, arrays.line_starts(t, limit))
    o, begins, of = _whole(t, limit)
    base = t.b[o][begins]
    opens = np.concatenate([[True], of[1:] != of[:-1]])
    n = np.bincount(of, minlength=len(t.per)) - 1  # gaps of each column
    first = np.cumsum(n) - n
    gaps, column = np.diff(base)[~opens[1:]], of[~opens]
    middle = np.zeros(len(n))
    two = n >= 2
    middle[two] = gaps[np.lexsort((gaps, column))][(first + n // 2)[two]]
    place = np.arange(len(gaps)) - first[column]
    a, z = np.maximum(0, place - lines.PARA_WINDOW), np.minimum(n[column], place + 1 + lines.PARA_WINDOW)
    window = a[:, None] + np.arange(2 * lines.PARA_WINDOW + 1)
    near = np.sort(np.where(window < z[:, None], gaps[np.minimum(first[column][:, None] + window, max(0, len(gaps) - 1))], np.inf), axis=1) if len(gaps) else np.zeros((0, 1))
    reference = np.where(n[column] >= 5, near[np.arange(len(gaps)), ((z - a) * 0.3).astype(np.int64)], middle[column])
    mark = lines._inline_separators(np.concatenate([[np.nan], t.x[o][1:] - t.r[o][:-1]]))
    mark[begins[opens]] = ""
    mark[begins[~opens]] = np.where((reference > 0) & (gaps > reference * lines.PARA_RATIO), "\n\n", "\n").astype(object)
    said = pc.binary_join_element_wise(pa.array(mark, pa.string()), text.take(pa.array(t.k[o])), "")
    found = pc.binary_join(arrays.lists(said, t.per), "")
    private = pc.match_substring_regex(found, "[\ue000-\uf8ff]").to_numpy(zero_copy_only=False)
    out = found.to_pylist()
    for c in np.flatnonzero(private).tolist():
        out[c] = out[c].translate(geometry._pua)
    return out


def region_texts(t: SimpleNamespace, page: np.ndarray, sides: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """geometry.region_text of each box: texts, numbers of hits and of columns."""
    out, n_hits, n_columns = [""] * len(page), np.zeros(len(page), np.int64), np.ones(len(page), np.int64)
    for some in runs(t.per[page]):
        held = hits(t, page[some], sides[some])
        if not len(held.k):
            continue
        at, box = separators(held), held.own + some.start
        n_hits[box], n_columns[box] = held.per, 1 + ~np.isnan(at)
        second = (held.x + held.r) / 2 > at[held.page]
        group = 2 * held.page + second
        o = np.argsort(group, kind="stable")
        columns = _flat(t, group[o], held.k[o])
        for g, said in zip((box[columns.own // 2]).tolist(), column_texts(columns, t.text), strict=True):
            out[g] = f"{out[g]}\n\n{said}" if out[g] and said else out[g] or said
    return out, n_hits, n_columns


# --- batches ---------------------------------------------------------------------------------------------------


def extracted(batch: pa.RecordBatch, schema: pa.Schema, alone: bool) -> Iterator[pa.RecordBatch]:
    """Rows of geometry.RESULT of pages (file_id, page, items, boxes). alone: each box by itself, and the text that it has kept (kept)
    in place of its own; else boxes that lie within another are dropped."""
    size = lambda c: pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for some in runs((1 + size("items")) * (1 + size("boxes")), 2 * CELLS):
        part = batch.slice(some.start, some.stop - some.start)
        boxes, t = part.column("boxes"), pages_of(part.column("items"))
        page, flat = np.repeat(np.arange(part.num_rows), size("boxes")[some]), boxes.flatten()
        if not len(page):
            continue
        sides = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")], 1)
        if not alone:
            stay = np.flatnonzero(contained(boxes_of(page, sides, page)))
            page, sides, flat = page[stay], sides[stay], flat.take(pa.array(stay))
        b = boxes_of(page, sides, np.arange(len(page)) if alone else page)
        phases = corrected(t, b)
        text, n_hits, n_columns = region_texts(t, page, phases[-1])
        text = pa.array(text, pa.string())
        if alone and any(f.name == "kept" for f in flat.type):
            text = pc.coalesce(flat.field("kept"), text)
        fours = lambda v: arrays.lists(pa.array(v.ravel()), np.full(v.size // 4, 4))
        every = arrays.lists(fours(np.stack(phases, 1)), np.full(len(page), 4))
        key = pa.array(page)
        columns = [part.column("file_id").take(key), part.column("page").take(key), flat.field("ord"), *map(pa.array, phases[-1].T.copy()), fours(sides), text, pa.array(n_hits, pa.int32()), pa.array(n_columns, pa.int32()), every]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
