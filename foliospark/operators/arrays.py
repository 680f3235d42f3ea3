"""Lines of packed pages, folded over the pages of an Arrow batch side by side.

Spark deals out, shuffles and groups the pages; a task takes them by mapInArrow and leaves rows. A pandas or Arrow UDF would keep
each row that it is given beside Python, with its items, and put many of them on disk; mapInArrow keeps none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Pages that are folded side by side.
ABREAST = 2000
FIELDS = {"b": "double", "i": "int", "x": "double", "r": "double", "y": "double", "n": "int", "s": "string"}


def struct_of(fields: Sequence[str]) -> str:
    return f"struct<{', '.join(f'{f}: {FIELDS[f]}' for f in fields)}>"


def each_page(items: DataFrame, keys: Sequence[str], told: dict[str, str], of: Callable[[SimpleNamespace], tuple[np.ndarray, Sequence[pa.Array]]]) -> DataFrame:
    """keys and the columns told, by what of makes of pages: the page of each row, and its columns. Pages without items leave none."""
    rows = items.select(*keys, "items")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [f"{c} {t}" for c, t in told.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ABREAST):
                some = batch.slice(at, ABREAST)
                some = some.filter(pc.greater(pc.fill_null(pc.list_value_length(some.column("items")), 0), 0))
                if some.num_rows:
                    page, columns = of(in_order(some.column("items")))
                    own = [some.column(c).take(pa.array(page)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, *columns], [*keys, *told])

    return rows.mapInArrow(run, schema)


def order(keys: Sequence[np.ndarray], last: Sequence[np.ndarray | pa.Array] = ()) -> np.ndarray:
    """Places in the order of keys, and of last where keys are equal."""
    found = np.lexsort(keys[::-1])
    if len(found) > 1 and np.logical_and.reduce([k[found][1:] == k[found][:-1] for k in keys]).any():
        every = {str(n): v for n, v in enumerate([*keys, *last])}
        found = pc.sort_indices(pa.table(every), sort_keys=[(n, "ascending") for n in every]).to_numpy()
    return found


def in_order(items: pa.ListArray) -> SimpleNamespace:
    """Items of pages in flat arrays, in baseline order, ties in input order: b, i, x, r, y, n, s, the page of each; per, first. Places
    are given; a text may be null."""
    per = pc.list_value_length(items).to_numpy().astype(np.int64)
    flat = items.flatten()
    of = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
    page, s = np.repeat(np.arange(len(per)), per), flat.field("str")
    b, i, x, y, n = of("norm_baseline"), of("item_idx"), of("norm_x"), of("norm_y"), pc.utf8_length(s)
    r = x + of("norm_w")
    at = order((page, b, i), (x, r, y, n, s))
    return SimpleNamespace(page=page, per=per, first=np.cumsum(per) - per, b=b[at], i=i[at], x=x[at], r=r[at], y=y[at], n=n.take(pa.array(at)), s=s.take(pa.array(at)))


def _turns(t: SimpleNamespace) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pages that have a first item and where it stands, then those that have a second, and so on."""
    by = np.argsort(-t.per, kind="stable")
    shorter = -t.per[by]
    for k in range(int(t.per.max())):
        pages = by[: np.searchsorted(shorter, -k)]
        yield pages, t.first[pages] + k


def anchors(t: SimpleNamespace, limit: float) -> np.ndarray:
    """Whether an item begins a cluster: it is limit or more from the first of the cluster so far."""
    starts, head = np.zeros(len(t.b), bool), np.full(len(t.per), np.nan)
    for pages, at in _turns(t):
        b = t.b[at]
        starts[at] = new = ~(np.abs(b - head[pages]) < limit)
        head[pages] = np.where(new, b, head[pages])
    return starts


def numbered(t: SimpleNamespace, starts: np.ndarray) -> SimpleNamespace:
    """The pages with their lines: line (of each item, over all pages), at (where lines begin), of (their pages), number (from 0)."""
    at = np.flatnonzero(starts)
    of, line = t.page[at], np.cumsum(starts) - 1
    return SimpleNamespace(**vars(t), line=line, at=at, of=of, number=np.arange(len(at)) - line[t.first][of])


def spans(t: SimpleNamespace) -> SimpleNamespace:
    """Unions of touching item spans on each line: line, left, right."""
    o = order((t.line, t.x, t.i), (t.r,))
    x, r, line = t.x[o], t.r[o], t.line[o]
    by = np.argsort(r, kind="stable")
    rank = np.empty(len(r), np.int64)
    rank[by] = np.arange(len(r))
    reach = r[by[np.maximum.accumulate(line * len(r) + rank) - line * len(r)]]
    begins = np.concatenate([[True], (line[1:] != line[:-1]) | (x[1:] > reach[:-1])])
    at = np.flatnonzero(begins)
    return SimpleNamespace(line=line[at], left=x[at], right=np.maximum.reduceat(r, at))


def places(groups: np.ndarray) -> np.ndarray:
    """Number from 0 within groups that stand together."""
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(begins, np.diff([*begins, len(groups)]))


def coverage(t: SimpleNamespace, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x0 of each page, its number of buckets of that width, and over all pages how many lines cover each bucket."""
    x0, x9 = np.minimum.reduceat(t.x, t.first), np.maximum.reduceat(t.r, t.first)
    n = (np.ceil((x9 - x0) / width) + 1).astype(np.int64)
    found = spans(t)
    page = t.of[found.line]
    at = lambda v: np.maximum(0, np.minimum(n[page] - 1, np.floor((v - x0[page]) / width).astype(np.int64)))
    a, z, first = at(found.left), at(found.right), np.cumsum(n + 1) - (n + 1)
    total = int((n + 1).sum())
    change = np.bincount(first[page] + np.minimum(a, z), minlength=total) - np.bincount(first[page] + np.maximum(a, z) + 1, minlength=total)
    return x0, n, np.delete(np.cumsum(change), first + n)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def structs(t: SimpleNamespace, fields: Sequence[str], at: np.ndarray | None = None) -> pa.StructArray:
    kind = {"double": pa.float64(), "int": pa.int32()}
    columns = [vars(t)[f] if f in "ns" else pa.array(vars(t)[f], kind[FIELDS[f]]) for f in fields]
    return pa.StructArray.from_arrays(columns if at is None else [c.take(pa.array(at)) for c in columns], list(fields))


def lines_of_pages(t: SimpleNamespace, fields: Sequence[str]) -> pa.ListArray:
    """The items of each line of each page."""
    return lists(lists(structs(t, fields), np.diff([*t.at, len(t.b)])), np.bincount(t.of, minlength=len(t.per)))


def thresholds(t: SimpleNamespace, micro: float, same_line: float) -> np.ndarray:
    """How far baselines of one line may be apart on each page, as threshold_of tells it of its clusters."""
    c = numbered(t, anchors(t, micro))
    baseline, count = t.b[c.at], np.diff([*c.at, len(t.b)])
    fits = lambda v: (v > micro) & (v < same_line)
    near = lambda v: np.maximum(micro, v * 0.7)

    def gaps(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = of[1:] == of[:-1]
        return of[1:][same], np.diff(at)[same]

    firm = count >= 2
    stable = np.full(len(t.per), np.inf)
    np.minimum.at(stable, *gaps(c.of[firm], baseline[firm]))
    of, gap = gaps(c.of, baseline)
    gap = gap[np.lexsort((gap, of))]
    n = np.bincount(of, minlength=len(t.per))
    middle = np.full(len(t.per), np.nan)
    middle[n > 0] = gap[(np.cumsum(n) - n + n // 2)[n > 0]]
    found = np.where(fits(stable), near(stable), np.where((n >= 2) & fits(middle), near(middle), same_line))
    return np.where(t.per >= 4, found, same_line)


def line_starts(t: SimpleNamespace, limit: np.ndarray, any_overlap: bool = False) -> np.ndarray:
    """Whether an item begins a line: within its page's limit of a line's first baseline it joins and widens the line's core; beyond,
    it joins without widening if it overlaps the core by 2 or more (any_overlap: at all)."""
    starts = np.zeros(len(t.b), bool)
    first, top, bottom = (np.full(len(t.per), np.nan) for _ in range(3))
    for pages, at in _turns(t):
        b, y, head, core, foot = t.b[at], t.y[at], first[pages], top[pages], bottom[pages]
        near = b - head < limit[pages]
        overlap = np.minimum(foot, b) - np.maximum(core, y)
        new = ~near & ~((overlap > 0) if any_overlap else (overlap >= 2.0))
        starts[at], first[pages] = new, np.where(new, b, head)
        top[pages] = np.where(new, y, np.where(near, np.minimum(core, y), core))
        bottom[pages] = np.where(new, b, np.where(near, np.maximum(foot, b), foot))
    return starts


def texts(lines: np.ndarray, x: np.ndarray, r: np.ndarray, s: pa.Array, n: int, separator: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The text of each of n lines: items as they stand, each behind what separator makes of its distance from the one before."""
    mark = separator(np.concatenate([[np.nan], x[1:] - r[:-1]]))
    mark[np.concatenate([[True], lines[1:] != lines[:-1]])] = ""
    said = pc.fill_null(pc.binary_join_element_wise(pa.array(mark, pa.string()), s, ""), "")
    return pc.binary_join(lists(said, np.bincount(lines, minlength=n)), "")
