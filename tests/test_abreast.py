"""Pages side by side give what the page helper makes of each page by itself, without work that waits for each item."""

import cProfile
import pstats
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.operators import abreast
from foliospark.operators import geometry as G
from foliospark.operators import regions
from foliospark.plans import adapters as A
from foliospark.plans import queries as Q
from tests.test_scale import documents, plan

SIDES = ("x1", "y1", "x2", "y2")
ITEM = pa.list_(pa.struct([("item_idx", pa.int32()), ("str", pa.string())] + [(f"norm_{c}", pa.float64()) for c in ("x", "y", "w", "h", "baseline")]))
BOX = pa.list_(pa.struct([("ord", pa.int32())] + [(c, pa.float64()) for c in SIDES]))


def some_page(seed):
    """Scattered words, columns, crossing lines or a table; some without items, with equal places or numbers, some not whole numbers."""
    r, items, boxes = random.Random(seed), [], []
    shift = r.random if seed % 2 else lambda: 0.0
    for k in range(r.choice([0, 1, 2, 3, 5, 20, 40, 80, 150])):
        x, y, w = [
            lambda: (r.randrange(900), r.randrange(50, 900), r.randrange(140)),
            lambda: (r.choice([50, 60, 550, 560]), 50 + 12 * (k // 3) + r.choice([0, 1, 4]), r.choice([100, 200, 380])),  # noqa: B023
            lambda: (50 + 480 * (k % 2) + r.randrange(100), 40 + r.choice([10, 14, 20, 30]) * (k // 4), r.randrange(20, 300)),  # noqa: B023
            lambda: (50 + 90 * (k % 10), 100 + 22 * (k // 10) + r.choice([0, 0, 0, 2, 16]), r.choice([10, 60, 85, 95, 200])),  # noqa: B023
            lambda: (50 + 300 * (k % 3) + r.randrange(60), 60 + 16 * (k // 3) + r.randrange(3), r.choice([0, 100, 330])),  # noqa: B023
        ][seed % 5]()
        x, y, h = x + shift(), y + shift(), float(r.choice([8, 12, 14]))
        items.append((k if seed % 7 else r.randrange(10), r.choice(["word", "營運", "a", "•", "", "\uf06c"]), x, y, float(w), h, y + h))
    for o in range(1, 1 + r.choice([0, 1, 2, 3, 4, 5, 8, 16])):
        x, y, w, h = (r.choice([0, 40, 500]), r.randrange(600), r.choice([480, 950]), r.randrange(30, 500)) if r.random() < 0.4 else (r.randrange(600), r.randrange(700), r.randrange(50, 400), r.randrange(30, 300))
        x, y = x + shift(), y + shift()
        boxes.append((o, x, y, x + w, y + h))
    return items if seed % 11 else None, boxes


def batch(pages):
    named = lambda rows, kind: rows if rows is None else [dict(zip([f.name for f in kind.value_type], map(float_but_first, range(len(r)), r), strict=True)) for r in rows]
    columns = [pa.array([f"f{k}" for k in range(len(pages))]), pa.array([1] * len(pages), pa.int32()), pa.array([named(i, ITEM) for i, _ in pages], ITEM), pa.array([named(b, BOX) for _, b in pages], BOX)]
    return pa.RecordBatch.from_arrays(columns, ["file_id", "page", "items", "boxes"])


def float_but_first(place, value):
    return value if place == 0 or isinstance(value, str) else float(value)


def by_pages(pages, alone):
    """What the helper tells of each page by itself."""
    out = []
    for file_id, page, boxes in zip(pages.column("file_id").to_pylist(), G.Page.each(pages.column("items")), pages.column("boxes").to_pylist(), strict=True):
        first = np.array([[b[c] for c in SIDES] for b in boxes], float).reshape(-1, 4)
        stay = range(len(first)) if alone else G.contained(first)
        for own in [[k] for k in stay] if alone else [list(stay)]:
            phases = G.correct(page, first[own]) if own else []
            for n, k in enumerate(own):
                last = phases[-1][n]
                text, n_hits, n_columns = G.region_text(page, last)
                out.append((file_id, 1, boxes[k]["ord"], *last.tolist(), first[k].tolist(), text, n_hits, n_columns, [p[n].tolist() for p in phases]))
    return out


def extracted(pages, alone):
    return [tuple(r.values()) for part in abreast.extracted(pages, G._fields(G.RESULT), alone) for r in part.to_pylist()]


def test_pages_side_by_side_are_the_helpers():
    pages = batch([some_page(s) for s in range(400)])
    for alone in (False, True):
        got, want = extracted(pages, alone), by_pages(pages, alone)
        assert list(map(repr, got)) == list(map(repr, want))
        assert sum(r[-2] == 2 for r in got) > 20 and sum(r[-1][0] != r[-4] for r in got) > 100


def test_work_does_not_wait_for_each_item():
    """Calls of Python for a page of 120 words and three boxes; by pages there are thousands."""
    words = [(k, "word", 60.0 + 150 * (k % 6), 40.0 + 40 * (k // 6), 100.0, 12.0, 52.0 + 40 * (k // 6)) for k in range(120)]
    pages = batch([(words, [(o, 50.0 + 230 * o, 55.0, 310.0 + 230 * o, 800.0) for o in range(3)])] * 500)
    for alone in (False, True):
        watch = cProfile.Profile()
        watch.runcall(extracted, pages, alone)
        assert pstats.Stats(watch).total_calls / 500 < 1000


def test_a_page_with_20000_items_and_one_with_many_boxes():
    r = random.Random(3)
    large = [(k, "w", r.random() * 900, y := r.random() * 990, r.random() * 80, 8.0, y + 8) for k in range(20_000)]
    began = time.time()
    got = extracted(batch([(large, [(1, 10.0, 10.0, 400.0, 300.0), (2, 420.0, 10.0, 900.0, 300.0)]), (large[:50], [(o, float(o), 10.0, o + 90.0, 60.0) for o in range(300)])]), False)
    assert len(got) > 2 and got[0][-3] > 1000
    assert time.time() - began < 60


def test_neighbours_of_pages_are_those_of_each():
    r = np.random.default_rng(5)
    for steps in (3, regions.STEPS):
        regions.STEPS, was = steps, regions.STEPS
        try:
            n = r.integers(0, 60, 80)
            page = np.repeat(np.arange(80), n)
            left = r.integers(0, 30, len(page)).astype(float)
            right, base = left + r.integers(0, 8, len(page)), r.integers(0, 12, len(page)).astype(float)
            got = regions.sweep_pages(page, left, right, base)
            for p, a in enumerate(np.cumsum(n) - n):
                z = slice(a, a + n[p])
                own = regions.sweep(left[z], right[z], base[z]) if n[p] else np.zeros(0)
                assert got[z].tolist() == np.where(own >= 0, own + a, -1).tolist()
        finally:
            regions.STEPS = was


def test_a_line_covers_a_bucket_once():
    """Two spans of one line that end and begin in one bucket."""
    t = abreast.pages_of(batch([([(0, "a", 0.0, 0.0, 10.5, 9.0, 9.0), (1, "b", 10.9, 0.0, 90.0, 9.0, 9.0), (2, "c", 0.0, 30.0, 9.0, 9.0, 39.0)], [])]).column("items"))
    held = abreast.hits(t, np.array([0]), np.array([[0.0, 0.0, 1000.0, 1000.0]]))
    assert len(abreast.low_bands(abreast._across(held)).box) == len(G.low_bands(next(G.Page.each(batch([([(0, "a", 0.0, 0.0, 10.5, 9.0, 9.0), (1, "b", 10.9, 0.0, 90.0, 9.0, 9.0), (2, "c", 0.0, 30.0, 9.0, 9.0, 39.0)], [])]).column("items"))), np.arange(3), [[0, 1], [2]]))


def test_deltas_follow_the_phases(spark, tmp_path):
    sf = documents(spark, tmp_path)
    done = {(r.file_id, r.page, r.ord): r for r in Q.queries()["extract_text_for_regions"](spark, sf).collect()}
    rows = Q.queries()["bbox_deltas"](spark, sf).collect()
    assert len(rows) == len(done) and rows
    for r in rows:
        d = done[r.file_id, r.page, r.ord]
        assert d.phases[3] == [d.x1, d.y1, d.x2, d.y2]


def test_names_of_debug_pages_need_no_pages(spark, tmp_path):
    sf = documents(spark, tmp_path)
    rows = Q.queries()["page_debug"](spark, sf)
    assert plan(rows).count("MapInArrow") == 2  # texts become pages, and pages regions, once
    assert sorted({r.file_base for r in rows.collect()}) == [f"doc_{k}" for k in (1, 2, 3, 5, 7)]


def test_neighbours_and_owners_leave_no_rows_beside_python(spark, tmp_path):
    sf = documents(spark, tmp_path)
    for name in ("nearest_lines", "item_ownership"):
        seen = plan(Q.queries()[name](spark, sf))
        assert "EvalPython" not in seen and seen.count("MapInArrow") == 2, name
    pages = A.text_pages(spark, sf)
    whole, bare = (regions.nearest_lines(pages, own).select("file_id", "page", "above", "below") for own in (None, ()))
    assert sorted(map(str, whole.collect())) == sorted(map(str, bare.collect()))
    assert regions.nearest_lines(pages).filter(F.col("str") == "w1").columns == ["file_id", "page", *A.ITEM, "above", "below"]
