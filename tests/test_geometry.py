import random
import time

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import geometry as G
from foliospark.operators import lines, packed, regions

ITEMS = "file_id string, page int, item_idx int, str string, norm_x double, norm_y double, norm_w double, norm_h double, norm_baseline double"
BOXES = "file_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double"


def random_page(seed, n=40, file_id="f"):
    r = random.Random(seed)
    items = []
    for k in range(n):
        y, h = r.randrange(50, 900), r.choice([8, 12, 14])
        items.append((file_id, 1, k, r.choice(["word", "營運", "a", "•"]), float(r.randrange(0, 900)), float(y), float(r.randrange(1, 140)), float(h), float(y + h)))
    boxes = []
    for o in range(1, r.randrange(2, 6)):
        x, y = r.randrange(0, 600), r.randrange(0, 700)
        boxes.append((file_id, 1, o, float(x), float(y), float(x + r.randrange(50, 400)), float(y + r.randrange(30, 300))))
    return items, boxes


def page_of(items):
    names = [c.split()[0] for c in ITEMS.split(", ")]
    return G.Page.of([dict(zip(names, r, strict=True)) for r in items])


def frames(spark, seeds):
    pages = [random_page(s, file_id=f"f{s}") for s in seeds]
    items = spark.createDataFrame([r for i, _ in pages for r in i], ITEMS)
    return pages, items, spark.createDataFrame([r for _, b in pages for r in b], BOXES)


def test_sql_forms_agree_with_helper(spark):
    pages, items, boxes = frames(spark, range(12))
    owned = {(r.file_id, r.ord, r.item_idx): r.owned for r in regions.item_ownership(items, boxes).collect()}
    gone = {(r.file_id, r.ord) for r in regions.drop_contained_regions(boxes).collect()}
    low = {(r.file_id, r.ord): r.y2 for r in regions.apply_descender(boxes, items).collect()}
    gaps = {(r.file_id, r.ord): (r.y1, r.y2) for r in regions.enforce_min_gap(boxes).collect()}
    limits = {r.file_id: r.threshold for r in lines.adaptive_threshold(items).collect()}
    for seed, (i, b) in enumerate(pages):
        page, array = page_of(i), np.array([r[3:] for r in b])
        f = f"f{seed}"
        mine = page.owned(array)
        assert all(owned[f, o + 1, k] == mine[o, k] for o in range(len(b)) for k in range(len(i)))
        assert {(f, k + 1) for k in G.contained(array)} == {x for x in gone if x[0] == f}
        assert np.allclose([low[f, o + 1] for o in range(len(b))], G.descend(page, array)[:, 3])
        assert np.allclose([gaps[f, o + 1] for o in range(len(b))], G.enforce_gap(array)[:, [1, 3]])
        assert np.isclose(limits[f], G.threshold_of(np.sort(page.base)))


def test_lines_fold_is_the_loop(spark):
    pages, items, _ = frames(spark, range(20, 28))
    got = {(r.file_id, r.i): r.line for r in lines.assign_lines(items).collect()}
    for seed, (i, _) in zip(range(20, 28), pages, strict=True):
        page = page_of(i)
        order = np.argsort(page.base, kind="stable")
        for n, line in enumerate(G.assigned_lines(page, order, G.threshold_of(page.base[order]))):
            assert all(got[f"f{seed}", k] == n for k in line)


def test_extraction_is_the_same_however_rows_come(spark):
    _, items, boxes = frames(spark, range(5))
    one = sorted(map(str, G.extract_text_for_regions(items, boxes).collect()))
    two = sorted(map(str, G.extract_text_for_regions(items.orderBy(F.rand(1)), boxes.repartition(3)).collect()))
    assert one == two


def test_columns_and_paragraphs():
    items, k = [], 0
    for line in range(8):
        for x in (50, 550):
            items.append(("f", 1, k, f"w{line}{'l' if x < 500 else 'r'}", float(x), 100.0 + 30 * line + (5 if x > 500 else 0) * (line % 2), 300.0, 12.0, 112.0 + 30 * line + (20 if x > 500 else 0)))
            k += 1
    page = page_of(items)
    text, hits, columns = G.region_text(page, np.array([0, 0, 1000, 1000.0]))
    assert hits == 16 and columns == 2
    assert text.index("w7l") < text.index("w0r")


def test_snap_takes_what_it_owns():
    items = [("f", 1, 0, "left", 100.0, 100.0, 100.0, 10.0, 110.0), ("f", 1, 1, "right", 205.0, 100.0, 100.0, 10.0, 110.0)]
    page = page_of(items)
    box = np.array([120.0, 102.0, 190.0, 108.0])
    out = G.snap(page, box, page.owned(box[None])[0])
    assert out[0] == 100.0 and out[2] == 305.0 and out[1] <= 102.5 and out[3] >= 110


def test_empty_page(spark):
    boxes = spark.createDataFrame([("f", 1, 1, 0.0, 0.0, 10.0, 10.0)], BOXES)
    got = G.extract_text_for_regions(spark.createDataFrame([], ITEMS), boxes).collect()
    assert len(got) == 1 and got[0].text == "" and got[0].n_hits == 0


def neighbours_by_pairs(left, right, base):
    """The nearest item above each that overlaps it, by trying all."""
    out = []
    for k in range(len(left)):
        near = [(base[k] - base[o], o) for o in range(len(left)) if left[o] < right[k] and right[o] > left[k] and base[o] < base[k]]
        out.append(min(near)[1] if near else -1)
    return out


def test_sweep_is_all_pairs():
    for seed in range(60):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 60))
        left = r.integers(0, 30, n).astype(float)
        right = left + r.integers(0, 8, n)  # some without width
        base = r.integers(0, 12, n).astype(float)
        assert regions.sweep(left, right, base).tolist() == neighbours_by_pairs(left, right, base)


def test_sweep_of_a_page_with_20000_items():
    r = np.random.default_rng(1)
    left = r.random(20_000) * 900
    began = time.time()
    found = regions.sweep(left, left + r.random(20_000) * 100, r.random(20_000) * 1000)
    assert (found >= 0).mean() > 0.9
    assert time.time() - began < 20


def test_column_text_is_the_helpers(spark):
    """Threshold, lines, fragments, paragraphs: one row per column."""
    pages, items, _ = frames(spark, range(40, 70))
    got = {r.file_id: r.text for r in packed.column_text(items).collect()}
    merged = 0
    for seed, (i, _) in zip(range(40, 70), pages, strict=True):
        page = page_of(i)
        order = np.argsort(page.base, kind="stable")
        limit = G.threshold_of(page.base[order])
        lines_ = G.assigned_lines(page, order, limit)
        merged += len(G.merge_fragments(page, lines_, limit)) < len(lines_)
        assert got[f"f{seed}"] == G.column_text(page, np.arange(len(i)))
    assert merged > 5


def test_overlaps_are_the_helpers(spark):
    pages, items, boxes = frames(spark, range(40))
    got = {(r.file_id, r.ord): [r.x1, r.y1, r.x2, r.y2] for r in regions.resolve_x_overlaps(boxes, items).collect()}
    moved = 0
    for seed, (i, b) in enumerate(pages):
        array = np.array([r[3:] for r in b])
        want = G.resolve_x_overlaps(page_of(i), array)
        moved += (want != array).any()
        assert np.allclose([got[f"f{seed}", k + 1] for k in range(len(b))], want)
    assert moved > 1


def test_columns_are_the_helpers(spark):
    """Pages with two columns, one column, and lines that cross."""
    rows = []
    for seed in range(24):
        r = random.Random(seed)
        for k in range(60):
            side, y = k // 4 % 2 if seed % 3 == 0 else r.randrange(2), 40.0 * (k // 4) + 20
            x = 30.0 + r.randrange(0, 330) + 480 * side
            if seed % 3 == 1:
                x = float(r.randrange(0, 850))
            if seed % 3 == 2 and k % 4 == 0:
                x, side = 380.0, 2
            rows.append((f"f{seed}", 1, k, "word" * r.randrange(1, 4), x, y, float(r.randrange(20, 90) + 100 * (side == 2)), 12.0, y + 12))
    items = spark.createDataFrame(rows, ITEMS)
    got = {(r.file_id, r.item_idx): r.column for r in lines.split_columns(items).collect()}
    two = 0
    for seed in range(24):
        own = [r for r in rows if r[0] == f"f{seed}"]
        columns = G.split_columns(page_of(own), np.arange(len(own)))
        two += len(columns) == 2
        for number, hits in enumerate(columns, 1):
            assert all(got[f"f{seed}", k] == number for k in hits.tolist())
    assert 2 < two < 24


def test_display_lines_take_any_overlap(spark):
    """Baselines 16 apart of which one overlaps the line above by 1: two lines of text, one line of the listing."""
    rows = [("f", 1, 0, "a", 10.0, 88.0, 300.0, 12.0, 100.0), ("f", 1, 1, "b", 400.0, 99.0, 300.0, 17.0, 116.0), ("f", 1, 2, "c", 10.0, 150.0, 20.0, 12.0, 162.4)]
    items = spark.createDataFrame(rows, ITEMS)
    assert [(r.line, r.text, r.b_min, r.b_max, r.merged) for r in packed.display_lines(items).orderBy("line").collect()] == [(1, "ab", 100.0, 116.0, 1), (2, "c", 162.0, 162.0, 0)]
    assert packed.column_text(items).first().text == "a\nb\nc"
