"""Lines of pages that are folded side by side: rows do not wait beside Python, and the results are those of one page alone."""

import math
import random

from foliospark.operators import lines, packed
from foliospark.plans import queries as Q

ITEM = "file_id string, page int, item_idx int, str string, norm_x double, norm_y double, norm_w double, norm_h double, norm_baseline double"


def waits(df):
    return "EvalPython" in df._jdf.queryExecution().executedPlan().toString()


def documents(spark, folder):
    spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n))) for k, n in ((1, 300), (2, 40), (3, 1))], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def odd_items(spark, seed=1):
    """Pages of 1 to 40 items in no order, with equal numbers, places and texts among them."""
    draw = random.Random(seed)
    rows = []
    for page in range(1, 60):
        for k in range(draw.choice((1, 2, 5, 40))):
            b, h, w = draw.choice((0, 2, 2.5, 14, 15, 29.5)) + 40 * draw.randrange(4), draw.choice((1, 8, 30)), draw.choice((0, 1, 7, 60, 200))
            rows.append(("f", page, k // draw.choice((1, 1, 2)), draw.choice(("a", "b", "", "中文", "longer")), float(draw.randrange(0, 300, 7)), float(b - h), float(w), float(h), float(b)))
    return spark.createDataFrame(rows, ITEM), rows


def by_first(rows, limit=15.0):
    """Lines of one page, item by item."""
    found = []
    for t in sorted(rows, key=lambda t: (t[8], t[2], t[4], t[4] + t[6])):
        if not found or t[8] - found[-1][0][8] >= limit:
            found.append([])
        found[-1].append(t)
    return found


def unions(line):
    out = []
    for a, z in sorted((t[4], t[4] + t[6]) for t in line):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def pages_of(rows):
    return {p: [t for t in rows if t[1] == p] for p in {t[1] for t in rows}}


def test_coverage_of_odd_pages(spark, tmp_path):
    items, rows = odd_items(spark)
    want = []
    for p, own in pages_of(rows).items():
        x0, x9 = min(t[4] for t in own), max(t[4] + t[6] for t in own)
        n = math.ceil((x9 - x0) / 2) + 1
        covered = [0] * n
        for a, z in (u for line in by_first(own) for u in unions(line)):
            for k in range(int((a - x0) // 2), min(n - 1, int((z - x0) // 2)) + 1):
                covered[k] += 1
        want += [("f", p, x0, k, c) for k, c in enumerate(covered)]
    assert sorted(map(tuple, lines.x_coverage(items).collect())) == sorted(want)
    sf = documents(spark, tmp_path)
    for name in ("x_coverage", "low_coverage_bands", "split_columns"):
        assert not waits(Q.queries()[name](spark, sf)), name


def test_spans_of_odd_pages(spark, tmp_path):
    items, rows = odd_items(spark, 2)
    want = [("f", p, n, k + 1, a, z) for p, own in pages_of(rows).items() for n, line in enumerate(by_first(own)) for k, (a, z) in enumerate(unions(line))]
    found = lines.merge_line_intervals(items)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def threshold(rows):
    """The adaptive threshold of one page."""
    clusters = []
    for b in sorted(t[8] for t in rows):
        if not clusters or b - clusters[-1][0] >= 3:
            clusters.append([b, 0])
        clusters[-1][1] += 1
    gaps = lambda cs: sorted(z[0] - a[0] for a, z in zip(cs, cs[1:]))
    firm, every = gaps([c for c in clusters if c[1] >= 2]), gaps(clusters)
    if len(rows) < 4:
        return 15.0
    if firm and 3 < firm[0] < 15:
        return max(3.0, firm[0] * 0.7)
    return max(3.0, every[len(every) // 2] * 0.7) if len(clusters) >= 3 and 3 < every[len(every) // 2] < 15 else 15.0


def adaptive(rows):
    """Lines of one page by the adaptive threshold, item by item."""
    found, limit = [], threshold(rows)
    for t in sorted(rows, key=lambda t: (t[8], t[2], t[4], t[4] + t[6], t[5], len(t[3]), t[3])):
        if found and t[8] - found[-1][0][8] < limit:
            top, bottom = min(top, t[5]), max(bottom, t[8])
        elif not found or min(bottom, t[8]) - max(top, t[5]) < 2:
            found, top, bottom = [*found, []], t[5], t[8]
        found[-1].append(t)
    return found


def test_texts_of_odd_lines(spark, tmp_path):
    items, rows = odd_items(spark, 3)
    want = []
    for p, own in pages_of(rows).items():
        for n, line in enumerate(adaptive(own)):
            said, before = "", None
            for t in sorted(line, key=lambda t: (t[4], t[8], t[2], t[4] + t[6], t[3])):
                gap = 0 if before is None else t[4] - before
                said += ("\t" if gap > 30 else " " if gap > 3 else "\n" if gap < -50 else "") + t[3]
                before = t[4] + t[6]
            want.append(("f", p, n, said))
    assert sorted(map(tuple, lines.line_texts(items).collect())) == sorted(want)
    sf = documents(spark, tmp_path)
    for name in ("line_texts", "line_gaps", "paragraph_breaks"):
        assert not waits(Q.queries()[name](spark, sf)), name


def test_odd_items_are_assigned_to_lines(spark):
    items, rows = odd_items(spark, 4)
    want = [("f", p, threshold(own), n, t[8], t[2], t[4], t[4] + t[6], t[5], len(t[3])) for p, own in pages_of(rows).items() for n, line in enumerate(adaptive(own)) for t in line]
    found = lines.assign_lines(items)
    assert sorted(map(tuple, found.collect())) == sorted(want) and {w[2] for w in want} > {15.0}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fragments_of_pages_side_by_side(spark):
    full = lambda at, n: [(x, 100.0, at) for x in (0.0, 100.0, 200.0, 300.0)[:n]]
    pages = {
        1: [*full(20.0, 4), *full(60.0, 2), (300.0, 50.0, 78.0), *full(120.0, 4)],  # two fragments of one line
        2: [*full(20.0, 4), *full(60.0, 2), *full(120.0, 4)],  # one alone
        3: [*full(20.0, 4), (0.0, 50.0, 60.0), (150.0, 50.0, 78.0), (300.0, 50.0, 96.0), *full(140.0, 4)],  # three fragments, 18 apart
        4: [(0.0, 20.0, 20.0), (30.0, 20.0, 38.0), (0.0, 20.0, 90.0)],  # too narrow
    }
    items = spark.createDataFrame([("f", p, k, f"w{k}", x, b - 10, w, 10.0, b) for p, own in pages.items() for k, (x, w, b) in enumerate(own)], ITEM)
    found = packed.merge_line_fragments(items)
    got = {p: [(r.lo, r.hi, r.item_idxs) for r in sorted(found.collect(), key=lambda r: r.line) if r.page == p] for p in pages}
    assert got[1] == [(0.0, 400.0, [0, 1, 2, 3]), (0.0, 350.0, [4, 5, 6]), (0.0, 400.0, [7, 8, 9, 10])]
    assert got[2] == [(0.0, 400.0, [0, 1, 2, 3]), (0.0, 200.0, [4, 5]), (0.0, 400.0, [6, 7, 8, 9])]
    assert [g[2] for g in got[3]] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9, 10]]
    assert [g[2] for g in got[4]] == [[0], [1], [2]]
    for p in pages:
        alone = packed.merge_line_fragments(items.filter(items.page == p)).collect()
        assert [(r.lo, r.hi, r.item_idxs) for r in sorted(alone, key=lambda r: r.line)] == got[p]
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
