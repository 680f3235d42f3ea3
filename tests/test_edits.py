"""Logs of edits against plain walks along them."""

import random

from foliospark.operators import state
from foliospark.plans.adapters import ALIASES

REGIONS = "file_id string, page int, ord int, id int, x1 double, y1 double, x2 double, y2 double, label string, text string, user_modified boolean"
EDITS = "file_id string, page int, seq long, op string, region_id int, x1 double, y1 double, x2 double, y2 double, text string, order array<int>"


def walk_page(regions, log):
    """Regions (id, x1, y1, x2, y2, label, text, user) of a page after its log, and whether it has a key."""
    now, key = list(regions), bool(regions)
    for _, op, rid, *box, text, order in log:
        if op == "bbox":
            now = [r if r[0] != rid or list(r[1:5]) == box else (rid, *box, *r[5:7], True) for r in now]
        elif op == "text":
            now = [r if r[0] != rid else (*r[:6], text, True) for r in now]
        elif op == "add":
            n = max((r[0] for r in now), default=0) + 1
            at = next((k for k, r in enumerate(now) if r[2] - box[1] > 15 or (abs(r[2] - box[1]) <= 15 and r[1] > box[0])), len(now))
            now.insert(at, (n, *box, f"手動框 {n}", "", True))
        elif op == "reorder":
            now = now if order is None else [r for i in order for r in now if r[0] == i] + [r for r in now if r[0] not in order]
        else:
            now = [r for r in now if op == "remove" and r[0] != rid]
    if now:
        key = True
    elif any(e[1].startswith("remove") for e in log):
        key = False
    return now, key


def test_region_log(spark):
    rnd = random.Random(3)
    box = lambda: [float(rnd.randrange(0, 9) * 10), float(rnd.randrange(0, 9) * 10), 500.0, 500.0]
    regions, edits, want, keys = [], [], [], set()
    for page in range(1, 60):
        held = [(k, *box(), f"r{k}", "t", k % 2 == 0) for k in range(1, rnd.randrange(0, 4) + 1)]
        regions += [("f", page, k + 1, *r) for k, r in enumerate(held)]
        log = []
        for seq in range(rnd.randrange(0, 7)):
            op = rnd.choice(["bbox", "text", "add", "add", "remove", "remove", "remove_page", "reorder"])
            ids = [1, 2, 3, 4]
            rnd.shuffle(ids)
            log.append((seq, op, rnd.randrange(1, 5), *box(), f"typed {seq}", ids))
        edits += [("f", page, *e) for e in log]
        now, key = walk_page(held, log)
        want += [("f", page, k + 1, *r) for k, r in enumerate(now)]
        keys |= {page} if key else set()
    rnd.shuffle(edits)
    frame = spark.createDataFrame(regions, REGIONS)
    got, pages = state.fold_region_edits(frame, frame.select("file_id", "page").distinct(), spark.createDataFrame(edits, EDITS))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.page for r in pages.collect()} == keys
    none, _ = state.fold_region_edits(frame, frame.select("file_id", "page"), spark.createDataFrame([], EDITS))
    assert none.count() == len(regions)


def walk_values(log):
    values, selected = [], ""
    for op, value, source in log:
        if op == "clear":
            values, selected = [], ""
        elif op == "add":
            if value.lower() not in [v.lower() for v in values]:
                values.append(value)
            selected = value if source == "manual" else selected or value
        elif op == "choose":
            selected = value
        else:
            values = [v for v in values if v.lower() != value.lower()]
            selected = (values[0] if values else "") if selected.lower() == value.lower() else selected or (values[0] if values else "")
    return selected


def test_value_log(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for f in range(200):
        log, held = [], []
        for _ in range(rnd.randrange(1, 12)):
            op = rnd.choice(["add", "add", "add", "choose", "remove", "remove", "clear"])
            if op == "choose" and not held:  # only what is listed can be chosen
                op = "add"
            value = rnd.choice(held) if op == "choose" else rnd.choice("ABCD")
            held = [] if op == "clear" else [v for v in held if v != value] if op == "remove" else held if value in held else [*held, value]
            log.append((op, value, rnd.choice(["ai", "ai", "filename", "manual"])))
        rows += [(str(f), "code", k, op, value if op != "clear" else None, source) for k, (op, value, source) in enumerate(log)]
        want[str(f)] = walk_values(log)
    rnd.shuffle(rows)
    got = state.selected_after_edits(spark.createDataFrame(rows, "file_id string, field string, seq long, op string, value string, source string"), ALIASES)
    assert {r.file_id: r.selected for r in got.collect()} == want


def test_clear_for_rerun(spark):
    rows = [("f", 1, 1, 1, 0.0, 0.0, 9.0, 9.0, "a", "", True), ("f", 2, 1, 1, 0.0, 0.0, 9.0, 9.0, "b", "", False), ("g", 1, 1, 1, 0.0, 0.0, 9.0, 9.0, "c", "", False)]
    frame = spark.createDataFrame(rows, REGIONS)
    pages = frame.select("file_id", "page")
    left, keys = state.clear_for_rerun(frame, pages, spark.createDataFrame([("f", 1)], "file_id string, page int"))
    assert sorted(r.label for r in left.collect()) == ["b", "c"] and keys.count() == 2
    left, keys = state.clear_for_rerun(frame, pages, spark.createDataFrame([("f",)], "file_id string"))
    assert [r.label for r in left.collect()] == ["c"] and keys.count() == 1


def test_reorder_keeps_what_it_does_not_name(spark):
    regions = spark.createDataFrame([("f", page, k, k, 0.0, 0.0, 1.0, 1.0, "r", "", False) for page in (1, 2) for k in (1, 2, 3, 4)], REGIONS)
    pages = regions.select("file_id", "page").distinct()
    edits = spark.createDataFrame([("f", 1, 1, "reorder", None, None, None, None, None, None, [3, 1, 3]), ("f", 2, 1, "reorder", None, None, None, None, None, None, None)], EDITS)
    left, _ = state.fold_region_edits(regions, pages, edits)
    got = {page: [r.id for r in left.filter(f"page = {page}").orderBy("ord").collect()] for page in (1, 2)}
    assert got == {1: [3, 1, 2, 4], 2: [1, 2, 3, 4]}
