import datetime

from pyspark.sql import functions as F

from foliospark.operators import state
from foliospark.plans.adapters import ALIASES
from foliospark.sources import files as S
from foliospark.streaming import jobs

REGIONS = "file_id string, page int, ord int, id int, x1 double, y1 double, x2 double, y2 double, label string, text string, user_modified boolean"


def region(page, ord_, text="", user=False, id_=None, x1=0.0, y1=0.0):
    return ("f", page, ord_, id_ or ord_, x1, y1, x1 + 100, y1 + 100, f"r{ord_}", text, user)


def test_merge_keeps_user_regions(spark):
    old = spark.createDataFrame([region(1, 1, user=True, id_=5), region(1, 2), region(2, 1)], REGIONS)
    new = spark.createDataFrame([region(1, 1, "n1"), region(1, 2, "n2")], REGIONS).drop("id", "user_modified")
    pages = spark.createDataFrame([("f", 2)], "file_id string, page int")
    merged, done = state.merge_page_result(old, new, pages, spark.createDataFrame([("f", 1), ("f", 3)], "file_id string, page int"))
    assert [(r.page, r.ord, r.id, r.text) for r in merged.orderBy("page", "ord").collect()] == [(1, 1, 5, ""), (1, 2, 6, "n1"), (1, 3, 7, "n2"), (2, 1, 1, "")]
    assert sorted(r.page for r in done.collect()) == [1, 2, 3]


def test_attempts(spark):
    body = lambda b: '{"hasAnalysis": true, "regions": [{"bbox": %s}]}' % b  # noqa: E731, UP031
    rows = [("f", 1, 1, "no"), ("f", 1, 2, body("[10, 10, 5, 90]")), ("f", 1, 3, body("[10, 10, 200, 300]")), ("f", 2, 1, body("[10, 10, 5, 90]")), ("f", 3, 1, '{"hasAnalysis": false}')]
    parsed = state.parse_responses(spark.createDataFrame(rows, "file_id string, page int, attempt int, response_text string"))
    got = {r.page: (r.attempt, r.has_analysis, len(r.regions)) for r in state.resolve_attempts(parsed, F.lit(True)).collect()}
    assert got == {1: (3, True, 1), 2: (1, False, 0), 3: (1, False, 0)}
    sound, bad, broken = body("[10, 10, 200, 300]"), body("[10, 10, 5, 90]"), body("[NaN, 10, 200, 300]")
    logs = {1: ["no"] * 3 + [sound], 2: ["no", "no", bad, "no", sound], 3: [bad] * 6 + [sound], 4: [broken] * 3 + [sound], 5: [bad, "no"], 6: ["no"]}
    rows = [("f", page, k + 1, text) for page, texts in logs.items() for k, text in enumerate(texts)]
    parsed = state.parse_responses(spark.createDataFrame(rows, "file_id string, page int, attempt int, response_text string"))
    got = {r.page: (r.attempt, r.has_analysis, len(r.regions)) for r in state.resolve_attempts(parsed, F.lit(True)).collect()}
    assert got == {2: (5, True, 1), 3: (6, False, 0), 4: (3, False, 0), 5: (1, False, 0)}
    assert {r.page: r.attempt for r in state.resolve_attempts(parsed, F.lit(True), check_boxes=False).collect()} == {2: 3, 3: 1, 4: 1, 5: 1}


def test_worklist_and_recognition(spark):
    rows = spark.createDataFrame([region(1, 1, " "), region(1, 2, "āāāāā"), region(1, 3, "good text"), region(1, 4, "", True, x1=7.0)], REGIONS)
    assert [r.work for r in state.recognition_worklist(rows).orderBy("ord").collect()] == ["empty", "garbled", None, "empty"]
    found = spark.createDataFrame([("f", 1, 7.0, 0.0, 107.0, 100.0, True, "x", None)], "file_id string, page int, x1 double, y1 double, x2 double, y2 double, success boolean, text string, error string")
    assert [r.text for r in state.apply_recognition(rows, found).orderBy("ord").collect()][3] == ""
    retries = spark.createDataFrame([("f", 1, 0.0, 0.0, 100.0, 100.0, False, None, "busy", 1), ("f", 1, 0.0, 0.0, 100.0, 100.0, True, "read", None, 2)], found.schema.simpleString()[7:-1].replace(":", " ") + ", seq int")
    boxes = spark.createDataFrame([region(1, 1, "", x1=0.0)], REGIONS)
    want = boxes.select("x1", "y1", "x2", "y2").first()
    retries = retries.withColumns({n: F.lit(v) for n, v in zip(("x1", "y1", "x2", "y2"), want, strict=True)})
    assert [(r.text, r.user_modified) for r in state.apply_recognition(boxes, retries).collect()] == [("read", True)]


def test_insert_and_move(spark):
    rows = spark.createDataFrame([region(1, 1, y1=0.0), region(1, 2, y1=200.0), region(1, 3, y1=400.0)], REGIONS)
    box = spark.createDataFrame([("f", 1, 0.0, 150.0, 50.0, 180.0)], "file_id string, page int, x1 double, y1 double, x2 double, y2 double")
    assert [r.id for r in state.insert_in_reading_order(rows, box).orderBy("ord").collect()] == [1, 4, 2, 3]
    for i, p, want in ((0, 3, [2, 3, 1]), (2, 0, [3, 1, 2]), (1, 2, [1, 2, 3]), (1, 1, [1, 2, 3])):
        moves = spark.createDataFrame([("f", 1, i, p)], "file_id string, page int, i int, p int")
        assert [r.id for r in state.move_region(rows, moves).orderBy("ord").collect()] == want


def test_candidates(spark):
    rows = spark.createDataFrame([("f", "broker", "KGI", "ai", 2), ("f", "broker", " 凱基 ", "filename", 1), ("f", "code", "1", "ai", 1), ("f", "code", "2", "manual", 5), ("f", "code", " ", "ai", 0)], "file_id string, field string, value string, source string, arrival long")
    found = state.collect_candidates(rows, ALIASES)
    assert found.filter("field = 'broker'").count() == 1
    assert {r.field: r.selected for r in state.selected_value(found).collect()} == {"broker": "凱基", "code": "2"}


def test_report_and_run_state(spark):
    rows = spark.createDataFrame([region(2, 1, "c"), region(1, 2, "b"), region(1, 1, " a "), region(1, 3, "  ")], REGIONS)
    assert state.assemble_report(rows).first().content == "a \n\nb\n\nc"
    files = spark.createDataFrame([("f", "done")], "file_id string, status string")
    assert state.run_state(files).first().label == "rerun"
    assert state.run_state(files.limit(0)).first().all_done is False


def test_session_and_debug(spark, tmp_path):
    files = spark.createDataFrame([("f", "processing"), ("g", "done"), ("h", "idle")], "file_id string, status string")
    rows = spark.createDataFrame([region(1, 1, "⏳ wait"), region(1, 2, "kept"), region(3, 1, "x", True)], REGIONS)
    pages = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "file_id string, page int")
    S.write_session(files, rows, pages, str(tmp_path / "s"))
    session = S.read_session(spark, str(tmp_path / "s"), files.filter("file_id != 'g'"))
    assert sorted((r.file_id, r.status, [(p.page, len(p.regions)) for p in r.pages]) for r in session.collect()) == [("f", "stopped", [(1, 2), (2, 0), (3, 1)]), ("h", "idle", [])]
    assert sorted((r.page, r.ord, r.text) for r in S.session_regions(session).collect()) == [(1, 1, ""), (1, 2, "kept"), (3, 1, "x")]
    texts = S.read_session(spark, str(tmp_path / "s"), files, ["text"])
    assert texts.schema["pages"].simpleString() == "pages:array<struct<page:int,regions:array<struct<text:string>>>>"
    assert sorted(r.text for r in S.session_regions(texts).collect()) == ["", "kept", "x"]


def test_debug_of_one_file_reads_its_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(f"file{k % 40}", k % 7, f"payload {k}") for k in range(400)], "file_base string, page int, payload string")
    for _ in range(2):
        S.write_page_debug(rows, str(tmp_path / "d"))
    assert S.read_page_debug(spark, str(tmp_path / "d")).count() == 400
    one = S.read_page_debug(spark, str(tmp_path / "d"), "file3")
    assert sorted(r.payload for r in one.collect()) == sorted(f"payload {k}" for k in range(3, 400, 40))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert len({p.name for p in (tmp_path / "d").glob("bucket=*")}) <= S.DEBUG_BUCKETS and not list((tmp_path / "d").glob("page=*"))


def test_collated_places(spark, tmp_path):
    names = ["b", "A", "元大", "a", "國票", "a", "凱基", None]
    rows = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "file_id string, name string").repartition(3)
    got = {r.file_id: r.place for r in S.collated(rows, str(tmp_path / "c")).collect()}
    want = [r.file_id for r in rows.orderBy(F.collate("name", "zh_Hant"), "name", "file_id").collect()]
    assert got == {f: k + 1 for k, f in enumerate(want)}


def test_paths_settings_pdfs(spark, tmp_path):
    row = spark.createDataFrame([("file:///d/a%20b+c.PDF",)], "p string").select(*[c.alias(k) for k, c in S.normalize_path(F.col("p")).items()]).first()
    assert (row.path, row.name, row.error) == ("d/a b+c.PDF", "a b+c.PDF", None)
    (tmp_path / "s.json").write_text('{"brokerSkipMap": {"B": 2, "A": 1}, "brokerAliasGroups": ["x, Y", "z，y"]}')
    skip, alias = S.load_broker_dims(spark, str(tmp_path / "s.json"))
    assert [r.broker for r in skip.orderBy("pos").collect()] == ["B", "A"]
    assert {r.alias: r.canonical for r in alias.collect()} == {"x": "x", "y": "z", "z": "z"}
    (tmp_path / "pdfs").mkdir()
    for n in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / "pdfs" / n).write_bytes(b"x")
    assert [r.name for r in S.list_pdfs(spark, str(tmp_path / "pdfs")).collect()] == ["a.PDF", "b.pdf"]
    assert S.read_pdf_bytes(spark, str(tmp_path / "pdfs")).count() == 2


def test_golden(spark):
    golden = spark.createDataFrame([("c", 1, "abc"), ("c", 2, "abc")], "case_id string, region_id int, expected string")
    actual = spark.createDataFrame([("c", 1, " abc "), ("c", 2, "abx")], "case_id string, region_id int, actual string")
    got = state.compare_golden(actual, golden)
    assert [(r.passed, r.first_diff) for r in got.orderBy("region_id").collect()] == [(True, None), (False, 3)]
    assert tuple(state.golden_summary(got).first()) == (1, 1, 1)


def parts_of(spark, tmp_path, schema, *parts):
    """A stream that delivers each part as a batch of its own."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_progress_ends(spark, tmp_path):
    deltas = parts_of(spark, tmp_path, "file_id string, analysis_delta int, completed_delta int, closes boolean", [("f", 2, 1, False), ("g", 1, 0, None), ("h", 3, None, False)], [("f", 0, 1, True), ("h", None, 1, True)], [("f", 5, 0, False)])
    run = jobs.write_updates(jobs.stream_progress(deltas), f"{tmp_path}/out", f"{tmp_path}/c")
    run.awaitTermination()
    rows = sorted((r.batch, r.file_id, r.planned, r.completed, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(0, "f", 2, 1, "processing"), (0, "g", 1, 0, "processing"), (0, "h", 3, 0, "processing"), (1, "f", 2, 2, "done"), (1, "h", 3, 1, "stopped"), (2, "f", 5, 0, "processing")]
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # f has begun again, g is open, h has left


def test_stream_progress_forgets(spark, tmp_path):
    """A file without news for a minute of event time begins anew."""
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    deltas = parts_of(spark, tmp_path, "file_id string, analysis_delta int, completed_delta int, ts timestamp", [("f", 2, 1, at(1)), ("g", 1, 0, at(1))], [("g", 1, 0, at(9))], [("g", 1, 0, at(10)), ("f", 7, 0, at(10))])
    run = jobs.write_updates(jobs.stream_progress(deltas, "1 minute", 60_000), f"{tmp_path}/out", f"{tmp_path}/c")
    run.awaitTermination()
    last = {r.file_id: (r.planned, r.completed) for r in jobs.read_latest(spark, f"{tmp_path}/out", "file_id").collect()}
    assert last["f"] == (7, 0)


def test_candidates_out_of_order(spark, tmp_path):
    schema = "file_id string, field string, value string, source string, arrival long, ts timestamp"
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    rows = parts_of(spark, tmp_path, schema, [("f", "code", "Ab", "ai", 5, at(5)), ("f", "code", " ", "ai", 1, at(1))], [("f", "code", "ab ", "filename", 3, at(3)), ("f", "broker", "kgi", "ai", 4, None)], [("f", "code", "AB", "manual", 9, at(9))])
    jobs.write_updates(jobs.stream_candidates(rows, ALIASES), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    told = sorted((r.batch, r.field, r.value, r.source, r.arrival) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert told == [(0, "code", "Ab", "ai", 5), (1, "broker", "凱基", "ai", 4), (1, "code", "ab", "filename", 3)]


RESULTS = "file_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double, label string, text string, run_id long, seq long"


def results(spark, *found):
    return spark.createDataFrame([(f, page, None if label is None else 1, 0.0, 0.0, 9.0, 9.0, label, "", run, seq) for f, page, label, run, seq in found], RESULTS)


def test_page_results_are_keyed_state(spark, tmp_path):
    """Late runs, a page twice in a batch, older numbers, empty results, and a batch that runs again."""
    user = spark.createDataFrame([region(1, 1, "mine", True, id_=4)], REGIONS)
    step = jobs.page_merger(spark, str(tmp_path), user)
    batches = [[("f", 1, "old", 2, 1), ("f", 1, "a", 2, 2), ("g", 1, "g", 2, 3)], [("f", 1, "late", 1, 9), ("f", 2, "late", 1, 9), ("g", 1, "older", 2, 2)], [("f", 2, "b", 3, 5), ("f", 1, None, 3, 6), ("f", 3, None, 3, 7)]]
    held = jobs.page_state(spark, str(tmp_path))
    for number, found in enumerate(batches):
        step(results(spark, *found), number)
        step(results(spark, *found), number)
    labels = sorted((r.file_id, r.page, r.ord, r.id, r.label) for r in held.read("regions", 2).collect())
    assert labels == [("f", 1, 1, 4, "r1"), ("f", 1, 2, 5, "a"), ("f", 2, 1, 1, "b"), ("g", 1, 1, 1, "g")]
    assert sorted((r.file_id, r.page) for r in held.read("pages", 2).collect()) == [("f", 1), ("f", 2), ("f", 3), ("g", 1)]
    # the last batch had one file: the bucket of the other is still of batch 0
    assert {v for (name, _), v in held.manifest(2).items() if name == "regions"} == {0, 2}


def test_reports_are_delivered_once(spark, tmp_path):
    schema = "file_id string, type string, name string, provider string, date string, content string, info string, error string, seq long"
    one = spark.createDataFrame([("f", "company", "2330", "JPM", "2026-01-01", "x", "f.pdf", None, 1), ("f", "company", "2330", "JPM", "2026-01-01", "y", "f.pdf", None, 2), ("g", "company", None, None, None, "", "g.pdf", "code", 1)], schema)
    sink = jobs.report_sink(str(tmp_path))
    for number in (0, 0, 1):
        sink(one, number)
    assert [(r.file_id, r.content) for r in jobs.read_reports(spark, str(tmp_path)).collect()] == [("f", "y")]
    assert spark.read.json(f"{tmp_path}/errors").count() == 2  # one for each batch
