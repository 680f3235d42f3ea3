"""What a query costs: texts parsed once, pages in one shuffle, no work that grows faster than its rows."""

from pyspark.sql import functions as F

from foliospark.operators import geometry, lines, regions, state
from foliospark.plans import adapters as A
from foliospark.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def orders(spark, folder, n=40):
    rows = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit("1996-03-04").cast("date").alias("o_orderdate"))
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_a_response_is_parsed_once_whatever_is_asked_of_it(spark, tmp_path):
    sf = orders(spark, tmp_path)
    for name in ("parse_responses", "accept_ai_metadata", "response_errors", "resolve_attempts"):
        assert plan(Q.queries()[name](spark, sf)).count("from_json(") == 1, name
    # rows of one small file are dealt out before they are multiplied
    assert A.responses(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_parsing_tells_of_odd_texts(spark):
    texts = ["{}", "[1]", "no", None, "```json\n{\"stock\": \"2330\", \"regions\": [{}]}\n``` and {\"code\": \"1\"}", '{"code": "1", "regions": null}']
    rows = spark.createDataFrame([("f", k, 1, t) for k, t in enumerate(texts)], "file_id string, page int, attempt int, response_text string")
    got = {r.page: r for r in state.parse_responses(rows, stock_as_code=True).collect()}
    assert [got[k].error for k in range(6)] == [None, "not JSON", "not JSON", "not JSON", None, None]
    assert (got[4].code, got[5].code, got[5].regions) == ("2330", "1", [])
    assert [(r.id, r.bbox, r.label) for r in got[4].regions] == [(1, [0.0] * 4, "區域 1")]


def documents(spark, folder):
    docs = [(k, " ".join(f"w{i}" if i % 7 else "中文" for i in range(n))) for k, n in ((1, 300), (2, 40), (3, 125), (5, 121), (7, 1))]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows(df, *columns):
    return sorted(map(repr, (df.select(*columns) if columns else df).collect()))


def test_items_and_boxes_of_a_page_meet_without_a_join(spark, tmp_path):
    sf = documents(spark, tmp_path)
    for name in ("item_ownership", "region_summary", "resolve_shared_lines", "reextract_region", "extract_text_for_regions", "normalize_text_items"):
        assert "Join" not in plan(Q.queries()[name](spark, sf)), name
    items, boxes, pages = A.text_items(spark, sf), A.regions(spark, sf), A.boxed_pages(spark, sf)
    for f in (regions.item_ownership, regions.region_summary, geometry.resolve_shared_lines, geometry.extract_text_for_regions, geometry.reextract_region):
        assert rows(f(items, boxes)) == rows(f(pages)), f.__name__


def test_text_that_tells_of_progress_is_kept_box_by_box(spark, tmp_path):
    sf = documents(spark, tmp_path)
    waits = F.when(F.col("ord") == 2, "⏳ waits").otherwise("old")
    told = {(r.file_id, r.page, r.ord): r.text for r in geometry.reextract_region(A.text_items(spark, sf), A.regions(spark, sf).withColumn("text", waits)).collect()}
    lone = {(r.file_id, r.page, r.ord): r.text for k in (1, 2, 3, 4) for r in geometry.extract_text_for_regions(A.text_items(spark, sf), A.regions(spark, sf).filter(F.col("ord") == k)).collect()}
    assert told == {k: "⏳ waits" if k[2] == 2 else v for k, v in lone.items()} and any(lone.values())


def test_items_of_one_number_are_owned_together(spark):
    item = "file_id string, page int, item_idx int, str string, norm_x double, norm_y double, norm_w double, norm_h double, norm_baseline double"
    items = spark.createDataFrame([("f", 1, 0, "a", 10.0, 10.0, 50.0, 10.0, 20.0), ("f", 1, 0, "b", 10.0, 90.0, 50.0, 10.0, 100.0), ("f", 1, 1, "c", 10.0, 12.0, 50.0, 10.0, 22.0)], item)
    boxes = spark.createDataFrame([("f", 1, 1, 0.0, 0.0, 100.0, 40.0), ("f", 1, 2, 0.0, 80.0, 100.0, 120.0)], "file_id string, page int, ord int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.ord, r.item_idx, r.owned) for r in regions.item_ownership(items, boxes).collect())
    assert got == [(1, 0, True), (1, 0, True), (1, 1, True), (2, 0, False), (2, 0, False), (2, 1, False)]


def test_an_edit_log_is_one_table(spark, tmp_path):
    assert plan(Q.queries()["apply_region_edits"](spark, documents(spark, tmp_path))).count("collect_list(text") <= 3


def test_first_difference_in_steps_of_powers(spark):
    texts = ["", "a", "ab", "abc", "abd", "🖊x", "🖊y", "z" * 700 + "a", "z" * 700 + "b", "z" * 1024]
    both = [(f"{i}-{j}", 1, a, e) for i, a in enumerate(texts) for j, e in enumerate(texts)]
    df = spark.createDataFrame(both, "case_id string, region_id int, actual string, expected string")
    found = state.compare_golden(df.drop("expected"), df.drop("actual"))
    assert "greatest(length" not in plan(found)
    want = {k: next((n + 1 for n in range(max(len(a), len(e))) if a[n : n + 1] != e[n : n + 1]), None) for k, _, a, e in both}
    assert {r.case_id: r.first_diff for r in found.collect()} == want


def test_texts_of_near_clusters_are_slices(spark):
    at = [10.0 * k - 6 * (k % 3 == 2) for k in range(30)]
    item = [("f", 1, k, f"w{k}", 0.0, b - 1, 5.0, 1.0, b + 0.4) for k, b in enumerate(at)]
    items = spark.createDataFrame(item, "file_id string, page int, item_idx int, str string, norm_x double, norm_y double, norm_w double, norm_h double, norm_baseline double")
    got = lines.danger_gaps(items)
    assert "filter(items" not in plan(got)
    assert [(r.upper_text, r.lower_text) for r in got.orderBy("upper").collect()] == [(f"w{k - 1}", f"w{k}") for k in range(2, 30, 3)]
