"""Files, pages, attempts, edits and progress: the state of a run as tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import boxes as B
from foliospark.functions import metadata as M
from foliospark.functions import text as T

PAGE = ["file_id", "page"]
RESPONSE = "hasAnalysis boolean, date string, code string, stock string, report string, regions array<struct<id:int,bbox:array<double>,label:string>>"


# --- file names ------------------------------------------------------------------------------------------------


def ingest_files(names: DataFrame, known: Sequence[str], aliases: Mapping[str, str], status: str = "queued") -> DataFrame:
    """names (file_id, name, num_pages, mime) to files: one row for each PDF, with what its name tells."""
    found = M.parse_metadata(F.col("name"), known, aliases)
    pdf = names.filter(F.col("mime") == "application/pdf")
    raw = pdf.select("file_id", "name", "num_pages", *[c.alias(k) for k, c in found.items()])
    return raw.select("file_id", "name", F.lit(status).alias("status"), "num_pages", F.col("date").alias("selected_date"), F.col("code").alias("selected_code"), M.normalize_broker(F.col("broker"), aliases).alias("selected_broker"), F.col("broker").alias("report"))


def search_files(files: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return files.filter(F.lower("name").contains(q)) if q else files


def page_skip(files: DataFrame, skip: DataFrame, default: int = M.DEFAULT_SKIP) -> DataFrame:
    """Files with skip and pages to read: skip by the raw broker name, else by the selected one, else the default."""
    by = lambda c: skip.select(F.col("broker").alias(c), F.col("skip").alias(f"skip_{c}"))
    out = files.join(by("report"), "report", "left").join(by("selected_broker"), "selected_broker", "left")
    out = out.withColumn("skip", F.coalesce("skip_report", "skip_selected_broker", F.lit(default))).drop("skip_report", "skip_selected_broker")
    return out.withColumn("target_pages", F.greatest(F.lit(1), F.col("num_pages") - F.col("skip")))


def planned_pages(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.explode(F.sequence(F.lit(1), "target_pages")).alias("page"))


def pending_pages(files: DataFrame, page_state: DataFrame) -> DataFrame:
    """Planned pages without a key in page_state; a page that was read and had nothing has one."""
    return planned_pages(files).join(page_state.select(*PAGE), PAGE, "left_anti")


def page_plan_diff(plans: DataFrame) -> DataFrame:
    """plans (file_id, old_pages, new_pages): pages that are dropped and added when a broker is found late."""
    upto = lambda c: F.when(F.col(c) >= 1, F.sequence(F.lit(1), F.col(c))).otherwise(F.expr("cast(array() as array<int>)"))
    return plans.select("file_id", F.array_except(upto("old_pages"), upto("new_pages")).alias("dropped"), F.array_except(upto("new_pages"), upto("old_pages")).alias("added"))


# --- model responses -------------------------------------------------------------------------------------------


def parse_responses(responses: DataFrame, stock_as_code: bool = False) -> DataFrame:
    """responses (file_id, page, attempt, response_text) with has_analysis, date, code, report, regions (id, bbox, label)
    and error. Text that is no JSON object is an error row. stock_as_code: take stock where there is no code."""
    zero = F.array(*[F.lit(0.0)] * 4)
    region = lambda r, i: F.struct(F.coalesce(r["id"], i + 1).alias("id"), B.swap_axes(F.coalesce(r["bbox"], zero)).alias("bbox"), F.coalesce(r["label"], F.concat(F.lit("區域 "), (i + 1).cast("string"))).alias("label"))
    none = F.expr("cast(array() as array<struct<id:int,bbox:array<double>,label:string>>)")

    def told(body: Column, json: Column) -> Column:
        code = F.coalesce(json["code"], json["stock"]) if stock_as_code else json["code"]
        return F.struct(
            F.coalesce(json["hasAnalysis"], F.lit(False)).alias("has_analysis"), json["date"].alias("date"), code.alias("code"), json["report"].alias("report"),
            F.coalesce(F.transform(json["regions"], region), none).alias("regions"), F.when(json.isNull() | ~body.startswith("{"), "not JSON").alias("error"),
        )

    parse = lambda body: M.bound(F.from_json(body, RESPONSE, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}), lambda json: told(body, json))
    # a text is parsed once: filters and columns on what was found stay above the inline
    return responses.select(*PAGE, "attempt", F.inline(F.transform(F.array("response_text"), lambda text: M.bound(T.strip_code_fence(text), parse))))


def resolve_attempts(parsed: DataFrame, portrait: Column, malformed_tries: int = 5, not_finite_tries: int = 2, check_boxes: bool = True, error_tries: int = 3) -> DataFrame:
    """One result for each page: the first attempt without an error whose boxes are all sound. Once the retries of
    a fault are used up, that attempt is taken and its bad boxes are dropped; a page left without any has no analysis.
    After error_tries errors in a row a page is given up and has no result. Without a sound attempt the last one that is no error is taken.

    Attempts of a page meet in one shuffle and are folded in their order."""
    regions = F.transform("regions", lambda r: r.withField("malformed", B.is_malformed(r["bbox"], portrait)).withField("broken", B.not_finite(r["bbox"]))) if check_boxes else F.col("regions")
    kind = F.when(F.col("error").isNotNull(), "error")
    if check_boxes:
        kind = kind.when(F.exists("regions", lambda r: r["malformed"]), "malformed").when(F.exists("regions", lambda r: r["broken"]), "broken")
    tried = F.struct("attempt", kind.otherwise("sound").alias("kind"), "has_analysis", "date", "code", "report", "regions")
    pages = parsed.withColumn("regions", regions).groupBy(*PAGE).agg(F.array_sort(F.collect_list(tried)).alias("tries"))
    # pick: the attempt that is taken, from 0; latest: the last one that is no error
    names = ("at", "errors", "malformed", "broken", "latest", "pick", "ended")
    start = F.struct(*[F.lit(-1 if n in ("latest", "pick") else 0).alias(n) for n in names[:-1]], F.lit(False).alias("ended"))

    def step(acc: Column, k: Column) -> Column:
        more = lambda n: acc[n] + F.when(k == n, 1).otherwise(0)
        errors = F.when(k == "error", acc["errors"] + 1).otherwise(0)
        takes = (k == "sound") | ((k == "malformed") & (acc["malformed"] >= malformed_tries)) | ((k == "broken") & (acc["broken"] >= not_finite_tries))
        latest = F.when(k == "error", acc["latest"]).otherwise(acc["at"])
        values = (acc["at"] + 1, errors, more("malformed"), more("broken"), latest, F.when(takes, acc["at"]).otherwise(acc["pick"]), takes | (errors >= error_tries))
        return F.when(acc["ended"], acc).otherwise(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]))

    pick = F.aggregate(F.transform("tries", lambda t: t["kind"]), start, step, lambda acc: F.when(acc["ended"], acc["pick"]).otherwise(acc["latest"]))
    taken = pages.withColumn("pick", pick).filter("pick >= 0").select(*PAGE, F.get("tries", F.col("pick")).alias("t"))
    first = taken.select(*PAGE, "t.attempt", "t.has_analysis", "t.date", "t.code", "t.report", "t.regions")
    if not check_boxes:
        return first
    return _without(first, lambda r: r["malformed"] | r["broken"]).withColumn("regions", F.transform("regions", lambda r: r.dropFields("malformed", "broken")))


def _without(results: DataFrame, bad: Callable[[Column], Column]) -> DataFrame:
    """Results without bad regions; a page that loses all of its regions has no analysis."""
    out = results.withColumn("n_before", F.size("regions")).withColumn("regions", F.filter("regions", lambda r: ~bad(r)))
    emptied = (F.col("n_before") > 0) & (F.size("regions") == 0)
    return out.withColumn("has_analysis", F.col("has_analysis") & ~emptied).drop("n_before")


def drop_bad_regions(results: DataFrame, portrait: Column) -> DataFrame:
    return _without(results, lambda r: B.is_malformed(r["bbox"], portrait) | B.not_finite(r["bbox"]))


def accept_ai_metadata(results: DataFrame) -> DataFrame:
    """Dates only if complete, brokers only if named, codes as they are."""
    return results.withColumn("date", F.when(M.is_complete_date(F.col("date")), F.col("date"))).withColumn("report", F.when(~M.should_ignore_broker(F.col("report")), F.col("report")))


def explode_regions(results: DataFrame) -> DataFrame:
    flat = results.select(*PAGE, F.posexplode("regions").alias("pos", "r"))
    side = lambda i, n: F.get("r.bbox", i).alias(n)
    return flat.select(*PAGE, (F.col("pos") + 1).alias("ord"), F.col("r.id").alias("id"), *[side(i, n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("r.label").alias("label"))


# --- merging ---------------------------------------------------------------------------------------------------


def merge_page_result(existing: DataFrame, new: DataFrame, page_state: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and page_state after new results: of pages with new regions the user's regions stay, first, and the new
    ones follow with ids from the largest of theirs on; other pages are as they were. done: all pages with a result."""
    touched = new.select(*PAGE).distinct()
    columns = [*PAGE, "ord", "id", "x1", "y1", "x2", "y2", "label", "text", "user_modified"]
    user = existing.join(touched, PAGE, "left_semi").filter("user_modified").select(*columns)
    top = user.groupBy(*PAGE).agg(F.max("id").alias("top"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    ai = new.join(top, PAGE, "left").withColumn("id", F.coalesce("top", F.lit(0)) + rank).withColumn("user_modified", F.lit(False)).select(*columns)
    both = user.withColumn("part", F.lit(0)).unionByName(ai.withColumn("part", F.lit(1)))
    both = both.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("part", "ord"))).drop("part")
    rest = existing.join(touched, PAGE, "left_anti").select(*columns)
    return rest.unionByName(both), page_state.select(*PAGE).unionByName(done.select(*PAGE)).distinct()


def recognition_worklist(regions: DataFrame) -> DataFrame:
    """Regions with work (empty or garbled, else null) and stored_text, in which garbled text is blanked."""
    blank = T.trim_text(F.coalesce("text", F.lit(""))) == ""
    garbled = ~blank & T.is_garbled(F.col("text"))
    return regions.withColumn("work", F.when(blank, "empty").when(garbled, "garbled")).withColumn("stored_text", F.when(garbled, "").otherwise(F.col("text")))


def apply_recognition(regions: DataFrame, recognitions: DataFrame) -> DataFrame:
    """Recognised text goes to regions with exactly the same box that the user has not changed, and marks them as the
    user's; a failure writes its message. Of several recognitions of a box (retries) the newest by seq counts, where there
    is such a column; else a success before a failure, then the smallest text."""
    sides = ["x1", "y1", "x2", "y2"]
    newest = F.col("seq") if "seq" in recognitions.columns else F.lit(0)
    order = F.struct((-newest).alias("seq"), (~F.col("success")).alias("failed"), "text", "error")
    found = recognitions.groupBy(*PAGE, *sides).agg(F.min(order).alias("r")).select(*PAGE, *sides, (~F.col("r.failed")).alias("success"), F.col("r.text").alias("new_text"), "r.error")
    out = regions.join(found, [*PAGE, *sides], "left")
    takes = F.col("success").isNotNull() & ~F.col("user_modified")
    message = F.concat(F.lit("❌ 識別失敗: "), F.coalesce("error", F.lit("")))
    text = F.when(takes & F.col("success"), F.col("new_text")).when(takes, message).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("user_modified", F.col("user_modified") | (takes & F.col("success"))).drop("success", "new_text", "error")


def prune_for_rerun(regions: DataFrame, page_state: DataFrame) -> DataFrame:
    """All regions of pages that are done, of others the user's."""
    done = page_state.select(*PAGE, F.lit(True).alias("is_done")).distinct()
    return regions.join(done, PAGE, "left").filter(F.coalesce("is_done", F.lit(False)) | F.col("user_modified")).drop("is_done")


def drop_stale(results: DataFrame) -> DataFrame:
    """Results of the newest run only. One row holds the newest run."""
    newest = results.agg(F.max("run_id").alias("newest"))
    return results.join(F.broadcast(newest), F.col("run_id") == F.col("newest")).drop("newest")


def reset_files(files: DataFrame) -> DataFrame:
    """Ready for another run: counters at 0, stopped and idle files queued."""
    return files.withColumn("status", F.when(F.col("status").isin("stopped", "idle"), "queued").otherwise(F.col("status"))).withColumn("analysis_pages", F.lit(0)).withColumn("completed_pages", F.lit(0))


def clear_for_rerun(regions: DataFrame, page_state: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and page_state without what is to be read again: single pages where targets have a page column, else
    whole files. The user's regions go as well."""
    key = [c for c in PAGE if c in targets.columns]
    gone = targets.select(*key).distinct()
    return regions.join(gone, key, "left_anti"), page_state.join(gone, key, "left_anti")


def normalize_status(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.when(F.col("status").isin("processing", "queued"), "stopped").otherwise(F.col("status")))


# --- edits -----------------------------------------------------------------------------------------------------


def insert_in_reading_order(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions with one drawn box (file_id, page, x1, y1, x2, y2) for each page put in: before the first region that
    is over 15 further down, or within 15 and further right; else last. Its id is the largest plus one."""
    new = boxes.select(*PAGE, *[F.col(c).alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")])
    down = F.col("y1") - F.col("n_y1")
    behind = (down > 15) | ((F.abs(down) <= 15) & (F.col("x1") > F.col("n_x1")))
    place = new.join(regions, PAGE, "left").groupBy(*new.columns).agg(F.min(F.when(behind, F.col("ord"))).alias("at"), F.coalesce(F.max("ord"), F.lit(0)).alias("last"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("new_id"))
    place = place.withColumn("at", F.coalesce("at", F.col("last") + 1))
    shifted = regions.join(place.select(*PAGE, "at"), PAGE, "left").withColumn("ord", F.col("ord") + F.when(F.col("ord") >= F.col("at"), 1).otherwise(0)).drop("at")
    drawn = place.select(*PAGE, F.col("at").alias("ord"), F.col("new_id").alias("id"), *[F.col(f"n_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.concat(F.lit("手動框 "), F.col("new_id").cast("string")).alias("label"), F.lit("").alias("text"), F.lit(True).alias("user_modified"))
    return shifted.select(*drawn.columns).unionByName(drawn)


def apply_region_edits(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions after a log of edits (file_id, page, seq, op, region_id, x1..y2, text): of box and text the last
    entry holds, a removal drops the region, remove_page the page's regions known before it; both kinds of change mark a
    region as the user's. A box equal to the region's is no change."""
    sides = ("x1", "y1", "x2", "y2")
    key = [*PAGE, "region_id"]
    last = lambda op, c: F.max_by(F.when(F.col("op") == op, c), F.when(F.col("op") == op, F.col("seq")))
    folded = edits.filter(F.col("op").isin("bbox", "text", "remove")).groupBy(*key).agg(last("bbox", F.struct(*sides)).alias("box"), last("text", F.struct("text")).alias("new_text"), F.bool_or(F.col("op") == "remove").alias("removed"))
    pages = edits.filter("op = 'remove_page'").select(*PAGE).distinct()
    left = regions.join(pages, PAGE, "left_anti").withColumnRenamed("id", "region_id").join(folded, key, "left").filter(~F.coalesce("removed", F.lit(False)))
    moved = F.col("box").isNotNull() & ~F.col("box").eqNullSafe(F.struct(*sides))
    out = left.withColumn("user_modified", F.col("user_modified") | moved | F.col("new_text").isNotNull()).withColumn("text", F.when(F.col("new_text").isNotNull(), F.col("new_text.text")).otherwise(F.col("text")))
    return out.select(*PAGE, "ord", F.col("region_id").alias("id"), *[F.when(moved, F.col(f"box.{c}")).otherwise(F.col(c)).alias(c) for c in sides], "label", "text", "user_modified")


BOX = "id:int,x1:double,y1:double,x2:double,y2:double,label:string,text:string,user_modified:boolean"


def fold_region_edits(regions: DataFrame, page_state: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and page_state after a log of edits (file_id, page, seq, op, region_id, x1..y2, text, order) of any kind,
    each on what those before it have left: bbox, text, remove, remove_page, add (a drawn box, put in reading order),
    reorder (order: ids in their new order; regions that it does not name follow as they were, without one nothing changes). A page whose last region is removed loses its key, one that has
    regions has it. Only pages with edits are folded, a page and its log being one row; ord counts from 1 there."""
    sides = ("x1", "y1", "x2", "y2")
    touched = edits.select(*PAGE).distinct()
    held = F.array_sort(F.collect_list(F.struct("ord", "id", *sides, "label", "text", "user_modified")))
    was = regions.join(touched, PAGE, "left_semi").groupBy(*PAGE).agg(F.transform(held, lambda r: r.dropFields("ord")).cast(f"array<struct<{BOX}>>").alias("was"))
    log = edits.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "region_id", *sides, "text", "order"))).alias("log"))
    start = F.coalesce("was", F.expr(f"cast(array() as array<struct<{BOX}>>)"))

    def step(acc: Column, e: Column) -> Column:
        on = lambda change: F.transform(acc, lambda r: F.when(r["id"] == e["region_id"], change(r)).otherwise(r))
        new = lambda r, **values: F.struct(*[values.get(n, r[n]).alias(n) for n in ("id", *sides, "label", "text", "user_modified")])
        same = lambda r: (r["x1"] == e["x1"]) & (r["y1"] == e["y1"]) & (r["x2"] == e["x2"]) & (r["y2"] == e["y2"])
        boxed = on(lambda r: F.when(same(r), r).otherwise(new(r, **{s: e[s] for s in sides}, user_modified=F.lit(True))))
        typed = on(lambda r: new(r, text=e["text"], user_modified=F.lit(True)))
        down = lambda r: r["y1"] - e["y1"]
        behind = F.array_position(F.transform(acc, lambda r: (down(r) > 15) | ((F.abs(down(r)) <= 15) & (r["x1"] > e["x1"]))), True)
        before = F.when(behind > 0, behind - 1).otherwise(F.size(acc)).cast("int")
        name = F.coalesce(F.array_max(F.transform(acc, lambda r: r["id"])), F.lit(0)) + 1
        drawn = F.struct(name.alias("id"), *[e[s].alias(s) for s in sides], F.concat(F.lit("手動框 "), name.cast("string")).alias("label"), F.lit("").alias("text"), F.lit(True).alias("user_modified"))
        added = F.concat(F.slice(acc, F.lit(1), before), F.array(drawn), F.slice(acc, before + 1, F.size(acc)))
        named = F.flatten(F.transform(F.array_distinct(e["order"]), lambda i: F.filter(acc, lambda r: r["id"] == i)))
        ordered = F.when(e["order"].isNull(), acc).otherwise(F.concat(named, F.filter(acc, lambda r: ~F.array_contains(e["order"], r["id"]))))
        gone = F.filter(acc, lambda r: (r["id"] != e["region_id"]) & (e["op"] == "remove"))
        return (
            F.when(e["op"] == "bbox", boxed).when(e["op"] == "text", typed).when(e["op"] == "add", added).when(e["op"] == "reorder", ordered)
            .when(e["op"].isin("remove", "remove_page"), gone).otherwise(acc)
        )

    folded = log.join(was, PAGE, "left").select(*PAGE, F.aggregate("log", start, step).alias("left"), F.exists("log", lambda e: e["op"].startswith("remove")).alias("cut"))
    changed = folded.select(*PAGE, F.posexplode("left").alias("pos", "r")).select(*PAGE, (F.col("pos") + 1).alias("ord"), "r.*")
    columns = [*PAGE, "ord", "id", *sides, "label", "text", "user_modified"]
    rest = regions.join(touched, PAGE, "left_anti")
    lost = folded.filter((F.size("left") == 0) & F.col("cut")).select(*PAGE)
    keys = page_state.select(*PAGE).join(lost, PAGE, "left_anti").unionByName(folded.filter(F.size("left") > 0).select(*PAGE)).distinct()
    return rest.select(*columns).unionByName(changed.select(*columns)), keys


def move_region(regions: DataFrame, moves: DataFrame) -> DataFrame:
    """Regions with one of each page moved (file_id, page, i, p, from 0): element i goes to insert point p; p = i and
    p = i + 1 change nothing. ord counts from 1 after it."""
    out = regions.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")) - 1).join(moves, PAGE, "left")
    # twice the place leaves room between neighbours for the moved one
    rank = F.when((F.col("k") == F.col("i")) & (F.col("p") != F.col("i")) & (F.col("p") != F.col("i") + 1), F.col("p") * 2 - 1).otherwise(F.col("k") * 2)
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank))).drop("k", "i", "p")


def next_region_id(regions: DataFrame) -> DataFrame:
    return regions.groupBy(*PAGE).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


# --- candidates ------------------------------------------------------------------------------------------------


def collect_candidates(arrivals: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """file_id, field, value, source, arrival: values in order of arrival, each once whatever its case and blanks; brokers
    by their kept name. Copies are merged before rows are shuffled."""
    value = F.when(F.col("field") == "broker", M.normalize_broker(F.col("value"), aliases)).otherwise(F.trim("value"))
    rows = arrivals.withColumn("value", value).filter(F.coalesce(F.col("value"), F.lit("")) != "")
    first = rows.groupBy("file_id", "field", F.lower(F.trim("value")).alias("norm")).agg(F.min_by(F.struct("value", "source", "arrival"), "arrival").alias("c"))
    return first.select("file_id", "field", "c.*")


def selected_value(candidates: DataFrame) -> DataFrame:
    """file_id, field, selected: a manual entry (the last), else the first that arrived."""
    manual = F.max_by(F.when(F.col("source") == "manual", F.col("value")), F.when(F.col("source") == "manual", F.col("arrival")))
    return candidates.groupBy("file_id", "field").agg(F.coalesce(manual, F.min_by("value", "arrival")).alias("selected"))


def selected_after_edits(log: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """file_id, field, selected ('' for none) after a log (file_id, field, seq, op, value, source) of add, choose, remove
    and clear, one row for each key of the log. A choice or a manual entry is selected; otherwise the first value is.
    When the selected value is removed, the first that remains follows, and stays selected until it is removed
    itself; clear forgets all before it. So the last choice counts if nothing removed it afterwards, else the first value that
    is left: sums of the log, no walk along it."""
    key = ["file_id", "field"]
    value = F.when(F.col("field") == "broker", M.normalize_broker(F.col("value"), aliases)).otherwise(F.trim("value"))
    cleared = log.filter("op = 'clear'").groupBy(*key).agg(F.max("seq").alias("cleared"))
    rows = log.withColumn("value", value).withColumn("norm", F.lower(F.trim("value"))).filter((F.col("op") != "clear") & (F.coalesce("norm", F.lit("")) != ""))
    rows = rows.join(cleared, key, "left").filter(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared")))
    removed = rows.filter("op = 'remove'").groupBy(*key, "norm").agg(F.max("seq").alias("removed"))
    put = rows.filter(F.col("op").isin("add", "choose")).join(removed, [*key, "norm"], "left")
    stands = F.col("removed").isNull() | (F.col("seq") > F.col("removed"))
    left = stands & (F.col("op") == "add")
    strong = (F.col("op") == "choose") | F.coalesce(F.col("source") == "manual", F.lit(False))
    last = F.max_by(F.when(strong, F.struct(F.when(stands, F.col("value")).alias("v"))), F.when(strong, F.col("seq")))
    picked = put.groupBy(*key).agg(F.min_by(F.when(left, F.col("value")), F.when(left, F.col("seq"))).alias("first"), last.alias("last"))
    return log.select(*key).distinct().join(picked, key, "left").select(*key, F.coalesce("last.v", "first", F.lit("")).alias("selected"))


# --- progress, reports, checks -----------------------------------------------------------------------------------


def progress_totals(files: DataFrame, page_state: DataFrame) -> DataFrame:
    """Pages done, to do and in all, for each file and (file_id null) over all."""
    done = page_state.groupBy("file_id").agg(F.countDistinct("page").alias("done"))
    rows = files.join(done, "file_id", "left").select("file_id", F.coalesce("done", F.lit(0)).alias("done"), "target_pages", "num_pages")
    return rows.rollup("file_id").agg(F.sum("done").alias("pages_done"), F.sum("target_pages").alias("pages_planned"), F.sum("num_pages").alias("pages"))


def run_state(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each group): whether any file waits, whether all are done, and the label of the button that follows."""
    waits, ended = F.col("status").isin("idle", "stopped"), F.col("status") == "done"
    out = files.groupBy(*by).agg(F.coalesce(F.bool_or(waits), F.lit(False)).alias("any_waiting"), (F.coalesce(F.bool_and(ended), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("all_done"))
    return out.withColumn("label", F.when(F.col("all_done"), "rerun").when(F.col("any_waiting"), "continue").otherwise("running"))


def assemble_report(regions: DataFrame, keep_blank: bool = False) -> DataFrame:
    """file_id, content: texts by page and order with a blank line between, blank ones left out, ends trimmed.
    keep_blank: texts of white space alone stay. Only texts are shuffled."""
    text = F.coalesce("text", F.lit(""))
    has = text != "" if keep_blank else T.trim_text(text) != ""
    parts = F.transform(F.array_sort(F.collect_list(F.when(has, F.struct("page", "ord", "text")))), lambda s: s["text"])
    joined = regions.select("file_id", "page", "ord", "text").groupBy("file_id").agg(F.array_join(parts, "\n\n").alias("content"))
    return joined.withColumn("content", T.trim_text(F.col("content")))


def export_reports(files: DataFrame, contents: DataFrame, page_state: DataFrame) -> DataFrame:
    """One payload for each file with a page that is done; without code, broker or date an error row."""
    targets = files.join(page_state.select("file_id").distinct(), "file_id", "left_semi").join(contents, "file_id", "left")
    lacking = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"selected_{c}"), F.lit("")) == "", c) for c in ("code", "broker", "date")])
    return targets.select(
        "file_id", F.lit("company").alias("type"), F.col("selected_code").alias("name"), F.col("selected_broker").alias("provider"), T.export_date(F.col("selected_date")).alias("date"),
        F.coalesce("content", F.lit("")).alias("content"), F.col("name").alias("info"), F.nullif(lacking, F.lit("")).alias("error"),
    )


def export_summary(exported: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successes, failures and one message for each failure, by file."""
    message = F.when(F.col("error").isNotNull(), F.struct("file_id", F.concat_ws(": ", "info", "error").alias("m")))
    return exported.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.transform(F.array_sort(F.collect_list(message)), lambda s: s["m"]).alias("messages"))


def restore_session(files: DataFrame, blobs: DataFrame) -> DataFrame:
    return files.join(blobs.select("file_id"), "file_id", "left_semi")


def running_index(regions: DataFrame) -> DataFrame:
    """Regions with offset (regions of the file on earlier pages) and index (from 1) across the file."""
    counts = regions.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*PAGE, F.coalesce(before, F.lit(0)).alias("offset"))
    return regions.join(offsets, PAGE).withColumn("index", F.col("offset") + F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")))


def compare_golden(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """golden (case_id, region_id, expected) with actual, passed (equal once trimmed) and the first place, from 1, that differs."""
    both = golden.join(actual, ["case_id", "region_id"], "left")
    a, e = T.trim_text(F.coalesce("actual", F.lit(""))), T.trim_text(F.col("expected"))
    diff = M.bound(F.struct(a.alias("a"), e.alias("e")), lambda t: F.when(t["a"] != t["e"], _common(t["a"], t["e"]) + 1))
    return both.withColumn("passed", a == e).withColumn("first_diff", diff)


def _common(a: Column, e: Column) -> Column:
    """How many characters two texts share at their start: steps of falling powers of two are taken if the stretch is equal,
    so a text is gone through once for each power and not once for each character."""
    powers = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    least = F.least(F.length(a), F.length(e))
    steps = M.bound(least, lambda n: F.filter(powers, lambda p: p <= n))
    part = lambda t, at, p: F.substring(t, at + 1, p)
    return F.aggregate(steps, F.lit(0), lambda at, p: F.when((at + p <= least) & (part(a, at, p) == part(e, at, p)), at + p).otherwise(at))


def golden_summary(compared: DataFrame, cases: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Regions passed and failed and cases with a failure; cases: only these."""
    rows = compared.filter(F.col("case_id").isin(*cases)) if cases else compared
    return rows.groupBy(*by).agg(F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.countDistinct(F.when(~F.col("passed"), F.col("case_id"))).alias("failed_cases"))
