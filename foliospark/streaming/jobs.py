"""The incremental side: files, page results, candidates, progress and recognitions as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.functions.metadata import normalize_broker
from foliospark.operators import state
from foliospark.streaming import buckets
from foliospark.streaming.buckets import BucketState


def stream_ingest(names: DataFrame, known: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """A stream of names becomes a stream of queued files; no state is kept."""
    return state.ingest_files(names, known, aliases)


CANDIDATE = "file_id string, field string, value string, source string, arrival long"
#: Groups that files are dealt into: the state of one is a row of the state store, its candidates are gone through together.
DEALT = 4096
_KEY, _BEST = ("file_id", "field", "norm"), ("arrival", "value", "source")
_HELD = "file_id array<string>, field array<string>, norm array<string>, arrival array<long>, value array<string>, source array<string>, leaves array<long>"


def _first() -> Callable:
    """For each key of a group of files the arrival that came first, whenever it is processed; told again whenever an earlier one
    turns up. leaves: when the state of a key does, in event time."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentWatermarkMs(), state.getOption
        best = {(f, n, v): (*b, u) for f, n, v, *b, u in zip(*held, strict=True)} if held else {}
        met, better = set(), set()
        if not state.hasTimedOut:
            for frame in frames:
                for f, n, v, arrival, value, source, until in zip(*(frame[c].tolist() for c in (*_KEY, *_BEST, "until")), strict=True):
                    key = (f, n, v)
                    was = best.get(key)
                    met.add(key)
                    if was is None or arrival < was[0]:  # the first of equals
                        best[key] = (int(arrival), value, source, max(until, was[3] if was else 0))
                        better.add(key)
                    elif until > was[3]:
                        best[key] = (*was[:3], until)
        kept = {k: (*b[:3], max(b[3], now + 1)) if k in met else b for k, b in best.items() if k in met or b[3] >= now}
        if kept:
            state.update(tuple(map(list, zip(*((*k, *b) for k, b in kept.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(b[3] for b in kept.values()), now + 1))
        else:
            state.remove()
        if better:
            yield pd.DataFrame([(k[0], k[1], best[k][1], best[k][2], best[k][0]) for k in better], columns=["file_id", "field", "value", "source", "arrival"])

    return step


def stream_candidates(arrivals: DataFrame, aliases: Mapping[str, str], late: str = "1 hour", late_ms: int = 3_600_000) -> DataFrame:
    """Each value of a file and field with the arrival that came first, as arrivals are numbered, not as they are
    processed: a row for every key that is new or gets an earlier arrival (update mode; the last row of a key counts). A
    key's state leaves once the watermark on ts has passed its last row by late_ms. Blank values are no candidates. Files are dealt
    into groups, so that a call of Python takes many keys."""
    value = F.when(F.col("field") == "broker", normalize_broker(F.col("value"), aliases)).otherwise(F.trim("value"))
    rows = arrivals.withColumn("value", value).filter(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("norm", F.lower(F.trim("value")))
    until = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")) + late_ms, F.lit(0).cast("long"))
    group = F.pmod(F.xxhash64("file_id"), F.lit(DEALT)).alias("dealt")
    keyed = rows.select(group, *_KEY, "value", "source", F.col("arrival").cast("long").alias("arrival"), until.alias("until"), "ts").withWatermark("ts", late)
    return keyed.groupBy("dealt").applyInPandasWithState(_first(), CANDIDATE, _HELD, "update", GroupStateTimeout.EventTimeTimeout)


PROGRESS = "file_id string, planned long, completed long, status string"


def _progress(timed: bool, ttl_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        planned, completed, until = state.getOption or (0, 0, 0)
        if timed and until <= state.getCurrentWatermarkMs():  # nobody has asked since it ran out
            planned, completed, until = 0, 0, state.getCurrentWatermarkMs() + ttl_ms
        closed = False
        for f in frames:
            if timed and f["ts"].notna().any():
                until = max(until, int(f["ts"].max().timestamp() * 1000) + ttl_ms)
            planned += int(f["analysis_delta"].fillna(0).sum())
            completed += int(f["completed_delta"].fillna(0).sum())
            closed = closed or bool(f["closes"].fillna(False).astype(bool).any())
        if closed:
            if state.exists:
                state.remove()
        else:
            state.update((planned, completed, until))
            if timed:
                state.setTimeoutTimestamp(until)
        status = "done" if completed >= planned else "stopped" if closed else "processing"
        yield pd.DataFrame([{"file_id": key[0], "planned": planned, "completed": completed, "status": status}])

    return step


def stream_progress(deltas: DataFrame, late: str = "7 days", ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """file_id, planned, completed, status for each file that a batch changes (update mode): sums of deltas; done when all that
    is planned is completed. A delta that closes a file (column closes, if there is one) is its last: what is not done is
    stopped, and the file's state leaves. Where deltas have a time ts, state without news for ttl_ms leaves as well, once the
    watermark, which lies late behind the newest time, has passed."""
    timed = "ts" in deltas.columns
    closes = F.coalesce("closes", F.lit(False)) if "closes" in deltas.columns else F.lit(False)
    rows = deltas.select("file_id", F.col("analysis_delta").cast("long").alias("analysis_delta"), F.col("completed_delta").cast("long").alias("completed_delta"), closes.alias("closes"), *(["ts"] if timed else []))
    rows = rows.withWatermark("ts", late) if timed else rows
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("file_id").applyInPandasWithState(_progress(timed, ttl_ms), PROGRESS, "planned long, completed long, until long", "update", timeout)


def write_updates(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The rows of an update-mode stream, batch by batch; a batch that runs twice replaces itself."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """The last row of each key that write_updates has written."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, "batch")]), "batch").alias("r"))
    return last.select(*key, "r.*")


def merge_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch is put into state by step; batches are numbered, so a batch that runs twice replaces itself."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REGIONS = "file_id string, page int, ord int, id int, x1 double, y1 double, x2 double, y2 double, label string, text string, user_modified boolean"


def page_state(spark: SparkSession, folder: str) -> BucketState:
    return BucketState(spark, folder, {"regions": REGIONS, "pages": "file_id string, page int, seq long"})


def page_merger(spark: SparkSession, folder: str, regions: DataFrame | None = None, pages: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """State of regions and pages in folder, keyed by file and page; regions and pages: what it begins with.

    A row of a batch is a region of a page's result (ord null: a result without any), with run_id and seq, the number of the
    result. Results of an older run than the newest of this batch or any before it are left out. Of a page the result with the
    largest seq counts, within a batch and against what an earlier batch has left; the user's regions stay, and a result
    without regions only marks the page. Only buckets of files in the batch are read and written."""
    state_ = page_state(spark, folder)
    if regions is not None:
        first = pages if pages is not None else regions.select("file_id", "page").distinct()
        state_.seed(regions=regions.select(*[c.split()[0] for c in REGIONS.split(", ")]), pages=first.select("file_id", "page", F.lit(-1).cast("long").alias("seq")))

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        newest = batch.agg(F.max("run_id").alias("newest"))
        if buckets.exists(spark, f"{folder}/newest-{number - 1}"):
            newest = newest.unionByName(spark.read.parquet(f"{folder}/newest-{number - 1}")).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{folder}/newest-{number}")
        one = F.broadcast(spark.read.parquet(f"{folder}/newest-{number}"))  # one row
        of_run = batch.join(one, F.col("run_id") == F.col("newest")).drop("run_id", "newest")
        held_pages = state_.read("pages", number - 1, state_.touched(of_run))
        last = of_run.groupBy("file_id", "page").agg(F.max("seq").alias("seq"))
        last = last.join(held_pages.withColumnRenamed("seq", "held"), ["file_id", "page"], "left").filter(F.col("held").isNull() | (F.col("seq") > F.col("held"))).drop("held")
        touched = state_.touched(last)
        held_regions, held_pages = (state_.read(n, number - 1, touched) for n in ("regions", "pages"))
        fresh = of_run.join(last, ["file_id", "page", "seq"], "left_semi")
        new = fresh.filter(F.col("ord").isNotNull()).select("file_id", "page", "ord", "x1", "y1", "x2", "y2", "label", "text")
        merged, _ = state.merge_page_result(held_regions, new, held_pages, last)
        keys = held_pages.unionByName(last.select("file_id", "page", F.col("seq").cast("long").alias("seq"))).groupBy("file_id", "page").agg(F.max("seq").alias("seq"))
        state_.write(number, touched, regions=merged, pages=keys)
        batch.unpersist()

    return step


def recognition_state(spark: SparkSession, folder: str) -> BucketState:
    return BucketState(spark, folder, {"recognised": REGIONS})


def recognition_writer(spark: SparkSession, folder: str, regions: DataFrame) -> Callable[[DataFrame, int], None]:
    """Recognised texts go onto the regions of the state, which begins as regions; only buckets of files in the batch are read
    and written."""
    state_ = recognition_state(spark, folder)
    columns = [c.split()[0] for c in REGIONS.split(", ")]
    state_.seed(recognised=regions.select(*columns))

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        touched = state_.touched(batch)
        out = state.apply_recognition(state_.read("recognised", number - 1, touched), batch).select(*columns)
        state_.write(number, touched, recognised=out)
        batch.unpersist()

    return step


def report_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Payloads of a batch under its number, of each file the last (column seq): a batch that is delivered again replaces
    what it has written. Reports that lack something go to their own folder."""

    def step(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in ("file_id", "seq")]
        one = batch.groupBy("file_id").agg(F.max_by(F.struct(*columns), "seq").alias("r"), F.max("seq").alias("seq")).select("file_id", "seq", "r.*")
        one.persist()
        one.filter(F.col("error").isNull()).drop("error").write.mode("overwrite").json(f"{folder}/reports/batch={number}")
        one.filter(F.col("error").isNotNull()).select("file_id", "seq", "info", "error").write.mode("overwrite").json(f"{folder}/errors/batch={number}")
        one.unpersist()

    return step


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One payload for each file, the one with the largest seq."""
    rows = spark.read.schema("file_id string, seq long, type string, name string, provider string, date string, content string, info string").json(f"{folder}/reports")
    columns = [c for c in rows.columns if c not in ("file_id", "batch")]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*columns), F.struct("seq", "batch")).alias("r")).select("file_id", "r.*").drop("seq")
