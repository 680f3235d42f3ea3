"""Folders, paths, settings, sessions and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foliospark.functions.text import clear_transient, sanitize_file_name, trim_text

SETTINGS = "brokerSkipMap map<string,int>, brokerAliasGroups array<string>"


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of files whose name ends in .pdf, in Chinese (traditional) order. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    named = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    return named.filter(F.lower("name").endswith(".pdf")).select("path", "name", "length").orderBy(F.collate("name", "zh_Hant"), "path")


def collated(names: DataFrame, folder: str, collation: str = "zh_Hant") -> DataFrame:
    """Rows with place, from 1: their rank by name in the order of a language, ties by the other columns.

    Names are dealt out by ranges of that order, so each task sorts its own range; a row's place is its place in the range and
    the sizes of the ranges before it, one number each. No task has all rows. The sorted ranges are written to folder once,
    so that ranges and sizes are of one deal."""
    ties = [c for c in names.columns if c != "name"]
    order = [F.collate("name", collation), *[F.col(c).asc_nulls_first() for c in ("name", *ties)]]
    dealt = names.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    inside = 1 << 33  # ids count from 0 within a partition; its number stands above these bits
    dealt.withColumn("range", F.expr("shiftright(monotonically_increasing_id(), 33)").cast("int")).withColumn("at", number % inside).write.mode("overwrite").parquet(folder)
    rows = names.sparkSession.read.parquet(folder)
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    offsets = sizes.select("range", before.alias("before"))
    return rows.join(F.broadcast(offsets), "range").withColumn("place", F.col("before") + F.col("at") + 1).drop("range", "at", "before")


def read_pdf_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """path, content. Contents belong to this frame alone; other tables carry the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def normalize_path(path: Column) -> dict[str, Column]:
    """path (decoded; a file URI twice, a plus stays a plus), name, and error for what is no PDF."""
    plus = lambda c: F.replace(c, F.lit("+"), F.lit("%2B"))
    decode = lambda c: F.coalesce(F.try_url_decode(plus(c)), c)
    t = trim_text(path)
    bare = F.when(t.startswith("file:///"), decode(F.substring(t, F.lit(9), F.length(t)))).when(t.startswith("file://"), decode(F.substring(t, F.lit(8), F.length(t)))).otherwise(t)
    clean = decode(bare)
    return {"path": clean, "name": F.regexp_extract(clean, r"[^/\\]+$", 0), "error": F.when(~F.coalesce(F.lower(clean).endswith(".pdf"), F.lit(False)), "not a PDF")}


def extract_pdf_path(text: Column) -> Column:
    """First line that is an absolute path or file URI ending in .pdf."""
    lines = F.transform(F.split(text, "\r?\n"), trim_text)
    return F.get(F.filter(lines, lambda s: F.lower(s).endswith(".pdf") & s.rlike(r"^(file://|[A-Za-z]:[\\/]|/)")), 0)


def read_text_items(spark: SparkSession, path: str) -> DataFrame:
    """The text layer as a table of items; decoding PDF files is not part of this library."""
    return spark.read.parquet(path).select("file_id", "page", "item_idx", "str", "norm_x", "norm_y", "norm_w", "norm_h", "norm_baseline")


def read_model_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file_id string, page int, attempt int, response_text string").json(path)


def load_broker_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """skip (pos, broker, skip) and aliases (group_pos, pos, alias, canonical) from a settings file; order is kept, and of
    groups of one alias the last wins."""
    settings = spark.read.schema(SETTINGS).option("multiLine", "true").json(path)
    skip = settings.select(F.posexplode("brokerSkipMap").alias("pos", "broker", "skip"))
    groups = settings.select(F.posexplode("brokerAliasGroups").alias("group_pos", "names"))
    names = F.filter(F.transform(F.split("names", "[，,]"), trim_text), lambda n: n != "")
    flat = groups.withColumn("names", names).filter(F.size("names") > 0).select("group_pos", F.get("names", 0).alias("canonical"), F.posexplode("names").alias("pos", "name"))
    last = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("group_pos"), F.desc("pos")))
    return skip, flat.withColumn("k", last).filter("k = 1").select("group_pos", "pos", F.lower("name").alias("alias"), "canonical")


REGION = ("id", "x1", "y1", "x2", "y2", "label", "text", "user_modified")


def session_rows(files: DataFrame, regions: DataFrame | None, pages: DataFrame) -> DataFrame:
    """One row for each file, with its pages (page, regions in order): a page that was read and has no region has an empty
    array. Texts that only tell of progress are cleared, running files become stopped; debug columns are left out. regions
    are packed once by page, then by file; without regions, pages are one row each and hold theirs (regions)."""
    from foliospark.operators.state import normalize_status

    if regions is None:
        kept = F.transform("regions", lambda r: F.struct(r["ord"].alias("ord"), *[(clear_transient(r[c]) if c == "text" else r[c]).alias(c) for c in REGION]))
        rows = pages.select("file_id", "page", F.array_sort(kept).alias("r"))
    else:
        cleared = regions.withColumn("text", clear_transient(F.col("text")))
        held = cleared.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", *REGION))).alias("r"))
        rows = pages.select("file_id", "page").distinct().join(held, ["file_id", "page"], "full")
    packed = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce(F.transform("r", lambda x: x.dropFields("ord")), F.array().cast(_REGIONS)).alias("regions")))).alias("pages"))
    return normalize_status(files).join(packed, "file_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(f"array<struct<page:int,regions:{_REGIONS}>>")))


_REGIONS = "array<struct<id:int,x1:double,y1:double,x2:double,y2:double,label:string,text:string,user_modified:boolean>>"


def write_session(files: DataFrame, regions: DataFrame | None, pages: DataFrame, folder: str) -> None:
    session_rows(files, regions, pages).write.mode("overwrite").parquet(folder)


def read_session(spark: SparkSession, folder: str, blobs: DataFrame, fields: Sequence[str] = REGION) -> DataFrame:
    """Files whose PDF is there, with their pages. Sessions of several versions may lie in one folder: columns that an older
    one lacks are null, also within regions. Of regions only the named fields are read from the files."""
    from foliospark.operators.state import restore_session

    reader = spark.read.option("recursiveFileLookup", "true")
    known = reader.option("mergeSchema", "true").parquet(folder).schema
    region = known["pages"].dataType.elementType["regions"].dataType.elementType
    kept = StructType([f for f in region if f.name in fields])
    pages = ArrayType(StructType().add("page", IntegerType()).add("regions", ArrayType(kept)))
    wanted = StructType([StructField("pages", pages) if f.name == "pages" else f for f in known])
    return restore_session(reader.schema(wanted).parquet(folder), blobs)


def session_regions(session: DataFrame) -> DataFrame:
    """Regions of a session as rows; ord counts from 1."""
    flat = session.select("file_id", F.explode("pages").alias("p")).select("file_id", "p.page", F.posexplode("p.regions").alias("pos", "r"))
    return flat.select("file_id", "page", (F.col("pos") + 1).alias("ord"), "r.*")


def session_table(session: DataFrame, *columns: str) -> DataFrame:
    """Regions of a session as session_regions has them, with columns of their files, in one go over the files; a page without a region
    is a row of its own."""
    pages = session.select("file_id", *columns, F.explode("pages").alias("p")).select("file_id", *columns, "p.page", F.posexplode_outer("p.regions").alias("pos", "r"))
    return pages.select("file_id", *columns, "page", (F.col("pos") + 1).alias("ord"), "r.*")


def session_pages(session: DataFrame) -> DataFrame:
    return session.select("file_id", F.explode("pages.page").alias("page"))


def page_debug(results: DataFrame, names: DataFrame) -> DataFrame:
    """file_base, page, payload (JSON) of extracted regions."""
    size = F.array(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    body = F.to_json(F.struct("ord", F.array("x1", "y1", "x2", "y2").alias("bbox"), size.alias("size"), "original_bbox", "n_hits", "n_columns", "phases", "text"))
    return results.join(names.select("file_id", sanitize_file_name(F.col("name")).alias("file_base")), "file_id").select("file_base", "page", body.alias("payload"))


#: Buckets of page debug, and rows of one file of it.
DEBUG_BUCKETS, DEBUG_ROWS = 32, 50_000


def debug_bucket(base: Column, buckets: int = DEBUG_BUCKETS) -> Column:
    """Bucket of a file's debug rows, by the first 8 hexadecimal digits of its md5."""
    return (F.conv(F.substring(F.md5(base), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def write_page_debug(debug: DataFrame, folder: str, buckets: int = DEBUG_BUCKETS) -> None:
    """Rows of page_debug in a fixed number of buckets by file, in files of bounded size, sorted so that a file's rows lie
    together; the page is a column. A large bucket is dealt over several files by page."""
    rows = debug.withColumn("bucket", debug_bucket(F.col("file_base"), buckets))
    dealt = rows.repartition("bucket", F.col("page") % 8).sortWithinPartitions("bucket", "file_base", "page")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", DEBUG_ROWS).partitionBy("bucket").parquet(folder)


def read_page_debug(spark: SparkSession, folder: str, base: str | None = None, buckets: int = DEBUG_BUCKETS) -> DataFrame:
    """All rows, or those of one file: then only its bucket is read."""
    rows = spark.read.parquet(folder)
    if base is None:
        return rows
    bucket = int(spark.range(1).select(debug_bucket(F.lit(base), buckets)).first()[0])
    return rows.filter((F.col("bucket") == bucket) & (F.col("file_base") == base))


def write_reports(reports: DataFrame, folder: str) -> None:
    """One JSON line per report that can be sent; sending is up to the reader."""
    reports.filter(F.col("error").isNull()).select("type", "name", "provider", "date", "content", "info").write.mode("overwrite").json(folder)
