"""Brokers of file names by joins with a broker dimension, as a settings file gives it.

skip: pos, broker, skip (brokers in the order in which they are tried). aliases: alias (lower-cased), canonical. Segments of
names are made distinct before they are matched, as few differ; every match is an equi join: what a segment may hold or be held
by is spelled out as substrings of the lengths that brokers have. Spark broadcasts the dimension while it is small by its size,
and shuffles it otherwise, so it may grow. The driver gets the distinct lengths of names alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import metadata as M

#: Which match counts first.
ALIAS, LETTERS, LETTERS_KNOWN, EXACT, CONTAINS = range(5)


def _lengths(names: DataFrame, name: str) -> list[int]:
    return sorted(r.n for r in names.select(F.length(name).alias("n")).distinct().filter("n > 0").collect())


def _substrings(text: Column, lengths: list[int]) -> Column:
    """All substrings of text that have one of the lengths, each once."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(*[at(n) for n in lengths])) if lengths else F.expr("cast(array() as array<string>)")


def match_segments(segments: DataFrame, skip: DataFrame, aliases: DataFrame) -> DataFrame:
    """segments (segment, distinct) to segment, hit: alias, letters before a date, known name, then the first known name that the
    segment holds or is held by; of the latter the segment itself is the hit."""
    known = skip.select("pos", "broker").filter(F.col("broker") != "")
    row = lambda df, rank, pos, hit: df.select("segment", F.lit(rank).alias("rank"), pos.cast("int").alias("pos"), hit.alias("hit"))
    zero = F.lit(0)
    own = segments.withColumn("low", F.lower("segment"))
    letters = segments.withColumn("letters", M.letters_before_date(F.col("segment"))).filter("letters is not null")
    inside = segments.select("segment", F.explode(_substrings(F.col("segment"), _lengths(known, "broker"))).alias("part"))
    longest = max(_lengths(known, "broker"), default=0)
    around = known.select("pos", F.explode(_substrings(F.col("broker"), list(range(1, longest + 1)))).alias("segment"))
    found = [
        row(own.join(aliases, own["low"] == aliases["alias"]), ALIAS, zero, F.col("canonical")),
        row(letters.join(aliases, F.lower("letters") == F.col("alias")), LETTERS, zero, F.col("canonical")),
        row(letters.join(known, F.upper("letters") == F.col("broker")), LETTERS_KNOWN, F.col("pos"), F.col("broker")),
        row(segments.join(known, F.col("segment") == F.col("broker")), EXACT, F.col("pos"), F.col("broker")),
        row(inside.join(known, F.col("part") == F.col("broker")), CONTAINS, F.col("pos"), F.col("broker")),
        row(segments.join(around, "segment"), CONTAINS, F.col("pos"), F.col("segment")),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("segment").agg(F.min_by("hit", F.struct("rank", "pos")).alias("hit"))


def match_prefixes(stems: DataFrame, skip: DataFrame, aliases: DataFrame) -> DataFrame:
    """stems (file_id, stem) to file_id, hit: the longest known name or alias that starts the stem, six digits behind it."""
    names = skip.select(F.col("broker").alias("prefix"), F.col("broker").alias("hit"), F.lit(0).alias("kind")).unionByName(aliases.select(F.col("alias").alias("prefix"), F.col("canonical").alias("hit"), F.lit(1).alias("kind")))
    t = F.col("stem")
    dated = [F.when(F.substring(t, n + 1, 6).rlike("^[0-9]{6}$"), F.substring(t, 1, n)) for n in _lengths(names, "prefix")]
    tried = stems.select("file_id", F.explode(F.array(*dated)).alias("prefix")).filter("prefix is not null")
    return tried.join(names, "prefix").groupBy("file_id").agg(F.min_by("hit", F.struct(-F.length("prefix"), F.col("kind"))).alias("prefix_hit"))


def ingest_files(names: DataFrame, skip: DataFrame, aliases: DataFrame, status: str = "queued") -> DataFrame:
    """state.ingest_files with the broker dimension as tables; file_id is unique."""
    pdf = names.filter(F.col("mime") == "application/pdf").select("file_id", "name", "num_pages", M.parse_date(F.col("name")).alias("date"), M.segments(F.col("name")).alias("cut"))
    rows = pdf.select("file_id", "name", "num_pages", "date", F.col("cut.mark").alias("mark"), F.col("cut.parts").alias("parts"))
    number = M.bound(M.filename_tokens(F.col("name")), lambda t: M.code_number(t, F.substring("date", 1, 4).cast("int")))
    # the first segment, in the order of search, that is matched
    each = rows.filter("mark is not null").select("file_id", F.posexplode(M.search_order(F.col("parts"))).alias("k", "segment")).filter("segment is not null")
    hits = each.join(match_segments(each.select("segment").distinct(), skip, aliases), "segment").groupBy("file_id").agg(F.min_by("hit", "k").alias("matched"))
    prefixes = match_prefixes(rows.filter("mark is null").select("file_id", M.stem(F.col("name")).alias("stem")), skip, aliases)
    # the first word that is no alias
    words = rows.select("file_id", F.posexplode(M.code_words(F.col("name"))).alias("k", "word"))
    word = words.join(aliases, F.lower("word") == F.col("alias"), "left_anti").groupBy("file_id").agg(F.min_by(F.upper("word"), "k").alias("word"))
    out = rows.join(hits, "file_id", "left").join(prefixes, "file_id", "left").join(word, "file_id", "left")
    named = F.when(M.is_annual(F.col("mark"), F.col("parts")), M.ANNUAL).otherwise(F.coalesce("matched", M.broker_by_place(F.col("mark"), F.col("parts"))))
    raw = F.when(F.col("mark").isNull(), F.col("prefix_hit")).otherwise(named)
    out = out.select("file_id", "name", F.lit(status).alias("status"), "num_pages", F.col("date").alias("selected_date"), F.coalesce(number, "word").alias("selected_code"), raw.alias("report"))
    kept = aliases.select(F.col("alias").alias("alias_"), "canonical")
    t = F.nullif(F.trim("report"), F.lit(""))
    out = out.join(kept, F.lower(t) == F.col("alias_"), "left")
    return out.select("file_id", "name", "status", "num_pages", "selected_date", "selected_code", F.coalesce("canonical", t).alias("selected_broker"), "report")
