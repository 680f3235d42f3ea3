"""Repeated strings: find and remove bytes covered by a LENGTH-byte string that starts anywhere else.

A full suffix array of the corpus would move every position of every text several times. This job ranks prefixes by
doubling too, but drops what is unique as early as it can:

* Inside a task, names of 2, 4, ... 128 bytes are made for all positions of a text, each from the pair of names at a
  position and at an offset of half the length. A string of LENGTH bytes has the pair of two overlapping names.
* Each window of LENGTH bytes picks the smallest of its GRAM-byte names, the leftmost of equals; the choice depends on
  its bytes alone, so equal windows pick the same place. Windows next to each other mostly pick the same position: they
  make one run, which is cut once more where the place is HALF bytes into the window. All windows of a run
  share a core of at least 115 bytes around the place that they picked.
* Round 1: Spark counts the names of cores; runs with a unique core are done, as none of their windows can
  repeat. Round 2: the runs that are left are ranked by the name of their whole context (the bytes of all their
  windows): runs with equal contexts repeat as a whole, and one stands for all. Round 3, past the threshold: where a
  core has different contexts, their windows of LENGTH bytes are named and counted.

Every round counts before it joins; a text or line that stands in a third of the documents is one context with a
large count. In round 3 the contexts of a core meet in one task; of cores with more than HOT_CORE contexts the windows are
dealt out one by one, counted before they are shuffled, and joined. Nothing is collected but bit tables of fixed size.
Names are of 64 bits; contexts are compared only where cores are equal, and windows only where cores are.

Null and empty texts, and those shorter than LENGTH bytes, keep everything. Rows with equal doc_id and text repeat
each other as any two documents would. Columns other than doc_id and text are not read by the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import keyed, scratch, small_batches
from foliospark.llm.shingles import mix

LENGTH = 200
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Runs are cut where the place that their windows picked is this far into the window.
HALF = 85
#: A core with more contexts is dealt out over tasks.
HOT_CORE = 2000
#: Window starts that are looked at together; longer texts are taken in parts.
PART = 1 << 18
#: Bits of the table that tells most documents without candidates from the others.
TABLE_BITS = 1 << 23
_A, _B = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def names(data: np.ndarray) -> dict[int, np.ndarray]:
    """Names of all strings of 32, 64 and 128 bytes, by doubling."""
    out = {}
    name, size = mix(data.astype(np.uint64) + _B), 1
    while size < 128 and len(name) > size:
        pair = name[:-size] * _A
        pair ^= name[size:]
        name, size = mix(pair), 2 * size
        out[size] = name
    return out


def picked(grams: np.ndarray, width: int = GRAMS) -> np.ndarray:
    """For each window of `width` grams the position of its smallest, the leftmost of equals."""
    # the name's upper bits, then the place: smaller means smaller name, then further left
    least = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64)


def runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, number of windows, core name, context name) of all runs, a part of the text at a time."""
    for first in range(0, len(data) - LENGTH + 1, PART):
        part = data[first : first + PART + LENGTH - 1]
        n = names(part)
        place = picked(n[GRAM])
        into = place - np.arange(len(place))
        right = into < HALF
        cut = np.flatnonzero((np.diff(place) != 0) | (right[1:] != right[:-1])) + 1
        start = np.concatenate([[0], cut])
        stop = np.concatenate([cut, [len(place)]])
        at, right = place[start], right[start]
        # all windows that pick a place less than HALF into them hold the LENGTH - HALF + 1 bytes from it on; the
        # others hold those from HALF before it to its gram's end
        width = LENGTH - HALF + 1
        ahead = n[64][at[right]] * _A ^ n[64][at[right] + width - 64]
        back = n[64][at[~right] - HALF] * _B ^ n[64][at[~right] + GRAM - 64]
        core = np.empty(len(at), np.uint64)
        core[right], core[~right] = mix(ahead), mix(back)
        size = stop - start - 1 + LENGTH  # bytes of the context, less than 2 * LENGTH
        last = start + size - 128
        context = mix(n[128][start] * _A ^ n[128][np.minimum(start + 128, last)])
        context = mix(context * _B ^ n[128][last])
        context = mix(context * _A ^ (size.astype(np.uint64) << np.uint64(20)) ^ (at - start).astype(np.uint64))
        yield start + first, stop - start, core, context


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"start": np.int32, "n": np.int32, "core": np.int64, "context": np.int64}
    for b in batches:
        rows, parts = [], []
        with np.errstate(over="ignore"):
            for i, text in enumerate(b.column("text").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                for part in runs(data):
                    parts.append(part)
                    rows.append(np.full(len(part[0]), i))
                if sum(map(len, rows)) > 100_000 or (rows and i == b.num_rows - 1):
                    take = pa.array(np.concatenate(rows))
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    columns = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(k) for c, k in zip(columns, kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_hash").take(take), *map(pa.array, columns)], names=["doc_id", "text_hash", *kinds])
                    rows, parts = [], []


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names_ = ("core", "context", "copies", "n", "hot", "bytes")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    for b in batches:
        for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
            data = text.encode()
            rows = [(x["core"], x["context"], x["copies"], x["n"], x["hot"], data[x["start"] : x["start"] + x["n"] - 1 + LENGTH]) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names_)


def _windows(contexts: DataFrame) -> DataFrame:
    each = contexts.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("core", "context", "copies", "at", F.expr(f"xxhash64(substring(bytes, at + 1, {LENGTH}))").alias("window"))


def only_likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key (a 64-bit hash) may be among keys': a bit table of fixed size (1 MB) stands for these. Rows that it
    lets through by chance cost time only; a join decides afterwards."""
    bit = F.pmod(key, F.lit(TABLE_BITS))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {TABLE_BITS}) % 64 as int))").alias("bits"))
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        table[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.mod(b.column(key).to_numpy(), TABLE_BITS)
            hit = (sent.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    return rows.mapInArrow(keep, rows.schema)


def _key_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """b has id_ and hash_."""
    return a.join(b, a["doc_id"].eqNullSafe(b["id_"]) & (a["text_hash"] == b["hash_"]), how)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (start, stop of windows next to each other that repeat), one row per document with any."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, start int, n int, core long, context long"
    every = scratch(keyed(docs).filter(F.octet_length("text") >= LENGTH).mapInArrow(_runs, schema), "runs")
    # round 1: cores
    cores = scratch(every.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"), "cores")
    left = scratch(only_likely(every, cores, "core").join(cores, "core"), "left")
    # round 2: contexts; the first run of each stands for all
    one = F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("one")
    contexts = scratch(left.groupBy("core", "context").agg(F.count(F.lit(1)).alias("copies"), one), "contexts")
    # a core all of whose runs have one context is settled, as every window of it repeats with the context; others are open
    several = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core", (F.col("c") > HOT_CORE).alias("hot"))
    asked = contexts.join(several, "core")
    held = asked.select(F.col("one.doc_id").alias("id_"), F.col("one.text_hash").alias("hash_"), F.struct("core", "context", "copies", "one.start", "one.n", "hot").alias("x"))
    held = scratch(held.groupBy("id_", "hash_").agg(F.collect_list("x").alias("found")), "held")
    text = only_likely(keyed(docs), held.select(F.col("hash_").alias("text_hash")), "text_hash")
    # equal rows have equal contexts; one of them is asked
    asked_text = _key_join(text, held).select("id_", "hash_", "text", "found").dropDuplicates(["id_", "hash_"])
    held_bytes = asked_text.select("text", "found").mapInArrow(_contexts, "core long, context long, copies long, n int, hot boolean, bytes binary")
    held_bytes = scratch(held_bytes, "context-bytes")
    # round 3: windows
    together = _windows(held_bytes.filter("not hot").repartition("core"))
    total = F.sum("copies").over(Window.partitionBy("core", "window"))
    again = together.withColumn("c", total).filter("c > 1 and copies = 1").groupBy("core", "context").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    apart = _windows(held_bytes.filter("hot"))
    counted = scratch(apart.groupBy("core", "window").agg(F.sum("copies").alias("c")).filter("c > 1").select("core", "window"), "hot-windows")
    also = apart.filter("copies = 1").join(counted, ["core", "window"]).groupBy("core", "context").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    single = again.unionByName(also)
    many = contexts.filter("copies > 1").select("core", "context", F.expr("cast(null as array<int>)").alias("ats"))
    repeated = scratch(single.select("core", "context", "ats").unionByName(many), "repeated")
    hit = left.join(repeated, ["core", "context"])
    offsets = F.coalesce("ats", F.sequence(F.lit(0), F.col("n") - 1))
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop")))
    each = F.transform(offsets, lambda k: F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + LENGTH).alias("stop")))
    spans = hit.select("doc_id", "text_hash", F.when(F.col("ats").isNull(), whole).otherwise(each).alias("s"))
    return scratch(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, runs_, sha, kept_all = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            own = merged(spans)
            kept = cut(text.encode(), own)
            removed.append(sum(z - a for a, z in own))
            runs_.append(len(own))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_all.append(kept)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_all, pa.binary())],
            names=["doc_id", "text_hash", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_removed, n_spans, kept_sha256, kept (bytes): the documents that lose any, once for each
    doc_id and text."""
    spans = repeated_windows(docs)
    text = only_likely(keyed(docs), spans.select("text_hash"), "text_hash")
    keys = spans.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "spans")
    joined = _key_join(text, keys).select("doc_id", "text_hash", "text", "spans").dropDuplicates(["doc_id", "text_hash"])
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(_cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op10: every row of docs. Texts are not shuffled for those that keep everything."""
    lost = scratch(remove_repeats(docs).drop("kept"), "lost").withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    slim = keyed(docs).select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"))
    out = _key_join(slim, lost, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
