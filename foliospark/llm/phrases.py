"""Repeated phrases: remove words covered by a window of LENGTH words that also starts anywhere else.

Words are what stands between blanks of ASCII (blank, tab to carriage return), unchanged.

Confirm. Each window picks the smallest of its GRAM-word names, the leftmost of equals; as the choice depends on its words
alone, equal windows pick the same place. Windows next to each other that pick one place, on the same side of HALF, share a
core of CORE words; the words of all of them are a context (48 at most). Spark counts cores, and what has a core of its own is
done. Of the rest it counts contexts: one that is there twice recurs as a whole. Where a core has several contexts, their
windows are counted; those that two contexts have are recurring passages. Windows next to each other that the very same
contexts have make one phrase, so an occurrence of any of them is one of the phrase.

Locate. Phrases are compiled into Aho-Corasick automata over words, one for each shard of cores and of PHRASES phrases at
most, and every context of the shard's cores runs through it; a hit gives the windows that recur there. Contexts stand for all
documents that hold them, so equal parts of documents are searched once and joined back. Cores with more than HOT_CORE contexts
are dealt out over shards, each of which gets the core's phrases.

Null and empty texts, and those shorter than LENGTH words, keep all their words. Rows with equal doc_id and text repeat each
other as any two documents would. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import keyed, scratch, small_batches
from foliospark.llm.repeats import merged, only_likely, picked
from foliospark.llm.shingles import WordHashes, mix

LENGTH, GRAM = 35, 8
GRAMS = LENGTH - GRAM + 1
HALF = 14
CORE = LENGTH - HALF + 1
HOT_CORE = 2000
PHRASES, CONTEXTS = 10_000, 40_000
#: Window starts that are looked at together; longer texts are taken in parts.
PART = 1 << 18
_A, _B = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_hashes = WordHashes()
BLANKS = "[\\x20\\x09-\\x0D]+"


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def names(h: np.ndarray) -> dict[int, np.ndarray]:
    """Names of all stretches of 8, 16 and 32 words, by doubling."""
    out = {}
    name, size = mix(h + _B), 1
    while size < 32:
        name, size = mix(name[:-size] * _A ^ name[size:]), 2 * size
        out[size] = name
    return out


def groups(h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, number of windows, core, context) of all groups of windows, a part of the text at a time."""
    for first in range(0, len(h) - LENGTH + 1, PART):
        n = names(h[first : first + PART + LENGTH - 1])
        place = picked(n[GRAM], GRAMS)
        ahead = place - np.arange(len(place)) < HALF
        cut = np.flatnonzero((np.diff(place) != 0) | (ahead[1:] != ahead[:-1])) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
        at, right = place[start], ahead[start]
        # windows that pick a place less than HALF into them hold the CORE words from it on; the others those that end with its gram
        begin = np.where(right, at, at - HALF)
        core = mix(n[16][begin] * np.where(right, _A, _B) ^ n[16][begin + CORE - 16])
        size = stop - start - 1 + LENGTH
        context = mix(n[32][start] * _A ^ n[32][start + size - 32])
        context = mix(context * _B ^ (size.astype(np.uint64) << np.uint64(20)) ^ (at - start).astype(np.uint64))
        yield start + first, stop - start, core, context


def window_names(words: list[bytes]) -> np.ndarray:
    n = names(hashed(words))[32]
    return mix(n[: len(words) - LENGTH + 1] * _A ^ n[LENGTH - 32 :])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"start": np.int32, "n": np.int32, "core": np.int64, "context": np.int64}

    def packed(b: pa.RecordBatch, rows: list, parts: list) -> pa.RecordBatch:
        take = pa.array(np.concatenate(rows))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        columns = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(k) for c, k in zip(columns, kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_hash").take(take), *map(pa.array, columns)], names=["doc_id", "text_hash", *kinds])

    for b in batches:
        rows, parts, size = [], [], 0
        with np.errstate(over="ignore"):
            for i, text in enumerate(b.column("text").to_pylist()):
                for part in groups(hashed(text.encode().split())):
                    parts.append(part)
                    rows.append(np.full(len(part[0]), i))
                    size += len(part[0])
                if size > 100_000:
                    yield packed(b, rows, parts)
                    rows, parts, size = [], [], 0
        if rows:
            yield packed(b, rows, parts)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"core": pa.int64(), "context": pa.int64(), "copies": pa.int64(), "words": pa.string(), "windows": pa.list_(pa.int64())}
    for b in batches:
        for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
            words, rows = text.encode().split(), []
            with np.errstate(over="ignore"):
                for x in found:
                    own = words[x["start"] : x["start"] + x["n"] - 1 + LENGTH]
                    rows.append((x["core"], x["context"], x["copies"], b" ".join(own).decode(), window_names(own).view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def stretches(ats: list[dict]) -> list[tuple[int, int]]:
    """(first window, last window) of windows next to each other that the same contexts hold."""
    out: list[tuple[int, int]] = []
    last = None
    for x in sorted(ats, key=lambda x: x["at"]):
        if last and x["at"] == last["at"] + 1 and (x["held"], x["mark"]) == (last["held"], last["mark"]):
            out[-1] = (out[-1][0], x["at"])
        else:
            out.append((x["at"], x["at"]))
        last = x
    return out


def automaton(phrases: list[list[str]], letters: dict[str, str]) -> ahocorasick.Automaton:
    """Over words, of which each is one letter of the shard's own alphabet; a phrase gives its length."""
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        a.add_word("".join([letters.setdefault(w, chr(len(letters) + (1 if len(letters) < 0xD000 else 0x1000))) for w in p]))
    a.make_automaton()
    return a


def locate(known: pa.Table, contexts: pa.Table) -> pa.Table:
    """Windows of contexts that are in a phrase of the shard: core, context, ats."""
    phrases: list[list[str]] = []
    for words, ats in zip(known.column("phrase").to_pylist(), known.column("ats").to_pylist(), strict=True):
        w = words.split(" ")
        phrases += [w[a : z + LENGTH] for a, z in stretches(ats)]
    texts = [t.split(" ") for t in contexts.column("words").to_pylist()]
    hit: list[set[int]] = [set() for _ in texts]
    for first in range(0, len(phrases), PHRASES):
        letters: dict[str, str] = {}
        a = automaton(phrases[first : first + PHRASES], letters)
        for found, words in zip(hit, texts, strict=True):
            for end, size in a.iter("".join([letters.get(w, "\0") for w in words])):
                found.update(range(end - size + 1, end - LENGTH + 2))
    at = [i for i, found in enumerate(hit) if found]
    rows = contexts.select(["core", "context"]).take(pa.array(at, pa.int64()))
    return rows.append_column("ats", pa.array([sorted(hit[i]) for i in at], pa.list_(pa.int32())))


def _of_rows(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """b has id_ and hash_."""
    return a.join(b, a["doc_id"].eqNullSafe(b["id_"]) & (a["text_hash"] == b["hash_"]), how)


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (start, stop of words in windows that recur), one row per document with any."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, start int, n int, core long, context long"
    long = keyed(docs).filter(F.octet_length("text") >= 2 * LENGTH - 1)
    every = scratch(long.mapInArrow(_groups, schema), "groups")
    cores = scratch(every.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"), "cores")
    left = scratch(only_likely(every, cores, "core").join(cores, "core"), "left")
    one = F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("one")
    contexts = scratch(left.groupBy("core", "context").agg(F.count(F.lit(1)).alias("copies"), one), "contexts")
    # words of the contexts of cores that have several
    open_cores = scratch(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "open-cores")
    asked = contexts.join(open_cores, "core")
    asked = asked.select(F.col("one.doc_id").alias("id_"), F.col("one.text_hash").alias("hash_"), F.struct("core", "context", "copies", "one.start", "one.n").alias("x"))
    asked = scratch(asked.groupBy("id_", "hash_").agg(F.collect_list("x").alias("found")), "asked")
    text = only_likely(keyed(docs), asked.select(F.col("hash_").alias("text_hash")), "text_hash")
    texts = _of_rows(text, asked).select("id_", "hash_", "text", "found").dropDuplicates(["id_", "hash_"])
    held = scratch(texts.select("text", "found").mapInArrow(_contexts, "core long, context long, copies long, words string, windows array<long>"), "context-words")
    # passages that two contexts have, told where they stand in the smallest of these
    windows = held.select("core", "context", F.posexplode("windows").alias("at", "window"))
    counted = windows.groupBy("core", "window").agg(F.count(F.lit(1)).alias("held"), F.bit_xor("context").alias("mark"), F.min(F.struct("context", "at")).alias("first"))
    known = counted.filter("held > 1").groupBy("core", F.col("first.context").alias("context")).agg(F.collect_list(F.struct("first.at", "held", "mark")).alias("ats"))
    known = scratch(known, "passages")
    phrases = held.select("core", "context", F.col("words").alias("phrase")).join(known, ["core", "context"])
    # shards: whole cores together, hot ones dealt out
    searched = held.select("core", "context", "words").join(known.select("core").distinct(), "core", "left_semi")
    sizes = open_cores.select("core", F.ceil(F.col("m") / HOT_CORE).cast("int").alias("deals"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // PHRASES), -(-held.count() // CONTEXTS))
    shard = lambda salt: F.when(F.col("deals") > 1, F.xxhash64("core", salt)).otherwise(F.pmod("core", F.lit(shards))).alias("shard")
    phrases = phrases.join(sizes, "core").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select(shard(F.col("salt")).alias("shard_"), F.col("phrase"), "ats")
    searched = searched.join(sizes, "core").select(shard(F.pmod("context", F.col("deals")).cast("int")), "core", "context", "words")
    located = phrases.groupBy("shard_").cogroup(searched.groupBy("shard")).applyInArrow(locate, "core long, context long, ats array<int>")
    many = contexts.filter("copies > 1").select("core", "context", F.expr("cast(null as array<int>)").alias("ats"))
    hits = scratch(located.join(many.select("core", "context"), ["core", "context"], "left_anti").unionByName(many), "located")
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop")))
    each = F.transform("ats", lambda k: F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + LENGTH).alias("stop")))
    spans = left.join(hits, ["core", "context"]).select("doc_id", "text_hash", F.when(F.col("ats").isNull(), whole).otherwise(each).alias("s"))
    return scratch(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, kept = [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words, own = text.encode().split(), merged(spans)
            edges = [0, *(x for s in own for x in s), len(words)]
            removed.append(sum(z - a for a, z in own))
            kept.append(b" ".join([w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]]))
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = [pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([k.decode() for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *columns], names=["doc_id", "text_hash", "n_removed", "kept_sha256", "kept"])


def remove_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_removed, kept_sha256, kept (words joined by one blank): the documents that lose any word, once for
    each doc_id and text."""
    spans = recurring(docs)
    text = only_likely(keyed(docs), spans.select("text_hash"), "text_hash")
    keys = spans.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "spans")
    joined = _of_rows(text, keys).select("doc_id", "text_hash", "text", "spans").dropDuplicates(["doc_id", "text_hash"])
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_removed long, kept_sha256 string, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op13: every row of docs. Texts are not shuffled for those that keep everything."""
    lost = scratch(remove_phrases(docs).drop("kept"), "lost").withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    words = F.array_remove(F.split("text", BLANKS), "")
    slim = keyed(docs).select("doc_id", "text_hash", F.size(words).cast("long").alias("n_words"), F.sha2(F.encode(F.array_join(words, " "), "UTF-8"), 256).alias("whole"))
    out = _of_rows(slim, lost, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
