"""Periodic runs of words: find every stretch that repeats itself four times or more, and fold it to its first period.

Words are what stands between blanks of ASCII (blank, tab to carriage return). A run is a stretch of words with smallest
period q (words q apart are the same), of max(LEAST, TIMES * q) words at least, that no neighbour extends with period q.

Periods are searched by octaves, 2^k to 2^(k+1) - 1. A run of an octave holds several boundaries, the multiples of 2^k; at
two of them in a row the 2^k words from it on return a period later. Where they do, the Z-functions of the words from the boundary on
and back from it tell how far every period reaches: a fragment. So an octave costs about as much as the document is long,
and the sum over octaves a logarithm more.

Documents over LONG_BYTES are exploded into tiles for each octave (the short octaves share theirs). A tile holds the
boundaries of its core and, as margin, 4 * 2^k words before and 6 * 2^k after it, so that fragments of one run from tiles next
to each other overlap by a period or more. Tiles are solved wherever they are dealt to; fragments are shuffled by document
and period, and those that overlap by a period are stitched together. Shorter documents are one tile, whose fragments are
whole, and are solved where they are read. A period that another one divides gives the same stretch, so of
equal stretches the smallest period counts.

A tile is never larger than its document. Null and empty texts have no words and no runs. Rows with equal doc_id and text
give equal rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import keyed, scratch, small_batches
from foliospark.llm.shingles import mix

LEAST, TIMES = 6, 4
LONG_BYTES = 1 << 15
#: Words of a tile's core, for all octaves up to 2^SHARED; a longer octave has cores of 8 times its period at least.
TILE, SHARED = 1 << 12, 9
BEFORE, AFTER = 4, 6
#: Words of short documents that are solved side by side.
TOGETHER = 1 << 17
#: From so many periods on that return at one boundary, the Z algorithm is cheaper than comparing for each.
MANY = 12
RUN = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Codes(dict):
    """word -> a number of its own, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def codes(words: list[bytes], known: Codes | None = None) -> np.ndarray:
    return np.fromiter(map((Codes() if known is None else known).__getitem__, words), np.int32, len(words))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : at + step] != b[at : at + step][: len(a[at : at + step])]
        if differs.any():
            return at + int(differs.argmax())
        at, step = min(n, at + step), 8 * step
    return n


def z_function(s: list[int]) -> list[int]:
    """For each place, how long what begins there agrees with the whole."""
    n = len(s)
    z = [n] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def reaches(w: np.ndarray, m: int, periods: np.ndarray) -> tuple[list[int], list[int]]:
    """For boundary m and each period q, how many words before m and from m on equal the word q later."""
    if len(periods) < MANY:
        left = [common(w[:m][::-1], w[q : m + q][::-1]) for q in periods.tolist()]
        right = [common(w[m : len(w) - q], w[m + q :]) for q in periods.tolist()]
        return left, right
    ends = np.flatnonzero(w < 0)  # no stretch holds the end of a document
    i = int(np.searchsorted(ends, m))
    w, m = (w[: ends[i]] if i < len(ends) else w), m
    if i:
        w, m = w[ends[i - 1] + 1 :], m - int(ends[i - 1]) - 1
    widest = min(int(periods.max()), len(w) - m)
    ahead = z_function(w[m:].tolist())
    # backwards, a word before m at distance d equals the one at m + q - d; a mark that is no word parts the two texts
    back = z_function([*w[:m][::-1].tolist(), -1, *w[: m + widest][::-1].tolist()])
    inside = [q < len(w) - m for q in periods.tolist()]
    return [back[m + 1 + widest - q] if ok else 0 for q, ok in zip(periods.tolist(), inside, strict=True)], [ahead[q] if ok else 0 for q, ok in zip(periods.tolist(), inside, strict=True)]


def fragments(w: np.ndarray, first: int, lo: int, hi: int, octaves: range) -> Iterator[tuple[int, int, int]]:
    """(period, start, stop) of stretches of two periods at least around boundaries from lo to hi, within w, whose first
    word is number `first` of the document. w may hold several documents, with a negative number of its own after each.

    A run holds two boundaries next to each other, m and m + 2^k, of which both return a period later."""
    name = mix(w.astype(np.uint64) + np.uint64(1))  # never 0
    for k in range(octaves.stop):
        size = 1 << k
        if k:
            half = size >> 1
            if len(name) <= half:
                return
            name = mix(name[:-half] * np.uint64(0x9E3779B185EBCA87) ^ name[half:])
        if k < octaves.start:
            continue
        m0 = -(-lo // size) * size - first
        n = (hi - 1) // size - -(-lo // size) + 2
        if n <= 1:
            continue
        have = name[m0 : m0 + (n + 1) * size]
        rows = np.zeros((n + 1) * size, np.uint64)
        rows[: len(have)] = have
        rows = rows.reshape(n + 1, size)
        returns = (rows[1:] == rows[:-1, :1]) & (rows[:-1, :1] != 0)  # 0: behind the end
        at, periods = np.nonzero(returns[:-1] & returns[1:])
        known = np.zeros(size, np.int64)  # where the last stretch of each period ends
        cut = np.flatnonzero(np.diff(at)) + 1
        for r, j in zip(at[np.concatenate([[0], cut])].tolist() if len(at) else (), np.split(periods, cut), strict=False):
            m = m0 + r * size
            j = j[known[j] <= m + size + j]
            if not len(j):
                continue
            for q, left, right in zip((j + size).tolist(), *reaches(w, m, j + size), strict=True):
                start, stop = m - left, m + q + right
                if right:
                    known[q - size] = stop
                if stop - start >= 2 * q:
                    yield q, first + start, first + stop


def runs_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of whole stretches: long enough, each with its smallest period."""
    least: dict[tuple[int, int], int] = {}
    for q, start, stop in found:
        if stop - start >= max(LEAST, TIMES * q):
            least[start, stop] = min(q, least.get((start, stop), q))
    return sorted((a, z - a, q) for (a, z), q in least.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a blank, without those that a run holds behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone).tolist()])


def _result(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, runs, kept = zip(*rows, strict=True) if rows else ([], [], [])
    as_rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(as_rows, _RUN), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "runs", "kept"])


def solve(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several documents, laid side by side."""
    known = Codes()
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    w = np.empty(int((lengths + 1).sum()), np.int32)
    for k, (a, t) in enumerate(zip(starts.tolist(), texts, strict=True)):
        w[a : a + len(t)] = codes(t, known)
        w[a + len(t)] = -2 - k
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for q, start, stop in fragments(w, 0, 0, len(w), range((int(lengths.max()) // TIMES).bit_length())):
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((q, start - int(starts[k]), stop - int(starts[k])))
    return [runs_of(own) for own in found]


def _solve_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, texts = [], [t.encode().split() for t in b.column("text").to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        with np.errstate(over="ignore"):
            for part in np.split(np.arange(len(texts)), np.searchsorted(ends, np.arange(TOGETHER, int(ends[-1]) if len(ends) else 0, TOGETHER))):
                own = [texts[i] for i in part]
                rows += [(len(t), runs, collapsed(t, runs)) for t, runs in zip(own, solve(own) if own else (), strict=True)]
        yield _result(b.column("doc_id"), rows)


def tiles(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first octave, stop octave, lo, hi, first word, stop word) of all tiles of a document of n words."""
    if not (last := (n // TIMES).bit_length()):
        return
    for k0, k1 in [(0, min(SHARED + 1, last)), *((k, k + 1) for k in range(SHARED + 1, last))]:
        size = 1 << (k1 - 1)
        core = max(TILE, 8 * size)
        for lo in range(0, n, core):
            hi = min(n, lo + core)
            yield k0, k1, lo, hi, max(0, lo - BEFORE * size), min(n, hi + AFTER * size)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"k0": pa.int32(), "k1": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "first": pa.int64(), "words": pa.binary()}
    for b in batches:
        for i, text in enumerate(b.column("text").to_pylist()):
            w = codes(text.encode().split())
            rows = [(k0, k1, lo, hi, a, w[a:z].tobytes()) for k0, k1, lo, hi, a, z in tiles(len(w))]
            for part in (rows[j : j + 64] for j in range(0, len(rows), 64)):
                key = [b.column(c).take(pa.array([i] * len(part))) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds.values(), strict=True))], names=["doc_id", "text_hash", *kinds])


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, rows = [], []
        with np.errstate(over="ignore"):
            for i, t in enumerate(b.drop_columns(["doc_id", "text_hash"]).to_pylist()):
                own = list(fragments(np.frombuffer(t["words"], np.int32), t["first"], t["lo"], t["hi"], range(t["k0"], t["k1"])))
                rows += own
                at += [i] * len(own)
        if rows:
            key = [b.column(c).take(pa.array(at)) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*key, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "text_hash", "period", "start", "stop"])


def stitch(found: DataFrame) -> DataFrame:
    """Fragments (doc_id, text_hash, period, start, stop) to doc_id, text_hash, runs: one row per document with any."""
    key = ["doc_id", "text_hash"]
    order = Window.partitionBy(*key, "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", F.coalesce((reach - F.col("start") < F.col("period")).cast("int"), F.lit(1)))
    whole = parted.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.groupBy(*key, "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start")
    long = whole.filter(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    runs = long.groupBy(*key, "start", "stop").agg(F.min("period").alias("period"))
    return runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", length.alias("length"), "period"))).alias("runs"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            words, own = text.encode().split(), [(r["start"], r["length"], r["period"]) for r in runs or ()]
            rows.append((len(words), own, collapsed(words, own)))
        yield _result(b.column("doc_id"), rows)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept (the text with its runs folded, words
    joined by one blank): one row for each row of docs."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs {RUN}, kept string"
    short = rows.filter(F.octet_length("text") <= LONG_BYTES).select("doc_id", "text").mapInArrow(_solve_documents, schema)
    large = rows.filter(F.octet_length("text") > LONG_BYTES)
    tiled = large.mapInArrow(_explode, f"doc_id {kind}, text_hash long, k0 int, k1 int, lo long, hi long, first long, words binary")
    dealt = tiled.repartition("doc_id", "text_hash", "k0", "lo")
    found = dealt.mapInArrow(_solve_tiles, f"doc_id {kind}, text_hash long, period long, start long, stop long")
    runs = scratch(stitch(found), "runs").withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    joined = large.join(runs, large["doc_id"].eqNullSafe(runs["id_"]) & (large["text_hash"] == runs["hash_"]), "left")
    return short.unionByName(joined.select("doc_id", "text", "runs").mapInArrow(_fold, schema))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op11 from the result of periodic_runs."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    b = found.withColumn("best", best)
    return b.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.back")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.back) div best.period").alias("exponent_milli"), sha(text).alias("runs_sha256"), sha(F.col("kept")).alias("collapsed_sha256"),
    )
