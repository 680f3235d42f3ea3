"""Benchmark decontamination: pairs of words propose passages, Smith-Waterman scores them.

Words are runs of letters and digits, lower-cased. A passage is aligned with the item word by word (match 2, mismatch
and gap -1). The score is the best local alignment over that of the whole item; from THRESHOLD on it is a leak.

An alignment that reaches THRESHOLD, with an item of L words, has M matches and at most 2M - L errors, so its span is
at most 2L words. Of the M - 1 steps from a match to the next at most half as many as there are errors hold two or
more, so ceil(L / 2) - 1 steps at least hold none or one: their two words are neighbours or have one word between
them, in the item and in the text alike. These pairs are the seeds. Where a text has so many hits of an item's seeds
within 2L words, the words that such an alignment can take up are a passage; overlapping ones are joined. So no leak is
left out, whatever its edits. Every passage is aligned, however many documents hold it; equal ones that meet in a task
are aligned once.

Seeds are sent to the tasks in blocks of at most BLOCK_SEEDS (or one item), one pass over the documents for each block, however
many items there are. Null and empty texts have no passages. A few words in common cannot be
told from chance, so an alignment must also score as much as LEAST matching words, or be the whole item where that is shorter (a
single word is its own seed). Repeated documents are scored alike; repeated items (equal id and text) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import free_names, keyed, scratch, small_batches
from foliospark.llm.shingles import hash_words, mix, words_of

LEAST = 8
THRESHOLD = 0.5
MARGIN = 6
BLOCK_SEEDS = 1_000_000


def links(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all pairs of words that are neighbours or have one word between them; both kinds are alike."""
    with np.errstate(over="ignore"):
        pairs = [mix(h[:-d] * np.uint64(0x9E3779B185EBCA87) + h[d:]) for d in (1, 2)]
    return np.concatenate(pairs), np.concatenate([np.arange(len(x)) for x in pairs])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [words_of(t) for t in b.column("text").to_pylist()]
        seeds, places = [], []
        for w in words:
            h = hash_words(w)
            hashes, at = links(h) if len(w) > 1 else (h, np.arange(len(w)))
            seeds.append(hashes.view(np.int64).tolist())
            places.append(at.tolist())
        columns = [b.column("item_id"), pa.array([" ".join(w) for w in words], pa.string()), pa.array(list(map(len, words)), pa.int32()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n_words", "seeds", "places"])


class SeedTable:
    """Seeds of a block: where each stands in which items. The bits tell most pairs apart without a search."""

    BITS = 1 << 22

    def __init__(self, rows: list):
        h = np.array([s for r in rows for s in r["seeds"]], np.int64).view(np.uint64)
        item = np.repeat(np.arange(len(rows)), [len(r["seeds"]) for r in rows])
        place = np.array([x for r in rows for x in r["places"]], np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.length = np.array([r["n_words"] for r in rows], np.int64)
        self.need = np.maximum(1, (self.length + 1) // 2 - 1)
        self.singles = bool((self.length == 1).any())
        self.ids = [r["item_id"] for r in rows]
        self.bits = np.zeros(self.BITS, bool)
        self.bits[(h % np.uint64(self.BITS)).astype(np.int64)] = True

    def passages(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, stop) for the word hashes of one document."""
        g, p = links(h)
        if self.singles:
            g, p = np.concatenate([g, h]), np.concatenate([p, np.arange(len(h))])
        maybe = self.bits[(g & np.uint64(self.BITS - 1)).astype(np.int64)]
        g, p = g[maybe], p[maybe]
        if not len(g):
            return []
        lo = np.searchsorted(self.h, g, "left")
        n = np.searchsorted(self.h, g, "right") - lo
        lo, n, p = lo[n > 0], n[n > 0], p[n > 0]
        if not len(n):
            return []
        k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place, p = self.item[k], self.place[k], np.repeat(p, n)
        enough = np.bincount(item, minlength=len(self.ids))[item] >= self.need[item]
        if not enough.any():
            return []
        item, place, p = item[enough], place[enough], p[enough]
        order = np.lexsort((p, item))
        item, place, p = item[order], place[order], p[order]
        at = np.arange(len(p))
        last = at + self.need[item] - 1
        inside = last < len(p)
        last = np.minimum(last, len(p) - 1)
        good = inside & (item[last] == item) & (p[last] - p <= 2 * self.length[item])
        item, place, p = item[good], place[good], p[good]
        size = self.length[item]
        first = np.maximum(0, p - np.minimum(place + size, 2 * size))
        stop = np.minimum(len(h), p + np.minimum(2 * size - place, 2 * size) + 1)
        out: list[tuple[int, int, int]] = []
        for i, a, z in sorted(zip(item.tolist(), first.tolist(), stop.tolist(), strict=True)):
            if out and out[-1][0] == i and a <= out[-1][2]:
                out[-1] = (i, out[-1][1], max(z, out[-1][2]))
            else:
                out.append((i, a, z))
        return out


def _finder(sent):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            rows = []
            for doc_id, text, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "text_hash")), strict=True):
                words = words_of(text)
                rows += [(doc_id, h, t.ids[i], a, " ".join(words[a:z])) for i, a, z in t.passages(hash_words(words))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text_hash", "item_id", "first_word", "passage"])

    return find


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of many pairs at once, and where in the passage each ends."""
    return align_ends(items, passages)[:2]


def align_ends(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores, and the stops of the alignments in passage and item."""
    rows, width = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), rows), np.int64)
    b = np.full((len(items), width), -1, np.int64)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)] = x
        b[k, : len(y)] = y
    h = np.zeros((len(items), width + 1), np.int32)
    best, end, last = (np.zeros(len(items), np.int32) for _ in range(3))
    drift = np.arange(width + 1, dtype=np.int32)
    length = np.array([len(x) for x in items])
    for i in range(rows):
        step = np.where(b == a[:, i : i + 1], 2, -1).astype(np.int32)
        now = np.zeros_like(h)
        now[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + step, h[:, 1:] - 1))
        now = np.maximum.accumulate(now + drift, axis=1) - drift  # gaps along the passage
        h = np.where((i < length)[:, None], now, h)
        top = h.max(1)
        at = h.argmax(1)
        end = np.where(top > best, at, end)
        last = np.where(top > best, i + 1, last)
        best = np.maximum(best, top)
    return best, end, last


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        asked = list(zip(b.column("words").to_pylist(), b.column("passage").to_pylist(), strict=True))
        place = {pair: k for k, pair in enumerate(dict.fromkeys(asked))}
        row = np.array([place[pair] for pair in asked], np.int64)
        n = len(place)
        number: dict[str, int] = {}
        code = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in t.split(" ")], np.int64)
        items = [code(t) for t, _ in place]
        passages = [code(t) for _, t in place]
        scores, ends, starts = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
        order = sorted(range(n), key=lambda k: (len(passages[k]), len(items[k])))
        at = 0
        while at < n:  # pairs of about equal length together, a few million cells at most
            z = at + 1
            while z < n and z - at < 500 and (z - at + 1) * (len(passages[order[z]]) + 1) < 400_000 and len(passages[order[z]]) < 1.3 * len(passages[order[at]]) + 16:
                z += 1
            part = order[at:z]
            best, end, last = align_ends([items[k] for k in part], [passages[k] for k in part])
            size = np.array([len(items[k]) for k in part])
            # a few words in common are chance: LEAST matches in a row's worth of score, or the whole of a shorter item
            scores[part] = np.where(best >= 2 * np.minimum(size, LEAST), best / (2 * size), 0.0)
            ends[part] = end
            # a leak's alignment backwards from its end tells where the item would begin
            leaks = [(k, e, x) for k, e, x in zip(part, end.tolist(), last.tolist(), strict=True) if scores[k] >= THRESHOLD]
            if leaks:
                _, back, before = align_ends([items[k][:x][::-1] for k, _, x in leaks], [passages[k][:e][::-1] for k, e, _ in leaks])
                for (k, e, x), b_, i_ in zip(leaks, back.tolist(), before.tolist(), strict=True):
                    starts[k] = (e - b_) - (x - i_) - MARGIN
            at = z
        first = np.maximum(0, b.column("first_word").to_numpy() + starts[row]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "text_hash", "item_id")] + [pa.array(first), pa.array(scores[row]), pa.array(ends[row])], names=["doc_id", "text_hash", "item_id", "first_word", "score", "length"])


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, first_word, passage: all passages that can hold a leak."""
    spark = docs.sparkSession
    total = items.select(F.sum(F.size("seeds"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_SEEDS // 2)))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, item_id long, first_word int, passage string"
    found = None
    todo = [(blocks, k) for k in range(blocks)]
    while todo:
        blocks, k = todo.pop()
        rows = items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).select("item_id", "n_words", "seeds", "places").collect()
        if sum(len(r["seeds"]) for r in rows) > BLOCK_SEEDS and len(rows) > 1:
            todo += [(2 * blocks, k), (2 * blocks, k + blocks)]
            continue
        part = keyed(docs).mapInArrow(_finder(spark.sparkContext.broadcast(SeedTable(rows))), schema)
        found = part if found is None else found.unionByName(part)
    return scratch(found, "passages")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word: the best passage of each document for each item that it leaks."""
    small_batches(docs.sparkSession)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = scratch(texts.mapInArrow(_items, "item_id long, words string, n_words int, seeds array<long>, places array<int>").filter(F.size("seeds") > 0).dropDuplicates(["item_id", "words"]), "items")
    found = passages(docs, items)
    of_item = items.select(F.col("item_id").alias("of_item"), "words")
    tried = found.join(of_item, F.col("item_id").eqNullSafe(F.col("of_item")))
    scored = tried.select("doc_id", "text_hash", "item_id", "first_word", "passage", "words").mapInArrow(
        _score, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, item_id long, first_word int, score double, length int"
    )
    leaks = scored.filter(F.col("score") >= THRESHOLD)
    return leaks.groupBy("doc_id", "text_hash", "item_id").agg(F.max("score").alias("score"), F.max_by("first_word", F.struct("score", -F.col("first_word"))).alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak any item."""
    id_, hash_ = free_names(docs, "leak_id_", "leak_hash_")
    leaked = contamination(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    leaked = scratch(leaked, "leaked")
    on = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hash_))
    return docs.join(leaked, on, "left_anti")
