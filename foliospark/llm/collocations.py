"""Phrase collocations: counts of all frequent phrases by vertically partitioned suffix trees, and a score for each.

Texts are lower-cased (A-Z), parted at PARTS into pieces and those at blanks and tabs into words. Counts are for each language
(null: und). A phrase has 2 to LONGEST words; one that stands LEAST times at least is a candidate. Cut after its first k
words it scores floor(SCALE * a / (l + r)), with a its own count and l, r those of the two sides; the lowest cut counts.
A candidate goes if a longer one holds its words and stands 0.8 times as often.

The counts come from suffixes of LONGEST words, in three passes over the texts, each combined inside the tasks:
* words of each language;
* pairs of neighbours, of words that can be frequent. No phrase with a rare pair is frequent, so
* each suffix is truncated at its first rare pair, and goes to the subtree of its prefix. Prefixes are partitioned by
  budget: a word that stands HEAVY times at most is a prefix; the suffixes of other words are parted by their first two
  words, and where these are as frequent by all of their words. Whole prefixes are put together into groups of GROUP
  suffixes, and each group's subtree is built by itself: suffixes in order, every node's count the sum of its leaves.
  Nodes above a prefix of all words get their parts added up by Spark.

What tasks must know of all texts, that a word or pair is frequent or heavy, is sent as bit tables of fixed size (TABLE_BITS).
They may name a rare one as frequent, which costs time only. Words are named by 64-bit hashes of language and word.

Null and empty texts have no words. Repeated rows count as often as they are there. Columns other than text and lang are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, small_batches
from foliospark.llm.shingles import mix

#: Fixed value: what parts pieces.
PARTS = b".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST, SCALE = 4, 30, 2_000_000
HELD, OF = 80, 100
TOP = 2000
HEAVY = 1 << 17
GROUP = 1 << 19
#: Words that are combined together inside a task.
FLUSH = 1 << 21
TABLE_BITS = 1 << 25
_PAIR = np.uint64(0x9E3779B185EBCA87)
_turn = bytes.maketrans(PARTS, b"." * len(PARTS))
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


class LanguageHashes(dict):
    """word -> hash that is its own for the language; 0 for the mark between pieces. Forgotten when it gets large."""

    LIMIT = 400_000

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = 0 if word == b"." else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return h


def tokens(text: str) -> list[bytes]:
    """Words, and a full stop wherever a piece ends."""
    return text.encode().lower().translate(_turn).replace(b".", b" . ").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(b".", None)
            words, look = list(own), LanguageHashes(lang)
            h = np.fromiter(map(look.__getitem__, words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(list(own.values()), pa.int64())], names=["h", "lang", "word", "f"])
        counts.clear()

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(text))
        if sum(map(len, counts.values())) > FLUSH // 4:
            yield from flush()
    yield from flush()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of the words of many texts at a time, 0 between pieces, closed by LONGEST zeros."""
    looks: dict[str, LanguageHashes] = {}
    parts: list[np.ndarray] = []
    end = np.zeros(LONGEST, np.uint64)
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if lang not in looks:
                if len(looks) > 50:
                    looks.clear()
                looks[lang] = LanguageHashes(lang)
            words = tokens(text)
            parts += [np.fromiter(map(looks[lang].__getitem__, words), np.uint64, len(words)), end]
            if len(parts) > 1000:
                parts = [np.concatenate(parts)]
        if sum(map(len, parts)) > FLUSH:
            yield np.concatenate(parts)
            parts = []
    if parts:
        yield np.concatenate(parts)


def pair_names(h: np.ndarray) -> np.ndarray:
    """A name for each word with the next."""
    return mix(h[:-1] * _PAIR ^ h[1:])


def bits(spark: SparkSession, keys: DataFrame, key: str) -> Broadcast:
    """A bit table in which every key of keys is set, for the tasks."""
    bit = F.expr(f"pmod({key}, {TABLE_BITS})")
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {TABLE_BITS}) % 64 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.mod(h.view(np.int64), TABLE_BITS)
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _pair_counter(frequent: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for h in _streams(batches):
                good = marked(frequent.value, h) & (h != 0)
                name, c = np.unique(pair_names(h)[good[:-1] & good[1:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(c.astype(np.int64))], names=["pair", "f"])

    return count


def _suffixes(pairs: Broadcast, heavy_words: Broadcast, heavy_pairs: Broadcast):
    """Distinct truncated suffixes of a task's texts with how often each is there, and the prefix that each belongs to."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for h in _streams(batches):
                name = pair_names(h)
                goes = marked(pairs.value, name) & (h[:-1] != 0) & (h[1:] != 0)
                at = np.flatnonzero(goes)
                w = [h[at], h[at + 1]]
                on = np.ones(len(at), bool)
                for k in range(2, LONGEST):
                    on = on & goes[np.minimum(at + k - 1, len(goes) - 1)]
                    w.append(np.where(on, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)))
                order = np.lexsort(w[::-1])
                w = [x[order] for x in w]
                new = np.ones(len(at), bool)
                if len(at):
                    new[1:] = np.any([x[1:] != x[:-1] for x in w], axis=0)
                starts = np.flatnonzero(new)
                c = np.diff(np.append(starts, len(at)))
                w = [x[starts] for x in w]
                pair = mix(w[0] * _PAIR ^ w[1])
                wide = marked(heavy_words.value, w[0])
                whole = wide & marked(heavy_pairs.value, pair)
                every = pair
                for x in w[2:]:
                    every = mix(every * _PAIR ^ x)
                prefix = np.where(whole, every, np.where(wide, pair, w[0]))
                columns = [prefix, *w]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(c.astype(np.int64)), pa.array(whole)], names=["prefix", *WORDS, "f", "whole"])

    return emit


def nodes_of(w: list[np.ndarray], c: np.ndarray, whole: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The nodes of 2 words and more of a group's subtree, with their counts: frequent ones, and parts of nodes that lie above
    their prefix."""
    order = np.lexsort(w[::-1])
    w, c, whole = [x[order] for x in w], c[order], whole[order]
    new = np.ones(len(c), bool)
    new[1:] = w[0][1:] != w[0][:-1]
    for depth in range(2, LONGEST + 1):
        new[1:] |= w[depth - 1][1:] != w[depth - 1][:-1]
        starts = np.flatnonzero(new)
        total = np.add.reduceat(c, starts)
        keep = (w[depth - 1][starts] != 0) & ((total >= LEAST) | whole[starts])
        at = starts[keep]
        yield [x[at] if k < depth else np.zeros(len(at), np.int64) for k, x in enumerate(w)], total[keep]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order of their prefixes: as many whole prefixes at a time as GROUP holds."""

    def build(t: pa.Table) -> Iterator[pa.RecordBatch]:
        w = [t.column(k).to_numpy() for k in WORDS]
        for words, f in nodes_of(w, t.column("f").to_numpy(), t.column("whole").to_numpy()):
            yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(f)], names=[*WORDS, "f"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < GROUP:
            continue
        t = pa.Table.from_batches(held)
        prefix = t.column("prefix").to_numpy()
        cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if prefix[0] != prefix[-1] else 0
        if cut:
            yield from build(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield from build(pa.Table.from_batches(held))


def vocabulary(docs: DataFrame) -> DataFrame:
    """h, lang, word, f: every word of every language."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return scratch(rows.mapInArrow(_count_words, "h long, lang string, word string, f long").groupBy("h", "lang", "word").agg(F.sum("f").alias("f")), "words")


def frequent_phrases(docs: DataFrame, words: DataFrame) -> DataFrame:
    """w1 to w4 (hashes, 0 behind the phrase's end), f: all phrases of 2 words and more that stand LEAST times."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    common = bits(spark, words.filter(F.col("f") >= LEAST), "h")
    pairs = rows.mapInArrow(_pair_counter(common), "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))
    pairs = scratch(pairs.filter(F.col("f") >= LEAST), "pairs")
    tables = bits(spark, pairs, "pair"), bits(spark, words.filter(F.col("f") > HEAVY), "h"), bits(spark, pairs.filter(F.col("f") > HEAVY), "pair")
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * GROUP)))
    schema = ", ".join(f"{w} long" for w in WORDS) + ", f long"
    suffixes = rows.mapInArrow(_suffixes(*tables), f"prefix long, {schema}, whole boolean")
    grouped = suffixes.repartition(parts, "prefix").sortWithinPartitions("prefix")
    nodes = grouped.mapInArrow(_subtrees, schema).groupBy(*WORDS).agg(F.sum("f").alias("f"))
    found = scratch(nodes.filter(F.col("f") >= LEAST), "phrases")
    for t in (common, *tables):
        t.unpersist()
    return found


def _key(*w: str):
    return F.xxhash64(*w)


def _spans(n: int, size: int) -> list:
    """Names of all stretches of size words of a phrase of n words."""
    return [_key(*WORDS[i : i + size]) for i in range(n - size + 1)]


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and bytes of the phrase."""
    small_batches(docs.sparkSession)
    words = vocabulary(docs)
    phrases = frequent_phrases(docs, words)
    size = sum((F.col(w) != 0).cast("int") for w in WORDS)
    by_size = lambda make: F.when(size == 2, make(2)).when(size == 3, make(3)).otherwise(make(4))
    named = phrases.withColumn("key", by_size(lambda n: _key(*WORDS[:n])))
    counts = words.filter(F.col("f") >= LEAST).select(_key("h").alias("key"), "f").unionByName(named.select("key", "f"))
    counts = scratch(counts, "counts")
    cut = lambda n: F.array(*[F.struct(F.lit(k).alias("k"), _key(*WORDS[:k]).alias("left"), _key(*WORDS[k:n]).alias("right")) for k in range(1, n)])
    cuts = named.select(*WORDS, "key", F.col("f").alias("a"), F.explode(by_size(cut)).alias("c")).select(*WORDS, "key", "a", "c.*")
    side = lambda name, count: counts.select(F.col("key").alias(name), F.col("f").alias(count))
    both = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("total", whole("l") + whole("r")).withColumn("top", F.lit(SCALE).cast("decimal(7,0)") * whole("a")).withColumn("score", F.expr("top div total"))
    lowest = scored.groupBy(*WORDS, "key", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("s"))
    # the most frequent longer candidate that holds a phrase
    inner = named.filter(size > 2).select("f", F.explode(F.when(size == 3, F.array(*_spans(3, 2))).otherwise(F.array(*_spans(4, 2), *_spans(4, 3)))).alias("key"))
    longer = inner.groupBy("key").agg(F.max("f").alias("longer"))
    held = F.coalesce(whole("longer") * OF >= whole("a") * HELD, F.lit(False))
    left = lowest.join(longer, "key", "left").filter(~held).select(*WORDS, "a", "s.*")
    word = words.select("h", "lang", "word")
    tagged = left.join(word.withColumnsRenamed({"h": "w1", "word": "t1"}), "w1")
    # phrases that tie with the last one stay until their words are known
    first = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = scratch(tagged.withColumn("place", first).filter(F.col("place") <= top).drop("place"), "best")
    for k in range(2, LONGEST + 1):
        best = best.join(word.select(F.col("h").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "inner" if k == 2 else "left")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    spelled = best.withColumn("phrase", F.concat_ws(" ", *[f"t{k}" for k in range(1, LONGEST + 1)])).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return spelled.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
