"""Near-duplicates by ProbMinHash, banding and exact verification.

A text's words are its runs of letters and digits, lower-cased; its shingles are runs of five words (all words
together, if fewer), weighted by 1 + log2 of their number in the text. Each shingle is a Poisson process whose rate
is its weight; an arrival goes to one of M components, which keeps the earliest shingle. All shingles of a batch
take their next arrival at once, and a shingle drops out when its arrival comes later than every component's
earliest. Two texts agree on a component with the probability Jaccard of their weighted shingles. Links are defined
by plain sets, so a text that repeats shingles has bands by unit weights as well (in others both are the same): there
two texts agree with the Jaccard similarity of their sets, and 16 bands of 4 make a candidate of a pair at similarity
0.8 with probability 0.9998, however often lines repeat in either.

A candidate is verified by the exact Jaccard similarity of the shingle sets. Not all pairs of a bucket are tried:
texts with equal words are one text from the start; in each round every bucket that still holds texts of more than
one class picks a leader, and the texts of other classes are verified against it. After LEADER_ROUNDS rounds, the
pairs across classes that are left and were not yet tried are tried all, so no link within a bucket is lost; of
these only such pairs are left out as cannot be similar, because too many shingles of one of them occur in no other text
or leave a mark that the other text lacks. Large buckets are dealt into cells then, so that no task has one alone.

Null and empty texts, and those without a word, are classes of their own. Equal rows are of one class. Ties: a
class is named by its smallest doc_id (null only if it has no other). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import free_names, keyed, scratch, small_batches
from foliospark.llm.shingles import grams, hash_words, mix, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: The same as a ratio of integers: at the limit itself doubles would refuse some pairs.
PART, WHOLE = Fraction(str(SIMILARITY)).as_integer_ratio()
BANDS, ROWS = 16, 4
LEADER_ROUNDS = 3
#: Texts of a cell: what is left of larger buckets in the last round is dealt into several.
CELL = 1000
#: Marks of a text: bits of its shingles' residues, in so many 64-bit words.
WORDS = 16
MARKS = [f"mark{w}" for w in range(WORDS)]
#: Texts of a batch are hashed in groups of about so many words.
GROUP_WORDS = 200_000


def prob_minhash(elements: list[np.ndarray], weights: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (documents x m) of non-empty weighted sets."""
    n = len(elements)
    doc = np.repeat(np.arange(n), [len(e) for e in elements])
    h = np.concatenate(elements)
    rate = np.concatenate(weights)
    first = np.full(n * m, np.inf)
    signature = np.zeros(n * m, np.uint64)
    t = np.zeros(len(h))
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(h):
            turn += np.uint64(1)
            x = mix(h + turn * np.uint64(0x9E3779B97F4A7C15))
            t = t - np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / rate
            at = doc * m + (mix(x) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, at, t)
            won = first[at] == t
            signature[at[won]] = h[won]
            live = t < first.reshape(n, m).max(1)[doc]
            doc, h, rate, t = doc[live], h[live], rate[live], t[live]
    return signature.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
        for k in range(parts.shape[2]):
            key = mix(key * np.uint64(0x9E3779B185EBCA87) + parts[:, :, k])
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        tids: list[bytes | None] = [None] * len(texts)
        keys, rows = [np.zeros((0, BANDS), np.uint64)], np.zeros(len(texts), np.int64)
        elements, weights, size = [], [], 0
        for i, text in enumerate(texts):
            if words := words_of(text):
                tids[i] = xxhash.xxh3_128_digest(" ".join(words))
                with np.errstate(over="ignore"):
                    values, counts = np.unique(grams(hash_words(words), SHINGLE), return_counts=True)
                for w in [1 + np.log2(counts)] + [np.ones(len(counts))] * bool(counts.max() > 1):
                    elements.append(values)
                    weights.append(w)
                    rows[i] += 1
                size += len(words)
            if elements and (size > GROUP_WORDS or i == len(texts) - 1):
                keys.append(band_keys(prob_minhash(elements, weights)))
                elements, weights, size = [], [], 0
        offsets = np.concatenate([[0], np.cumsum(rows * BANDS)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(tids, pa.binary()), bands], names=["doc_id", "text_hash", "tid", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        with np.errstate(over="ignore"):
            sets = [np.unique(grams(hash_words(words_of(t)), SHINGLE)).view(np.int64) for t in b.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        marks = np.zeros((len(sets), 64 * WORDS), np.uint8)
        for k, s in enumerate(sets):
            marks[k, s & (64 * WORDS - 1)] = 1
        words = np.packbits(marks, axis=1).view(np.int64)
        columns = [b.column("tid"), pa.ListArray.from_arrays(pa.array(offsets), values), *(pa.array(np.ascontiguousarray(words[:, w])) for w in range(WORDS))]
        yield pa.RecordBatch.from_arrays(columns, names=["tid", "shingles", *MARKS])


def components(edges: DataFrame) -> DataFrame:
    """node, root of the graph with edges (a, b): the smallest node that each can reach.

    Each round takes the least label among the neighbours and then that label's own label, so a path of n edges
    takes about log n rounds. Labels are written between rounds; only the number of changes comes to the driver.
    """
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        own = labels.withColumnRenamed("root", "was")
        least = own.join(near, own["node"] == near["a"]).select("node", "was", F.least("was", "near").alias("least"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        moved = scratch(least.join(jump, F.col("least") == F.col("at")).select("node", "was", F.least("least", "far").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter(F.col("was") != F.col("root")).isEmpty():
            return labels


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least SIMILARITY."""
    one = sets.select(F.col("tid").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("tid").alias("b"), F.col("shingles").alias("of_b"))
    # the size of each set bounds the similarity, so most failing pairs are left before their sets meet
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), F.size("of_a").alias("na"), F.size("of_b").alias("nb")).filter(
        WHOLE * F.col("both") >= PART * (F.col("na") + F.col("nb") - F.col("both"))
    ).select("a", "b")


def _most_shared(tids: DataFrame, sets: DataFrame) -> DataFrame:
    """tid, n, most and the marks: a text's shingles, and how many of them any other of these texts has as well."""
    own = sets.join(tids, "tid", "left_semi")
    lone = own.select("tid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("tid").alias("tid")).filter("c = 1")
    count = lone.groupBy("tid").agg(F.count(F.lit(1)).alias("lone"))
    sizes = own.select("tid", F.size("shingles").alias("n"), *MARKS)
    return sizes.join(count, "tid", "left").select("tid", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("most"), *MARKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id: one row for each row of docs; copies and near copies share a class_id."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, tid binary, bands array<long>"
    members = scratch(keyed(docs).mapInArrow(_signatures, schema), "minhash")
    banded = members.filter(F.col("tid").isNotNull()).select(F.explode("bands").alias("band"), "tid").distinct()
    shared = banded.groupBy("band").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).filter("lo != hi").select("band")
    buckets = scratch(banded.join(shared, "band"), "buckets")
    edges, roots, tried = None, None, None
    # of all texts in shared buckets; each text once, from the row with its smallest key
    wanted = buckets.select("tid").distinct()
    rows = members.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    rows = rows.select("tid", F.col("k.doc_id").alias("id_"), F.col("k.text_hash").alias("hash_"))
    text = keyed(docs)
    found = text.join(rows, text["doc_id"].eqNullSafe(F.col("id_")) & (text["text_hash"] == F.col("hash_"))).select("tid", "text")
    sets = scratch(found.mapInArrow(_shingle_sets, "tid binary, shingles array<long>, " + ", ".join(f"{m} long" for m in MARKS)).dropDuplicates(["tid"]), "shingles")
    for turn in range(LEADER_ROUNDS + 1):
        rooted = buckets.withColumn("root", F.col("tid"))
        if roots is not None:
            rooted = buckets.join(roots, buckets["tid"] == roots["node"], "left").select("band", "tid", F.coalesce("root", "tid").alias("root"))
        if turn < LEADER_ROUNDS:
            order = F.xxhash64("tid", F.lit(turn))
            leaders = rooted.groupBy("band").agg(F.min_by(F.struct("tid", "root"), order).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            leaders = leaders.filter("lo != hi").select("band", F.col("lead.tid").alias("lead"), F.col("lead.root").alias("lead_root"))
            pairs = rooted.join(leaders, "band").filter(F.col("root") != F.col("lead_root")).select(F.col("lead").alias("x"), F.col("tid").alias("y"))
        else:
            mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("band")
            rest = rooted.join(mixed, "band")
            most = scratch(_most_shared(rest.select("tid").distinct(), sets), "most-shared")
            # whoever has a similar text at all shares SIMILARITY of its own shingles with others
            rest = rest.join(most, "tid").filter(F.col("most") * WHOLE >= F.col("n") * PART)
            # texts of a large bucket are dealt into cells, and each pair of cells is a task's work
            cells = rest.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("cells"))
            rest = rest.join(cells, "band").withColumn("own", F.pmod(F.xxhash64("tid"), F.col("cells")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            rest = scratch(rest.drop("cells"), "rest")
            other = rest.select(F.col("band").alias("band_y"), F.col("own").alias("own_y"), F.col("with").alias("with_y"), F.col("tid").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.col("most").alias("most_y"), *[F.col(m).alias(f"{m}_y") for m in MARKS])
            # a pair shares no more than either has in common with any, and at least one shingle of a text for each of
            # its marks that the other lacks is not shared; below this no pair reaches SIMILARITY
            lacks = lambda one, two: sum((F.bit_count(F.col(m + one).bitwiseAND(F.bitwise_not(F.col(m + two)))) for m in MARKS), F.lit(0))
            bound = F.least(F.col("most"), F.col("most_y"), F.col("n") - lacks("", "_y"), F.col("n_y") - lacks("_y", ""))
            enough = bound * (PART + WHOLE) >= PART * (F.col("n") + F.col("n_y"))
            cell = (F.col("band") == F.col("band_y")) & (F.col("own") == F.col("with_y")) & (F.col("with") == F.col("own_y"))
            pairs = rest.join(other, cell & (F.col("tid") < F.col("y")) & (F.col("root") != F.col("root_y")) & enough).select(F.col("tid").alias("x"), "y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch(pairs, "pairs")
        if pairs.isEmpty():  # the leaders of all open buckets have been tried; the last round goes through the rest
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = scratch(_verify(pairs, sets), "links")
        edges = good if edges is None else edges.unionByName(good)
        if not good.isEmpty():
            roots = components(edges)
    if roots is None:
        rooted = members.select("doc_id", "text_hash", F.col("tid").alias("root"))
    else:
        rooted = members.join(roots, members["tid"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "tid").alias("root"))
    rooted = scratch(rooted, "rooted")
    names = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = scratch(names.select(F.col("root").alias("named"), "least"), "names")
    return rooted.join(named, rooted["root"] == named["named"], "left").select("doc_id", "text_hash", F.coalesce("least", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class: that with the smallest doc_id. Rows without an id stay
    unless they are in a class with another; of rows with equal id and text one stays."""
    id_, hash_, copies = free_names(docs, "kept_id_", "kept_hash_", "copies_")
    classes = near_duplicates(docs)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias(copies))
    kept = scratch(kept.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), copies), "kept")
    on = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hash_))
    out = docs.join(kept, on)
    if not kept.filter(F.col(copies) > 1).isEmpty():
        empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\w")
        single = out.filter((F.col(copies) == 1) | empty)
        out = single.unionByName(out.filter((F.col(copies) > 1) & ~empty).dropDuplicates([id_, hash_]))
    return out.select(*[docs[c] for c in docs.columns])
