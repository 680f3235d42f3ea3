r"""PII: patterns find personal data; corpus co-occurrence finds the terms that would give it away.

An entity is the value of an email, ip, card or phone match. A term is a word of at least MIN_TERM letters that stands
outside all matches of a document, lower-cased. Over the whole corpus, with N documents, n(t) holding the term,
n(e) the entity and n(t, e) both, the term's disclosure of e is

    log2(N n(t, e) / (n(t) n(e))) / log2(N / n(e)),

pointwise mutual information over the entity's information content: 1 if the term stands only where the entity
does. Pairs seen in at least MIN_DOCS documents count. From GENERALISE on the term is replaced by its class (a word, a name or
an acronym, by its letter case), from REMOVE on it is removed, wherever it stands in each document that holds the entity:
elsewhere there is nothing of e to protect.

Entities that stand in the same documents have the same disclosures, so they are counted as one: a list of addresses
that is copied about is a single entity here. A document with k such groups and m terms makes k m pairs, added up in its
task before they are shuffled. Up to MAX_SENT_TERMS candidate terms come to the driver, to be sent to the tasks that
count terms; where there are more, these count all terms, with equal results. Nothing else is collected.

Null and empty texts have no spans. Repeated rows count as so many documents and get equal results. Columns other
than doc_id and text are not read by the search; `redact` carries them along. In an empty table nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.llm.common import keyed, scratch, small_batches

#: The kinds, in the order in which spans with equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "generalised", "removed")

MIN_TERM = 3
MIN_DOCS = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Up to so many candidate terms (some MB) are sent along with the counting tasks; beyond, all are counted.
MAX_SENT_TERMS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a digit before would only repeat a search that failed
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

_SPANS = "array<struct<start:int,kind:int,stop:int>>"
_TERMS = "array<struct<term:string,disclosure:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, stop) of all base matches, sorted. Linear in the length of the text."""
    spans = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                spans.append((start, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def entity_of(value: str, kind: int) -> str:
    return f"{KINDS[kind]}:" + (value.lower() if kind < 2 else "".join(c for c in value if c.isdigit()))


def outside_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, stop) for the words of a text; words that touch any of the sorted spans are left out."""
    k, reach = 0, 0  # reach: how far the spans that start before the word's end go
    for m in _TERM.finditer(text):
        start, stop = m.span()
        while k < len(spans) and spans[k][0] < stop:
            reach = max(reach, spans[k][2])
            k += 1
        if start >= reach and stop - start >= MIN_TERM:
            yield m[0].lower(), start, stop


def _triples(base: list[dict]) -> list[tuple[int, int, int]]:
    return [(x["start"], x["kind"], x["stop"]) for x in base]


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    for b in batches:
        base, entities, kept = [], [], []
        for text in b.column("text").to_pylist():
            spans = find_base(text)
            base.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
            entities.append(sorted({entity_of(text[s:e], k) for s, k, e in spans}))
            kept.append(text if spans else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(base, pa.list_(kinds)), pa.array(entities, pa.list_(pa.string())), pa.array(kept, pa.string())],
            names=["doc_id", "text_hash", "base", "entities", "text"],
        )


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[tuple[str, str]] = Counter()

    def flush() -> pa.RecordBatch:
        terms, held = zip(*seen, strict=True) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(held, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "entity", "n"])

    for b in batches:
        for text, base, held in zip(*(b.column(c).to_pylist() for c in ("text", "base", "held")), strict=True):
            terms = {t for t, _, _ in outside_terms(text, _triples(base))}
            for e in held:
                seen.update((t, e) for t in terms)
                if len(seen) > MAX_SENT_TERMS:
                    yield flush()
                    seen.clear()
    yield flush()


def _spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of a document's telling terms."""
    kinds = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    for b in batches:
        extra = []
        for text, base, telling in zip(*(b.column(c).to_pylist() for c in ("text", "base", "telling")), strict=True):
            most: dict[str, float] = {}
            for x in telling:
                most[x["term"]] = max(x["disclosure"], most.get(x["term"], 0.0))
            found = ((s, ALL_KINDS.index("removed" if most[t] >= REMOVE else "generalised"), e) for t, s, e in outside_terms(text, _triples(base)) if t in most)
            extra.append([{"start": s, "kind": k, "stop": e} for s, k, e in found])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(extra, pa.list_(kinds))], names=["doc_id", "text_hash", "extra"])


def _counter(terms: frozenset[str] | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
        for b in batches:
            for text in b.column("text").to_pylist():
                words = {t for t, _, _ in outside_terms(text, find_base(text))}
                seen.update(words & terms if terms is not None else words)
            if len(seen) > MAX_SENT_TERMS:
                yield flush()
                seen.clear()
        yield flush()

    return count


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base spans and entities of every document, and the text of those that have any, written to the shared folder."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, base {_SPANS}, entities array<string>, text string"
    return scratch(keyed(docs).mapInArrow(_detect, schema), "pii-base")


def entity_groups(found: DataFrame) -> DataFrame:
    """entity, group (an entity that stands in the same documents, the same for all of these) and n_entity (documents) of
    entities in at least MIN_DOCS documents."""
    of_doc = [F.xxhash64("doc_id", "text_hash", F.lit(k)).cast("decimal(20,0)") for k in (0, 1)]
    rows = found.select(F.explode("entities").alias("entity"), of_doc[0].alias("h0"), of_doc[1].alias("h1"))
    # the sums of two hashes over its documents stand for the set of them
    every = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1"))
    every = scratch(every.filter(F.col("n_entity") >= MIN_DOCS), "pii-entities")
    same = every.groupBy("n_entity", "s0", "s1").agg(F.min("entity").alias("group"))
    return scratch(every.join(same, ["n_entity", "s0", "s1"]).select("entity", "group", "n_entity"), "pii-groups")


def disclosures(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, entity, n_pair, n_term, n_entity, disclosure) of all pairs in at least MIN_DOCS documents, one entity of each
    group; and the texts, spans and groups (held) of the documents that hold any."""
    total = found.count()
    groups = entity_groups(found)
    held = found.select("doc_id", "text_hash", F.explode("entities").alias("entity")).join(groups, "entity")
    held = scratch(held.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.sort_array(F.collect_set("group")).alias("held")), "pii-held")
    texts = found.join(held, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select("doc_id", "text_hash", "text", "base", "held")
    # n(t, e): each document counts a pair once; tasks add up their own before the shuffle
    counted = texts.select("text", "base", "held").mapInArrow(_count_pairs, "term string, entity string, n long")
    pairs = scratch(counted.groupBy("term", "entity").agg(F.sum("n").alias("n_pair")).filter(F.col("n_pair") >= MIN_DOCS), "pii-pairs")
    sent = [r["term"] for r in pairs.select("term").distinct().limit(MAX_SENT_TERMS + 1).collect()]
    words = frozenset(sent) if len(sent) <= MAX_SENT_TERMS else None
    counts = keyed(docs).select("text").mapInArrow(_counter(words), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    sizes = groups.filter(F.col("entity") == F.col("group")).select("entity", "n_entity")
    disclosure = F.log2(total * F.col("n_pair") / (F.col("n_term") * F.col("n_entity"))) / F.log2(total / F.col("n_entity"))
    return pairs.join(counts, "term").join(sizes, "entity").filter(F.col("n_entity") < total).withColumn("disclosure", disclosure), texts


def disclosing_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_hash, extra: the spans of terms over the disclosure thresholds; one row for each such document."""
    schema = f"doc_id {dict(found.dtypes)['doc_id']}, text_hash long, extra {_SPANS}"
    measured, texts = disclosures(docs, found)
    telling = scratch(measured.filter(F.col("disclosure") >= GENERALISE).select("term", "entity", "disclosure"), "pii-telling")
    by_entity = telling.groupBy("entity").agg(F.collect_list(F.struct("term", "disclosure")).alias("telling"))
    asked = texts.select("doc_id", "text_hash", F.explode("held").alias("entity")).distinct().join(by_entity, "entity")
    asked = asked.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.flatten(F.collect_list("telling")).cast(_TERMS).alias("telling"))
    wanted = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    spotted = wanted.select("doc_id", "text_hash", "text", "base", "telling").mapInArrow(_spot, schema)
    return spotted.filter(F.size("extra") > 0).dropDuplicates(["doc_id", "text_hash"])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans of the patterns) and spans (with those of disclosing terms), one row per document."""
    found = detect(docs)
    extra = disclosing_spans(docs, found)
    joined = found.select("doc_id", "text_hash", "base").join(
        extra.select(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_"), "extra"),
        F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_")),
        "left",
    )
    return joined.select("doc_id", "text_hash", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def class_of(term: str) -> str:
    """What a generalised term is replaced by."""
    return "[ACRONYM]" if term.isupper() and len(term) <= 5 else "[NAME]" if term[:1].isupper() else "[WORD]"


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are masked as one, under the name of the first."""
    parts, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            name = ALL_KINDS[kind]
            parts += [text[at:start], "" if name == "removed" else class_of(text[start:stop]) if name == "generalised" else f"[{name.upper()}]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


@F.pandas_udf(StringType())
def _mask(texts: pd.Series, extra: pd.Series) -> pd.Series:
    own = lambda e: [] if e is None else [(x["start"], x["kind"], x["stop"]) for x in e]
    return pd.Series([None if t is None else mask(t, find_base(t) + own(e)) for t, e in zip(texts, extra, strict=True)])


def redact(docs: DataFrame) -> DataFrame:
    """docs with text masked (null stays null), other columns as they are; n_chars, where there is one, follows the text."""
    extra = disclosing_spans(docs, detect(docs))
    extra = extra.select(F.col("doc_id").alias("pii_id_"), F.col("text_hash").alias("pii_hash_"), F.col("extra").alias("pii_extra_"))
    on = docs["doc_id"].eqNullSafe(F.col("pii_id_")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("pii_hash_"))
    out = docs.join(extra, on, "left").withColumn("text", _mask("text", "pii_extra_")).drop("pii_id_", "pii_hash_", "pii_extra_")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def span_text(col: str):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(n, range(4)), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))



