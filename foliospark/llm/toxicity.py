"""Toxicity: a cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(theta_k - w.x): one weight vector is shared by all grades, whose thresholds are ordered.
Features are the words of a text and the starts of three to five letters of its longer words, each once. The vocabulary holds
those that stand in toxic training texts more often than chance would have it, so a text is judged by what speaks
against it and not by its length.

Training rows are a bounded sample of labelled documents: at most MAX_TOXIC toxic and MAX_CLEAN clean ones, those
with the smallest hash of their id. The labels say only whether a text is toxic, so severity among toxic training
rows comes from their evidence, the sum of the z values of the features they hold: its terciles are grades 1 to 3. Clean rows are grade 0.

Every document is scored, whole text. Null and empty texts, and all others without a feature of the vocabulary, have
nothing against them: severity 0, grade 0, p_toxic 0, not rejected. Without labels of
both kinds no model can be fitted: every severity is 0. Labels that are null or name no document are left
out; of several labels of a document the worst counts; of documents with equal id one trains. Other columns
are carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, keyed, scratch, small_batches

#: Bounds of the training sample.
MAX_TOXIC, MAX_CLEAN = 4000, 12000
VOCABULARY = 2048
MIN_COUNT = 4
GRADES = 4
#: Lengths of the word starts that are features.
STARTS = (3, 4, 5)
#: A feature tells if the difference of its log odds between toxic and clean texts is so many standard errors.
TELLING = 3.0
#: A text is rejected if a grade above 0 is at least this likely. Of 0.2, 0.3 and 0.5 this had the best F1 on held-out halves
#: of two label tables (0.913 with 242, 0.996 with 1,091 toxic training labels).
REJECT = 0.3


def features(text: str | None) -> set[str]:
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:n] for w in words for n in STARTS if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(features(text))
    names = list(seen[0] | seen[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"]
    )


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic (0 or 1) of the bounded sample."""
    worst = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = worst.filter("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(worst.filter("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    picked = scratch(picked, "label-sample")
    rows = keyed(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN rows of two numbers
    return scratch(rows.dropDuplicates(["doc_id"]), "training")


class Model:
    """vocabulary: feature -> index; weights; thresholds, ascending."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, likeliest grade, P(grade > 0)."""
        get = self.vocabulary.keys()
        own = [[self.vocabulary[f] for f in features(t) & get] for t in texts]
        above = self.above(np.array([self.weights[x].sum() for x in own], float))
        above[[not x for x in own]] = 0.0
        p = -np.diff(np.concatenate([np.ones((len(own), 1)), above, np.zeros((len(own), 1))], axis=1), axis=1)
        return above.sum(1), p.argmax(1), above[:, 0]


def fit_weights(rows: list[np.ndarray], grades: np.ndarray, size: int, penalty: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent (Adam) on the penalised likelihood."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    k = int(grades.max())
    share = np.array([(grades <= j).mean() for j in range(k)])
    # thresholds are the first one and positive gaps, so that they stay ordered
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    n = len(rows)
    for t in range(1, steps + 1):
        w, gaps = x[:size], np.exp(x[size + 1 :])
        theta = np.concatenate([[-np.inf], x[size] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        eta = np.bincount(row, w[col], n)
        hi, lo = (1 / (1 + np.exp(-np.clip(theta[grades + d] - eta, -40, 40))) for d in (1, 0))
        hi, lo = np.where(grades == k, 1, hi), np.where(grades == 0, 0, lo)
        # d log(hi - lo): logistic densities over the probability, simplified so that it cannot divide by 0
        up, down = hi * (1 - hi) / np.maximum(hi - lo, 1e-12), lo * (1 - lo) / np.maximum(hi - lo, 1e-12)
        by_eta = -(up - down)
        by_theta = np.array([up[grades == j].sum() - down[grades == j + 1].sum() for j in range(k)])
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(col, by_eta[row], size) - penalty * w, tail[:1], tail[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        x = x + 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return x[:size], x[size] + np.concatenate([[0], np.cumsum(np.exp(x[size + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None where labelled documents are not of both kinds."""
    rows = training_rows(docs, labels)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    counts = rows.select("text", "toxic").mapInArrow(_count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # standardised difference of log odds, half a text added to each count
    odds = lambda c, total: F.log((F.col(c) + 0.5) / (total - F.col(c) + 0.5))
    spread = F.sqrt(1 / (F.col("clean") + 0.5) + 1 / (F.col("toxic") + 0.5))
    z = (odds("toxic", n[1]) - odds("clean", n[0])) / spread
    top = counts.filter(F.col("clean") + F.col("toxic") >= MIN_COUNT).withColumn("z", z).filter(F.col("z") > TELLING).orderBy(F.desc("z"), "feature").limit(VOCABULARY).collect()
    vocabulary = {r["feature"]: i for i, r in enumerate(top)}
    if not vocabulary:
        return None
    packed = rows.select("text", "toxic").mapInArrow(_vectors(vocabulary), "toxic int, indices array<int>").collect()  # bounded by the sample
    packed.sort(key=lambda r: (r["toxic"], r["indices"]))
    xs, toxic = [np.array(r["indices"], np.int64) for r in packed], np.array([r["toxic"] for r in packed])
    z_of = np.array([r["z"] for r in top])
    evidence = np.array([z_of[x].sum() for x in xs])
    cuts = np.quantile(evidence[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (evidence > cuts[0]) + (evidence > cuts[1]), 0)
    _, grades = np.unique(grades, return_inverse=True)  # no gaps, should two cuts be equal
    weights, thresholds = fit_weights(xs, grades, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def _vectors(vocabulary: dict[str, int]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(vocabulary[f] for f in features(t) & vocabulary.keys()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "indices"])

    return pack


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with severity (expected grade), grade, p_toxic and toxic (the verdict), in a struct named toxicity_."""
    small_batches(docs.sparkSession)
    kind = "severity double, grade int, p_toxic double, toxic boolean"

    @F.pandas_udf(kind)
    def judge(texts: pd.Series) -> pd.DataFrame:
        if model is None or not len(texts):
            zero = np.zeros(len(texts))
            return pd.DataFrame({"severity": zero, "grade": zero.astype("int32"), "p_toxic": zero, "toxic": zero > 1})
        severity, grade, p = model.predict(texts)
        return pd.DataFrame({"severity": severity, "grade": grade.astype("int32"), "p_toxic": p, "toxic": p >= REJECT})

    return docs.withColumn("toxicity_", judge("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the model does not reject."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # so that no column of docs clashes with the verdict
    return score(rows, fit(docs, labels)).filter(~F.col("toxicity_.toxic")).select("row.*")
