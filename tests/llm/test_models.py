"""Toxicity and nearest neighbours."""

import random

import numpy as np
import pytest

from foliospark.llm import ann, toxicity
from tests.llm.conftest import make_docs


@pytest.fixture(scope="module")
def labelled(spark, prose):
    r = random.Random(5)
    bad = ["vileword", "nastyterm", "awfulslur", "badness"]
    texts, labels = [], []
    for k in range(600):
        t = prose(k, 60).split()
        toxic = k % 4 == 0
        for _ in range(r.randrange(1, 6) if toxic else 0):
            t[r.randrange(len(t))] = r.choice(bad)
        texts.append(" ".join(t))
        labels.append((k, int(toxic)))
    return make_docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter("doc_id < 400"))
    assert all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r.toxicity_ for r in toxicity.score(docs, model).collect()}
    right = sum(got[k].toxic == (k % 4 == 0) for k in range(400, 600))
    assert right >= 195
    assert all(0 <= x.severity <= toxicity.GRADES - 1 and 0 <= x.p_toxic <= 1 for x in got.values())


def test_gradient():
    """Weights and thresholds reach a point where the likelihood is stationary: known thresholds come back."""
    r = np.random.default_rng(0)
    n, w = 4000, np.array([1.5, -1.0])
    rows = [np.flatnonzero(r.random(2) < 0.5) for _ in range(n)]
    eta = np.array([w[x].sum() for x in rows])
    theta = np.array([0.0, 1.0, 2.0])
    grades = (r.logistic(size=n) + eta)[:, None] > theta[None, :]
    got, cuts = toxicity.fit_weights(rows, grades.sum(1), 2, penalty=0.0, steps=1500)
    assert np.abs(got - w).max() < 0.2 and np.abs(cuts - theta).max() < 0.2


def test_scores_are_those_of_the_definition(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity_ for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = {*r.text.lower().split()}
        own = {f for f in model.vocabulary if (f[1:] if f[0] == "^" else f) in {x for w in words for x in ([w] if f[0] != "^" else [w[:n] for n in (3, 4, 5) if len(w) > n])}}
        eta = sum(model.weights[model.vocabulary[f]] for f in own)
        above = [1 / (1 + np.exp(t - eta)) if own else 0.0 for t in model.thresholds]
        x = got[r.doc_id]
        assert abs(x.severity - sum(above)) < 1e-9 and abs(x.p_toxic - above[0]) < 1e-9 and x.toxic == (above[0] >= toxicity.REJECT)
        assert x.grade == int(np.argmax(-np.diff([1.0, *above, 0.0])))


def test_texts_without_features_are_clean(spark, labelled):
    # even where most labels are toxic
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter("toxic = 1 or doc_id < 40"))
    texts = make_docs(spark, [None, "", " ... ", "unheard offwords"])
    got = [r.toxicity_ for r in toxicity.score(texts, model).collect()]
    assert [(x.severity, x.grade, x.p_toxic, x.toxic) for x in got] == [(0.0, 0, 0.0, False)] * 4
    assert toxicity.drop_toxic(texts, labels.limit(0)).count() == 4


def test_odd_labels(spark, labelled, odd):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(odd, None).filter("toxicity_.toxic").count() == 0
    messy = labels.unionByName(spark.createDataFrame([(None, 1), (0, None), (0, 0), (9999, 1)], labels.schema))
    assert toxicity.fit(docs, messy) is not None
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd, model).count() == 7 and toxicity.score(odd.limit(0), model).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 430 <= kept.count() <= 470


VECTORS = "vec_id long, embedding array<float>"


def brute(x, ids, own, k):
    score = x @ x[own]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[own]]
    return [ids[j] for j in order[:k]]


def test_recall(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(10, 16))
    x = (centres[r.integers(0, 10, 1500)] + 0.5 * r.normal(size=(1500, 16))).astype(np.float32)
    x[200:420] = x[200]  # many equal vectors
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], VECTORS)
    index = ann.build_index(df, k=20, shard_rows=500)
    got: dict[int, list[int]] = {}
    for row in ann.search(index, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    ids, y = np.arange(1500), x.astype(np.float64)
    hits = [len(set(brute(y, ids, q, 20)) & set(got[q])) for q in range(0, 1500, 20)]
    assert len(got) == 75 and all(len(v) == 20 for v in got.values()) and sum(hits) / (75 * 20) >= 0.9
    ties = brute(y, ids, 300, 20)
    assert got[300] == ties  # equal vectors: exact, the smaller ids first


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(ann.build_index(df, 20), df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert ann.search(ann.build_index(df.limit(0), 20), df.limit(0), 20).count() == 0


def test_prune_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    out = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]), 3, 1.2)
    assert out[0].tolist() == [1, 3, -1]


def test_shards_grow_and_not_their_number():
    sizes = [50_000, 100_000, 400_000, 786_432]
    assert [ann.shard_count(n) for n in sizes] == [12] * 4  # every query searches every shard: searches grow as the queries
    assert ann.shard_count(10_000) == 2 and ann.shard_count(10) == 1 and ann.shard_count(10_000_000) == 153  # within MAX_SHARD
    assert ann.beam_for(96, 4096) == 96 and ann.beam_for(96, 65_536) == 192


def test_building_prunes_a_few_points_for_each(monkeypatch):
    x = np.random.default_rng(3).normal(size=(6000, 24)).astype(np.float32)
    pruned = []
    prune = ann.robust_prune
    monkeypatch.setattr(ann, "robust_prune", lambda x, points, *more: pruned.append(len(points)) or prune(x, points, *more))
    edges, start = ann.build(x)
    assert sum(pruned) < 4 * len(x)
    held = edges >= 0
    assert edges.shape == (6000, ann.DEGREE) and held.any(1).all() and (edges != np.arange(6000)[:, None]).all()
    assert all(len(set(e[h].tolist())) == h.sum() for e, h in zip(edges, held, strict=True))  # each neighbour once
    asked = x[:200] + np.float32(0.1)
    found = ann.beam_search(x, edges, asked, start, ann.BEAM)[0]
    nearest = ((asked[:, None, :] - x[None, :, :]) ** 2).sum(2).argsort(1)[:, :10]
    assert np.mean([len(set(a) & set(b.tolist())) / 10 for a, b in zip(nearest.tolist(), found, strict=True)]) >= 0.95


def test_marks_are_left_as_found():
    x = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    edges, start = ann.build(x)
    met = ann.marks(300, 50)
    first = ann.beam_search(x, edges, x[:50], start, 32, met)[0]
    assert (met == -1).all() and (ann.beam_search(x, edges, x[:50], start, 32, met)[0] == first).all()
