import hashlib
import random
import zlib

import numpy as np
import pytest

from foliospark.llm import periodic as P
from foliospark.llm import queries as Q

from .conftest import make_docs


def brute(words):
    """Every run, by trying all periods."""
    out = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in out.items())


def tangled(seed, n):
    """Words from a small alphabet, with stretches that repeat, nested and side by side."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        part = [r.choice("abc") for _ in range(r.randrange(1, 9))]
        if r.random() < 0.3:
            part = part * r.randrange(2, 7)
        out += part * r.choice((1, 1, 3, 4, 5, 9))
    return out[:n]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(words):
    runs = brute(words)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (len(runs), best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (0, None, None, None, None)
    return (*head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(40))
def test_fragments_of_a_document_are_its_runs(seed):
    words = tangled(seed, random.Random(seed).choice((5, 6, 7, 60, 300)))
    w = P.codes([x.encode() for x in words])
    found = list(P.fragments(w, 0, 0, len(w), range((len(w) // 4).bit_length())))
    assert P.runs_of(found) == brute(words)


def test_z_function_and_slices_agree(monkeypatch):
    w = P.codes([x.encode() for x in tangled(3, 200)])
    periods = np.arange(1, 40)
    fast = P.reaches(w, 77, periods)
    monkeypatch.setattr(P, "MANY", 1000)
    assert P.reaches(w, 77, periods) == fast


def test_documents_side_by_side(monkeypatch):
    """Equal documents next to each other, many periods at a boundary among them, keep to themselves."""
    texts = [["a"] * 50, ["a"] * 50, [], ["a", "b"] * 30, ["b", "a"] * 30, *(tangled(s, 90) for s in range(20)), ["a"] * 5]
    assert P.solve([[w.encode() for w in t] for t in texts]) == [brute(t) for t in texts]


def test_one_word_many_times_is_one_run_in_every_octave():
    w = np.zeros(30_000, np.int32)
    assert P.runs_of(list(P.fragments(w, 0, 0, len(w), range(13)))) == [(0, 30_000, 1)]


@pytest.mark.parametrize("long_bytes", [1 << 15, 0])
def test_query_against_brute_force(spark, monkeypatch, long_bytes):
    """With long_bytes 0 every document goes through tiles and stitching."""
    monkeypatch.setattr(P, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(P, "TILE", 32)
    monkeypatch.setattr(P, "SHARED", 2)
    texts = [" ".join(tangled(s, 20 + 12 * s)) for s in range(30)] + ["", None, " \t ", "a", "x " * 700, "\xa0 a\x85b  " * 9, "y z\n" * 5, "y z\n" * 5]
    docs = make_docs(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in Q.periodic.digest(Q.periodic.periodic_runs(Q.planted_runs(docs))).collect()}
    want = {k: expected(planted(k, [w.decode() for w in (t or "").encode().split()])) for k, t in enumerate(texts)}
    assert got == want
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))) > 1


def test_odd_rows(spark, odd):
    got = P.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    assert {(r.doc_id, r.n_words, len(r.runs), r.kept) for r in got} == {(None, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (None, 5, 0, "some words that stand here")}
    assert P.periodic_runs(odd.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tiles_stitched_are_the_whole(spark, monkeypatch, seed):
    """Small tiles: runs cross several of them in every octave."""
    monkeypatch.setattr(P, "TILE", 16)
    monkeypatch.setattr(P, "SHARED", 1)
    words = tangled(seed, 400) + ["u", "v", "w", "x", "y", "z", "q"] * 40 + [f"n{k}" for k in range(90)] * 5
    w = P.codes([x.encode() for x in words])
    rows = [("d", 1, *f) for k0, k1, lo, hi, a, z in P.tiles(len(w)) for f in P.fragments(w[a:z], a, lo, hi, range(k0, k1))]
    found = P.stitch(spark.createDataFrame(rows, "doc_id string, text_hash long, period long, start long, stop long")).collect()
    assert [tuple(r) for r in found[0].runs] == brute(words)
