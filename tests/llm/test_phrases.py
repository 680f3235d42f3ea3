import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from foliospark.llm import phrases as P
from foliospark.llm import queries as Q

from .conftest import make_docs

SF = "/root/testdata/sf0.001"


def brute(texts):
    """(n_words, n_removed, sha256 of what is kept) of each text, by all windows."""
    docs = [(t or "").encode().split() for t in texts]
    seen = defaultdict(int)
    for w in docs:
        for i in range(len(w) - P.LENGTH + 1):
            seen[tuple(w[i : i + P.LENGTH])] += 1
    out = []
    for w in docs:
        gone = {k for i in range(len(w) - P.LENGTH + 1) if seen[tuple(w[i : i + P.LENGTH])] > 1 for k in range(i, i + P.LENGTH)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def shared_texts(prose, seed):
    """Copies, edited copies, passages of 34 to 120 words in other surroundings, a common line, repeats within a text."""
    r = random.Random(seed)
    base = [prose(seed * 100 + k, 200) for k in range(12)]
    out = base + base[:2]
    for t in base[2:8]:
        w = t.split()
        for _ in range(r.randrange(3, 12)):
            w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    for k, size in enumerate((34, 35, 36, 40, 48, 60, 90, 120)):
        w = base[k].split()
        a = r.randrange(0, 200 - size)
        for j in range(2):
            out.append(prose(k * 9 + j + 1000, r.randrange(0, 60)) + "  \n" + " ".join(w[a : a + size]) + "\t" + prose(k * 9 + j + 2000, r.randrange(0, 60)))
    line = prose(5, 41)
    out += [prose(3000 + k, 30) + " " + line + " " + prose(4000 + k, 30) for k in range(60)]
    out += [f"{line} {line} end", "one word " * 40, "", None, "short text"]
    return out


@pytest.mark.parametrize("hot", [2000, 7])
def test_against_brute_force(spark, prose, monkeypatch, hot):
    """hot 7: cores of the common line are dealt out over shards."""
    monkeypatch.setattr(P, "HOT_CORE", hot)
    texts = shared_texts(prose, 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in P.digest(make_docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert sum(n > 0 for _, n, _ in got.values()) > 80


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(c.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({Q.OP13_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in Q.op13_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want


def test_equal_windows_are_in_groups_with_equal_cores(prose):
    """Whatever surrounds a window, its group has the same core, and stands at the same place of it."""
    window = prose(8, P.LENGTH)
    found = set()
    for k in range(30):
        before = prose(100 + k, k)
        words = f"{before} {window} {prose(200 + k, 30 - k)}".encode().split()
        at = len(before.split())
        for start, n, core, _ in P.groups(P.hashed(words)):
            g = int(np.searchsorted(start, at, "right")) - 1
            assert start[g] <= at < start[g] + n[g]
            found.add(int(core[g]))
    assert len(found) == 1


def test_windows_of_the_same_contexts_make_one_phrase():
    row = lambda at, held, mark: {"at": at, "held": held, "mark": mark}
    assert P.stretches([row(3, 2, 9), row(2, 2, 9), row(4, 3, 9), row(5, 3, 8), row(7, 3, 8)]) == [(2, 3), (4, 4), (5, 5), (7, 7)]


def test_odd_rows(spark, odd):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in P.digest(odd).collect())
    assert got == [(-1, 0, 0), (-1, 5, 0), (-1, 5, 0), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert P.digest(odd.limit(0)).collect() == []
