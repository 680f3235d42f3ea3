import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliospark.llm import collocations as C
from foliospark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def by_sql(path):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{path}')")
    found = c.execute(Q.OP12_SQL)
    names = [d[0] for d in found.description]
    return sorted(tuple(r[names.index(k)] for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.fetchall())


def chatter(seed, n):
    r = random.Random(seed)
    words = [f"W{k}" for k in range(25)]
    fixed = ["of the great lake", "New York City", "in spite of", "à la carte"]
    return "".join(r.choice([r.choice(words), r.choice(words), r.choice(fixed)]) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))


@pytest.mark.parametrize("heavy", [False, True])
def test_against_sql(spark, tmp_path, monkeypatch, heavy):
    """heavy: every word and pair is parted as the most frequent ones are."""
    if heavy:
        monkeypatch.setattr(C, "HEAVY", 0)
    rows = [(k, chatter(k, 300), random.Random(k).choice(["en", "fr", None])) for k in range(40)] + [(None, None, "en"), (50, "", None), (51, " . ,\n", "de"), (52, chatter(1, 300), "en"), (52, chatter(1, 300), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as f", "2 as h", "'x' as word").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(C.collocations(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert got == by_sql(f"{tmp_path}/documents.parquet/*.parquet")
    assert {"of the great lake", "new york city"} <= {r[2] for r in got}


def test_given_tables(spark):
    assert rows_of(Q.op12_collocations(spark, SF)) == by_sql(f"{SF}/documents.parquet")


def test_subtree_counts_are_leaf_totals():
    r = np.random.default_rng(1)
    w = [r.integers(1, 4, 500) for _ in range(4)]
    w[2][::7] = 0
    w[3][(w[2] == 0) | (r.random(500) < 0.2)] = 0
    c = r.integers(1, 9, 500)
    got = {}
    for words, f in C.nodes_of(w, c, np.zeros(500, bool)):
        got |= {tuple(int(x) for x in row if x): int(n) for *row, n in zip(*words, f, strict=True)}
    want = Counter()
    for *row, n in zip(*w, c, strict=True):
        for d in range(2, 5):
            if row[d - 1]:
                want[tuple(int(x) for x in row[:d])] += int(n)
    assert got == {k: n for k, n in want.items() if n >= C.LEAST}


def test_tokens_of_a_text():
    found = [t.decode() for t in C.tokens("Ein Ärger,zwei\tDREI\x0b!\x1c x")]
    assert found == ["ein", "Ärger", ".", "zwei", "drei", ".", ".", "\x1c", "x"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(empty).collect() == []
