"""Near-duplicates, decontamination, repeats, pieces and the pipeline, each against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import decontaminate, minhash, pieces, repeats
from foliospark.llm.shingles import words_of
from tests.llm.conftest import make_docs


def edited(text, share, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(int(share * len(w))):
        w[r.randrange(len(w))] = f"zz{r.randrange(10**6)}"
    return " ".join(w)


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def test_near_duplicates(spark, prose):
    base = prose(1, 120)
    # a large group whose members mostly are near the middle text only, chains, exact copies, short texts
    texts = [edited(base, (k % 30) / 200, k) for k in range(150)] + [prose(k, 80) for k in range(50, 90)] + ["a b", "A, b!", "a", "", None, "***", "***", prose(50, 80)]
    chain_ = prose(7, 100).split()
    texts += [" ".join(chain_[k:] + [f"new{k}x{j}" for j in range(k)]) for k in range(0, 30, 3)]
    want = brute_classes([t or "" for t in texts])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_near_duplicates_with_repeated_lines(spark, prose):
    texts = []
    for k in range(12):
        line = prose(1200 + k, 24)
        texts += [f"{prose(1100 + k, 80)} {' '.join([line] * n)}" for n in (2, 400)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts) == [k - k % 2 for k in range(len(texts))]


def test_pairs_at_the_limit_in_the_last_round(spark, prose, monkeypatch):
    # 28 shingles, and the same with 7 more: exactly 0.8
    texts = []
    for k in range(40):
        w = prose(1000 + k, 41).split()
        texts += [" ".join(w[:32]), " ".join(w[:39])]
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [k - k % 2 for k in range(len(texts))]


def test_deduplicate(spark, prose, odd):
    texts = [prose(1, 60), prose(2, 60), prose(1, 60) + " more", None, ""]
    docs = make_docs(spark, texts)
    kept = minhash.deduplicate(docs.unionByName(docs.filter("doc_id = 1")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4] and kept.columns == docs.columns
    assert minhash.deduplicate(odd).count() == 6 and minhash.deduplicate(odd.limit(0)).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(0)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    wx, wy = np.concatenate([np.full(60, 2.0), np.ones(20)]), np.ones(80)
    s = minhash.prob_minhash([x, y], [wx, wy], 4096)
    # by definition: sum over shared elements of 1 / sum of the larger ratios
    ux, uy = dict(zip(x, wx, strict=True)), dict(zip(y, wy, strict=True))
    exact = sum(1 / sum(max(ux.get(j, 0) / ux[i], uy.get(j, 0) / uy[i]) for j in {*ux, *uy}) for i in ux.keys() & uy.keys())
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_components(spark):
    rows = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[200] == 200


def test_alignment():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    r = random.Random(2)
    items = [np.array([r.randrange(6) for _ in range(r.randrange(1, 20))]) for _ in range(60)]
    passages = [np.array([r.randrange(6) for _ in range(r.randrange(1, 40))]) for _ in range(60)]
    best, _ = decontaminate.align(items, passages)
    assert best.tolist() == [plain(a, b) for a, b in zip(items, passages, strict=True)]


def test_contamination(spark, prose, odd):
    items = [prose(900 + k, 40) for k in range(6)]
    texts = [prose(k, 200) for k in range(30)]
    texts[3] = texts[3] + " " + items[0] + " " + texts[4]
    texts[5] = prose(33, 500) + " " + edited(items[1], 0.25, 1)
    w = items[2].split()
    texts[6] = " ".join(w[:15] + ["inserted", "words"] + w[15:25] + w[27:])
    texts[7] = items[3].upper().replace(" ", ", ")
    texts += [prose(70 + k, 30) + " " + items[4] for k in range(20)]  # one item leaks into very many
    bench = spark.createDataFrame([*enumerate(items), (90, "too short"), (91, None), (0, items[0])], "item_id long, text string").withColumn("score", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(make_docs(spark, texts), bench).collect()}
    assert got == {(3, 0), (5, 1), (6, 2), (7, 3), *((30 + k, 4) for k in range(20))}
    kept = decontaminate.drop_contaminated(make_docs(spark, texts), bench)
    assert kept.count() == len(texts) - 24
    assert decontaminate.contamination(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 7
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_contamination_by_a_frequent_part(spark, prose):
    item = prose(900, 40)
    part = " ".join(item.split()[:24])
    texts = [prose(k, 30) for k in range(100)]
    texts[7] = texts[7] + " " + item
    for k in range(20, 60):  # far over 1 % of the documents
        texts[k] = f"{texts[k]} {part} {prose(200 + k, 20)}"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(make_docs(spark, texts), bench).collect()} == {7, *range(20, 60)}


def test_contamination_by_edited_short_copies(spark, prose):
    r = random.Random(8)
    pairs, texts, items = set(), [], []
    for k in range(60):
        w = prose(2000 + k, r.randrange(4, 41)).split()
        items.append(" ".join(w))
        kind, copy = k % 4, list(w)
        if kind < 2:  # every third or fourth word replaced
            copy[2 + kind :: 3 + kind] = [f"q{k}q{j}" for j in range(len(copy[2 + kind :: 3 + kind]))]
        elif kind == 2:  # a word put in after each
            copy = [x for j, y in enumerate(w) for x in (y, f"q{k}q{j}")][:-1]
        else:
            for j in range(len(copy) // 3):
                copy[r.randrange(len(copy))] = f"q{k}q{j}"
        texts.append(f"{prose(3000 + k, 40)} {' '.join(copy)} {prose(4000 + k, 40)}")
    items += ["zq1 zq2 zq3", "zq9"]
    texts += ["a zq1 zq2 zq3 b", "a zq1 zq2 b", "zq9", "zq9 zq9x"]
    number: dict[str, int] = {}
    code = [[np.array([number.setdefault(x, len(number)) for x in words_of(t)]) for t in some] for some in (items, texts)]
    for i, a in enumerate(code[0]):
        best, _ = decontaminate.align([a] * len(texts), code[1])
        pairs |= {(d, i) for d, x in enumerate(best.tolist()) if x >= max(len(a), 2 * min(len(a), 8))}  # half the item, and 8 words of it or all
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contamination(make_docs(spark, texts), bench).collect()}
    assert got == pairs and {(60, 60), (62, 61), (63, 61)} <= pairs and len(pairs) > 40


def test_contamination_in_blocks(spark, prose, monkeypatch):
    items = [prose(900 + k, 40) for k in range(8)]
    docs = make_docs(spark, [prose(k, 50) + " " + items[k] for k in range(8)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 250)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == {(k, k) for k in range(8)}


def brute_repeats(texts, n=200):
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[1 + i : 1 + i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats(spark, prose, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CORE", hot)
    p = prose(1, 60)
    texts = [prose(k, 100) for k in range(10)] + [prose(20 + k, 30) + p + prose(40 + k, 30) for k in range(12)] + ["a" * 700, "a" * 250 + "b", "ab" * 300, p[:199], "x" + p[:199], p[:200], "y" + p[:200] + "z", "é" * 150, "éé" * 150, "", None]
    texts += [edited(prose(3, 150), 0.02, k) for k in range(5)] + [prose(60, 20) + p[40:300] + prose(61, 50) + p[100:350]]
    docs = make_docs(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs).collect()}
    want = brute_repeats(texts)
    assert [got[k] for k in range(len(texts))] == want


def test_repeats_in_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 300)
    p = prose(1, 80)
    texts = [prose(5, 300) + p, p + prose(6, 300), prose(5, 300)]
    rows = []
    for k, t in enumerate(texts):
        for part in repeats.runs(np.frombuffer(t.encode(), np.uint8)):
            rows += [(k, int(s), int(n)) for s, n in zip(part[0], part[1], strict=True)]
    for k, t in enumerate(texts):  # runs cover each start once
        assert sum(n for d, _, n in rows if d == k) == len(t) - 199


def test_repeats_odd_rows(spark, odd, prose):
    assert repeats.digest(odd).filter("n_removed = 0").count() == 7 and repeats.digest(odd.limit(0)).count() == 0
    one = make_docs(spark, [prose(1, 100)])
    assert repeats.digest(one).first().n_removed == 0
    assert all(r.n_removed == r.n_bytes for r in repeats.digest(one.unionByName(one)).collect())


TEXTS = ["hello world", "", None, " two  spaces\n\ttab", "▁literal▁ mark", "日本語 テキスト 😀", "naïve café", "x" * 500, "a\u00a0b\u2028c", "<0x0A> </s> <unk>"]


def test_pieces_are_lossless(spark):
    docs = make_docs(spark, TEXTS)
    coded = pieces.encode(docs)
    got = {r.doc_id: r for r in pieces.decode(coded).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].text == t and got[k].lossless and got[k].n_pieces == len(got[k].piece_ids or [])


def test_pieces_do_not_depend_on_partitions(spark, prose):
    docs = make_docs(spark, [prose(k, 50) for k in range(40)])
    one = {r.doc_id: r.piece_ids for r in pieces.encode(docs.coalesce(1)).collect()}
    two = {r.doc_id: r.piece_ids for r in pieces.encode(docs.repartition(4)).collect()}
    assert one == two and one != {r.doc_id: r.piece_ids for r in pieces.encode(docs, seed=1).collect()}


def test_pieces_follow_the_weights():
    v = pieces.Vocabulary(pieces.default_model())
    s = pieces.Sampler(v, 1.0)

    def ways(chunk, i=0):
        if i == len(chunk):
            yield (), 1.0
        for j in range(i + 1, len(chunk) + 1):
            if chunk[i:j] in v.pieces:
                code, rank = v.pieces[chunk[i:j]]
                for rest, w in ways(chunk, j):
                    yield (code, *rest), w / (pieces.RANK0 + rank)

    n = 20_000
    ids, counts = s.sample([" hello"] * n, np.arange(n, dtype=np.uint64))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[z - c : z].tolist()) for z, c in zip(ends, counts, strict=True))
    every = list(ways(" hello"))
    total = sum(w for _, w in every)
    assert sum(got[x] for x, _ in every) == n and max(abs(got[x] / n - w / total) for x, w in every) < 0.015


def marginals(v, text):
    """Share of all segmentations' weight that has a border at each place, by plain sums in both directions."""
    n, weight = len(text), lambda a, z: 1 / (pieces.RANK0 + v.pieces[text[a:z]][1]) if text[a:z] in v.pieces else 0.0
    log = lambda x: np.log(x) if x else -np.inf
    ahead, back = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
    for z in range(1, n + 1):
        for a in range(max(0, z - v.longest), z):
            ahead[z] = np.logaddexp(ahead[z], ahead[a] + log(weight(a, z)))
    for a in range(n - 1, -1, -1):
        for z in range(a + 1, min(n, a + v.longest) + 1):
            back[a] = np.logaddexp(back[a], back[z] + log(weight(a, z)))
    return np.exp(np.array(ahead) + np.array(back) - ahead[n])


def test_pieces_of_a_long_word_follow_the_weights():
    v = pieces.Vocabulary(pieces.default_model())
    s = pieces.Sampler(v, 1.0)
    r = random.Random(6)
    word = " " + "".join(r.choice(["in", "er", "at", "on", "es"]) for _ in range(250))
    ids, counts = s.sample([word] * 4000, np.arange(4000, dtype=np.uint64))
    assert s.size.tolist() == [501]  # a single lattice, cut nowhere
    ends, borders = np.cumsum(counts), np.zeros(len(word) + 1)
    for z, c in zip(ends, counts, strict=True):
        borders[np.cumsum([0, *(len(v.raw[k]) for k in ids[z - c : z])])] += 1
    assert np.abs(borders / 4000 - marginals(v, word)).max() < 0.04


def test_borders_of_chunks_cut_no_piece():
    v = pieces.Vocabulary(pieces.default_model())
    s = pieces.Sampler(v, 1.0)
    every = list(v.pieces)
    s.sample(every, np.arange(len(every), dtype=np.uint64))
    assert set(s.size.tolist()) >= set(map(len, every)) and len(s.first) == len(every)
    whole = s.chunks(pieces._points("".join(every)), np.cumsum([0, *map(len, every[:-1])]), np.array(list(map(len, every))))
    assert all(v.pieces[t][0] in s.code[s.edge[s.first[k] + len(t)] :][:1] for t, k in zip(every, whole, strict=True))


def test_chunks_of_equal_hash_are_told_apart(monkeypatch):
    v = pieces.Vocabulary(pieces.default_model())
    texts = [" some words that stand here", "日本語 and others", "words"]
    want = pieces.Sampler(v, 1.0).sample(texts, np.arange(3, dtype=np.uint64))
    monkeypatch.setattr(pieces, "_chunk_hash", lambda points, begin, size: np.zeros(len(begin), np.uint64))
    got = pieces.Sampler(v, 1.0).sample(texts, np.arange(3, dtype=np.uint64))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_pieces_do_not_depend_on_groups(monkeypatch, prose):
    v = pieces.Vocabulary(pieces.default_model())
    texts = [prose(k, 60) + "é漢 " + "ab" * 300 for k in range(30)]
    seeds = np.arange(30, dtype=np.uint64)
    want = pieces.Sampler(v, 1.0).sample(texts, seeds)
    monkeypatch.setattr(pieces, "BLOCK_CHUNKS", 50)
    monkeypatch.setattr(pieces, "LAYOUT_POSITIONS", 100)
    monkeypatch.setattr(pieces, "KEPT_EDGES", 2000)
    got = pieces.Sampler(v, 1.0).sample(texts, seeds)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_pieces_odd_rows(spark, odd):
    assert pieces.encode(odd).filter("lossless").count() == 7 and pieces.encode(odd.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, prose):
    item = prose(900, 40)
    texts = [prose(k, 100) for k in range(60)] + [prose(1, 100) + " x", prose(70, 30) + " " + item, "write a@b.co " + prose(71, 40)]
    labels = [(k, 0) for k in range(40)]
    for k in range(100, 130):
        texts.append(prose(k, 50) + " vileword nastyterm")
        labels.append((len(texts) - 1, 1))
    make_docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "pieces"]
    got = {r.doc_id: r for r in pieces.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    assert set(got) == {*range(60), 62}
    assert "[EMAIL]" in got[62].text and got[5].text == texts[5]


def test_a_few_common_words_are_no_leak(spark):
    bench = spark.createDataFrame([(1, "the city of london"), (2, "a b c d e f g h i j k l m n o p"), (3, "w x y z")], "item_id long, text string")
    texts = ["an essay on trees, and of london nothing at all", "we saw the City of London", "a b c d and nothing more of it", "q a b c d e f g h q", "w x y"]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(make_docs(spark, texts), bench).collect()}
    assert found == {(1, 1), (3, 2)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(make_docs(spark, texts), bench).collect()) == [0, 2, 4]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_odd_rows(spark, tmp_path, odd, empty):
    """Nulls in every column, repeated rows, columns that clash, and empty tables: repeated rows with words are one document,
    rows without words are kept as they are."""
    full = odd.selectExpr("*", "'en' as lang", "cast(null as string) as source", "cast(null as long) as n_chars", "4 as copies_", "5 as leak_id_", "6 as kept_id_", "7 as toxicity_", "8 as id_", "9 as hash_")
    docs = full.limit(0) if empty else full.unionByName(full.selectExpr("* except (doc_id, text)", "7L as doc_id", "'a longer text that is repeated word for word' as text"))
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([] if empty else [(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pieces.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()
    words = sorted((r.doc_id or -1, r.text) for r in got if (r.text or "").strip())
    assert words == ([] if empty else [(-1, "some words that stand here"), (7, "a longer text that is repeated word for word")])
    assert len(got) == (0 if empty else 2 + 5)
