import json
import random
import re
import time

from pyspark.sql import functions as F

from foliospark.llm import license_scan as L
from foliospark.llm import url_filter as U
from foliospark.llm.queries import URL_RULES, op7_license_scan
from tests.llm.conftest import make_docs


def test_host_and_path():
    cases = {"HTTP://A.Org/x?y#z": ("a.org", "/x"), "a.org/x": ("", ""), "x://": ("", ""), "h://a?b/c": ("a", ""), "h://a#b": ("a", ""), "h://É.org": ("É.org", ""), "a://b/c://d": ("b", "/c://d"), None: ("", "")}
    assert {u: U.split_url(u) for u in cases} == cases


def test_rules(spark):
    urls = ["http://x.example.org/es/1", "http://example.org/en/12", "http://badexample.org/es/", "http://org", "http://a.com/fr/casino", "http://a.com/de/x", "http://spam-farm.net/", "http://a.net/farm/win", "http://a.net/farm/farm", "http://spammy.net", None]
    got = [(r.rule, r.verdict) for r in U.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1), URL_RULES).collect()]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow")]


def test_terms_are_counted_by_the_definition(spark, tmp_path):
    r = random.Random(4)
    bits = [*list(U.STRICT)[:6], *list(U.SOFT)[:12], "x", "É", "9", "WIN", "Bets"]
    urls = ["http://a.net/" + "".join(r.choice(bits) + r.choice(["", "-", ".", "/", "é", "_", "7"]) for _ in range(8)) for _ in range(400)]
    for row in U.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), row.url)
        hits = {t: len(re.findall(f"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in U.STRICT | U.SOFT}
        strict, soft = (sum(hits[t] for t in terms) for terms in (U.STRICT, U.SOFT))
        distinct = sum(hits[t] > 0 for t in U.SOFT)
        assert (row.strict_hits, row.soft_hits, row.soft_distinct) == (strict, soft, distinct), row.url
        assert row.verdict == ("block" if strict or distinct >= 2 else "allow")
        assert abs(row.weight - sum(w for t, w in (U.STRICT | U.SOFT).items() if hits[t]) / 100) < 1e-9
    (tmp_path / "terms").write_text("badterm strict 70\n\nmeh soft 10\n")
    assert U.read_vocabulary(str(tmp_path / "terms")) == ({"badterm": 70}, {"meh": 10})
    assert U.filter_urls(spark.createDataFrame([("u://badterm",)], "url string"), (), *U.read_vocabulary(str(tmp_path / "terms"))).first().weight == 0.7


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("http://a.org/", "mine", 1)], "url string, host string, weight int")
    assert U.filter_urls(df).first().host == "a.org"
    assert U.filter_urls(df.limit(0), URL_RULES, (), ()).count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Words, base places and uncontained detections by plain loops."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(low)
    base = sorted((k, label) for phrase, label in L.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    norm = " " + " ".join(words) + " "
    found = []
    for label, priority, confidence, keyword, rx in L.rules():
        if keyword in norm:
            for m in re.finditer(f" (?:{rx})(?= )", norm):
                a = norm[: m.start()].count(" ")
                found.append((a, -(a + m[0].count(" ")), priority, label, confidence))
    outer = [d for d in sorted(found) if not any((e[0] <= d[0] and e[1] <= d[1]) and (e[0], e[1]) != (d[0], d[1]) or (e[0], e[1]) == (d[0], d[1]) and e < d for e in found)]
    rank = lambda d: (d[2], d[0] + d[1], d[0])
    kept = [d for d in outer if not any(e[0] < -d[1] and d[0] < -e[1] and rank(e) < rank(d) for e in outer)]
    return len(words), base, kept


def test_scan_is_the_loop(spark, prose):
    bits = ["This is under the MIT License.", "Licensed under the Apache License, Version 2.0!", "GNU Lesser General Public License v3", "SPDX-License-Identifier: MIT", "mit\n--license", "All rights reserved. Copyright (c) 2020 X", "GENERAL PUBLIC  LICENSE", "BSD 3-Clause License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "summit license", "mit licensed", "MIT LİCENSE", "mit license mit license"]
    texts = [f"{prose(k, 20)} {b} {prose(k + 99, k % 7)} {bits[(k * 5) % len(bits)]}" for k, b in enumerate(bits * 3)] + ["", None, "no licence here", "MIT License", "\x00é mit license ÉÉ"]
    docs = make_docs(spark, texts)
    got = {r.doc_id: r for r in L.scan_licenses(docs).collect()}
    for k, t in enumerate(texts):
        n, base, kept = brute(t)
        assert got[k].n_words == n
        assert sorted(got[k].base) == [p for p, _ in base]
        assert [(d.start, d.stop, d.label) for d in got[k].detections] == [(a, -z, label) for a, z, _, label, _ in kept], t
        assert got[k].labels == sorted({label for _, label in base} | {d[3] for d in kept})


def test_priority_settles_what_overlaps_in_part(spark, monkeypatch):
    monkeypatch.setattr(L, "rules", lambda: [("a", 1, 1.0, "one two", "one two three"), ("b", 2, 1.0, "three four", "three four license"), ("c", 1, 1.0, "license five", "license five six seven"), ("d", 1, 1.0, "seven eight", "seven eight license")])
    texts = ["one two three four license five six seven eight license", "three four license x one two three", "license five six seven eight license"]
    got = {r.doc_id: [(d.start, d.stop, d.label) for d in r.detections] for r in L.scan_licenses(make_docs(spark, texts)).collect()}
    assert got == {0: [(0, 3, "a"), (4, 8, "c")], 1: [(0, 3, "b"), (4, 7, "a")], 2: [(0, 4, "c")]}


def test_many_hits_in_one_text(spark):
    """100,000 places of a phrase: the work is in proportion to the text."""
    began = time.time()
    r = L.scan_licenses(make_docs(spark, ["mit license x " * 100_000])).select("n_words", F.size("base").alias("b"), F.size("detections").alias("d"), F.array_max("base").alias("last")).first()
    assert tuple(r) == (300_000, 100_000, 100_000, 299_997)
    assert time.time() - began < 60


def test_keywords_lose_nothing(spark, monkeypatch):
    texts = ["Licensed under the X11 License", "SPDX-License-Identifier: Expat", "the expat license, x11 licence and MIT license"]
    names = [n for _, _, names, _ in L.FAMILIES for n in re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", names).split("|")]
    texts += [f"released under the {n} license. SPDX-License-Identifier: {n}" for n in names]
    got = {r.doc_id: r for r in L.scan_licenses(make_docs(spark, texts)).collect()}
    every = [(label, priority, confidence, "", rx) for label, priority, confidence, _, rx in L.rules()]
    monkeypatch.setattr(L, "rules", lambda: every)
    for k, t in enumerate(texts):
        assert [(d.start, d.stop, d.label) for d in got[k].detections] == [(a, -z, label) for a, z, _, label, _ in dict.fromkeys(brute(t)[2])], t
    assert [(got[k].labels, got[k].score) for k in range(2)] == [(["mit"], 0.95), (["mit"], 1.0)]


def test_hundreds_of_rules_compile():
    rules = L.rules()
    assert len(rules) >= 200 and all(re.compile(r[4]) for r in rules) and json.dumps(rules)


def test_each_signature_finds_its_sentence(spark):
    lines = [(label, re.sub(r"\(\?:([^|()]*)(?:\|[^()]*)?\)(?:\?|\{[0-9,]+\})?", r"\1", rx).replace("[^ ]+", "somebody").replace("[sc]", "s").replace("  ", " ").strip()) for written in (L.SIGNATURES, L.NOTICES) for label, rxs in written.items() for rx in rxs]
    assert len({t for _, t in lines}) + len(L.SENTENCES) >= 200
    got = {r.doc_id: r for r in L.scan_licenses(make_docs(spark, [f"Some words. {t.capitalize()}; and more" for _, t in lines])).collect()}
    for k, (label, text) in enumerate(lines):
        assert label in got[k].labels, (label, text)


def test_odd_rows(spark, odd, tmp_path):
    got = L.scan_licenses(odd)
    assert got.count() == 7 and got.filter(F.size("labels") > 0).count() == 0 and L.scan_licenses(odd.limit(0)).count() == 0
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    plan = op7_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
