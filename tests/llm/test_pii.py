import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import pii
from tests.llm.conftest import make_docs


def plain_base(text):
    """The definition, word for word, by the patterns themselves."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_is_the_definition():
    import random

    r = random.Random(3)
    for k in range(3000):
        alphabet = "ab1.@+- ()29%_é" if k % 2 else "0123456789. -+@a"
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert pii.find_base(text) == plain_base(text), text
    for text in ("a@b.c@d.e", "@d.e@f.g", "x 4111 1111 1111 1111 y", "1.2.3.4.5.6.7.8", "+1 (202) 555-0100.", "a@b", "256.1.1.1", "a.b@c-d.e.f.", "001.002.003.004"):
        assert pii.find_base(text) == plain_base(text), text


def test_long_runs_are_linear():
    assert pii.find_base("a" * 300_000 + "1" * 300_000 + "@") == []


def test_disclosing_terms(spark, prose):
    texts = [f"{prose(k, 40)} Zorblax Quuxington write to boss{k % 4}@corp.com now {prose(k + 500, 40)}" if k % 4 == 0 else prose(k, 90) for k in range(80)]
    docs = make_docs(spark, texts)
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for k in range(0, 80, 4):
        named = {texts[k][s.start : s.stop] for s in got[k].spans}
        assert {"boss0@corp.com", "Zorblax", "Quuxington"} <= named
    assert all(not got[k].spans for k in range(80) if k % 4)
    red = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "Zorblax" not in red[0].text and "[EMAIL]" in red[0].text and red[0].n_chars == len(red[0].text)
    assert red[1].text == texts[1] and red[1].source == "src1"


def test_disclosing_terms_far_from_the_match(spark, prose):
    # the name in the first line, the address in the last, and the name once more after it
    texts = [f"Zorblax {prose(k, 60)} write to boss@corp.com {prose(k + 500, 60)} zorblax" if k % 8 == 0 else prose(k, 120) for k in range(80)]
    docs = make_docs(spark, [*texts, texts[0]])
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for k in [*range(0, 80, 8), 80]:
        text = texts[k % 80]
        assert {0, len(text) - 7} <= {s.start for s in got[k].spans} and [s.kind for s in got[k].base] == [0]
    assert "zorblax" not in " ".join(r.text.lower() for r in pii.redact(docs).collect())


def brute_disclosures(texts):
    """(term, entity) -> disclosure by the definition, of pairs in MIN_DOCS documents."""
    docs = []
    for text in texts:
        spans = plain_base(text)
        docs.append(({pii.entity_of(text[a:z], k) for a, k, z in spans}, {m[0].lower() for m in re.finditer(r"[^\W\d_]+", text) if len(m[0]) >= 3 and not any(a < m.end() and m.start() < z for a, _, z in spans)}))
    n, out = len(docs), {}
    for e in {e for es, _ in docs for e in es}:
        of_e = [ts for es, ts in docs if e in es]
        for t in {t for ts in of_e for t in ts}:
            both, single = sum(t in ts for ts in of_e), sum(t in ts for _, ts in docs)
            if both >= pii.MIN_DOCS and len(of_e) < n:
                out[t, e] = np.log2(n * both / (single * len(of_e))) / np.log2(n / len(of_e))
    return out


@pytest.mark.parametrize("sent", [200_000, 1])
def test_disclosures_are_those_of_the_definition(spark, prose, monkeypatch, sent):
    monkeypatch.setattr(pii, "MAX_SENT_TERMS", sent)
    r = random.Random(11)
    names = ["İstanbul", "Zorblax", "Quux", "boss", "ΟΔΟΣ", "ßtraße"]
    texts = []
    for k in range(60):
        t = prose(k, 12).split()
        for j in range(4):
            if r.random() < 0.4:
                t.insert(r.randrange(len(t)), f"boss{j}@corp.com")
                t.insert(r.randrange(len(t)), names[j] if r.random() < 0.9 else names[-1])
        if k % 10 == 0:
            t += ["a@b.co", "c@d.eu", "Quartett"]
        texts.append(" ".join(t))
    docs = make_docs(spark, texts)
    found = pii.detect(docs)
    want = brute_disclosures(texts)
    group = {r.entity: r.group for r in pii.entity_groups(found).collect()}
    assert group["email:c@d.eu"] == group["email:a@b.co"] == "email:a@b.co"
    got = {(r.term, r.entity): r.disclosure for r in pii.disclosures(docs, found)[0].collect()}
    assert got.keys() == {(t, group[e]) for t, e in want} and all(abs(got[t, group[e]] - x) < 1e-9 for (t, e), x in want.items())
    for row in pii.sanitise(docs).collect():
        text = texts[row.doc_id]
        held = {group.get(pii.entity_of(text[a:z], k)) for a, k, z in plain_base(text)}
        most = {}
        for t, s, e in pii.outside_terms(text, plain_base(text)):
            top = max((want.get((t, x), 0) for x in held), default=0)
            if top >= pii.GENERALISE:
                most[s, e] = "removed" if top >= pii.REMOVE else "generalised"
        assert {(x.start, x.stop): pii.ALL_KINDS[x.kind] for x in row.spans if x.kind > 3} == most


def test_very_many_entities_in_one_text(spark):
    text = " ".join(f"user{k}@host{k % 7}.org word{chr(97 + k % 26)}" for k in range(40_000))
    docs = make_docs(spark, [text, text, text, "short", "other"])
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(pii.sanitise(docs)).collect()}
    assert got[0].n_email == 40_000 and got[0].spans == got[2].spans and got[4].spans == ""
    assert time.time() - began < 60


def test_generalised_terms_keep_their_class():
    spans = [(0, 4, 4), (5, 4, 12), (13, 4, 17), (18, 5, 22)]
    assert pii.mask("ACME Zorblax word gone", spans) == "[ACRONYM] [NAME] [WORD] "


def test_terms_outside_matches():
    import random

    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("abc de@.1+") for _ in range(40))
        spans = pii.find_base(text)
        want = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text) if len(m[0]) >= 3 and not any(a < m.end() and m.start() < b for a, _, b in spans)]
        assert list(pii.outside_terms(text, spans)) == want


def test_digest(spark):
    docs = make_docs(spark, ["mail a@b.co or 10.0.0.1", None, ""])
    got = {r.doc_id: r for r in pii.digest(pii.sanitise(docs)).collect()}
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:11,ip:15:23").hexdigest() and (got[0].n_email, got[0].n_ip) == (1, 1)
    assert got[1].base_sha256 == got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""


def test_odd_rows(spark, odd):
    assert pii.digest(pii.sanitise(odd)).count() == 7
    assert pii.sanitise(odd.limit(0)).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == 7 and out.filter(F.col("text").isNull()).count() == 2


def test_mask_joins_overlaps():
    assert pii.mask("0123456789", [(1, 0, 4), (3, 2, 6), (8, 5, 9)]) == "0[EMAIL]679"
