"""The broker dimension as tables gives what it gives as plan literals."""

import json
import random

from foliospark.functions.metadata import ALIAS_GROUPS, BROKER_SKIP, alias_map
from foliospark.operators import brokers, state
from foliospark.sources import files as S


def dims(spark, tmp_path, skip, groups):
    (tmp_path / "settings.json").write_text(json.dumps({"brokerSkipMap": skip, "brokerAliasGroups": groups}, ensure_ascii=False))
    return S.load_broker_dims(spark, str(tmp_path / "settings.json"))


def names(n):
    r = random.Random(5)
    pieces = ["JPM", "jpm", "KGI", "kgi260215", "MS20260215", "凱基", "凱基(法說memo)", "元大", "元", "元大投顧", "國泰金控", "2330", "20260215", "1150215", "260215", "AAPL", "CITI", "Citi", "memo", "產業", "台積電", "", " ", "PDF", "report2026", "12345678901"]
    out = []
    for _ in range(n):
        mark = r.choice(["_", "-", "|", "｜", " ", ""])
        out.append(mark.join(r.choice(pieces) for _ in range(r.randrange(1, 6))) + r.choice([".pdf", ".PDF", ""]))
    return out + ["2026_2330_20260215F04_20260215_193139.pdf", "凱基260215.pdf", "kgi260215.pdf", "", ".pdf"]


def test_joins_are_the_literals(spark, tmp_path):
    rows = [(str(k), n, 3, "application/pdf" if k % 7 else "text/plain") for k, n in enumerate(names(300))]
    files = spark.createDataFrame(rows, "file_id string, name string, num_pages int, mime string")
    groups = [*ALIAS_GROUPS, "JPM, JPMorgan", "元大, 元大投顧，元", "Apple, AAPL"]
    skip, aliases = dims(spark, tmp_path, BROKER_SKIP, groups)
    got = {r.file_id: tuple(r) for r in brokers.ingest_files(files, skip, aliases).collect()}
    want = {r.file_id: tuple(r) for r in state.ingest_files(files, list(BROKER_SKIP), alias_map(groups)).collect()}
    assert got == want
    assert len({t[6] for t in got.values()}) > 10


def test_empty_dimension(spark, tmp_path):
    files = spark.createDataFrame([("1", "JPM_2330_x.pdf", 3, "application/pdf")], "file_id string, name string, num_pages int, mime string")
    skip, aliases = dims(spark, tmp_path, {}, [])
    assert tuple(brokers.ingest_files(files, skip, aliases).first())[5:] == ("2330", "x", "x")
