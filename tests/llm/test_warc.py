import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(k, f"http://h/{k}", ["same", "", "épreuve" * k, None][k % 4]) for k in range(40)]
    folder, manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3))
    assert manifest.agg(F.sum("n_records")).first()[0] == 40
    got = {r.page_id: r for r in warc.page_records(spark, folder).collect()}
    first = {}
    for k, _, html in rows:
        first.setdefault(html or "", k)
    for k, _, html in rows:
        data = (html or "").encode()
        assert got[k].payload_bytes == len(data)
        assert got[k].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if first[html or ""] == k else ("revisit", first[html or ""]))


def test_least_payload(spark):
    folder, _ = warc.write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES), min_payload=5)
    assert sorted((r.page_id, r.record_type) for r in warc.page_records(spark, folder).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


@pytest.mark.parametrize("compress", [True, False])
def test_filters_and_skipping(spark, compress):
    rows = [(k, f"http://h/{k}", "x" * 1000 if k % 2 else f"y{k}") for k in range(20)]
    folder, _ = warc.write_warc(spark.createDataFrame(rows, PAGES), compress=compress)
    df = warc.read_warc(spark, folder)
    assert df.filter("record_type = 'revisit'").count() == 9
    assert df.filter("target_uri in ('http://h/4', 'http://h/6')").select("payload").collect()[0]["payload"][:1] == b"y"
    assert df.filter("record_type = 'response' and http_status = 200").count() == 11
    lean = warc.read_warc(spark, folder, payload=False)
    assert lean.filter("payload is null").count() == 20 and lean.filter("block_length > 1000").count() == 1


def test_foreign_gzip_without_lengths(spark, tmp_path):
    a = warc.encode_record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:a>", "Folded": "one\r\n two"}, b"A" * 5000, compress=False)
    b = warc.encode_record({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:b>"}, b"B" * 10, compress=False)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    df = warc.read_warc(spark, str(tmp_path))
    assert [bytes(r.payload) for r in df.filter("record_type = 'metadata'").collect()] == [b"B" * 10]
    row = df.filter("record_type = 'resource'").first()
    assert bytes(row.payload) == b"A" * 5000 and row.headers["folded"] == "one two"


def test_cut_off_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.encode_record({"WARC-Type": "resource"}, b"A" * 50, compress=False)[:60])
    with pytest.raises(Exception, match="x.warc: cut off in the block"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None), (1, None, "a"), (1, None, "a"), (2, "u\r\nv", "a")], PAGES).withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit(2))
    folder, _ = warc.write_warc(odd)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.page_records(spark, folder).collect())
    assert got == [(-1, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    folder, _ = warc.write_warc(odd.limit(0))
    assert warc.page_records(spark, folder).count() == 0


def test_member_with_several_records(spark, tmp_path):
    plain = [warc.encode_record({"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>"}, body, compress=False) for kind, body in (("warcinfo", b"i" * 3000), ("resource", b"\r\n\r\nA" * 40000), ("metadata", b"last"))]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(plain)) + gzip.compress(plain[2]))
    df = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_type, len(r.payload)) for r in df.collect()) == [("metadata", 4), ("metadata", 4), ("resource", 200000), ("warcinfo", 3000)]
    assert [bytes(r.payload) for r in df.filter("record_type = 'metadata'").collect()] == [b"last"] * 2
    # the stated length of a member is that of one record; with more in it the others are read all the same
    size = len(plain[0]) + len(plain[2])
    own = warc.encode_record({"WARC-Type": "warcinfo"}, b"x" * (size - 100), compress=True)
    (tmp_path / "y.warc.gz").write_bytes(own[:12] + own[12:])
    assert warc.read_warc(spark, str(tmp_path)).filter("record_type = 'warcinfo'").count() == 2


@pytest.mark.parametrize("compress", [True, False])
def test_short_block_is_an_error(spark, tmp_path, compress):
    raw = warc.encode_record({"WARC-Type": "resource"}, b"A" * 14, compress=False).replace(b"Content-Length: 14", b"Content-Length: 9999")
    (tmp_path / f"x.warc{'.gz' if compress else ''}").write_bytes(gzip.compress(raw) if compress else raw)
    with pytest.raises(Exception, match="cut off in the block of a record"):
        warc.read_warc(spark, str(tmp_path)).collect()
