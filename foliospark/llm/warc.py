r"""WARC archives: a Spark data source that reads them, and a job that writes them.

Reading (format "warc"): the driver lists the archives under the given path and packs them into partitions by size.
A task reads the headers of a record first. Filters on record_type and on header columns that Spark pushes down
are tried on these, and what they reject is skipped: an uncompressed block is passed over by its Content-Length, a
gzip member by the length that its "sl" extra field states (Annex D of the format), and inflated without being
decoded only where there is no such field. A member may hold any number of records; all are read. With option payload=false no payload is decoded at all.

Each partition is a set of whole files, so a lost task reads its files again; an archive is never split, as a payload may
hold what looks like the start of a record. Archives that are cut off, blocks shorter
than their Content-Length, and records without a version line end their file with an error naming it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from io import BufferedReader

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from foliospark.llm.common import new_folder, scratch, small_batches

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_type string, block_length long, headers map<string,string>, http_status int, payload binary"
#: Columns that filters can be pushed on, and the header each is read from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: Bytes of an archive that are asked for at once; headers and short records are then read from memory.
READ_BYTES = 256 << 10
#: Pages with equal payloads are dealt over so many tasks.
SALTS = 16
#: Archives are given this date unless the caller has another, so that writing twice gives equal bytes.
DATE = "2000-01-01T00:00:00Z"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:", path) else (pafs.LocalFileSystem(), path)


# --- one record ------------------------------------------------------------------------------------------------


def encode_record(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """A record, as a gzip member of its own that states its length, or plain."""
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    plain = b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return plain
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(plain) + z.flush()
    # header of 10 bytes, length of the extra field, subfield sl with 8 bytes, data, and the 8 bytes that end a member
    size = 10 + 2 + 4 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(plain) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            out[last := k.strip().lower()] = v.strip()
    return out


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """Status and payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\S+ (\d{3})", head)
    return (int(status[1]), body) if gap and status else (None, block)


def records(f, wanted, skip) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record whose headers are wanted. skip(headers): the block is not needed (None)."""
    while head := f.read(2):
        if head == b"\x1f\x8b":
            yield from _member(f, wanted, skip)
        elif head.strip():
            raw = head + f.readline()
            while not raw.endswith((b"\r\n\r\n",)):
                if not (line := f.readline()):
                    raise ValueError("cut off in the headers of a record")
                raw += line
            headers = parse_headers(raw[:-4])
            length = int(headers["content-length"])
            if not wanted(headers) or skip(headers):
                f.seek(length, 1)
                block = None
            elif len(block := f.read(length)) < length:
                raise ValueError("cut off in the block of a record")
            if wanted(headers):
                yield headers, block


class Inflated:
    """The plain bytes of one gzip member, as they are asked for."""

    def __init__(self, f):
        self.f, self.z, self.held = f, zlib.decompressobj(31), b""
        self.passed, self.asked = 0, 2048  # plain bytes handed out, file bytes to read next

    def fill(self) -> bool:
        if self.z.eof:
            return False
        if not (chunk := self.z.unconsumed_tail or self.f.read(self.asked)):
            raise ValueError("cut off in a gzip member")
        self.asked = 65536
        self.held += self.z.decompress(chunk, 1 << 20)
        return True

    def head(self) -> bytes | None:
        """Headers of the next record, None behind the last."""
        while not (rest := self.held.lstrip(b"\r\n")):
            self.passed += len(self.held)
            self.held = b""
            if not self.fill():
                return None
        self.passed += len(self.held) - len(rest)
        self.held = rest
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                raise ValueError("cut off in the headers of a record")
        head, self.held = self.held[:at], self.held[at + 4 :]
        self.passed += at + 4
        return head

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes, or None when they are not kept."""
        parts, left = [], n
        while left:
            if not self.held and not self.fill():
                raise ValueError("cut off in the block of a record")
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        self.passed += n
        return b"".join(parts) if keep else None


def _member(f, wanted, skip) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """All records of a gzip member. One that has a single record is passed over by its stated length once that is
    not needed."""
    start = f.tell() - 2
    fixed = f.read(8)
    length = plain = None
    if len(fixed) == 8 and fixed[1] & 4:
        extra = f.read(struct.unpack("<H", f.read(2))[0])
        if extra[:2] == b"sl" and len(extra) >= 12:
            length, plain = struct.unpack("<II", extra[4:12])
    f.seek(start)
    data = Inflated(f)
    while (head := data.head()) is not None:
        headers = parse_headers(head)
        size = int(headers["content-length"])
        take = wanted(headers)
        need = take and not skip(headers)
        if not need and length is not None and (data.passed + size + 4) & 0xFFFFFFFF == plain:
            f.seek(start + length)
            if take:
                yield headers, None
            return
        block = data.take(size, need)
        if take:
            yield headers, block
    f.seek(-len(data.z.unused_data), 1)


# --- data source -----------------------------------------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
                continue
            values = set(f.value if isinstance(f, In) else [f.value])
            self.allowed[column] = self.allowed.get(column, values) & values

    def partitions(self) -> list[InputPartition]:
        system, root = open_fs(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        packs: list[list[str]] = []
        room = 0
        for x in sorted((x for x in found if re.search(r"\.warc(\.gz)?$", x.path)), key=lambda x: x.path):
            if not packs or x.size > room:
                packs.append([])
                room = self.size
            packs[-1].append(x.path)
            room -= x.size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        allowed = {HEADERS[c]: v for c, v in self.allowed.items()}
        wanted = lambda h: all(h.get(k) in v for k, v in allowed.items())
        skip = lambda h: not self.payload
        system, _ = open_fs(self.root)
        rows, size = [], 0
        for path in partition.paths:
            with BufferedReader(system.open_input_file(path), READ_BYTES) as raw:
                try:
                    for headers, block in records(raw, wanted, skip):
                        rows.append(self.row(headers, block))
                        size += len(block or b"") + 500
                        if size > BATCH_BYTES:
                            yield self.batch(rows)
                            rows, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        yield self.batch(rows)

    def row(self, h: dict[str, str], block: bytes | None) -> tuple:
        status, payload = (None, None) if block is None else split_http(block) if h.get("content-type", "").startswith("application/http") else (None, block)
        return (*(h.get(HEADERS[c]) for c in HEADERS), int(h["content-length"]), list(h.items()), status, payload)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        s = pa.string()
        kinds = [s] * 7 + [pa.int64(), pa.map_(s, s), pa.int32(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        names = [*HEADERS, "block_length", "headers", "http_status", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under path. Python filter pushdown is turned on for the session, as the source lives by it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# --- writing ---------------------------------------------------------------------------------------------------


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _archive(folder: str, compress: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        # each attempt has a file of its own, which only then gets its name: a task that died leaves no archive
        name = f"{root}/{uuid.uuid4().hex}"
        n = size = 0
        with system.open_output_stream(f"{name}.part", compression=None) as out:
            for b in batches:
                for page_id, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    digest = sha1_base32(payload)
                    headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
                    if url is not None:
                        headers["WARC-Target-URI"] = re.sub(r"[\r\n]", " ", url)
                    headers["Content-Type"] = "application/http; msgtype=response"
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    if refers is None:
                        block += payload
                    else:
                        headers |= {"WARC-Refers-To": f"<urn:page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
                    out.write(record := encode_record(headers, block, compress))
                    n, size = n + 1, size + len(record)
        if n:
            system.move(f"{name}.part", final := f"{name}.warc{'.gz' * compress}")
            yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])
        else:
            system.delete_file(f"{name}.part")

    return write


def write_warc(pages: DataFrame, min_payload: int = 0, compress: bool = True) -> tuple[str, DataFrame]:
    """Write a record for each page (page_id, url, html); the folder, and its manifest (path, n_records, n_bytes).

    Of pages with equal payloads of at least min_payload bytes, that with the smallest page_id is written whole, the
    others as revisits of it. Null html is an empty payload. Null page_ids come last; repeated rows of a response
    are responses too. Only digests are shuffled to find equal payloads; copies are counted before that.
    Only archives that the manifest names belong to the result: a task that ran twice leaves a second file, which
    is removed here.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "warc")
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    shared = slim.filter(F.col("n") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    shared = scratch(shared.filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).drop("copies"), "warc-shared")
    # pages of one digest are dealt over SALTS tasks, and its row goes to each of them
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = slim.filter(F.col("n") >= min_payload).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = dealt.join(salted, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first_id").alias("refers_to")).distinct()
    whole = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    typed = whole.join(revisits, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    manifest = scratch(
        typed.select("page_id", "url", "payload", "refers_to").mapInArrow(_archive(folder, compress), "path string, n_records long, n_bytes long"), "warc-manifest"
    )
    named = {r["path"] for r in manifest.select("path").toLocalIterator()}  # one row a task
    for x in system.get_file_info(pafs.FileSelector(root)):
        if x.path not in named:
            system.delete_file(x.path)
    return folder, manifest


@F.pandas_udf(StringType())
def _base32(payloads: pd.Series) -> pd.Series:
    return payloads.map(sha1_base32, na_action="ignore")


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives say of each page; of responses, length and digest are those of the payload that was read."""
    both = read_warc(spark, folder)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    response = both.filter(F.col("record_type") == "response").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), _base32("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    revisit = read_warc(spark, folder, payload=False).filter(F.col("record_type") == "revisit").select(
        number("record_id").alias("page_id"), F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.regexp_extract("payload_digest", "^sha1:(.*)$", 1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )
    return response.unionByName(revisit)
