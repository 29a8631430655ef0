"""WARC archives: writing pages as records, reading them back, reassembling segments (operator 10).

Writing. A page's payload is its text in UTF-8. Among payloads of at least ``REVISIT_BYTES`` bytes that are equal, the page
of smallest id is stored and the others become revisit records that refer to its record. A response's block is an HTTP
message in chunked transfer framing; a block over ``segment_bytes`` is cut into a first record and continuation records.
Each record is a gzip member of its own, and each file, a .warc.gz, begins with a warcinfo record and holds a bounded number of
records, so a file fits a task. A task writes its files under hidden names; when all have ended, the files of the attempts that count
get their own names, and those of attempts that were lost stay hidden, which no reader looks at. A row that repeats very often is
numbered copy by copy in blocks, in as many tasks as there are blocks.

Reading. Files are parsed member by member, records by Content-Length. Records of a segmented block are grouped by the origin's
identifier and put in order of segment number; the numbers must be 1 to n, and the last one's total length must be that of
what was put together. Then the chunked framing is decoded, and the payload's digest is compared with the record's.

Defined results: a null page is an empty payload; a long page is segmented; repeated rows are records of their own (those of
smallest id are all responses); rows without page_id revisit the first page that has one, else are responses; an empty
table gives an archive without records; a record that is cut off or broken comes back with ``intact`` false and what could be
read of it, and those after it are read on; white space and control characters in URLs are percent-encoded; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from callmark.llm.common import few, materialise, name, slices, table, whole, work_dir

REVISIT_BYTES = 100
SEGMENT_BYTES = 65_536
#: Copies of a row that one task numbers and writes.
COPIES_PER_BLOCK = 1_000
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 2_000
MOST_REPEATED = 1_000_000
VERSION, CRLF, MAGIC = b"WARC/1.1", b"\r\n", b"\x1f\x8b\x08"

RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()),
                    ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()), ("sound", pa.bool_())])
RECORD_DDL = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, origin_id string, segment int, total_length long, block binary, sound boolean"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record, as a gzip member. White space and control characters in a header's value are percent-encoded."""
    value = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    lines = [VERSION, *(f"{k}: {value(v)}".encode() for k, v in headers if v is not None), f"Content-Length: {len(block)}".encode()]
    whole_ = CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(whole_) + packer.flush()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def urn(key: str) -> str:
    """A record's identifier, from what tells it from others."""
    h = hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_records(key: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> list[bytes]:
    """key names the response's record; refers_to the key of the one that a revisit refers to."""
    common = [("WARC-Record-ID", urn(key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http)]
    block = http + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(f"{key}/{n}")), ("WARC-Date", date), ("WARC-Segment-Origin-ID", urn(key)), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
    return out


def members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """(content, whole and sound) of each gzip member; after a broken one the next that begins is looked for."""
    at = data.find(MAGIC)
    while 0 <= at < len(data):
        unpacker, out, end, sound = zlib.decompressobj(31), [], at, True
        try:
            while not unpacker.eof and end < len(data):
                part = data[end : end + 65_536]
                out.append(unpacker.decompress(part))
                end += len(part) - len(unpacker.unused_data)
            sound = unpacker.eof
        except zlib.error:
            sound = False
        yield b"".join(out), sound
        at = data.find(MAGIC, end if sound else at + 1)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bool] | None:
    """(headers by lower-case name, block, is it as its headers say) of a record; None where no record begins."""
    head, gap, rest = content.partition(CRLF + CRLF)
    if not head.startswith(VERSION):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = headers.get("content-length", "")
    n = int(size) if size.isascii() and size.isdigit() else len(rest)
    return headers, rest[:n], bool(gap) and size.isascii() and size.isdigit() and rest[n:] == CRLF + CRLF


def _key(copy: Column | int) -> Column:
    """What tells a record from all others: page, address, payload, and which of equal rows it is."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat_ws("|", text("page_id"), text("url"), "digest", F.lit(copy).cast("string") if isinstance(copy, int) else copy.cast("string"))


def in_blocks(several: DataFrame) -> DataFrame:
    """A row for each of the n copies of a row, with its number as copy; dealt by blocks of copies before they are made."""
    blocks = several.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_PER_BLOCK)))).repartition("same", "block")
    first = F.col("block") * COPIES_PER_BLOCK
    return blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES_PER_BLOCK, F.col("n")) - 1)))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows of column value, one after another, as files of RECORDS_PER_FILE rows."""

    def __init__(self, path: str, per_file: int):
        self.path, self.per_file = path, per_file

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self.store()
        store.create_dir(base, recursive=True)
        names, out, n = [], None, 0
        for batch in iterator:
            for value in batch.column("value"):
                if n % self.per_file == 0:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{base}/.{names[-1]}", compression=None)
                out.write(value.as_buffer())
                n += 1
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self.store()
        store.create_dir(base, recursive=True)
        for i, name in enumerate(n for m in messages if m for n in m.names):
            store.move(f"{base}/.{name}", f"{base}/part-{i:06d}-{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = self.store()
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{base}/.{name}")


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "callmark_archives"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options["perfile"]))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives below path. Payloads meet their first page by digest; a hot digest's rows are split by the skew join."""
    pages = pages.select(F.col(name(id_col)).cast("long").alias("page_id"), F.col(name(url_col)).cast("string").alias("url"), whole(name(html_col)).alias("html")).withColumn("digest", F.sha2("html", 256)).withColumn("same", F.md5(_key(0)))
    # rows that agree in everything are counted first, so that each copy gets a number of its own
    repeated = materialise(pages.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("same"))
    rows = pages.withColumn("copy", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        repeated = F.broadcast(repeated) if few(repeated, MOST_REPEATED) else repeated
        several = pages.join(repeated, "same", "left_semi").groupBy("same").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html", "digest")), F.count(F.lit(1)).alias("n"))
        rows = rows.join(repeated, "same", "left_anti").unionByName(in_blocks(several).select(*pages.columns, "copy"))
    large = F.octet_length("html") >= REVISIT_BYTES
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = pages.filter(large).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    known = rows.filter(large).join(firsts, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.concat_ws("|", F.col("first.page_id").cast("string"), F.coalesce("first.url", F.lit("none")), "digest", F.lit("0")))
    columns = ["page_id", "url", "html", "digest", _key(F.col("copy")).alias("key")]
    all_pages = known.select(*columns, F.when(F.col("first").isNotNull(), refers).alias("refers_to")).unionByName(rows.filter(~large).select(*columns, F.lit(None).cast("string").alias("refers_to")))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for part in slices(batches):
            out = []
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                key, page_id, url, html, digest, to = row
                for r in page_records(key, date, page_id, url, html.encode(), digest, to, segment_bytes):
                    if n % RECORDS_PER_FILE == 0:  # where the writer begins a file
                        out.append(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn(f"{key}/info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: callmark\r\nformat: WARC File Format 1.1\r\n"))
                        n += 1
                    out.append(r)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    spark = pages.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans and commits the write has no shipped package
    spark.dataSource.register(Archives)
    all_pages.mapInArrow(run, "value binary").write.format("callmark_archives").option("path", path if "://" in path else f"file://{path}").option("perfile", RECORDS_PER_FILE).mode("append").save()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path, but for those that describe the file."""
    number = lambda x: int(x) if x and x.isascii() and x.isdigit() else None

    def row(content: bytes, whole_: bool) -> dict | None:
        headers, block, sound = parse(content) or ({}, content, False)
        get = headers.get
        if get("warc-type") == "warcinfo":
            return None
        page_id = get("warc-page-id") or ""
        return {"record_id": get("warc-record-id"), "record_type": get("warc-type"), "page_id": int(page_id) if re.fullmatch(r"-?\d+", page_id) else None, "url": get("warc-target-uri"),
                "payload_digest": (get("warc-payload-digest") or "").removeprefix("sha256:") or None, "refers_to_id": get("warc-refers-to"), "origin_id": get("warc-segment-origin-id"),
                "segment": number(get("warc-segment-number")), "total_length": number(get("warc-segment-total-length")), "block": block, "sound": whole_ and sound}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for content, sound in members(batch.column("content")[0].as_py()):
                if content and (r := row(content, sound)):
                    rows.append(r)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.filter("length > 0").select("content").mapInArrow(run, RECORD_DDL)


def reassemble(records: DataFrame) -> DataFrame:
    """records without continuations, each block whole; n_segments, and intact: sound, numbers without gap and the total length as told."""
    lone = records.filter("segment IS NULL").withColumns({"n_segments": F.lit(1), "intact": F.col("sound")}).drop("origin_id", "segment", "total_length", "sound")
    origin = F.coalesce("origin_id", "record_id").alias("origin")
    head = ["record_type", "page_id", "url", "payload_digest", "refers_to_id"]
    grouped = records.filter("segment IS NOT NULL").groupBy(origin).agg(
        *(F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in head),
        F.max("total_length").alias("total"), F.min("sound").alias("sound"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary")  # joins bytes, whatever they are, in one go
    in_order = F.expr("transform(parts, x -> x.segment) = sequence(1, greatest(1, size(parts)))")
    whole_ = grouped.withColumn("block", block).withColumn("intact", F.col("sound") & in_order & F.coalesce(F.col("total") == F.octet_length("block"), F.lit(False)))
    return lone.unionByName(whole_.select(F.col("origin").alias("record_id"), *head, "block", F.size("parts").alias("n_segments"), "intact"))


def payloads(records: DataFrame) -> DataFrame:
    """records with payload (binary) in place of block; intact only if framing and digest agree. A revisit has no payload."""
    names = ["record_id", "record_type", "page_id", "url", "payload_digest", "refers_to_id", "n_segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out, good = [], []
            for kind, block, digest, intact in zip(*(part.column(c).to_pylist() for c in ("record_type", "block", "payload_digest", "intact")), strict=True):
                head, _, body = (block or b"").partition(CRLF + CRLF)
                payload = None
                if kind != "revisit":
                    try:
                        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    except ValueError:
                        intact = False
                    intact = intact and payload is not None and hashlib.sha256(payload).hexdigest() == digest
                out.append(payload)
                good.append(intact)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.binary()), pa.array(good, pa.bool_())], [*names, "payload", "intact"])

    return records.select(*names, "block", "intact").mapInArrow(run, "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, n_segments int, payload binary, intact boolean")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, payload_digest, refers_to_id, n_segments, payload, intact of every page; a revisit has no payload."""
    return payloads(reassemble(read_records(spark, path)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    own = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256))
    read = materialise(read_pages(spark, path).select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), own.alias("payload_digest"), F.col("payload_digest").alias("told"), "record_type", "refers_to_id", "intact"))  # small columns, so the archives are parsed once
    responses = read.filter("record_type = 'response'")
    first = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    revisits = read.filter("record_type = 'revisit'").join(first, "refers_to_id", "left").select(
        "page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", "refers_to", (F.col("intact") & F.coalesce(F.col("told") == F.col("first_digest"), F.lit(False))).alias("intact"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "intact").unionByName(revisits)


ORACLE = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to,
    true AS intact
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""
