"""Web archives: a converter of legacy ARC files to WARC.

ARC files start with a version line that says how the header line of each record is
built: version 1 has five fields, version 2 ten, and the last is always the length of
the network document. The converter reads records by these lengths, never by
separators, and writes a WARC record for each with the identifier, date, type and
digests that ARC lacks. A record whose payload an earlier one already holds becomes a
revisit that refers to it.

Archives are written by Spark's text sink, which commits the files of finished tasks
only, about ``FILE_BYTES`` of records each. ARC files are gzip as a whole. Each WARC
record is a gzip member of its own, so that it can be read alone from its offset. The
sink ends every value with a separator; here it is the zero byte that ends a member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import in_tasks_of, ship_code, text_bytes, write_stage
from weekcast.session import new_path

FILE_BYTES = 32 << 20
READ_BYTES = 8 << 10
# Fixed values of the formats: header fields of each ARC version, and what ends a record.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Result-code Content-type Checksum Location Offset "
       "Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
MEMBER_END = "\0"                # the highest byte of a member's length, below 16 MB
HTTP_TYPE = "application/http; msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NOT_IN_URL = re.compile(r"[\x00-\x20\x7f]")
_ONE_VALUE = pa.schema([("value", pa.string())])
_ONE_MEMBER = pa.schema([("value", pa.binary())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, date: str, kind: str, name: str, length: int) -> str:
    """The header line of a record, without its line break."""
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind,
             "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(length)}
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version].split())


def write_arc(pages: DataFrame, date: str = "20240101000000", path: str | None = None,
              file_bytes: int = FILE_BYTES) -> str:
    """Write pages (page_id, url, html) as ARC files of both versions in turn; returns
    their folder.

    A network document is an HTTP response whose header has the page id (absent if
    null), percent-encoded: ids may be of any type that has a text. White space and control characters of a url are percent-encoded; a null url
    is ``-``. Null html is an empty payload. Rows may repeat; other columns are not
    written. An empty table gives a folder without records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, version, begun = f"pages-{part:06d}.arc", 1 + part % 2, False
        for batch in batches:
            values = []
            if not begun and batch.num_rows:
                about = f"{version} 0 origin\n{ARC_FIELDS[version]}\n"
                values.append(arc_header(version, f"filedesc://{name}", date, "text/plain",
                                         name, len(about)) + "\n" + about)
                begun = True
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                          strict=True):
                size = len((html or "").encode())
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {size}\r\n"
                        + (f"X-Page-Id: {quote(page_id, safe='')}\r\n" if page_id is not None else "") + "\r\n")
                url = _NOT_IN_URL.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
                values.append(arc_header(version, url, date, "text/html", name,
                                         len(head) + size) + "\n" + head + (html or ""))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], schema=_ONE_VALUE)

    spark = pages.sparkSession
    ship_code(spark)
    path = path or new_path(spark, "llm/arc")
    pages = pages.select(F.col("page_id").cast("string"), "url", "html")
    (in_tasks_of(pages, text_bytes(pages, "html"), file_bytes).mapInArrow(run, "value string")
     .write.option("lineSep", ARC_END).option("compression", "gzip").text(path))
    return path


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, without the version block, in order."""
    version, at, seq = None, 0, 0
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line, at = data[at:end].decode("utf-8", "replace"), end + 1
        if version is None:
            length = int(line.rsplit(" ", 1)[1])
            block = data[at:at + length].decode("utf-8", "replace").split("\n")
            version = int(block[0].split(" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            at += length
            archive = line.split(" ", 1)[0].removeprefix("filedesc://")
            continue
        fields = ARC_FIELDS[version].split()                 # a url may hold spaces
        record = dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True))
        length = int(record["Archive-length"])
        document = data[at:at + length]
        if len(document) != length:
            raise ValueError(f"record {seq} of {archive} is cut short")
        at += length
        head, _, payload = document.partition(b"\r\n\r\n")
        yield {"archive": archive, "seq": seq, "url": record["URL"],
               "ip": record["IP-address"], "date": record["Archive-date"],
               "head": head.decode("utf-8", "replace"), "payload": payload}
        seq += 1


def http_header(head: str, name: str) -> str | None:
    for line in head.split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.lower() == name.lower():
            return value.strip()
    return None


def page_id_of(head: str) -> str | None:
    found = http_header(head, "X-Page-Id")
    return None if found is None else unquote(found)


def record_id(archive: str, seq: int) -> str:
    """The identifier of a record: the same whenever the archive is converted."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{seq}").urn


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict[str, str | None], block: str) -> str:
    """One record; the length is that of the block in UTF-8."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block.encode())}",
                        "", block]) + WARC_END


def member(record: str) -> bytes:
    """A record as one gzip member without its last byte, a zero. From 16 MB on it is
    followed by an empty member, which ends in a zero too."""
    data = gzip.compress(record.encode(), 6, mtime=0)
    return (data if not data[-1] else data + gzip.compress(b"", mtime=0))[:-1]


def members_of(data: bytes | memoryview) -> Iterator[bytes]:
    """The content of each gzip member in turn, so that one is held at a time."""
    data, at = memoryview(data), 0
    while at < len(data):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof:
            piece = data[at:at + READ_BYTES]
            if not piece:
                raise ValueError("the last member is cut short")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("path", "content"))


def convert(spark: SparkSession, arc: str, smallest: int = 0, path: str | None = None,
            id_type: T.DataType | None = None) -> str:
    """Convert ARC files to WARC; returns the folder of the WARC files.

    Of records with equal payloads of at least ``smallest`` bytes the one with the
    smallest page id is a response and the others revisit it (among equal ids the first
    in the archives; no id counts as larger than any). Page ids are compared as values of
    ``id_type`` (default: long).
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"),
                                     strict=True):
                rows = [(file, r["archive"], r["seq"], page_id_of(r["head"]),
                         r["url"], iso_date(r["date"]), len(r["payload"]),
                         base32_sha1(r["payload"]))
                        for r in parse_arc(gzip.decompress(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (
                            pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(),
                            pa.string(), pa.int64(), pa.string()), strict=True)],
                        names=["path", "archive", "seq", "page_id", "url", "date", "bytes",
                               "digest"])

    ship_code(spark)
    stored = archives(spark, arc)
    index = write_stage(stored.mapInArrow(
        scan, "path string, archive string, seq int, page_id string, url string, date string, "
              "bytes long, digest string"), "arc-index")
    number = F.col("page_id").cast(id_type or T.LongType())
    rank = F.struct(number.isNull().alias("none"), number.alias("id"), "archive", "seq")
    first = write_stage(
        index.where(F.col("bytes") >= smallest).groupBy("digest", "bytes")
        .agg(F.min(F.struct(*[rank[c].alias(c) for c in ("none", "id", "archive", "seq")],
                            F.col("url"), F.col("date"))).alias("first"),
             F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-holders")
    revisits = (index.where(F.col("bytes") >= smallest)
                .join(first, ["digest", "bytes"])
                .where("archive <> first.archive OR seq <> first.seq")
                .groupBy("path").agg(F.collect_list(F.struct(     # at most a file's records
                    "seq", "first.archive", F.col("first.seq").alias("of"), "first.url",
                    "first.date")).alias("revisits")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False

        def members(values: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(map(member, values), pa.binary())], schema=_ONE_MEMBER)

        for batch in batches:
            for content, revisit in zip(batch.column("content"),
                                        batch.column("revisits").to_pylist(), strict=True):
                known = {r["seq"]: r for r in revisit or ()}
                values = []
                for r in parse_arc(gzip.decompress(content.as_py())):
                    if not begun:
                        begun, text = True, "software: weekcast\r\nformat: WARC File Format 1.0"
                        values.append(warc_record({
                            "WARC-Type": "warcinfo",
                            "WARC-Record-ID": f"<{record_id(r['archive'], -1)}>",
                            "WARC-Date": iso_date(r["date"]),
                            "Content-Type": "application/warc-fields"}, text))
                    values.append(_converted(r, known.get(r["seq"])))
                    if len(values) >= 500:
                        yield members(values)
                        values = []
                yield members(values)

    path = path or new_path(spark, "llm/warc")
    (stored.join(revisits, "path", "left").select("content", "revisits")
     .mapInArrow(write, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", MEMBER_END).text(path))
    return path


def _converted(r: dict, revisit: dict | None) -> str:
    block = r["head"] + "\r\n\r\n" + ("" if revisit else r["payload"].decode())
    return warc_record({
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{record_id(r['archive'], r['seq'])}>",
        "WARC-Date": iso_date(r["date"]),
        "WARC-Target-URI": r["url"],
        "WARC-IP-Address": r["ip"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(r['payload'])}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block.encode())}",
        "WARC-Refers-To": revisit and f"<{record_id(revisit['archive'], revisit['of'])}>",
        "WARC-Refers-To-Target-URI": revisit and revisit["url"],
        "WARC-Refers-To-Date": revisit and revisit["date"],
        "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "Content-Type": HTTP_TYPE,
    }, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; blocks are read by their length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        at = end + 4 + length
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} has no end")
        yield fields, data[end + 4:at]
        at += 4


def read_warc(spark: SparkSession, warc: str) -> DataFrame:
    """Responses and revisits: page_id, record_id, refers_to_record, record_type, url, date,
    payload_bytes, payload_digest (bare base32; checked where the payload is there), payload
    (null in revisits)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64() if n == "payload_bytes" else pa.string())
             for v, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                records = itertools.chain.from_iterable(
                    map(parse_warc, members_of(content.as_buffer())))
                for f, block in records:
                    kind = f["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    head, digest = head.decode(), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or (
                            kind == "response" and digest != base32_sha1(payload)):
                        raise ValueError(f"{f['WARC-Record-ID']} does not match its digest")
                    size = (len(payload) if kind == "response"
                            else int(http_header(head, "Content-Length")))
                    rows.append((page_id_of(head), f["WARC-Record-ID"],
                                 f.get("WARC-Refers-To"), kind, f["WARC-Target-URI"],
                                 f["WARC-Date"], size, digest,
                                 payload.decode() if kind == "response" else None))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    names = ["page_id", "record_id", "refers_to_record", "record_type", "url", "date",
             "payload_bytes", "payload_digest", "payload"]
    ship_code(spark)
    return archives(spark, warc).select("content").mapInArrow(run, ", ".join(
        f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names))


def page_records(spark: SparkSession, warc: str, id_type: T.DataType | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page id of the
    response that a revisit refers to; both of ``id_type``, default long) of each record
    read back from WARC files."""
    kind = id_type or T.LongType()
    page = lambda c: F.col(c).cast(kind)
    records = write_stage(read_warc(spark, warc).drop("payload", "url", "date"), "warc-index")
    held = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), page("page_id").alias("refers_to"))
    named: list[Column] = [page("page_id").alias("page_id"), F.col("payload_bytes"),
                           F.col("payload_digest"), F.col("record_type")]
    responses = records.where("record_type = 'response'").select(
        *named, F.lit(None).cast(kind).alias("refers_to"))
    again = records.where("record_type = 'revisit'").join(held, "refers_to_record", "left")
    return responses.unionByName(again.select(*named, "refers_to"))
