"""Pages through ARC and WARC files and back."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest

from weekcast.llm import warc

HTML = ["<p>a</p>", "<p>É</p>\r\n\r\n<p>x</p>\n\n", None, "", "<p>a</p>", "WARC/1.0\r\n\r\n", "\n",
        "x" * 300_000, "<p>a</p>", "http://u 0.0.0.0 20240101000000 text/html 5\nhello\n", "\n"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i != 3 else None, f"http://x.org/{i} b\n" if i % 4 else None, h, "1", "z")
            for i, h in enumerate(HTML)]
    rows += [rows[0], rows[8], (None, "http://n", "alone", "", "")]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, seq string, payload string"
    ).repartition(3).cache()


def want(pages, smallest):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out, groups = Counter(), {}
    for page_id, body in rows:
        groups.setdefault(body if len(body) >= smallest else object(), []).append((page_id, body))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is None, m[0]))
        for i, (page_id, body) in enumerate(members):
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            out[page_id, len(body), digest, "revisit" if i else "response",
                members[0][0] if i else None] += 1
    return out


@pytest.mark.parametrize("smallest", [0, 1, 9])
def test_records_are_read_back(spark, pages, smallest):
    arc = warc.write_arc(pages)
    got = warc.page_records(spark, warc.convert(spark, arc, smallest=smallest)).collect()
    assert Counter(map(tuple, got)) == want(pages, smallest)


def test_files_follow_the_formats(spark, pages):
    arc = warc.write_arc(pages, file_bytes=1000)
    files = [gzip.decompress(r.content) for r in warc.archives(spark, arc).collect()]
    assert {f.split(b"\n")[1] for f in files if f} == {b"1 0 origin", b"2 0 origin"}
    assert sum(1 for f in files for _ in warc.parse_arc(f)) == pages.count()
    made = warc.convert(spark, arc)
    records = [x for r in warc.archives(spark, made).collect()
               for x in warc.parse_warc(gzip.decompress(r.content))]
    kinds = Counter(f["WARC-Type"] for f, _ in records)
    assert kinds["response"] + kinds["revisit"] == pages.count() and kinds["warcinfo"]
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    bodies = Counter(r.payload for r in warc.read_warc(spark, made).collect()
                     if r.payload is not None)
    assert set(bodies) == {h or "" for h in HTML} | {"alone"}


def test_records_are_gzip_members_of_their_own(spark, pages):
    made = warc.convert(spark, warc.write_arc(pages))
    n = 0
    for r in warc.archives(spark, made).collect():
        data = bytes(r.content)
        while data:
            one = zlib.decompressobj(wbits=31)
            (_, _), = warc.parse_warc(one.decompress(data))
            data, n = one.unused_data, n + 1
    assert n > pages.count()                        # and a warcinfo record in each file
    two = [b"ab" * 9000, b"", b"c"]
    joined = b"".join(map(gzip.compress, two))
    assert list(warc.members_of(joined)) == two and list(warc.members_of(b"")) == []
    with pytest.raises(ValueError):
        list(warc.members_of(joined[:-1]))
    big = "é" * (8 << 20)                           # 16 MB: the length's last byte is no zero
    assert gzip.decompress(warc.member(big) + b"\0").decode() == big


def test_page_ids_of_any_type(spark):
    ids = ["b\r\nX: 1", "a é", " b", "", "10", "9", None, "10"]
    rows = [(i, "u", "same") for i in ids]
    for kind, cast in (("string", str), ("decimal(38,2)", Decimal), ("date", date.fromisoformat)):
        if kind != "string":
            texts = ["10.5", "9.5", None] if kind != "date" else ["2024-01-02", "2023-05-06", None]
            rows = [(t and cast(t), "u", "same") for t in texts]
        pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
        typed = pages.schema["page_id"].dataType
        arc = warc.write_arc(pages)
        got = warc.page_records(spark, warc.convert(spark, arc, id_type=typed), typed).collect()
        assert Counter(map(tuple, got)) == want(pages, 0)


def test_broken_archives_are_reported():
    record = warc.arc_header(1, "http://a b", "20240101", "text/html", "f", 9)
    about = "1 0 origin\n" + warc.ARC_FIELDS[1] + "\n"
    top = warc.arc_header(1, "filedesc://f", "20240101", "text/plain", "f", len(about))
    good = f"{top}\n{about}\n{record}\nx\r\n\r\nabcd\n".encode()
    (r,) = warc.parse_arc(good)
    assert (r["url"], r["payload"]) == ("http://a b", b"abcd")
    with pytest.raises(ValueError):
        list(warc.parse_arc(good[:-4]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(good.replace(b"1 0 origin", b"7 0 origin")))


def test_empty_table(spark, pages):
    arc = warc.write_arc(pages.where("page_id < 0"))
    assert warc.page_records(spark, warc.convert(spark, arc)).count() == 0
