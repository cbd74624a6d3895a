"""Archives: exact round trip, both ARC versions, revisits, odd bytes."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import warc as W

SCHEMA = "page_id long, url string, html string, path string, content string"


def plain(rows, min_bytes=0):
    by_payload = defaultdict(list)
    for page_id, _, html, *_ in rows:
        by_payload[(html or "").encode()].append(page_id)
    out = Counter()
    for payload, ids in by_payload.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for n, page_id in enumerate(ids):
            first = n == 0 or len(payload) < min_bytes
            out[page_id, len(payload), sha, "response" if first else "revisit", None if first else ids[0]] += 1
    return out


def key(r):
    return r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to


ROWS = [
    (5, "http://a/x y", "<p>same</p>", "p", "c"), (3, "http://a/", "<p>same</p>", None, "c"), (9, None, "<p>same</p>", "p", "c"),
    (4, "http://b/", None, "p", None), (2, "http://b/2", "", "p", "c"), (8, "http://c/\n", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "p", "c"),
    (1, "http://é/", "é漢🙂\x00\r\n\r\n\n\nhttp://a/ 0.0.0.0 20240101000000 text/html 12\n", "p", "c"), (7, "http://d/", "x" * 300000, "p", "c"),
    (None, "http://e/", "no id", "p", "c"), (6, "http://e/", "no id", "p", "c"), (7, "http://d/", "x" * 300000, "p", "c"),
]


@pytest.mark.parametrize("min_bytes", [0, 12])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = W.archived_pages(pages, min_bytes).collect()
    assert Counter(map(key, rows)) == plain(ROWS, min_bytes)
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows)
    for r in rows:
        if r.record_type == "revisit":
            other = ids[r.refers_to_id]
            assert other.record_type == "response" and other.page_id == r.refers_to and other.payload_digest == r.payload_digest


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert Counter(map(key, W.archived_pages(pages).collect())) == plain(rows)


def test_empty_table(spark):
    assert W.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


ARC1 = (
    b"filedesc://old.arc 0.0.0.0 19970203040506 text/plain 68\n1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://a/b c 10.0.0.1 199702030405 text/html 31\nHTTP/1.0 200 OK\nX: y\n\n\xff\xfe body\n\n\n"
    b"dns:a 10.0.0.2 19970203 text/dns 5\nhello\n"
    b"http://cut/ 10.0.0.3 19970203040506 text/html 500\nHTTP/1.0 200 OK\r\n\r\nshort"
)


def test_version_1_with_spaces_bytes_and_a_cut():
    for content in (ARC1, gzip.compress(ARC1[:300]) + gzip.compress(ARC1[300:])):
        a, b, c = W.read_arc(content)
        assert (a.url, a.ip, a.content_type, a.archive) == ("http://a/b c", "10.0.0.1", "text/html", "old.arc")
        assert W.split_http(a.block) == (b"HTTP/1.0 200 OK\nX: y\n\n", b"\xff\xfe body\n\n") and not a.truncated
        assert (b.url, b.block) == ("dns:a", b"hello") and c.truncated
    assert W.warc_date(a.date) == "1997-02-03T04:05:00Z" and W.warc_date(b.date) == "1997-02-03T00:00:00Z"
    assert W.warc_date("") == "0000-01-01T00:00:00Z"
    (h, block), = W.read_warc(W.to_warc(b, None) + b"\r\n\r\n")
    assert h["warc-type"] == "resource" and block == b"hello" and h["content-type"] == "text/dns" and h["warc-ip-address"] == "10.0.0.2"
    assert dict([*W.read_warc(W.to_warc(c, None))][0][0])["warc-truncated"] == "unspecified"


def test_version_2_fields():
    about = f"2 0 Someone\n{W.ARC_FIELDS[2]}\n".encode()
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    content = (
        f"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc {len(about)}\n".encode() + about + b"\n"
        + f"http://z/ 1.2.3.4 20010102030405 text/html 200 abc - 99 new.arc {len(body)}\n".encode() + body + b"\n"
    )
    r, = W.read_arc(content)
    assert (r.url, r.date, r.block, r.archive) == ("http://z/", "20010102030405", body, "new.arc")


def test_converts_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(ARC1)
    W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    rows = {r.url: r for r in W.warc_records(spark, str(tmp_path / "warc")).collect()}
    assert rows["http://a/b c"].payload_bytes == 9 and rows["dns:a"].record_type == "resource"


def test_url_that_begins_like_a_version_block(spark):
    rows = [(1, "filedesc://x.arc", "<p>a</p>", "p", "c"), (2, "http://a/", "<p>a</p>", "p", "c"), (3, "filedesc:b", "<p>b</p>", "p", "c")]
    for parts in (1, 3):
        got = W.archived_pages(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        assert Counter(map(key, got)) == plain(rows)


def test_waves_give_the_same_rows(spark, tmp_path):
    rows = [(k, f"http://{k}/", f"<p>{k % 7}</p>", None, None) for k in range(120)] + ROWS
    pages = spark.createDataFrame(rows, SCHEMA).repartition(9)
    W.write_arc(pages, f"{tmp_path}/arc")
    for bound in (1 << 20, 2000):
        W.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc{bound}", expected=len(rows), wave_bytes=bound)
        assert Counter(map(key, W.warc_records(spark, f"{tmp_path}/warc{bound}").collect())) == plain(rows)
    with pytest.raises(ValueError):
        W.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/none", expected=len(rows) + 1)


def test_archives_are_not_shuffled(spark, tmp_path):
    W.write_arc(spark.createDataFrame(ROWS, SCHEMA).repartition(3), f"{tmp_path}/arc")
    known = W.revisits(W.arc_records(spark, f"{tmp_path}/arc"))
    known.write.parquet(f"{tmp_path}/known")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = W._listed(spark, f"{tmp_path}/arc", spark.read.parquet(f"{tmp_path}/known"))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    physical = plan[plan.index("== Physical Plan =="):]
    assert "BroadcastHashJoin" in physical and "hashpartitioning" not in physical
