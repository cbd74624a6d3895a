"""Legacy archive converter: ARC files, versions 1 and 2, to WARC 1.1.

An archive is read by its own rules: the version block names the fields of
the header lines, and each line declares how many bytes follow. From these
come the WARC identifiers, timestamps, types and digests. Records with equal
payloads become one response and its revisits. Archives are written by
Spark's text writer, whose line separator is the end of a record, so commits,
retries and file systems are Spark's; records may hold any bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import scratch, written

#: The field lines of the two ARC versions, and names of the WARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
#: How archives are compressed: the fastest level, for most of the work is compression.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Bytes of records that a task hands on at once.
BATCH_BYTES = 4 << 20
#: Bytes of revisit lists that are broadcast at once.
WAVE_BYTES = 32 << 20


class ArcRecord(NamedTuple):
    archive: str
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    truncated: bool


def _opened(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block left out. A record cut short has `truncated` set.

    Only the first record of a file can be the version block: a page's URL may begin like one.
    """
    stream = _opened(content)
    fields = ARC_FIELDS[1].split()
    archive, offset, begun = "", 0, False
    while True:
        line = stream.readline()
        if not line:
            return
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        at_start, begun = not begun, True
        if at_start and text.startswith("filedesc:"):
            archive = text.split(" ", 1)[0].removeprefix("filedesc://")
            block = stream.read(int(text.rsplit(" ", 1)[1]))
            offset += len(block)
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0][:1].isdigit() else 1
            declared = lines[1].split() if len(lines) > 1 else []
            fields = declared if declared[-1:] == ["Archive-length"] else ARC_FIELDS[2 if version == 2 else 1].split()
            continue
        # From the right: old writers left spaces in URLs.
        found = dict(zip(fields, text.rsplit(" ", len(fields) - 1)))
        length = int(found["Archive-length"])
        block = stream.read(length)
        offset += len(block)
        yield ArcRecord(
            archive, start, found.get("URL", ""), found.get("IP-address", ""), found.get("Archive-date", ""),
            found.get("Content-type", ""), block, len(block) < length,
        )


def warc_date(arc_date: str) -> str:
    """An ISO timestamp from the 14 digits of an ARC date; what older, shorter dates lack counts as zero, or one."""
    d = re.sub(r"\D", "", arc_date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Head, with the empty line, and payload of an HTTP response; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if m is None else (block[: m.end()], block[m.end() :])


def record_id(record: ArcRecord) -> str:
    """The same for the same record of the same archive, however often it is converted."""
    return str(uuid.uuid5(_IDS, f"arc:{record.archive}:{record.offset}:{record.url}:{record.date}"))


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"^X-Page-Id: (-?\d+)\r?$", head, re.M)
    return int(m[1]) if m else None


class Revisit(NamedTuple):
    refers_to: str
    refers_to_url: str
    refers_to_date: str
    refers_to_page: int | None


def to_warc(record: ArcRecord, revisit: Revisit | None) -> bytes:
    """A WARC record without the two line ends behind it."""
    http = split_http(record.block)
    block = record.block
    payload = http[1] if http else block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response' if http else 'resource'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(record)}>",
        f"WARC-Date: {warc_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if re.fullmatch(r"[0-9A-Fa-f.:]+", record.ip) and record.ip != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {record.ip}")
    if revisit:
        block = http[0] if http else b""
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{revisit.refers_to}>",
            f"WARC-Refers-To-Target-URI: {revisit.refers_to_url}",
            f"WARC-Refers-To-Date: {revisit.refers_to_date}",
        ]
        if revisit.refers_to_page is not None:
            lines.append(f"X-Refers-To-Page-Id: {revisit.refers_to_page}")
    if record.truncated:
        lines.append("WARC-Truncated: unspecified")
    lines += [
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: " + ("application/http; msgtype=response" if http else record.content_type),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, by the declared lengths."""
    stream = _opened(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("the file ends within a record")
        yield headers, block


def _lines(values: list[bytes]) -> pa.RecordBatch:
    """Bytes as the string column that the text writer takes, unchanged."""
    raw = pa.array(values, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())], ["value"]
    )


def _batched(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size > BATCH_BYTES:
            yield _lines(held)
            held, size = [], 0
    if held:
        yield _lines(held)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(`path`, `content`) of the archives in a folder. An archive is as large as a task's input, compressed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """`pages` (`page_id`, `url`, `html`) as ARC files, one per task, versions 1 and 2 in turn.

    Null html is an empty payload, a null url the URL "unknown:"; a null
    `page_id` is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"pages-{part:06d}.arc"

        def header(url: str, kind: str, length: int, offset: int) -> bytes:
            extra = f"200 - - {offset} {name} " if version == 2 else ""
            return f"{url} 0.0.0.0 {date} {kind} {extra}{length}\n".encode()

        def records() -> Iterator[bytes]:
            offset = 0
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    if not offset:
                        about = f"{version} 0 tallyspark\n{ARC_FIELDS[version]}\n".encode()
                        first = header(f"filedesc://{name}", "text/plain", len(about), 0) + about
                        offset += len(first) + 1
                        yield first
                    payload = html or b""
                    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    head = (
                        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}"
                        f"Content-Length: {len(payload)}\r\n\r\n"
                    ).encode()
                    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:")
                    record = header(url, "text/html", len(head) + len(payload), offset) + head + payload
                    offset += len(record) + 1
                    yield record

        yield from _batched(records())

    source = pages.select("page_id", "url", F.col("html").cast("binary"))
    source.mapInArrow(run, "value string").write.options(**GZIP).option("lineSep", "\n").text(path)


_FOUND = (
    "path string, ordinal int, page_id long, record_id string, url string, date string, digest string, bytes long"
)


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per HTTP record of the ARC files below `path`, without its payload."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = []
                for k, r in enumerate(read_arc(content.as_py())):
                    if http := split_http(r.block):
                        rows.append((name.as_py(), k, _page_id(http[0]), record_id(r), r.url, warc_date(r.date), digest(http[1]), len(http[1])))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FOUND.split(", ")])
    return _files(spark, path).mapInArrow(run, _FOUND)


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(`path`, `revisits`): per archive, which records revisit which other one.

    Of records with equal payloads of at least `min_bytes`, the one with the
    smallest page id, then record id, is the response; a missing page id
    comes last. A list is as long as its archive has records at most.
    """
    same = records.where(F.col("bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    first = same.groupBy("digest", "bytes").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.drop("n"), "warc-responses")
    return (
        same.join(first, ["digest", "bytes"])
        .where(F.col("record_id") != F.col("first.record_id"))
        .groupBy("path")
        .agg(F.collect_list(F.struct("ordinal", "first.record_id", "first.url", "first.date", "first.page_id")).alias("revisits"))
    )


def _listed(spark: SparkSession, path: str | list[str], known: DataFrame) -> DataFrame:
    """(`content`, `revisits`) of archives; `known` is a bounded list, and the archives stay where they are read."""
    files, known = _files(spark, path), known.withColumnRenamed("path", "_path")
    return files.join(F.broadcast(known), files["path"] == known["_path"], "left").select("content", "revisits")


def convert(
    spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, expected: int | None = None,
    wave_bytes: int = WAVE_BYTES,
) -> None:
    """The ARC files below `arc_path` as WARC files below `warc_path`, one for one.

    Archives never move: the list of revisits goes to the tasks that read
    them, in as many waves of archives as keep a wave's list below about
    `wave_bytes`. If `expected` is given, and the archives hold another number
    of records, it raises.
    """
    records = written(arc_records(spark, arc_path), "warc-records")
    if expected is not None and records.count() != expected:
        raise ValueError(f"{records.count()} records in the archives, not {expected}")
    known = written(revisits(records, min_bytes), "warc-revisits")
    # Ids, dates and numbers take about 100 bytes of an entry.
    size = known.select(F.aggregate("revisits", F.lit(0).cast("long"), lambda n, r: n + 100 + F.length(r["url"])).alias("n"))
    waves = -(-(size.agg(F.sum("n")).first()[0] or 1) // wave_bytes)
    wave = F.pmod(F.xxhash64("path"), F.lit(waves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for content, listed in zip(*batch.columns):
                    again = {
                        r["ordinal"]: Revisit(r["record_id"], r["url"], r["date"], r["page_id"])
                        for r in listed.as_py() or ()
                    }
                    for k, r in enumerate(read_arc(content.as_py())):
                        yield to_warc(r, again.get(k))

        yield from _batched(records())

    if waves == 1:
        lists = [(arc_path, known)]
    else:
        # Names of files, as Spark's own listing holds them.
        paths = _files(spark, arc_path).select("path", wave.alias("wave")).collect()
        lists = [([r.path for r in paths if r.wave == w], known.where(wave == w)) for w in range(waves)]
    for path, some in lists:
        if not path:
            continue
        lines = _listed(spark, path, some).mapInArrow(run, "value string")
        lines.write.mode("append").options(**GZIP).option("lineSep", "\r\n\r\n").text(warc_path)


_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_id string, url string, date string"
)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per response, revisit or resource of the WARC files below `path`.

    A response's length and digest come from its payload and must agree with
    its header; a revisit's are those of the full payload, from its headers.
    """
    names = [c.split()[0] for c in _READ.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in _READ.split(", ")])

    def row(headers: dict[str, str], block: bytes) -> tuple:
        http = split_http(block)
        head, payload = http or (b"", block)
        declared = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "revisit":
            size = int(re.search(rb"^Content-Length: (\d+)\r?$", head, re.M)[1])
        else:
            size = len(payload)
            if digest(payload) != declared:
                raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
        refers = headers.get("x-refers-to-page-id")
        return (
            _page_id(head), size, declared, headers["warc-type"], None if refers is None else int(refers),
            headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers["warc-date"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [row(*r) for r in read_warc(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)

    return _files(spark, path).select("content").mapInArrow(run, _READ)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (`page_id`, `url`, `html`) through ARC and WARC files and read back, a row per row.

    `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`
    and more of the record's headers. Null html is an empty payload. Repeated
    rows are records each: one is the response, the others revisit it. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    root = scratch(spark, "archives")
    write_arc(pages, f"{root}/arc")
    convert(spark, f"{root}/arc", f"{root}/warc", min_bytes, expected=pages.count())
    return warc_records(spark, f"{root}/warc")
