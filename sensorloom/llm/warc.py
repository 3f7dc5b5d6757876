"""WARC archives: writing, and reading with segment reassembly (operator 6).

Pages become HTTP responses in chunked transfer framing.  Blocks above ``segment_bytes`` are cut into a
first segment and continuation records that name their origin, so a record has a bounded size, and a file
of a bounded number of records too.  Archives are files that Spark's own writer puts in the shared folder.
Reading inflates them in a stream (one gzip member or one for each record), groups continuation records by
origin identifier, orders them by segment number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged, looked_up, scratch, text_or_empty, written

SEGMENT_BYTES = 32_768
CHUNK_CHARS = 4_096
LEAST_REVISIT = 100
#: So a file has at most 2,000 * (SEGMENT_BYTES + its headers), some 65 MB, before gzip.
RECORDS_A_FILE = 2_000
#: Bytes that are inflated at once.
PART = 1 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
#: Record ids are name-based, so a task that runs again writes the same bytes.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(row: str, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{row}#{number}')}>"


def chunked(payload: str) -> str:
    """``payload`` in chunked transfer framing; sizes count bytes."""
    parts = [payload[i : i + CHUNK_CHARS] for i in range(0, len(payload), CHUNK_CHARS)]
    return "".join(f"{len(p.encode('utf-8', 'replace')):x}{END}{p}{END}" for p in parts) + f"0{END}{END}"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError(f"chunk of {size} bytes at {at} does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def segments(block: str, most: int) -> list[str]:
    """``block`` cut between characters into parts of at most ``most`` bytes (``most`` is 4 or more)."""
    raw, parts, at = block.encode("utf-8", "replace"), [], 0
    while len(raw) - at > most:
        end = at + most
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(raw[at:end].decode())
        at = end
    return [*parts, raw[at:].decode()]


def record(kind: str, block: str, **fields: object) -> str:
    """A record but for the two line ends that close it; the sink writes those between rows."""
    size = len(block.encode("utf-8", "replace"))
    head = {"WARC-Type": kind, **{k.replace("_", "-"): v for k, v in fields.items()}, "WARC-Date": DATE, "Content-Length": size}
    return f"WARC/1.1{END}" + "".join(f"{k}: {v}{END}" for k, v in head.items()) + END + block


def page_records(row: str, page: str, url: str, payload: str, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[str]:
    """The record of a page and its continuation records; ``row`` names the row, since ids may repeat."""
    size = len(payload.encode("utf-8", "replace"))
    named = {"WARC_Target_URI": re.sub(r"[\r\n]+", " ", url), "X_Page_Id": page, "WARC_Payload_Digest": f"sha256:{digest}"}
    if refers_to is not None:
        yield record("revisit", f"HTTP/1.1 200 OK{END}Content-Length: {size}{END}{END}", WARC_Record_ID=record_id(row), X_Refers_To_Page=refers_to, **named, Content_Type="application/http; msgtype=response")
        return
    block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}" + chunked(payload)
    parts = segments(block, segment_bytes)
    more = {"WARC_Segment_Number": 1} if len(parts) > 1 else {}
    yield record("response", parts[0], WARC_Record_ID=record_id(row), **named, Content_Type="application/http; msgtype=response", **more)
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": len(block.encode("utf-8", "replace"))} if n == len(parts) else {}
        yield record("continuation", part, WARC_Record_ID=record_id(row, n), WARC_Segment_Origin_ID=record_id(row), WARC_Segment_Number=n, **last)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives at ``path`` with a record of each row of ``pages``, and continuation records.

    Of rows with equal payloads of at least 100 bytes, that with the smallest page_id is the response and
    the others revisit it.  Null html is an empty payload, a null url an empty one; rows with a null
    page_id are written without an id.  Of rows repeated with the same id and payload all are responses
    if they hold the smallest id.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), text_or_empty(f"`{url}`").alias("url"), text_or_empty(f"`{html}`").alias("html"))
    raw = F.encode("html", "UTF-8")
    rows = rows.withColumns({"digest": F.sha2(raw, 256), "size": F.length(raw)})
    # only payloads that occur again, and only rows that may hold one of them are shuffled; hot payloads stay where they are
    again = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again, total = written(again, "payloads"), pages.count()
    keyed = flagged(rows, F.col("digest"), again.select("digest"), "maybe")
    alone, maybe = keyed.filter("not maybe").withColumn("first", F.lit(None).cast("long")), keyed.filter("maybe")
    joined = alone.drop("maybe").unionByName(looked_up(maybe.drop("maybe"), again, "digest", "n", total, "left").drop("n"))
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for page, uri, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, n = "" if page is None else str(page), n + 1
                found = list(page_records(f"{text}/{part}/{n}", text, uri, payload, digest, None if refers is None else str(refers), segment_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    joined.mapInArrow(records, "value string").write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def inflated(content: bytes) -> Iterator[bytes]:
    """The archive's bytes in parts of at most PART; gzip members follow one another, anything else is plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(47)
        while not member.eof:
            part = member.decompress(content, PART)
            content = member.unconsumed_tail
            if part:
                yield part
            elif not content and not member.eof:
                raise ValueError("the archive ends inside a gzip member")
        content = member.unused_data


def parsed(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive that comes in parts."""
    held, at, parts = bytearray(), 0, iter(parts)

    def more() -> bool:
        """Takes another part in; what was read goes."""
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while at < len(held) or more():
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("the archive ends inside a record's headers")
        lines = held[at:end].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        size = int(head["content-length"])
        while len(held) - at < size + 4:
            if not more():
                raise ValueError(f"the archive ends inside a block of {size} bytes")
        block = bytes(held[at : at + size])
        if held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of {size} bytes has another length")
        at += size + 4
        yield head, block


RECORDS = "origin string, number int, total long, type string, page_id string, digest string, refers_to string, block binary"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives at ``path``; archives are files of a bounded number of records."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                part, size = [], 0
                for h, block in parsed(inflated(content.as_py())):
                    own = h.get("warc-segment-origin-id", h["warc-record-id"])
                    number = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                    total = h.get("warc-segment-total-length")
                    part.append((own, number, total and int(total), h["warc-type"], h.get("x-page-id") or None, h.get("warc-payload-digest"), h.get("x-refers-to-page"), block))
                    size += len(block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORDS)


def decoded(kind: str, page: str | None, digest: str, refers: str | None, block: bytes) -> tuple:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    page, stated = None if page is None else int(page), digest.removeprefix("sha256:")
    if kind == "revisit":
        return page, int(fields[b"content-length"]), stated, kind, None if refers is None else int(refers), None
    payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    found = hashlib.sha256(payload).hexdigest()
    if found != stated:
        raise ValueError(f"page {page}: the payload has digest {found}, its record states {stated}")
    return page, len(payload), found, kind, None, payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each response and revisit.

    Missing or repeated segments, another total length, broken chunks and digests that do not fit raise
    ValueError.  A revisit has no payload.  No archives give no rows.
    """
    records = read_records(spark, path)
    names = [x.split()[0] for x in PAGES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield batch_of([decoded(*row)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.sort(key=lambda p: p["number"])
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"{origin}: segments {[p['number'] for p in parts]}")
                block = b"".join(p["block"] for p in parts)
                if len(block) != parts[-1]["total"]:
                    raise ValueError(f"{origin}: {len(block)} bytes of {parts[-1]['total']}")
                first = parts[0]
                yield batch_of([decoded(first["type"], first["page_id"], first["digest"], first["refers_to"], block)])

    single = records.filter("number is null").select("type", "page_id", "digest", "refers_to", "block").mapInArrow(whole, PAGES)
    # the segments of one page make a group; only those are shuffled
    parts = F.collect_list(F.struct("number", "total", "type", "page_id", "digest", "refers_to", "block"))
    several = records.filter("number is not null").groupBy("origin").agg(parts.alias("parts")).mapInArrow(joined, PAGES)
    return single.unionByName(several)


def archive(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, path: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives and reads them back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, segment_bytes)
    return read_archives(spark, path)
