"""WARC archives: writing pages as segmented records, and reassembling them.

Pages become HTTP responses with chunked transfer framing; equal payloads after the response's become revisit records;
blocks longer than a segment go on in continuation records, anywhere in the archives. Reading parses the records,
groups continuations by their origin's identifier, orders them by segment number, checks the total length, and decodes
the chunked framing.

Archives are written and read by Spark's own readers and writers, so they can be in any store that Spark reaches. A
record's end mark, two line ends, is the writer's line separator.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import rows_of, saved, shared_dir, table

SEGMENT, CHUNK = 16_384, 4_096
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages have no date; a fixed one keeps archives reproducible


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """Equal only for pages that repeat both id and payload."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


# --- framing ---------------------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are skipped. Raises ValueError where the framing
    is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size has no end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than its size")
        out.append(body[at : at + size])
        at += size + 2


def http_fields(head: bytes) -> dict[bytes, bytes]:
    return dict(x.split(b":", 1) for x in head.lower().split(b"\r\n") if b":" in x)


def block_payload(block: bytes) -> bytes:
    """Of an HTTP response: the body, without its transfer framing. Of another protocol's: all of it."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP header has no end")
    fields = http_fields(head)
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


# --- records ---------------------------------------------------------------------------------------------------------


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to, not with, its end mark."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def response_records(page_id: int | None, url: str | None, payload: bytes, digest: str, segment: int = SEGMENT) -> list[bytes]:
    """The response, cut into segments of at most `segment` bytes of block if it is longer."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    own = record_id(page_id, digest)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{own}#{k}")
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", own)]
        out.append(record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part))
    return out


def revisit_record(page_id: int | None, url: str | None, digest: str, n_bytes: int, response: int | None) -> bytes:
    """Its block keeps the HTTP header only, which tells the length of the payload left out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", record_id(response, digest)), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")]
    return record(fields, head)


def parsed(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, given whole or in pieces."""
    pieces, held, base = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        seen = 0
        while (head_end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("a record's header has no end")
                return
        version, *lines = held[:head_end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {base}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = head_end + 4
        end = start + int(fields["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != END:
            raise ValueError(f"the record at byte {base} doesn't end where its length says")
        yield fields, bytes(held[start:end])
        del held[: end + 4]
        base += end + 4


# --- Spark -----------------------------------------------------------------------------------------------------------


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, keeper): each page's payload digest and the largest page_id with that payload.

    Rows that repeat page_id and payload give one. A digest that very many pages share is first counted within each
    task, and joining its keeper to them can be split among tasks.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    own = saved(pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n_bytes")))
    shared = own.where(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper")
    return own.join(shared, "sha1", "left").where("keeper is not null").select("page_id", "sha1", "keeper").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """One record for each row of pages, and its continuations, in gzipped archives at path.

    Of pages with equal payloads of at least least_bytes bytes that with the largest page_id is written as response,
    the others as revisits that refer to it. Null html is an empty payload; null urls are empty; null ids revisit like
    any other page and are kept as such where they stand alone. Other columns aren't read.
    """
    shared = decisions(pages, least_bytes).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "keeper")
    sha1 = F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8"))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", sha1.alias("sha1"))
    joined = own.join(shared, own.page_id.eqNullSafe(shared._id) & (own.sha1 == shared._sha1), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 500):
                out = []
                for page, url, html, digest, keeper in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload, digest = (html or "").encode(), base32_digest(digest)
                    if keeper is None or page == keeper:
                        out += response_records(page, url, payload, digest, segment)
                    else:
                        out.append(revisit_record(page, url, digest, len(payload), keeper))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = joined.select("page_id", "url", "html", "sha1", F.col("keeper").cast("bigint").alias("keeper")).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response and revisit record: record_id, page_id, url, record_type, refers_to_id, payload_digest
    (as the archive has it), payload (null for revisits), payload_bytes (null for revisits that don't tell it).

    Archives are *.gz, of any number of gzip members, or *.warc. Gzipped ones are inflated and parsed as a stream, record
    by record; plain ones are held whole, as no record tells where it starts in a split. Records of other types (warcinfo,
    request, metadata, resource, conversion) are skipped. Records in one segment are decoded where they are read; only
    segments of longer ones are moved, grouped by origin and put together. Copies of a record that is written twice give a
    row each. A missing segment, a wrong total length, broken framing, a payload that doesn't fit its SHA-1 digest and an
    archive that is cut off or followed by something else are errors. No archives: no rows.
    """
    schema = "record_id string, url string, record_type string, refers_to_id string, payload_digest string, payload binary, payload_bytes bigint, segment int, total bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for batch in batches for k in range(batch.num_rows))
        for _, own in groupby(pieces, itemgetter(0)):
            held: list[tuple] = []
            size = 0
            for f, block in parsed(x for _, x in own):
                row = _row(f, block)
                if row is None:
                    continue
                held.append(row)
                size += len(row[5] or b"")
                if size > 4_000_000 or len(held) >= 2000:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    # A text reader's lines hold a file's bytes as they are. They come in order, and a gzipped file is never split.
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", END.decode()).text(path).select(file, F.concat(F.col("value").cast("binary"), F.lit(END)).alias("bytes"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select(file, F.col("content").alias("bytes"))
    found = saved(lines.unionByName(plain).mapInArrow(run, schema))
    whole = found.where("segment is null")
    joined = found.where("segment is not null").repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(_reassembled, schema)
    return whole.unionByName(joined).drop("segment", "total")


def _row(f: dict[str, str], block: bytes) -> tuple | None:
    """None for records that are neither response, revisit nor a segment of any type."""
    said = f.get("warc-payload-digest", "")
    digest = said.removeprefix("sha1:") if said.startswith("sha1:") else said or None
    kind = f["warc-type"]
    number = f.get("warc-segment-number")
    total = f.get("warc-segment-total-length")
    if kind == "revisit":
        size = http_fields(block).get(b"content-length", b"").strip()
        return f["warc-record-id"], f.get("warc-target-uri"), kind, f.get("warc-refers-to"), digest, None, int(size) if size.isdigit() else None, None, None
    if number is None:
        if kind != "response":
            return None
        payload = _checked(block, said, f["warc-record-id"])
        return f["warc-record-id"], f.get("warc-target-uri"), kind, None, digest, payload, len(payload), None, None
    origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
    return origin, f.get("warc-target-uri"), kind, None, said or None, block, None, int(number), int(total) if total else None


def _checked(block: bytes, said: str | None, name: str) -> bytes:
    """The block's payload. Digests of other kinds than SHA-1 in base32 aren't checked."""
    payload = block_payload(block)
    kind, _, digest = (said or "").partition(":")
    if kind == "sha1" and len(digest) == 32 and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest.upper():
        raise ValueError(f"the payload of {name} doesn't fit its digest")
    return payload


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    names = ["record_id", "url", "record_type", "refers_to_id", "payload_digest", "payload", "payload_bytes", "segment", "total"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come by origin and number; a record is put together as soon as its last segment is there."""
    held: list[tuple] = []

    def whole(own: list[tuple]) -> list[tuple]:
        # A row that repeats a page repeats all its segments: equal numbers stand together, one record for each copy.
        copies = sum(r[7] == 1 for r in own)
        parts = own[::copies] if copies else []
        if not copies or len(own) % copies or [r[7] for r in own] != [n for n in range(1, len(parts) + 1) for _ in range(copies)]:
            raise ValueError(f"segments of {own[0][0]} are missing")
        block = b"".join(r[5] for r in parts)
        if parts[-1][8] != len(block):
            raise ValueError(f"{own[0][0]} has {len(block)} bytes, not {parts[-1][8]}")
        if parts[0][2] != "response":
            return []  # a record of another type that is long
        payload = _checked(block, parts[0][4], own[0][0])
        return [(*parts[0][:4], (parts[0][4] or "").removeprefix("sha1:") or None, payload, len(payload), None, None)] * copies

    out: list[tuple] = []
    for batch in batches:
        for part in rows_of(batch, 500):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += whole(held)
                    held = []
                    if len(out) >= 100:
                        yield _rows(out)
                        out = []
                held.append(row)
    if held:
        out += whole(held)
    if out:
        yield _rows(out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.split(F.regexp_replace(c, "[<>]", ""), ":")[2]
    number = lambda c: F.when(page(c) != "", page(c)).cast("bigint")
    return read_archives(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
