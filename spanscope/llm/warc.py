"""WARC archives: segmented writing, and reassembly on reading.

``write_archives`` turns pages into gzip-compressed WARC files through Spark's
text sink: a row is a record up to its block's last byte, and the line
separator is the two line ends that close a record.  So any file system Spark
can write to will do, and lost tasks are written again under its commit
protocol.  Blocks are HTTP responses in chunked transfer framing; one longer
than ``segment`` bytes is cut into a first record and continuation records.

``read_archives`` parses the files, groups continuation records by their
origin's identifier, puts them in order of segment number, verifies the total
length and the numbering, takes the chunked framing off and digests the payload.
Archives are inflated and parsed once, into a table of the shared folder.

Archives written elsewhere: records of type response and revisit are pages,
others (warcinfo, request, metadata, resource, conversion) are passed over.  Digests may
be SHA-256 or SHA-1, hexadecimal or base 32; where none is stated, or of another
kind, none is checked.  A page_id not stated is null.  A revisit that names no
page refers to the response of its stated digest (of several, the smallest page_id).
An archive that is cut off, or broken from some byte on, gives its records up
to there, and a response or revisit cut off within its block is a row that is
not complete; so is a divided one with a segment missing, cut or broken.

Null payloads are empty.  A null page_id stays null, and sorts after all others
when the response among equal payloads is chosen; rows with the smallest
page_id repeated are all responses.  Record identifiers hold the writing
partition and row, so repeated rows stay apart.  Null urls are written empty.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import cut, partitions, pick, shared_dir, stored, tidy

_END = b"\r\n"
_CLOSE = "\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
PARSED = "page_id bigint, record_type string, refers_to bigint, origin string, number int, total bigint, payload_bytes bigint, payload_digest string, complete boolean, block binary, stated string"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; raises ValueError on bad framing."""
    out, at = [], 0
    while True:
        end = body.index(_END, at)
        n = int(body[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != _END:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + _END + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, name: str, segment: int):
    """The records of a page: one, or a first one and its continuations."""
    clean = re.sub(r"[\x00-\x1f\x7f]", " ", url or "")
    ident = f"<urn:record:{name}>"
    base = [("WARC-Date", _DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to), *base], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", ident), ("Content-Type", "application/http; msgtype=response"), *base], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        digest_of = ("WARC-Block-Digest", f"sha256:{hashlib.sha256(part).hexdigest()}")
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", ident), ("WARC-Segment-Number", 1), ("Content-Type", "application/http; msgtype=response"), digest_of, *base], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{name}-{k}>"), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None), ("WARC-Date", _DATE), digest_of], part)


def parse(data: bytes, strict: bool = True):
    """(header fields in lower case, block) of every record of an uncompressed archive.

    Unless ``strict``, the records end where the archive breaks, and a block that is cut off is None.
    """
    try:
        yield from _parse(data)
    except (ValueError, KeyError) as e:
        if strict:
            raise
        if isinstance(e, _CutOff):
            yield e.args[1], None


class _CutOff(ValueError):
    """A record whose block ends before its length is reached; args are a message and the header."""


def _parse(data: bytes):
    at = 0
    while at < len(data):
        if data[at : at + 2] == _END:
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n:
            raise _CutOff("the last record is cut off", head)
        yield head, block
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, its transfer framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def reassemble(parts: list[tuple[int, int | None, bytes | None]]) -> bytes | None:
    """The whole block of (number, total length, block) segments in any order.

    None if a number is missing or repeated, a block is None, or the total length disagrees.
    """
    if any(b is None for _, _, b in parts):
        return None
    parts = sorted(parts, key=lambda p: p[0])
    total = [t for _, t, _ in parts if t is not None]
    whole = b"".join(b for _, _, b in parts)
    return whole if [n for n, _, _ in parts] == list(range(1, len(parts) + 1)) and total == [len(whole)] else None


def first_seen(pages: DataFrame, least: int) -> DataFrame:
    """(digest, first): the smallest page_id of every payload of ``least`` bytes or more that repeats."""
    d = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, segment: int = 32768, records_per_file: int = 2000, broadcast_rows: int = 100_000) -> None:
    """Write every page as a response, or as a revisit of an equal payload of at least ``least`` bytes.

    The payloads that repeat are counted; up to ``broadcast_rows`` of them (about
    100 bytes each) are broadcast, more are joined by shuffle.  An archive holds
    at most ``records_per_file`` records of about ``segment`` bytes.
    """
    src = pick(pages, **{id_col: "bigint", url_col: "string", payload_col: "string"}).toDF("page_id", "url", "payload")
    src = src.withColumn("payload", F.coalesce("payload", F.lit("")))
    seen = cut(first_seen(src, least))
    table = F.broadcast(seen) if seen.count() <= broadcast_rows else seen
    src = src.withColumn("_d", F.sha2("payload", 256))
    src = src.join(table, (F.octet_length("payload") >= least) & (src["_d"] == table["digest"] if table is seen else F.col("_d") == F.col("digest")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    src = src.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), F.col("_d"), refers.alias("refers_to"))

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in (b.slice(i, 128) for i in range(0, b.num_rows, 128)):
                out = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    out += records(page_id, url, payload, digest, refers_to, f"{part}-{row}", segment)
                    row += 1
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    lines = src.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", _CLOSE).option("maxRecordsPerFile", records_per_file).text(path)


def inflate(blob: bytes, strict: bool = True) -> bytes:
    """An archive's bytes: all members of a gzip file, which usually has one for each record, or a plain file.

    Unless ``strict``, what can be read before a member is cut off or broken.
    """
    if blob[:2] != b"\x1f\x8b":
        return blob
    out = []
    while blob[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            for i in range(0, len(blob), 1 << 16):  # piece by piece, so that all before a broken one is kept
                out.append(member.decompress(blob[i : i + (1 << 16)]))
                if member.eof:
                    blob = member.unused_data + blob[i + (1 << 16) :]
                    break
            else:
                out.append(member.flush())
                raise ValueError("a gzip member is cut short")
        except (ValueError, zlib.error) as e:
            if strict:
                raise ValueError(str(e)) from e
            return b"".join(out)
    if strict and blob.strip(b"\0"):
        raise ValueError("an archive goes on after its last gzip member")
    return b"".join(out)


def agrees(data: bytes, stated: str | None) -> bool:
    """Whether a stated digest is that of the data; true where none of a known kind is stated."""
    kind, _, value = (stated or "").rpartition(":")
    kind = kind.strip().lower().replace("-", "") or {64: "sha256", 40: "sha1", 32: "sha1"}.get(len(value))
    if kind not in ("sha256", "sha1"):
        return True
    got = hashlib.new(kind, data).digest()
    value = value.strip().rstrip("=")
    try:
        return got == (bytes.fromhex(value) if len(value) == 2 * len(got) else base64.b32decode(value.upper() + "=" * (-len(value) % 8)))
    except (ValueError, binascii.Error):
        return False


def _checked(block: bytes | None, stated: str | None) -> tuple:
    """(bytes, SHA-256, whether it is whole) of a response's payload; a broken block or chunk has none and is not."""
    try:
        payload = payload_of(block) if block is not None else None
    except ValueError:
        payload = None
    if payload is None:
        return None, None, False
    return len(payload), hashlib.sha256(payload).hexdigest(), agrees(payload, stated)


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


def _record_row(head: dict[str, str], block: bytes | None) -> tuple | None:
    """A row of ``PARSED``: a whole record, or a segment (number not null) of a divided one; None for what is no page."""
    kind, number = head.get("warc-type", "").lower(), _number(head.get("warc-segment-number"))
    page, stated = _number(head.get("x-page-id")), head.get("warc-payload-digest") or None
    if number is not None:
        if block is not None and not agrees(block, head.get("warc-block-digest")):
            block = None
        origin = head.get("warc-segment-origin-id", head.get("warc-record-id"))
        return page, kind, None, origin, number, _number(head.get("warc-segment-total-length")), None, None, None, block, stated
    if kind == "revisit":
        return page, kind, _number(head.get("x-refers-to-page-id")), None, None, None, None, None, block is not None, None, stated
    return (page, kind, None, None, None, None, *_checked(block, stated), None, stated) if kind == "response" else None


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of whole records and of the segments of divided ones."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                rows, held = [], 0
                for head, block in parse(inflate(blob.as_py(), strict=False), strict=False):
                    row = _record_row(head, block)
                    if row is not None:
                        rows.append(row)
                        held += len(row[9] or b"")
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return files.mapInArrow(tidy(run), PARSED)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _joined(batches):
    """Reassemble segments that arrive ordered by (origin, number); holds one record at a time."""
    origin, parts, first = None, [], None

    def close():
        """A row of the record; none if its first segment says that it is no response."""
        kind, page, stated = first or ("response", None, None)
        return [(page, "response", None, origin, None, None, *_checked(reassemble(parts), stated), None, stated)] if kind == "response" else []

    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["origin"] != origin:
                if parts:
                    rows += close()
                origin, parts, first = r["origin"], [], None
            parts.append((r["number"], r["total"], r["block"]))
            if r["number"] == 1:
                first = r["record_type"], r["page_id"], r["stated"]
        yield _rows(rows)
    if parts:
        yield _rows(close())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, complete.

    Only the segments of divided records are shuffled.  A revisit has the size
    and digest of the response it refers to; ``complete`` is false where
    reassembly or the digest failed, or a revisit's response is not in the archives.
    """
    parsed = stored(_parsed(spark, path))
    whole = parsed.where("number is null")
    parts = parsed.where("number is not null").repartition(partitions(spark), "origin").sortWithinPartitions("origin", "number")
    full = parts.mapInArrow(tidy(_joined), PARSED)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    response = stored(whole.where("record_type = 'response'").select(*cols, "stated").unionByName(full.select(*cols, "stated")))
    good = response.where("complete and stated is not null")
    named = good.groupBy("page_id", "stated").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("_r"))
    # the complement as key: a join both sides of which are shuffled can be split where one response has most revisits
    named = named.select(F.bitwise_not("page_id").alias("_p"), F.col("stated").alias("_s"), "_r.*")
    least = good.groupBy("stated").agg(F.min_by(F.struct("payload_bytes", "payload_digest", "page_id"), F.struct(F.col("page_id").isNull(), "page_id")).alias("_r"))
    least = least.select(F.reverse("stated").alias("_s"), "_r.payload_bytes", "_r.payload_digest", F.col("_r.page_id").alias("_p"))
    revisit = whole.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated", F.col("complete").alias("_whole"))
    by_page = revisit.where("refers_to is not null").join(named, (F.bitwise_not("refers_to") == F.col("_p")) & (F.col("stated") == F.col("_s")), "left")
    by_digest = revisit.where("refers_to is null").join(least, F.reverse("stated") == F.col("_s"), "left").withColumn("refers_to", F.col("_p"))
    bare = F.when(F.lower("stated").startswith("sha256:"), F.lower(F.substring_index("stated", ":", -1)))
    found = by_page.unionByName(by_digest).withColumns({"complete": F.col("_whole") & F.col("payload_bytes").isNotNull(), "payload_digest": F.coalesce("payload_digest", bare)})
    return response.select(*cols).unionByName(found.select(*cols))


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
