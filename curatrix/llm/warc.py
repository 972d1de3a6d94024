"""WARC archives: a deduplicating writer and a splittable reader.

Writer: every record is its own gzip member.  Of records with equal payloads of
at least ``min_bytes`` bytes the one with the smallest id is a response, the
others are revisits that name it; smaller payloads are always responses.  Each
task writes one file under a name of its own attempt and reports it; only
reported files are read, so a retried or speculative attempt leaves no
duplicates.

Reader: archives are cut into byte ranges.  A task scans its range for the gzip
magic; a candidate counts if it inflates to a well-formed WARC header block,
however long, and the member ends at another such member or at the end of the file.  From there
it follows member after member.  A record belongs to the range in which its
member starts, so each is read exactly once wherever the cuts fall; the query
compares the records read with those written.

Foreign archives: digests other than SHA-256 are not checked, and the payload's
SHA-256 is given instead; only blocks that are HTTP messages lose a head; records
of any type but revisits are read with their payload.

Defined cases: a null payload is empty; a null url has no target URI; a url is
read back as it was written, percent signs and other characters included; rows with
a null id sort after all others (they revisit a row with an id); repeated rows
with the smallest id are all responses; an empty table writes no archive and
reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, qualified, stored

MIN_BYTES = 100
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"  # records carry no capture time of their own
#: Characters that a target URI holds as they are.
_PRINTABLE = "".join(map(chr, range(33, 127)))
#: Bytes read and inflated at a time while a header block is looked for.
_CHUNK = 1 << 16
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member holding one WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + payload if refers_to is None else _HTTP
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        uri = quote(url, safe=_PRINTABLE)  # escapes that are there stay as they are
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:
            head.append(f"X-Target-URL: {quote(url, safe='')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of a WARC header block at the start of ``data``, if it is one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


def _plausible(file, at: int, size: int) -> bool:
    """Does a gzip member start at ``at`` that begins with a WARC header block, however long?"""
    z, head, data = zlib.decompressobj(31), bytearray(), b""
    try:
        while not z.eof:
            if not data:
                data = file.read_at(min(_CHUNK, size - at), at) if at < size else b""
                if not data or (not head and not data.startswith(MAGIC[: len(data)])):
                    return False
                at += len(data)
            seen = max(0, len(head) - 3)
            head += z.decompress(data, _CHUNK)
            data = z.unconsumed_tail
            if not head.startswith(b"WARC/1."[: len(head)]):
                return False
            if head.find(b"\r\n\r\n", seen) >= 0:
                return _header(bytes(head)) is not None
    except zlib.error:
        pass
    return False


def _inflate(file, offset: int, size: int) -> tuple[bytes, int] | None:
    """The member at ``offset`` and where it ends; None if it is no whole gzip member."""
    z, out, at = zlib.decompressobj(31), [], offset
    try:
        while not z.eof:
            data = file.read_at(min(1 << 18, size - at), at) if at < size else b""
            if not data:
                return None
            at += len(data)
            out.append(z.decompress(data))
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def read_range(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records whose members start in [start, end)."""
    system, path = _filesystem(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        at, sure = start, start == 0
        while at < min(end, size):
            if not sure:
                found, where = -1, at
                while found < 0 and where < min(end, size):
                    chunk = file.read_at(min(1 << 20, size - where), where)
                    found = chunk.find(MAGIC)
                    if found < 0:
                        where += max(1, len(chunk) - len(MAGIC) + 1)
                at = where + found
                if found < 0 or at >= end:
                    return
                if not _plausible(file, at, size):
                    at += 1
                    continue
            member = _inflate(file, at, size)
            head = _header(member[0]) if member else None
            chained = member is not None and (member[1] == size or _plausible(file, member[1], size))
            if head is None or not chained:
                at, sure = at + 1, False
                continue
            fields, begins = head
            yield fields, member[0][begins : begins + int(fields["content-length"])]
            at, sure = member[1], True


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """A record's payload: what follows the HTTP head, for blocks that are HTTP messages; otherwise the block."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


def _url(fields: dict[str, str]) -> str | None:
    """The address as the writer had it, else the target URI without the angle brackets that some writers put round it."""
    if "x-target-url" in fields:
        return unquote(fields["x-target-url"])
    uri = fields.get("warc-target-uri")
    return uri[1:-1] if uri and uri.startswith("<") and uri.endswith(">") else uri


def references(pages: DataFrame, *, page_id: str, digest: str, n_bytes: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, first_id of payloads that occur more than once: minima merged before the shuffle, then written, so the join can split hot digests."""
    big = pages.where(F.col(n_bytes) >= min_bytes).groupBy(F.col(digest).alias("payload_digest")).agg(F.min(page_id).alias("first_id"), F.count("*").alias("n"))
    return stored(big.where("n > 1").select("payload_digest", "first_id"), "warc-first")


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> list[tuple[str, int, int]]:
    """Write one archive per task into ``folder``; the (uri, bytes, records) of those committed."""
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = references(rows.select("page_id", "payload_digest", "n_bytes"), page_id="page_id", digest="payload_digest", n_bytes="n_bytes", min_bytes=min_bytes)
    refers = F.when((F.col("n_bytes") >= min_bytes) & (F.col("page_id").isNull() | (F.col("first_id") < F.col("page_id"))), F.col("first_id"))
    marked = rows.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        name, stream, size, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                stream = stream or system.open_output_stream(f"{base}/{name}", compression=None)
                data = encode_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"])
                stream.write(data)
                size += len(data)
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["uri", "bytes", "records"])

    return [(r["uri"], r["bytes"], r["records"]) for r in marked.mapInArrow(write, "uri string, bytes long, records long").collect()]  # a row a task


def read_archives(spark: SparkSession, files: list[tuple[str, int, int]], *, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives, one task a byte range; see READ_SCHEMA."""
    ranges = [(uri, at, min(at + range_bytes, size)) for uri, size, _ in files for at in range(0, size, range_bytes)]
    table = spark.createDataFrame(ranges, "uri string, first long, last long").repartition(max(1, len(ranges)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                held = 0
                for fields, block in read_range(r["uri"], r["first"], r["last"]):
                    body, digest = _payload(fields, block), fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    length = int(fields.get("x-payload-length", len(body)))
                    if fields["warc-type"] != "revisit":
                        length, own = len(body), hashlib.sha256(body).hexdigest()
                        if fields.get("warc-payload-digest", "").startswith("sha256:") and own != digest.lower():
                            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
                        digest = own
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append((number("x-page-id"), _url(fields), length, digest, fields["warc-type"], number("x-refers-to-page-id"), body if with_payload and fields["warc-type"] != "revisit" else None))
                    held += len(body)
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return table.mapInArrow(read, READ_SCHEMA)


def all_read(records: DataFrame, files: list[tuple[str, int, int]]) -> DataFrame:
    """``records`` of the archives, written and counted: a ValueError if they are not as many as went in."""
    got, wrote = stored(records, "warc-read"), sum(n for _, _, n in files)
    if (read := got.count()) != wrote:
        raise ValueError(f"{read} records read from archives of {wrote}; check the archives for damage")
    return got


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(pages, fresh_path(spark, "warc"))
    return all_read(read_archives(spark, files, with_payload=False).drop("payload", "url"), files)


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id < page_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id OR page_id IS NULL THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
