"""WARC archives: writer and sequential reader, one gzip member a record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import join_counted, scratch, staged

VERSION = b"WARC/1.1"
CHUNK = 1 << 20
#: Bytes of compressed records after which the writer starts a new archive.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "archive string, records long, bytes long"
RECORDS = "archive string, position long, record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, verified boolean"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def clean(value: str) -> str:
    """A header value holds no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str, place: str = "", refers_uri: str | None = None) -> bytes:
    """One record, uncompressed. Its identifier comes from its ``place``, which no other record
    has. A revisit carries the HTTP head only, and names the response by its URI, page and
    payload digest."""
    block = HTTP_HEAD + payload if kind == "response" else HTTP_HEAD
    head = [
        VERSION,
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, place)).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + clean(url or "").encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
        b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()),
        b"X-Payload-Length: " + str(len(payload)).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: " + str(len(block)).encode(),
    ]
    if kind == "revisit":
        head += [
            b"WARC-Profile: " + REVISIT_PROFILE.encode(),
            b"WARC-Refers-To-Target-URI: " + clean(refers_uri or "").encode(),
            b"X-Refers-To-Page: " + str(refers_to).encode(),
        ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


#: Bytes that the head of a record has at most.
HEAD_BYTES = 1 << 20


class Member:
    """A gzip member of a stream, inflated piece by piece."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.unzip, self.data = stream, rest, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate up to CHUNK bytes more; whether the member had not ended."""
        if self.unzip.eof:
            return False
        held = self.unzip.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        if not held:
            raise WarcError("archive ends within a record")
        self.data += self.unzip.decompress(held, CHUNK)
        self.rest = self.unzip.unused_data
        return True

    def head_end(self) -> int:
        while (at := self.data.find(b"\r\n\r\n")) < 0:
            if len(self.data) > HEAD_BYTES or not self.more():
                raise WarcError("no WARC head")
        return at

    def record(self) -> tuple[dict[str, str], bytes]:
        """Headers and block. The block is framed by the content length while it is inflated: no
        more of a member is held than its head says, whatever it would grow to."""
        at = self.head_end()
        head = parse_head(bytes(self.data[:at]))
        end = at + 4 + int(head["content-length"])
        while len(self.data) < end + 4 and self.more():
            pass
        while len(self.data) <= end + 4 and self.more():
            pass
        if self.data[end:] != b"\r\n\r\n" or len(self.data) != end + 4:
            raise WarcError("content length does not frame the block")
        return head, bytes(memoryview(self.data)[at + 4 : end])


def members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a stream, one gzip member each, one after another."""
    rest = b""
    while rest := rest or stream.read(CHUNK):
        member = Member(stream, rest)
        yield member.record()
        rest = member.rest


def parse_head(data: bytes) -> dict[str, str]:
    """Headers by lower-case name."""
    lines = data.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC head")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        head[name.decode().strip().lower()] = value.decode("utf-8").strip()
    if not {"warc-type", "warc-record-id"} <= head.keys() or not head.get("content-length", "").isdigit():
        raise WarcError("head lacks a type, an identifier or a length")
    return head


def digest_fits(stated: str, data: bytes) -> bool | None:
    """Whether data has a stated digest, algorithm:value in hex or base32; None if the algorithm
    is not known."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    found = hashlib.new(name, data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def read_archive(stream) -> Iterator[tuple[int, dict[str, str], bytes, bool | None]]:
    """(position, headers, payload, whether its digests fit) for each record of any type in
    order; None for a record without a digest that can be checked.

    The payload is what follows the HTTP head, or the whole block of records that hold no HTTP
    message. The payload digest of a revisit is that of another record and not checked.
    """
    for position, (head, block) in enumerate(members(stream)):
        http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        stated = [("warc-block-digest", block)] + [("warc-payload-digest", payload)] * (head["warc-type"] != "revisit")
        fits = [x for x in (digest_fits(head[k], of) for k, of in stated if k in head) if x is not None]
        yield position, head, payload, all(fits) if fits else None


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, html, record_type, refers_to, refers_uri, payload_digest) as
    archives. A record is identified by its archive and its place there.

    Each task writes archives of about ARCHIVE_BYTES under names of its own; the returned
    manifest is a table, so only archives of tasks that ended well are named in it and a
    task that runs again leaves at most files that nothing refers to.
    """

    def run(batches):
        out, name, count, size = None, "", 0, 0
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = (row["html"] or "").encode("utf-8")
                zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = zipper.compress(record_bytes(row["page_id"], row["url"], payload, row["payload_digest"], row["refers_to"], row["record_type"], f"{folder}/{name}#{count}", row["refers_uri"])) + zipper.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    columns = ["page_id", "url", "html", "record_type", "refers_to", "refers_uri", "payload_digest"]
    return staged(records.select(*columns).mapInArrow(run, MANIFEST), "manifest")


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the archives named in the column ``archive``; one row per record, in RECORDS.

    A record that fails a digest returns with verified false, one without a known digest with
    null; one that breaks the format raises WarcError. Records of other writers have no page
    numbers, and other digests than SHA-256 keep the name of their algorithm.
    """
    n = max(1, archives.count())

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = open_store(archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for position, head, payload, fine in read_archive(stream):
                        number = lambda k, h=head: int(h[k]) if h.get(k) else None
                        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append((archive, position, head["warc-record-id"], number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page"), digest, number("x-payload-length"), payload if with_payload else None, fine))
                        held += len(payload) if with_payload else 100
                        if held >= 8 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return archives.select("archive").repartition(n, "archive").mapInArrow(run, RECORDS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.rsplit(" ", 1) for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Decide for each page whether its record is a response or revisits an equal payload.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the
    response. Only the groups of two or more are joined back; they are counted before, so
    that pages of a large group skip the shuffle by payload.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("size"))
    groups = base.filter(F.col("size") >= least).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = staged(groups.filter("copies > 1"), "payload_groups")
    first = F.col("g.first.page_id")
    revisit = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return (
        join_counted(base, groups, ["payload_digest"], "copies", ["page_id", "url"], "g")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumns({"refers_to": F.when(revisit, first), "refers_uri": F.when(revisit, F.col("g.first.url"))})
        .drop("size", "g")
    )


def warc_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per page, then read the archives back sequentially.

    A null html is an empty payload, a null url an empty URI. A null page_id stays null and is
    never referred to: such a row revisits an equal page that has one, else it is a response. Repeated rows each get a record;
    with equal page_ids all rows with the smallest are responses. Empty tables give no
    archive and no rows; other columns are not read.
    """
    return read_warc(write_warc(plan_records(pages), folder), with_payload=False)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc_round_trip(pages, scratch(spark, "warc"))
    checked = F.when(F.col("verified"), F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM g
"""
