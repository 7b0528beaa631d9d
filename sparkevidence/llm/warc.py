"""WARC archives: writing pages, reading records back, and reassembling segmented ones.

Writing. A page becomes a response record whose block is an HTTP response with chunked transfer
framing. Pages with equal payloads (``min_revisit_bytes`` and more) are found by their SHA-1: the
smallest page_id is the response, the others are revisit records without a payload. A block longer
than ``segment_bytes`` is split into a first segment and continuation records that name its
identifier, so no record is larger than that. Each record is a gzip member of its own; a task
collects members into archives of ``archive_bytes`` of records or so, one file each, which Spark's
writer puts into the shared folder (it ends a file with a zero byte, which gzip readers skip).

Reading. Archives are read whole (they are of bounded size) and cut into records by the lengths in
their headers. Only continuation records and the first segments they belong to are shuffled: they
are grouped by origin identifier, ordered by segment number, and checked for gaps and against the
total length that the last one states. Then the transfer framing is decoded.

Defined results: a null payload is empty; pages of one id and equal payload are all responses; an
empty table gives no archive and no records; a record with missing segments or a wrong length gives
``payload`` null and ``error`` set instead of a crash; a null page_id is written and read as such,
and is never what others revisit. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import ensure_checkpoint_dir

SEGMENT_BYTES = 16 << 10
ARCHIVE_BYTES = 16 << 20
CHUNK_BYTES = 8192
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "record_id string, record_type string, page_id bigint, refers_to bigint, digest string, "
    "origin_id string, segment int, total_length bigint, block binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[a : a + size] for a in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def records_of_page(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    segment_bytes: int,
) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or the segments of a response."""
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    common = [
        ("WARC-Date", DATE),
        ("WARC-Page-ID", _page_urn(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None and "\r" not in url and "\n" not in url:
        common.append(("WARC-Target-URI", url))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Profile", profile),
               ("WARC-Refers-To", _page_urn(refers_to))]
        yield _record(own + common, head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    own = [("WARC-Type", "response"), ("WARC-Record-ID", record_id)]
    if len(parts) > 1:
        own.append(("WARC-Segment-Number", "1"))
    yield _record(own + common, parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(k)),
            ("WARC-Date", DATE),
        ]
        if k == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(own, part)


def _archives(segment_bytes: int, archive_bytes: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                for record in records_of_page(
                    row["page_id"], row["url"], payload, digest_of(payload), row["refers_to"],
                    segment_bytes,
                ):
                    if held and size + len(record) > archive_bytes:
                        yield _archive(held)
                        held, size = [], 0
                    held.append(gzip.compress(record, compresslevel=6, mtime=0))
                    size += len(record)
        if held:
            yield _archive(held)

    return run


def _archive(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["a"])


def write_archives(
    pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives under ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    sha = F.sha1(F.encode("html", "utf-8"))
    enough = F.octet_length("html") >= min_revisit_bytes
    firsts = (
        rows.where(enough & F.col("page_id").isNotNull())
        .select(sha.alias("sha"), "page_id")
        .groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "first_id")
    )
    # only ids and digests meet here; the pages themselves are joined with the few that revisit
    revisits = (
        rows.where(enough & F.col("page_id").isNotNull())
        .select(sha.alias("sha"), "page_id")
        .join(firsts.hint("shuffle_merge"), "sha")
        .where("page_id > first_id")
        .select("page_id", "sha", "first_id")
        .distinct()
    )
    marked = rows.withColumn("sha", sha).join(
        revisits.hint("shuffle_merge"), ["page_id", "sha"], "left"
    )
    (
        marked.select("page_id", "url", "html", F.col("first_id").alias("refers_to"))
        .mapInArrow(_archives(segment_bytes, archive_bytes), "a binary")
        .select(F.col("a").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", "\u0000")
        .text(path)
    )


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page_number(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def records_of_archive(data: bytes) -> Iterator[dict]:
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        fields = _fields(data[start:end])
        size = int(fields["content-length"])
        total = fields.get("warc-segment-total-length")
        yield {
            "record_id": fields.get("warc-record-id"),
            "record_type": fields["warc-type"],
            "page_id": _page_number(fields.get("warc-page-id")),
            "refers_to": _page_number(fields.get("warc-refers-to")),
            "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "origin_id": fields.get("warc-segment-origin-id"),
            "segment": int(fields.get("warc-segment-number", 0)),
            "total_length": int(total) if total else None,
            "block": data[end + 4 : end + 4 + size],
        }
        at = end + 4 + size


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])


def _read_batches(batches):
    schema = _schema()
    for batch in batches:
        for content in batch.column("content"):
            data = gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())).read()
            found = list(records_of_archive(data))
            for a in range(0, len(found), 256):
                yield pa.RecordBatch.from_pylist(found[a : a + 256], schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read_batches, RECORDS)


PAYLOADS = (
    "record_type string, page_id bigint, refers_to bigint, digest string, payload binary, error string"
)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = _fields(head + b"\r\n")
    return unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _decoded(rows: list[dict]) -> pa.RecordBatch:
    out = []
    for row in rows:
        payload, error = None, row.get("error")
        if error is None and row["record_type"] == "response":
            try:
                payload = _payload(row["block"])
                if row["digest"] and digest_of(payload) != row["digest"]:
                    payload, error = None, "payload digest differs"
            except ValueError as broken:
                error = str(broken)
        kept = {k: row[k] for k in ("record_type", "page_id", "refers_to", "digest")}
        out.append(kept | {"payload": payload, "error": error})
    schema = pa.schema([
        ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
        ("digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
    ])
    return pa.RecordBatch.from_pylist(out, schema)


def joined_segments(segments: list[dict]) -> dict:
    """One record from its segments: ordered by number, without gaps, of the stated length."""
    segments = sorted(segments, key=lambda x: x["segment"])
    head, last = segments[0], segments[-1]
    block = b"".join(x["block"] for x in segments)
    error = None
    if head["segment"] != 1 or [x["segment"] for x in segments] != list(range(1, len(segments) + 1)):
        error = "segments missing"
    elif last["total_length"] is None:
        error = "last segment missing"
    elif last["total_length"] != len(block):
        error = "total length differs"
    return head | {"block": block, "error": error}


def _reassembled(group: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_decoded([joined_segments(group.to_pylist())])])


def reassemble(records: DataFrame) -> DataFrame:
    """Payloads of all responses and revisits; segmented ones are put together first."""

    def whole(batches):
        for batch in batches:
            yield _decoded(batch.to_pylist())

    single = records.where("segment = 0").mapInArrow(whole, PAYLOADS)
    parts = records.where("segment > 0").withColumn("origin", F.coalesce("origin_id", "record_id"))
    return single.unionByName(parts.groupBy("origin").applyInArrow(_segments_of, PAYLOADS))


def _segments_of(group: pa.Table) -> pa.Table:
    return _reassembled(group.drop_columns(["origin"]))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives among the shared ones."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc/{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages and read them back: type, payload size and digest of each page.

    A revisit has no payload of its own; its size is that of the response it names.
    """
    write_archives(pages, path, min_revisit_bytes)
    payloads = reassemble(read_records(pages.sparkSession, path)).select(
        "page_id",
        "record_type",
        "refers_to",
        "digest",
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    sizes = payloads.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("digest"), F.col("own_bytes").alias("its_bytes")
    )
    sizes = sizes.distinct().hint("shuffle_merge")
    return payloads.join(sizes, ["refers_to", "digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "its_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
