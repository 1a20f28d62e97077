"""WARC archives: writing records with continuation segments, and reassembling them on reading.

Writing: archives are gzip files; pages with equal payloads share one response, that of the largest page id; the others become revisit
records, which name that response's record by WARC-Refers-To, and its page by a field of our own. A response's record id follows
from its page id and payload. A response's block is an HTTP head and the payload in chunked transfer framing. A block longer than
``segment_bytes`` is split: the first segment is the response record, the rest are continuation records that name
it by WARC-Segment-Origin-ID, the last of them with WARC-Segment-Total-Length. Archives are written through
Spark's text sink with the record end as line separator, so that a lost executor leaves no half-written file; a file is one gzip
member, as the sink makes it.

Reading: archives are parsed by Content-Length. Records in one piece are decoded where they are read; segments are
grouped by origin, ordered by number and checked for gaps and total length before decoding, and the payload is
checked against the digest in the record. A revisit's length is that of the response with its page id and digest.

Defined cases: null html is an empty payload. Rows with equal payloads are all responses where they have the
largest page id, repeated rows too (these get record ids at random, and their revisits name the page only); rows with a null id
are responses only if no row with that payload has an id. Rows with one id and different payloads are judged by their payloads.
Null URLs stay out of the record. An empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.llm.common import map_batches, materialize, shared_dir, text_bytes

END = b"\r\n\r\n"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Fixed value: the date that all records carry, so that archives of equal pages are equal but for record ids.
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk_bytes: int = 4096) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for at in range(0, len(payload), chunk_bytes) for x in (payload[at : at + chunk_bytes],)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a broken frame is an error."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the end that separates it from the next."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def record_id(page_id, digest: str) -> str:
    """The record id of the response that holds a page's payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def records_of(page_id, url: str | None, payload: bytes, refers_to, segment_bytes: int, chunk_bytes: int = 4096, repeated: bool = False) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations. repeated: the response stands in several rows."""
    found = payload_digest(payload)
    uri = None if url is None else "".join(c for c in url if c > " ")
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id)]
    digest, own = ("WARC-Payload-Digest", f"sha1:{found}"), f"<urn:uuid:{uuid.uuid4()}>"
    if refers_to is not None:
        refers = [("WARC-Refers-To", None if repeated else record_id(refers_to, found)), ("WARC-Refers-To-Page-ID", refers_to)]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, *refers, ("WARC-Profile", _REVISIT)], b"")]
    own = own if repeated or page_id is None else record_id(page_id, found)
    block = _HEAD + chunked(payload, chunk_bytes)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, ("Content-Type", "application/http; msgtype=response")]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def parse(archive: bytes):
    """(headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        if len(archive) < start + size:
            raise ValueError("record is cut short")
        yield headers, archive[start : start + size]
        at = start + size + len(END)


def decode(block: bytes, digest: str) -> tuple[int, str]:
    """Length and digest of the payload in an HTTP block, checked against the record's digest."""
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = payload_digest(payload)
    if digest and digest.removeprefix("sha1:") != found:
        raise ValueError("payload differs from its digest")
    return len(payload), found


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = 16 << 10, file_records: int = 512) -> None:
    """Writes a record per page under path; a file holds at most file_records segments."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("payload"))
    keyed = source.withColumn("sha", F.unhex(F.sha1("payload")))
    rows = keyed.groupBy("sha", "id").agg(F.count("*").alias("n"))
    first = F.max(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")  # of structs with different ids
    shared = materialize(rows.groupBy("sha").agg(first, F.sum("n").alias("n")).where("n > 1 and first is not null").select("sha", F.col("first.id").alias("first"), (F.col("first.n") > 1).alias("repeated")), "shared")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    told = keyed.join(shared, "sha", "left").select(F.col("id").cast("string"), "url", "payload", refers.cast("string").alias("refers"), F.coalesce("repeated", F.lit(False)).alias("repeated"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [r for page_id, url, payload, refers, repeated in zip(*[c.to_pylist() for c in batch.columns]) for r in records_of(page_id, url, payload, refers, segment_bytes, repeated=repeated)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = map_batches(told, run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", END.decode()).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


_PART = "page_id string, kind string, payload_bytes long, payload_digest string, refers_to string, origin string, segment int, total long, block binary"


def _parts(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for archive in batch.column(0):
        content = archive.as_py()
        for h, block in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
            kind, digest = h["warc-type"], h.get("warc-payload-digest", "")
            page, number = h.get("warc-page-id"), h.get("warc-segment-number")
            if kind == "revisit":
                rows.append((page, kind, None, digest.removeprefix("sha1:"), h["warc-refers-to-page-id"], None, None, None, None))
            elif number is None:
                rows.append((page, kind, *decode(block, digest), None, None, None, None, None))
            else:
                total = h.get("warc-segment-total-length")
                rows.append((page, kind, None, digest, None, h.get("warc-segment-origin-id", h["warc-record-id"]), int(number), total and int(total), block))
    columns = list(zip(*rows)) if rows else [()] * 9
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _PART.split(", ")])


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Joins the segments of each origin: (segments in order of their numbers)."""
    ids, sizes, digests = [], [], []
    for parts in batch.column(0).to_pylist():
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
            raise ValueError("a segment is missing or repeated")
        block = b"".join(p["block"] for p in parts)
        if parts[-1]["total"] != len(block):
            raise ValueError("segments don't add up to the total length")
        size, digest = decode(block, parts[0]["payload_digest"])
        ids.append(parts[0]["page_id"])
        sizes.append(size)
        digests.append(digest)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = materialize(map_batches(files, _parts, _PART), "parts")
    simple = parts.where("segment is null and kind = 'response'").select("page_id", "payload_bytes", "payload_digest")
    ordered = F.array_sort(F.collect_list(F.struct("segment", "page_id", "payload_digest", "total", "block")))
    grouped = parts.where("segment is not null").groupBy("origin").agg(ordered.alias("parts")).select("parts")  # one response each
    responses = materialize(simple.unionByName(map_batches(grouped, _whole, "page_id string, payload_bytes long, payload_digest string")), "responses")
    key = ["refers_to", "payload_digest"]
    sizes = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))  # equal in all of a group
    wanted = parts.where("kind = 'revisit'").select("page_id", *key)
    referred = materialize(sizes.join(wanted.select(*key).distinct(), key, "left_semi"), "referred")
    revisits = wanted.join(referred, key, "left")
    out = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    out = out.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = 16 << 10) -> DataFrame:
    """Writes the pages' archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, segment_bytes)
    return read_archives(spark, path, pages.schema[id_col].dataType.simpleString())
