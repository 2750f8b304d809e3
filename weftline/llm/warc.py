"""WARC archives of pages: writing with segments and revisits, and reading with segment reassembly.

Writing: each page is a record whose block is an HTTP response with a chunked body. Of pages with equal payloads of
at least SHARED bytes the one with the smallest id (rows repeated with that id: each of them) is a response, the
others are revisits of it. Blocks over SEGMENT bytes are split into a first record and continuation records that
name it as their origin. Archives are text files of records written by Spark's own writer, so any store will do;
no chunk or segment ends inside a character.

Reading: archives are cut into records by their content lengths. Records with a segment number are grouped by
origin, ordered by number, checked to be complete and of the stated total length, and joined; then the chunked
framing is decoded and the digest compared with the one stated. A record that fails a check raises an error.

Null html counts as empty. Null ids and urls are written as absent fields and read back as null. Ids may be numbers
or strings; an id or url that would not survive in a header line is written in hexadecimal. A file holds at most
PER_FILE records of at most SEGMENT bytes and a head, so reading one whole is bounded.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scratch_path, small_or_not, trimmed

SHARED, SEGMENT, CHUNK, PER_FILE = 100, 16384, 4096, 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, origin string, segment int, total bigint, block binary"


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """data in pieces of at most size bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, CHUNK)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        if body[at + n : at + n + 2] != b"\r\n" or len(out[-1]) != n:
            raise ValueError("broken chunk")
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head.encode(), len(block), block)


def _named(field: str, value: object) -> list[tuple[str, object]]:
    """A field that holds value, in hexadecimal if need be."""
    text = None if value is None else str(value)
    if text is None or text and text.isascii() and text.isprintable() and text == text.strip():
        return [(field, text)]
    return [(f"{field}-Hex", text.encode("utf-8", "surrogatepass").hex())]


def _value(fields: dict[str, str], field: str) -> str | None:
    if f"{field}-hex" in fields:
        return bytes.fromhex(fields[f"{field}-hex"]).decode("utf-8", "surrogatepass")
    return fields.get(field)


def records(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, refers_url: str | None, mark: str) -> Iterator[bytes]:
    """The records of one page; mark makes their ids unique."""
    name = lambda *x: f"<{uuid.UUID(bytes=hashlib.blake2b(repr((mark, *x)).encode(), digest_size=16).digest()).urn}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    uri = None if url is None else " ".join(url.split())
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), *_named("WARC-Page-ID", page_id), ("WARC-Page-URL", None if url is None or url == uri else url.encode().hex())]
    if refers_to is not None:
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", refers_url), *_named("WARC-Refers-To-Page-ID", refers_to), ("WARC-Payload-Length", len(payload))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name()), *common, *extra], head)
        return
    block = head + chunked(payload)
    pieces = list(cuts(block, SEGMENT))
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name()), *common]
    if len(pieces) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        total = len(block) if i == len(pieces) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(i)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name()), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], piece)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields by lower-case name, and the block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        n = int(fields["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield fields, data[start : start + n]
        at = start + n + 4


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, stated: str) -> tuple[str, int]:
    payload = payload_of(block)
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload digest {digest} is not the stated {stated}")
    return digest, len(payload)


def _written(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            out = []
            for page_id, url, html, digest, first, first_url in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns], strict=True):
                n += 1
                for r in records(page_id, url, html.encode(), digest, first, first_url, f"{task}-{n}"):
                    out.append(r[:-2].decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages in the folder path, gzip-compressed."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = rows.where(F.octet_length("html") >= SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = small_or_not(keep(same, "op9-shared"))
    rows = rows.join(same, "digest", "left").withColumn("first", F.when(F.col("first").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first")))
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("first").cast("string"), "first_url").mapInArrow(trimmed(_written), "value string")
    rows.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", PER_FILE).text(path)


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows, held = [], 0
            for f, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                kind, segment = f["warc-type"], number(f.get("warc-segment-number"))
                stated = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                url = bytes.fromhex(f["warc-page-url"]).decode() if "warc-page-url" in f else f.get("warc-target-uri")
                digest, size = stated, number(f.get("warc-payload-length"))
                if kind == "response" and segment is None:
                    digest, size = _checked(block, stated)
                origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                rows.append((_value(f, "warc-page-id"), url, kind, _value(f, "warc-refers-to-page-id"), digest, size, origin, segment, number(f.get("warc-segment-total-length")), block if segment else None))
                held += len(block) if segment else 100
                if held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def _joined(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        digests, sizes = [], []
        for stated, total, parts in zip(*[batch.column(i).to_pylist() for i in (4, 5, 6)], strict=True):
            block = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                raise ValueError("segments are missing or their total length is wrong")
            digest, size = _checked(block, stated)
            digests.append(digest)
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"])


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload_bytes of each page in a folder of archives."""
    found = keep(spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(_read), READ), "op9-records")
    out = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    lead = F.when(F.col("segment") == 1, F.struct("page_id", "url", "record_type", "refers_to", F.col("payload_digest").alias("stated")))
    parts = found.where("segment is not null").groupBy("origin").agg(F.max(lead).alias("lead"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    schema = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"
    joined = parts.select("lead.*", "total", "parts").mapInArrow(trimmed(_joined), schema)
    both = found.where("segment is null").select(*out).unionByName(joined)
    return both.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    return read_archives(pages.sparkSession, path, pages.schema[id_col].dataType.simpleString())
