"""WARC archives: a writer with revisit records, and a splittable reader.

The reader's tasks get byte ranges. Each scans its range for gzip magic, takes a candidate as a member only if its decoded
start is a WARC header, follows members from there, and owns the records that begin inside its range.

Defined results: null html is an empty payload; among rows with equal payloads of at least min_bytes that with the smallest
page_id is the response (all of them, if several rows share that id), a null page_id is never smallest unless all are null;
null urls leave out the target; an empty table gives no records; long pages are read in parts; only page_id, url and html are
read, so other columns may have any name. The job fails with Damaged where an archive is shorter than listed, ends within a
record, or has other records than the list says begin in a range, and where a record's digest or length is another. Lists that
don't say where records begin leave one case unnoticed: a cut at a record's begin or within its first bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.common import chunks, materialised, shared_dir
from florilege.operators.stored import opened, qualified

#: Bytes after which a file is closed and a next one begun, bytes of a reader's range, and bytes fetched at once.
FILE_BYTES, SPLIT_BYTES, FETCH_BYTES = 512 << 20, 16 << 20, 1 << 20
#: So many revisits are sent to every task at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000
MAGIC, SAYS = b"\x1f\x8b\x08", b"WARC/1."
_ID = "<urn:florilege:page:{}>"
_ID_PATTERN = re.compile(r"<urn:florilege:page:(-?\d+)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member with a response, or a revisit whose block holds the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID.format('' if refers_to is None else refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(raw: bytes) -> dict:
    """Fields of a decoded record; a response's digest is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise Damaged(f"damaged record {fields['warc-record-id']}")
    number = lambda x: int(m[1]) if (m := _ID_PATTERN.fullmatch(x or "")) else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


class Damaged(ValueError):
    """An archive that ends within a record, or a record that doesn't hold what it says."""


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records of a gzip file whose members begin in [start, end).

    Bytes that look like a member but don't decode to a record are passed over, as a range may begin anywhere; a member that
    begins as a record and breaks off is damage, which is raised.
    """
    buffer, base = b"", start  # the file's bytes from base on

    def fetch(at: int) -> bytes:
        file.seek(at)
        got = file.read(min(FETCH_BYTES, size - at))
        if not got:
            raise Damaged(f"the archive ends at byte {at} of {size}")
        return got

    at, done = start, None
    while at < end:
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            keep = max(at, base + len(buffer) - len(MAGIC) + 1)
            if base + len(buffer) >= size:
                break
            buffer, base, at = buffer[keep - base :] + fetch(base + len(buffer)), keep, keep
            continue
        at = base + found
        if at >= end:
            break
        buffer, base = buffer[found:], at
        inflate, out, head, upto, part = zlib.decompressobj(31), [], b"", at + len(buffer), buffer
        broken = False
        while True:
            try:
                out.append(inflate.decompress(part))
            except zlib.error:
                broken = True
                break
            if len(head) < len(SAYS):
                head += out[-1][: len(SAYS)]
            if inflate.eof or (len(head) >= len(SAYS) and not head.startswith(SAYS)):
                break
            if upto >= size:
                broken = True
                break
            part = fetch(upto)
            upto += len(part)
        if head.startswith(SAYS):
            if broken:
                raise Damaged(f"the record at byte {at} of {size} breaks off")
            yield b"".join(out)
            rest = inflate.unused_data
            at = done = upto - len(rest)
            buffer, base = rest, at
        else:
            at += 1
    if done is not None and end >= size > done:
        raise Damaged(f"{size - done} bytes after the last record are none")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder, a URI that pyarrow can open; returns (path, bytes, records,
    starts: where each record begins).

    File names follow from the task, and a file appears by a rename, so a task that runs again replaces what it wrote.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary"))))
    firsts = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    later = rows.select("page_id", "sha").join(firsts.select("sha", "first"), "sha").where("page_id IS NULL OR page_id <> first").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first").distinct()
    later = materialised(later, "revisits")
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "first", F.col("s").isNotNull().alias("revisit"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = opened(folder)
        system.create_dir(root)
        done, stream, size, starts = [], None, 0, []
        final = temporary = ""

        def close() -> None:
            stream.close()
            system.move(temporary, final)
            done.append((final, size, starts))

        for batch in (part for whole in batches for part in chunks(whole, "html")):
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    final = f"{root}/part-{context.partitionId():06d}-{len(done):04d}.warc.gz"
                    temporary = f"{final}.{context.taskAttemptId()}.tmp"
                    stream, size, starts = system.open_output_stream(temporary, compression=None), 0, []
                one = record(page_id, url, html.encode("utf-8", "replace"), first, revisit)
                stream.write(one)
                starts.append(size)
                size += len(one)
                if size >= file_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"path": p, "bytes": b, "records": len(x), "starts": x} for p, b, x in done], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("starts", pa.list_(pa.int64()))]))

    return materialised(rows.mapInArrow(store, "path string, bytes long, records long, starts array<long>"), "archives")


def read(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of files (path, bytes, and where known starts): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload. Ranges are scanned without regard to starts; these only tell how many records a range must have had."""
    folder = qualified(files.sparkSession, folder)
    starts = F.col("starts") if "starts" in files.columns else F.lit(None).cast("array<long>")
    ranges = files.where(F.col("bytes") > 0).select("path", "bytes", starts.alias("starts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    last = F.col("start") + split_bytes >= F.col("bytes")  # what should begin behind the file's end is missed by its last range
    expected = F.size(F.filter("starts", lambda x: (x >= F.col("start")) & (last | (x < F.col("start") + split_bytes))))
    ranges = ranges.select("path", "bytes", "start", F.when(F.col("starts").isNotNull(), expected).alias("expected"))
    n = ranges.count()
    ranges = ranges.repartition(max(1, min(n, 4096)), "path", "start") if n else ranges
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, size, start, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path) as file:
                    ready, held, n = [], 0, 0
                    for raw in members(file, size, start, min(size, start + split_bytes)):
                        ready.append(parse(raw))
                        held, n = held + len(raw), n + 1
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(ready, schema=types)
                            ready, held = [], 0
                    if ready:
                        yield pa.RecordBatch.from_pylist(ready, schema=types)
                    if expected is not None and n != expected:
                        raise Damaged(f"{n} records instead of {expected} begin in {path} from byte {start} on")

    return ranges.mapInArrow(scan, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or f"{shared_dir(spark)}/florilege/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), folder).drop("payload", "url")


#: DuckDB has no SHA-1 in base 32 for text, so it is made from the hexadecimal one, five bits at a time.
ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(sha, 1 + (k // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (k % 8))) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (sha)"""
