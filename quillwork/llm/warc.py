"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. The reader cuts archives into byte ranges; a task scans its range for the gzip magic,
takes a place for a member only if it inflates to a WARC header and onwards to a whole record, and owns the records that start
inside its range, however far they run past its end."""

from __future__ import annotations


import uuid
import zlib
from collections.abc import Iterator


import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, stage, staging_root, table, utf8

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
READ = 1 << 20
#: Payloads from this size on are stored once; equal ones are revisits.
LEAST_DEDUP = 100
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_URN, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, when: str) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless the record is a revisit."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    clean = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when}", f"WARC-Target-URI: {clean}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, when: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages(page_id, url, html) as one .warc.gz per task under `folder`, a URI all executors reach; (path, bytes, records).

    A task writes under a name of its own attempt and reports it only when the file is whole, so lost or repeated attempts
    leave files that no result names."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("digest", F.sha2("html", 256)).withColumn("large", F.octet_length("html") >= LEAST_DEDUP)
    first = keyed.where("large and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = keyed.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("large") & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = _open(folder)
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, size, records = None, 0, 0
        for b in batches:
            for page, url, html, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                member = encode_record(page, url, html, digest, refers, when)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])

    return stage(marked.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def member_at(data: bytes, at: int, more) -> tuple[bytes, int] | None:
    """(inflated record, its compressed size) if a whole gzip member with a WARC record starts at `at`; more() gives further bytes."""
    inflater, out, used, first = zlib.decompressobj(31), bytearray(), 0, data[at:]
    try:
        chunk = first
        while chunk:
            out += inflater.decompress(chunk, READ)
            while inflater.unconsumed_tail:
                if not out.startswith(b"WARC/"[: len(out)]):
                    return None
                out += inflater.decompress(inflater.unconsumed_tail, READ)
            used += len(chunk)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
            if inflater.eof:
                size = used - len(inflater.unused_data)
                head, mark, body = bytes(out).partition(b"\r\n\r\n")
                length = parse_header(head).get("content-length", "") if mark else ""
                return (bytes(out), size) if length.isdigit() and int(length) + 4 == len(body) else None
            chunk = more()
    except zlib.error:
        return None
    return None


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(path: str, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end) of the archive."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        total = f.size()
        f.seek(start)
        base, data = start, b""
        at = start
        while at < end:
            if at - base > READ:
                data, base = data[at - base :], at
            if len(data) - (at - base) < len(MAGIC):
                data += f.read(READ)
                if len(data) - (at - base) < len(MAGIC):
                    return
            found = data.find(MAGIC, at - base)
            if found < 0:
                at = base + len(data) - len(MAGIC) + 1
                continue
            at = base + found
            if at >= end:
                return
            grown = []

            def more() -> bytes:
                chunk = f.read(READ) if f.tell() < total else b""
                grown.append(chunk)
                return chunk

            got = member_at(data, found, more)
            data += b"".join(grown)
            if got:
                yield got[0]
                at += got[1]
            else:
                at += 1


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """files(path, bytes) -> a row per record: record_type, record_id, target_uri, page_id, refers_to, payload_digest,
    declared_bytes (of the full payload, by the HTTP header), payload (null for revisits)."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "bytes").alias("end")).repartition(bucket_count(files.sparkSession), "path", "start")
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload", pa.binary())])

    def rows(record: bytes) -> tuple:
        head, _, rest = record.partition(b"\r\n\r\n")
        h = parse_header(head)
        http, _, body = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
        number = lambda k: int(h[k]) if h.get(k) else None
        return h["warc-type"], h["warc-record-id"], h["warc-target-uri"], number("x-page-id"), number("x-refers-to-page-id"), h["warc-payload-digest"].removeprefix("sha256:"), int(parse_header(http)["content-length"]), None if h["warc-type"] == "revisit" else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = 0
                for record in split_records(path, start, end):
                    held.append(rows(record))
                    size += len(record)
                    if size > 4 * READ:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)

    return ranges.mapInArrow(run, "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, declared_bytes long, payload binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back.

    A response's size and digest come from the payload read; a revisit's from its own headers, which describe the full
    payload. Null html is an empty payload; pages without an id are responses; rows that repeat a page id and payload are
    responses each, as a page is no revisit of itself; an empty table gives no rows; other columns are ignored."""
    folder = f"{staging_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = read_archives(write_archives(pages, folder), split)
    full = F.col("record_type") == "response"
    return found.select("page_id", F.when(full, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"), F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {LEAST_DEDUP} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {LEAST_DEDUP} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_DEDUP} AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)"""
