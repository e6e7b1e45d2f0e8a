"""WARC archives: a writer with revisit records and a splittable reader.

Writing: each record is a gzip member of its own; each task writes one archive under a name of its own attempt and returns it, so that the manifest lists
what finished attempts wrote and a lost executor's leftovers are never read. Of records with equal payloads of at least ``min_revisit_bytes`` bytes (equal
SHA-256), that with the largest page_id is the response and the others revisit it.

Reading: an archive is dealt out as byte ranges. A task scans its range for the gzip magic, accepts a candidate only if it inflates to a WARC version line
and header, and owns the records that start inside, the last of which it reads on past the end of the range. Memory: one range and one record.

Archives go to the shared folder of the session through pyarrow's file systems (local paths and the remote stores it knows); nothing is collected.

Edge cases: null html is an empty payload; a null or odd url is written percent-encoded, or left out; rows with a null page_id are written without one (page_id null
when read; they revisit the largest page_id of their payload where there is one); repeated rows of the largest page_id are all responses; an empty
table gives no archives and no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.store import new_path, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES, SLICE = 8 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, _MANIFEST_NAME = "file string, size long, records long", "manifest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, file string, offset long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, not compressed. A revisit holds the HTTP header of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?&=#;,+@!$'()*[]~-._"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, n, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, html, refers_to, revisit = (batch.column(k)[i].as_py() for k in range(5))
                out.write(gzip_member(record(page_id, url, (html or "").encode(), refers_to, revisit, date), level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [store.get_file_info(f"{root}/{name}").size], "records": [n]})

    return write


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (``page_id, url, html``); returns the manifest ``file, size, records``, which is also in ``folder`` (see ``read_manifest``)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("same", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    # written before it is joined: a join right above a sum shares its exchange, which Spark then can't split at a hot payload
    latest = written(rows.groupBy("same").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("same", "latest"), "warc-latest")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest")) & (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes)
    linked = rows.join(latest, "same", "left").select("page_id", "url", "html", F.when(revisit, F.col("latest")).alias("refers_to"), revisit.alias("revisit"))
    linked.mapInArrow(_writer(folder, level, date), MANIFEST).write.parquet(f"{folder}/{_MANIFEST_NAME}")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What finished attempts wrote to a folder: ``file, size, records``."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{_MANIFEST_NAME}")


def _header(raw: bytes) -> tuple[str, dict[str, str]]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def is_record(raw: bytes, at: int) -> bool | None:
    """Whether a gzip member that inflates to a WARC header, however long, starts at ``at``; None if ``raw`` ends within the header."""
    z, out = zlib.decompressobj(31), bytearray()
    try:
        while at < len(raw) and not z.eof:
            seen = max(0, len(out) - 3)
            out += z.decompress(raw[at : at + 4096])
            at += 4096
            if not b"WARC/1.".startswith(out[:7]):
                return False
            if (end := out.find(b"\r\n\r\n", seen)) >= 0:
                return "content-length" in _header(bytes(out[:end]))[1]
    except zlib.error:
        return False
    return False if z.eof or len(out) < 7 else None


def members(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of the records that start in [start, end) of an open file."""
    source.seek(start)
    raw, at, more = source.read(end - start + len(MAGIC) - 1), 0, True
    while (at := raw.find(MAGIC, at)) >= 0 and start + at < end:
        while more and len(raw) - at < SLICE:  # a header may lie across the end of the range
            more = bool(block := source.read(SLICE))
            raw += block
        while (found := is_record(raw, at)) is None:  # a long header: twice as much each time
            if not (block := source.read(max(SLICE, len(raw) - at)) if more else b""):
                raise EOFError(f"record at {start + at} is cut off")
            raw += block
        if not found:
            at += 1
            continue
        z, out, k = zlib.decompressobj(31), [], at
        while not z.eof:
            if k >= len(raw):
                block = source.read(SLICE) if more else b""
                if not block:
                    raise EOFError(f"record at {start + at} is cut off")
                raw += block
            part = raw[k : k + SLICE]
            out.append(z.decompress(part))
            k += len(part)
        yield start + at, b"".join(out)
        at = k - len(z.unused_data)


def parsed(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    _, fields = _header(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    page = lambda x: None if x is None or x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    url = fields.get("warc-target-uri")
    return {
        "page_id": page(fields["warc-record-id"]), "url": None if url is None else unquote(url), "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")),
        "payload": None if revisit else payload, "payload_bytes": int(_header(http)[1]["content-length"]) if revisit else len(payload), "payload_digest": digest,
    }


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for part in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(part["file"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for offset, data in members(source, part["start"], part["stop"]):
                        row = parsed(data) | {"file": part["file"], "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (``file, size``); see ``RECORDS`` for the columns."""
    ranges = manifest.select("file", F.explode(F.expr(f"sequence(0L, size - 1, {range_bytes}L)")).alias("start"), "size").select("file", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"))
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(max(n, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_reader(with_payload), RECORDS)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``file, size`` of the .warc.gz files below a folder: those of its manifest if ``write_warc`` made it, as lost attempts leave files behind, else all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFEST_NAME}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return read_manifest(spark, folder).select("file", "size")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new folder of archives and reads them back; an archive of which not all records are read is an error."""
    manifest = write_warc(pages, new_path(pages.sparkSession, "warc"), **options)
    back = written(read_warc(manifest, with_payload=False), "warc-read")
    check_counts(back, manifest)
    return back


def check_counts(back: DataFrame, manifest: DataFrame) -> None:
    """Raises if the records read (``file``) are not as many as the manifest (``file, records``) has."""
    read = back.groupBy("file").agg(F.count("*").alias("read"))
    short = manifest.join(read, "file", "left").where(F.coalesce("read", F.lit(0)) != F.col("records")).head()
    if short:
        raise ValueError(f"{short.read or 0} of {short.records} records read from {short.file}")
