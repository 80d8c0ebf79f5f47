"""WARC archives: one gzip member per record, written by tasks, and a splittable reader.

A reading task scans its byte range for gzip magic, takes a candidate only if it decodes to a record header, and owns the records
that start inside the range, whatever lies beyond its end. Payloads in UTF-8 never hold the magic; for others a false candidate is
left out unless it decodes to a record header too.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, slices, stored, utf8
from candlewick.sources.files import scratch

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
RECORDS = "record_id string, record_type string, refers_to string, digest string, full_bytes long, payload binary"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, local or remote."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def record(name: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the headers alone, as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
             f"WARC-Target-URI: {name}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of the record, of the message in it, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    message, _, payload = rest[:int(headers.get("content-length", 0))].partition(b"\r\n\r\n")
    return headers, message, payload


def members(read, begin: int, end: int) -> Iterator[bytes]:
    """Decoded members that are records and start in [begin, end). read(at, size) gives bytes, fewer at the end of the file."""
    data, at = read(begin, end - begin), 0

    def more(upto: int) -> bool:
        nonlocal data
        if upto > len(data):
            new = read(begin + len(data), max(STEP, upto - len(data)))
            data += new
            return bool(new)
        return True

    while True:
        at = data.find(MAGIC, at)
        if at < 0 or at >= end - begin:
            tail = max(0, end - begin - 2)  # magic may lie across the end of the range
            if at < 0 and len(data) == end - begin and more(len(data) + STEP):
                at = tail
                continue
            return
        unpack, out, pos, good = zlib.decompressobj(31), [], at, True
        size = 0
        try:
            while not unpack.eof:
                if pos >= len(data) and not more(pos + STEP):
                    good = False  # cut off
                    break
                piece = data[pos:pos + STEP]
                out.append(unpack.decompress(piece))
                pos += len(piece)
                size += len(out[-1])
                if len(out) == 1 and size >= 7 and not out[0].startswith(b"WARC/1."):
                    good = False
                    break
        except zlib.error:
            good = False
        raw = b"".join(out) if good else b""
        if raw.startswith(b"WARC/1.") and b"\r\n\r\n" in raw:
            yield raw
            at = pos - len(unpack.unused_data)
        else:
            at += 1


def written(rows: DataFrame, folder: str, roll: int = 64 << 20) -> DataFrame:
    """(path, length) of the archives of rows (record_id, payload, digest, refers_to) in a folder that all executors share.

    Each task writes files of its own name and only names of finished tasks are returned, so repeated tasks leave no doubles.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        out, size, name = None, 0, ""
        for batch in slices(batches, "payload"):
            ids, digests, refers = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for key, payload, digest, other in zip(ids, utf8(batch.column(1)), digests, refers, strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = record(key, payload, digest, other)
                out.write(member)
                size += len(member)
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [size]})

    chosen = rows.select("record_id", "payload", "digest", "refers_to")
    return stored(chosen.mapInArrow(work, "path string, length long"), "archives")


def records(files: DataFrame, split: int = 8 << 20) -> DataFrame:
    """The records of files (path, length), read in ranges of `split` bytes."""
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "begin", F.least(F.col("begin") + split, "length").alias("end"))
    # a stated number of tasks: rows of ranges are small, and run-time coalescing would read all of them in one
    known = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    ranges = ranges.repartition(int(min(known, max(4 * files.sparkSession.sparkContext.defaultParallelism, known // 16))), "path", "begin")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "refers_to", "digest")] + [("full_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = place(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    def read(at: int, size: int, file=file) -> bytes:
                        file.seek(at)
                        return file.read(size)
                    for raw in members(read, begin, end):
                        head, message, payload = parsed(raw)
                        told = re.search(rb"(?i)content-length:\s*(\d+)", message)
                        strip = lambda s: s and s.strip("<>")
                        rows.append({"record_id": strip(head.get("warc-record-id")), "record_type": head.get("warc-type"), "refers_to": strip(head.get("warc-refers-to")),
                                     "digest": head.get("warc-payload-digest"), "full_bytes": int(told[1]) if told else len(payload), "payload": payload})
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(work, RECORDS)


def archived(pages: DataFrame, least: int = 100, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(path, length) of new archives with one record per row of pages.

    Of rows with equal payloads of at least `least` bytes that with the smallest id is a response and the others revisit it. Null html
    is empty. Rows without an id are responses and nothing refers to them, nor does a row to one of its own id.
    """
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    rows = narrow(pages, page_id=id_col, payload=html_col).withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    keys = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest").dropna()
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = stored(keys.join(groups, "digest").filter("page_id <> first").distinct(), "revisits")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    typed = rows.join(revisits, ["page_id", "digest"], "left").select(
        name("page_id").alias("record_id"), "payload", "digest", F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"))
    return written(typed, scratch(pages.sparkSession, "warc"))


def round_trip(pages: DataFrame, least: int = 100, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The records of pages, written to archives and read back."""
    return records(archived(pages, least, id_col, html_col))
