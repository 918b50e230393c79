"""WARC files: one gzip member a record, and a reader that splits files by byte ranges.

Writing: each task writes its rows to one archive in the shared folder, under a name of its attempt, and renames
it to the name of its partition at the end; a task that runs again replaces the file by an equal one. Equal
payloads are found by a grouped minimum over digests before; only the first holds the payload.

Reading: files are cut into ranges of equal size. A task scans its range for the gzip magic, accepts a place only
if it decodes there to a record's header, then walks from member to member. It owns the records that start inside
its range, so each record is read once whatever the cut, and a range may hold none.

Defined cases: a null payload is empty; payloads below `min_bytes` never become revisits; ties go to the smallest
id; an empty table writes no archive and reads no rows; repeated ids give repeated records."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trellis.operators.materialize import scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
#: Ranges that one task reads where there are enough for all cores.
RANGES_A_TASK = 16
READ_BYTES = 1 << 18
RECORD_SCHEMA = "page_id long, target string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_DATE = "2000-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Each page with its digest and the id of the response it refers to (null where it is the response)."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    large = F.length("body") >= min_bytes
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(firsts, "digest", "left").select(
        "page_id", "target", "body", "digest", F.when(large & (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to")
    )


def _record(page_id: int | None, target: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", target or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write plan_records()' rows; (file, bytes, records) for each archive. Eager where an action runs on it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        final, temp = f"{root}/part-{part:06d}.warc.gz", f"{root}/_tmp-{part:06d}-{uuid.uuid4().hex}"
        out, n, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(temp)
                data = _member(_record(row["page_id"], row["target"], row["body"], row["digest"], row["refers_to"]), level)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"file": [f"part-{part:06d}.warc.gz"], "bytes": [size], "records": [n]})

    return records.mapInArrow(task, "file string, bytes long, records long")


def _decode(fs, path: str, start: int, until: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded member) for members starting in [start, until)."""
    with fs.open_input_file(path) as f:
        size = f.size()
        buffer, base = b"", start  # buffer holds the bytes from base on

        def more() -> bool:
            nonlocal buffer
            data = f.read_at(min(READ_BYTES, size - base - len(buffer)), base + len(buffer)) if base + len(buffer) < size else b""
            buffer += data
            return bool(data)

        synced = start == 0
        while base < until:
            if not synced:
                at = buffer.find(MAGIC)
                if at < 0:
                    drop = max(0, len(buffer) - 2)
                    buffer, base = buffer[drop:], base + drop
                    if not more():
                        return
                    continue
                buffer, base = buffer[at:], base + at
                if base >= until:
                    return
            if not buffer and not more():
                return
            z, parts, fed, bad = zlib.decompressobj(31), [], 0, False
            try:
                while not z.eof:
                    if fed == len(buffer) and not more():
                        bad = True
                        break
                    parts.append(z.decompress(buffer[fed:]))
                    fed = len(buffer)
                    if not synced and sum(map(len, parts)) >= 5 and not b"".join(parts[:2]).startswith(b"WARC/"):
                        bad = True
                        break
            except zlib.error:
                bad = True
            data = b"" if bad else b"".join(parts)
            if bad or not data.startswith(b"WARC/"):
                if synced:
                    raise ValueError(f"broken archive member at {base} in {path}")
                buffer, base = buffer[1:], base + 1
                continue
            used = fed - len(z.unused_data)
            yield base, data
            synced = True
            buffer, base = buffer[used:], base + used


def _id(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _parse(data: bytes, payloads: bool) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    if kind == "response":
        digest, size = hashlib.sha256(body).hexdigest(), len(body)
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    else:
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    return {
        "page_id": _id(fields["WARC-Record-ID"]), "target": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": digest,
        "payload_bytes": size, "refers_to": _id(fields.get("WARC-Refers-To")), "payload": body if payloads and kind == "response" else None,
    }


def read(spark: SparkSession, folder: str, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of `files` (file, bytes) in a folder; payload is null unless asked for.

    Ranges are dealt out in turn to a number of tasks that follows from the bytes; rows this small would else be
    coalesced to a few tasks, whatever they stand for."""
    ranges = files.select("file", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start"))
    n = files.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1))), F.lit(0))).first()[0]
    ranges = ranges.repartition(max(1, min(n, 2 * spark.sparkContext.defaultParallelism), -(-n // RANGES_A_TASK)))
    schema = pa.schema([("page_id", pa.int64()), ("target", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for _, data in _decode(fs, f"{root}/{row['file']}", row["start"], min(row["start"] + range_bytes, row["bytes"])):
                    rows.append(_parse(data, payloads))
                    held += len(data) if payloads else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(task, RECORD_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write archives for all pages into the shared folder, then read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    written = write(plan_records(pages, id_col, url_col, body_col, min_bytes), folder)
    listing = f"{folder}-files"
    scratch = scratch_path(spark, os.path.basename(listing))
    written.write.parquet(scratch)
    return read(spark, folder, spark.read.schema(written.schema).parquet(scratch))
