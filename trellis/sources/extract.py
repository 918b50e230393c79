"""Incremental extraction: what can be reused is joined from the cache, the rest is read and parsed in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trellis import lang, schema


def plan_reuse(walked: DataFrame, cached: DataFrame) -> DataFrame:
    """walked with action: reuse where path, time and size are those of the cache and the time is known; else parse."""
    known = cached.select("path", "mtime_ns", "size", F.lit("reuse").alias("action"))
    rows = walked.join(known, ["path", "mtime_ns", "size"], "left")
    return rows.withColumn("action", F.when(F.col("mtime_ns") != 0, F.coalesce("action", F.lit("parse"))).otherwise("parse"))


def extract_text(path: str, content: bytes) -> dict | None:
    """One file's extraction, or None where no language owns it."""
    name = lang.detect(path)
    if name is None:
        return None
    spec, text = lang.LANGUAGES[name], content.decode("utf-8", "replace")
    found = spec.extract(text)
    return {
        "language": name, "content_hash": xxhash.xxh64_intdigest(content) - (1 << 63), "package": spec.package(text),
        "symbols": found.symbols, "imports": found.imports, "calls": found.calls,
    }


def extract_files(files: DataFrame) -> DataFrame:
    """files (path, abs or content, mtime_ns, size) -> extractions; unreadable and foreign files are dropped."""
    by_content = "content" in files.columns
    columns = ["path", "content" if by_content else "abs", "mtime_ns", "size"]
    fields = to_arrow_schema(StructType.fromDDL(schema.EXTRACTION))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                content = row.get("content")
                if not by_content:
                    try:
                        with open(row["abs"], "rb") as f:
                            content = f.read()
                    except OSError:
                        continue
                made = extract_text(row["path"], content or b"")
                if made is not None:
                    out.append({"path": row["path"], "mtime_ns": row["mtime_ns"], "size": row["size"], **made})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    extensions = [f".{e}" for e in lang.EXTENSIONS]
    owned = F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(F.col("path"), e))
    return files.where(owned).select(*columns).mapInArrow(task, schema.EXTRACTION)


def extract(walked: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Extractions of all walked files; cached ones are taken where nothing changed. Deleted paths vanish."""
    if cached is None:
        return extract_files(walked)
    plan = plan_reuse(walked, cached)
    reused = cached.join(plan.where("action = 'reuse'").select("path", "mtime_ns", "size"), ["path", "mtime_ns", "size"], "left_semi")
    return extract_files(plan.where("action = 'parse'")).unionByName(reused)
