"""A repository's index: Parquet tables and a version; and building one from a tree."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trellis import schema
from trellis.operators import calls, kernels, resolve
from trellis.operators.materialize import cut
from trellis.plans.codegraph import CodeGraph
from trellis.sources import extract, repo

VERSION = 1
TABLES = ("files", "symbols", "imports", "calls", "diagnostics")


def build(extractions: DataFrame, read: Callable[[str], str | None] = lambda path: None, written: bool = False) -> CodeGraph:
    """Extractions -> graph. Files are numbered by path, symbols by file and place. written: extractions are a step."""
    extractions = extractions if written else cut(extractions, "extractions")
    files = cut(kernels.dense_ids(extractions.select("path", "language", "content_hash", "package"), ["path"], "file_id"), "files")
    ids = files.select("path", "file_id")
    listed = extractions.join(ids, "path")
    symbols = listed.select("file_id", F.posexplode("symbols").alias("pos", "s")).select("file_id", "pos", "s.name", "s.kind", "s.span")
    symbols = cut(kernels.dense_ids(symbols, ["file_id", "pos"], "symbol_id"), "symbols")
    raw = listed.select("file_id", F.posexplode("imports").alias("ordinal", "i")).select("file_id", "ordinal", "i.specifier")
    called = listed.select("file_id", F.posexplode("calls").alias("n", "c")).select("file_id", "n", F.col("c.caller").alias("pos"), F.col("c.callee").alias("callee"))
    called = called.join(symbols.select("file_id", "pos", F.col("symbol_id").alias("caller")), ["file_id", "pos"])
    called = called.select("file_id", "caller", "callee", (F.col("file_id") * (1 << 31) + F.col("n")).alias("seq"))
    known = lambda: [r["path"] for r in ids.select("path").toLocalIterator()]  # noqa: E731  only where a manifest needs it
    resolved = cut(resolve.resolve_imports(files.select("file_id", "path", "language", "package"), raw, read, known), "resolved")
    seq = (F.col("file_id") * (1 << 31) + F.col("ordinal")).alias("seq")
    imports = resolved.where("status = 'resolved' and dst <> file_id").select(F.col("file_id").alias("src"), "dst", "confidence", seq)
    message = F.concat(F.lit("unresolved import `"), "specifier", F.lit("`: "), "reason")
    broken = resolved.where("status = 'unresolved'").select(F.lit(schema.UNRESOLVED_IMPORT).alias("kind"), "file_id", message.alias("message"), seq)
    return CodeGraph(files.select("file_id", "path", "language", "content_hash"), symbols.select("symbol_id", "name", "kind", "file_id", "span"), imports, calls.resolve_calls(symbols, called), broken)


def reader(root: str) -> Callable[[str], str | None]:
    def read(path: str) -> str | None:
        try:
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    return read


def index(spark: SparkSession, root: str, cached: DataFrame | None = None, graph: CodeGraph | None = None, times: dict[str, float] | None = None) -> tuple[CodeGraph, DataFrame]:
    """A local tree's graph and its extractions, for the next run. times gets seconds by phase.

    Extractions of unchanged files are reused; where the whole listing is that of `graph`, so is the graph."""
    times = {} if times is None else times
    began = time.perf_counter()
    rows = repo.list_files(root)
    listing = repo.signature(rows)
    times["walk"] = time.perf_counter() - began
    if graph is not None and cached is not None and listing and graph.listing == listing:
        return graph, cached
    extractions = cut(extract.extract(repo.walk(spark, rows), cached), "extractions")
    times["extract"] = time.perf_counter() - began - times["walk"]
    made = build(extractions, reader(root), written=True)
    made.listing = listing
    times["resolve"] = time.perf_counter() - began - times["walk"] - times["extract"]
    return made, extractions


def _uri(folder: str) -> str:
    """Local paths as URIs; others as they are."""
    return folder.rstrip("/") if "://" in folder else f"file://{os.path.abspath(folder)}"


def _file(spark: SparkSession, folder: str):
    """The version file's file system and place."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{_uri(folder)}/_meta.json")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def save(graph: CodeGraph, extractions: DataFrame, folder: str) -> None:
    """Tables first, the version last: a broken write leaves no valid index. folder is a path or any store's URI."""
    fs, meta = _file(graph.spark, folder)
    if fs.exists(meta):
        fs.delete(meta, False)
    for name in TABLES:
        cut(getattr(graph, name), name).write.mode("overwrite").parquet(f"{_uri(folder)}/{name}")
    cut(extractions, "extractions").write.mode("overwrite").parquet(f"{_uri(folder)}/extractions")
    out = fs.create(meta, True)
    out.write(bytearray(json.dumps({"version": VERSION, "listing": graph.listing}).encode()))
    out.close()


def exists(spark: SparkSession, folder: str) -> bool:
    fs, meta = _file(spark, folder)
    return fs.exists(meta)


def _meta(spark: SparkSession, folder: str) -> dict | None:
    """The version file, or None where there is none that can be read, or one of another version."""
    fs, meta = _file(spark, folder)
    if not fs.exists(meta):
        return None
    stream = fs.open(meta)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) and found.get("version") == VERSION else None


def load(spark: SparkSession, folder: str) -> CodeGraph | None:
    """None where there is no index, or one of another version."""
    found = _meta(spark, folder)
    if found is None:
        return None
    return CodeGraph(*[spark.read.parquet(f"{_uri(folder)}/{name}") for name in TABLES], listing=found.get("listing", ""))


def load_extractions(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.parquet(f"{_uri(folder)}/extractions") if _meta(spark, folder) else None
