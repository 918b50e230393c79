"""Session files: lists of files that were shown or warned about, and token logs, as JSON in one folder.

A session's files are `<id>.json` (shown), `<id>.guard.json` (warned) and `<id>.tokens.json` (events). Malformed or
missing ones are empty. They are read through Spark's own readers and written through the folder's file system."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from trellis.functions import paths

#: What a list or a log keeps, and the ends of the files' names.
SEEN_KEPT, EVENTS_KEPT = 1000, 500
SEEN, WARNED, EVENTS = ".json", ".guard.json", ".tokens.json"
EVENT = "at bigint, files_injected bigint, files_deduped bigint, est_tokens_injected bigint, est_tokens_saved bigint"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _texts(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(session_id, value): each file with this ending and no longer one, as a whole."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return spark.createDataFrame([], "session_id string, value string")
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", f"*{ending}").text(folder)
    rows = rows.select(F.col("_metadata.file_name").alias("name"), "value")
    for longer in (WARNED, EVENTS):
        if longer != ending:
            rows = rows.where(~F.endswith("name", F.lit(longer)))
    return rows.select(F.expr(f"left(name, length(name) - {len(ending)})").alias("session_id"), "value")


def read_list(spark: SparkSession, folder: str, ending: str = SEEN) -> DataFrame:
    """(session_id, place, path): the lists of all sessions, oldest first."""
    rows = _texts(spark, folder, ending).select("session_id", F.from_json("value", "array<string>").alias("x"))
    return rows.select("session_id", F.posexplode("x").alias("place", "path")).where("path is not null")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, seq, ...): the token logs of all sessions."""
    rows = _texts(spark, folder, EVENTS).select("session_id", F.from_json("value", f"array<struct<{EVENT.replace(' ', ':').replace(',:', ', ')}>>").alias("x"))
    return rows.select("session_id", F.posexplode("x").alias("seq", "e")).where("e is not null").select("session_id", "seq", "e.*")


def summary(spark: SparkSession, folder: str) -> dict:
    """Totals and a row for each session with a readable log, most saved first. Tokens are estimates."""
    rows = _texts(spark, folder, EVENTS).select("session_id", F.from_json("value", f"array<struct<{EVENT.replace(' ', ':').replace(',:', ', ')}>>").alias("x")).where("x is not null")
    add = lambda c: F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e[c], F.lit(0)))
    rows = rows.select(F.col("session_id").alias("id"), add("est_tokens_injected").alias("injected_tokens"), add("est_tokens_saved").alias("saved_tokens"), F.size("x").cast("long").alias("injections"))
    listed = [r.asDict() for r in rows.orderBy(F.desc("saved_tokens"), "id").collect()]  # a row a session, for a page
    total = lambda name: sum(r[name] for r in listed)
    return {"estimated": True, "total_injected_tokens": total("injected_tokens"), "total_saved_tokens": total("saved_tokens"), "total_injections": total("injections"), "sessions": listed}


def save(spark: SparkSession, folder: str, session_id: str, values: list, ending: str = SEEN) -> None:
    """Replace one session's file; shown files and events keep the latest SEEN_KEPT and EVENTS_KEPT."""
    keep = {SEEN: SEEN_KEPT, EVENTS: EVENTS_KEPT}.get(ending, len(values))
    safe = spark.range(1).select(paths.safe_session_id(F.lit(session_id))).first()[0]
    fs, target = _fs(spark, f"{folder}/{safe}{ending}")
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(values[max(0, len(values) - keep) :]).encode()))
    out.close()


def append_event(spark: SparkSession, folder: str, session_id: str, event: dict) -> None:
    """One event more in a session's log; a malformed log is started again."""
    safe = spark.range(1).select(paths.safe_session_id(F.lit(session_id))).first()[0]
    old = read_events(spark, folder).where(F.col("session_id") == safe).orderBy("seq").collect()
    names = [part.split()[0] for part in EVENT.split(", ")]
    save(spark, folder, session_id, [*[{n: r[n] for n in names} for r in old], event], EVENTS)
