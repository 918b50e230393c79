"""Steps written to the folder that driver and executors share, so loops have no growing lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the steps that are still there, with their sessions; and the lists of open recordings.
_held: dict[str, SparkSession] = {}
_recordings: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset (one machine)."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not getattr(context, "_trellis_scratch", None):
        context._trellis_scratch = "file://" + tempfile.mkdtemp(prefix="trellis-")
    return context._trellis_scratch


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system of its own scheme."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _held.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_held.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends or by done_with."""
    path = f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}-{name}"
    _held[path] = spark
    for made in _recordings:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all steps written inside, for a caller that knows when nothing reads them any more."""
    made: list[str] = []
    _recordings.append(made)
    try:
        yield made
    finally:
        _recordings.remove(made)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows as Parquet and go on from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trellis_step = path
    return out


def done_with(*steps: DataFrame | None) -> None:
    """Delete the files of steps (as returned by cut) that no later plan reads."""
    for step in steps:
        path = getattr(step, "_trellis_step", None)
        if path in _held:
            remove(_held[path], path)
