"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trellis.operators import kernels, materialize

#: ASCII white space as a Java character class body: space, tab, newline, vertical tab, form feed, carriage return.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"


#: Rows that go to a Python worker at once while a step is written: whole texts, or two sets of shingles, each.
BATCH_ROWS = 1000
#: A key with more than one of so many of the rows is hot; there are fewer of these than so many.
HOT_PARTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send at most BATCH_ROWS rows at once to Python workers."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows as Parquet in the shared folder and go on from the files.

    The lineage ends there, so a lost executor costs no more than the tasks after this step."""
    with small_batches(df.sparkSession):
        return materialize.cut(df, name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where a lambda inside body uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(c: Column) -> Column:
    """The same value in a form that the optimizer takes for non-deterministic.

    Filters on what is computed from it stay above the projection and are not rewritten in terms of its inputs, which
    would evaluate a costly expression again, or for each element of a lambda."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges, as kernels.components says; few edges take no rounds."""
    return kernels.folded_components(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")))


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, parts: int = HOT_PARTS) -> DataFrame:
    """rows with the columns of groups (one row a key, `size` of which counts its rows), for written steps.

    A group with more than one of `parts` of the counted rows is one of fewer than `parts`: these few are broadcast, so
    no task has to take all rows of a hot key; the others are joined by the keys. Rows without a group drop out."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = groups.where(F.col(size) * parts > total)
    cold = groups.where(F.col(size) * parts <= total)
    if hot.isEmpty():
        return rows.join(cold, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
