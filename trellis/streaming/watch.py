"""A stream of file changes, and an index that follows it."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trellis.operators import materialize
from trellis.sources import repo, store

#: Folders whose changes are the tools' own.
IGNORED = (".git", ".trellis", "target")
DEBOUNCE = "500 milliseconds"
CHANGE = "path string, action string, mtime_ns bigint, size bigint"


#: Changes in one task of a batch.
ROWS_A_TASK = 10_000


class _Span(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    """Offsets are versions; a version's listing is a file in `folder`, so an in-place edit and a deletion are changes
    like a new file, and offsets stay small. Listings before the last committed version are deleted."""

    def __init__(self, root: str, folder: str):
        self.root, self.folder = root, folder
        os.makedirs(folder, exist_ok=True)

    def _file(self, version: int) -> str:
        return os.path.join(self.folder, f"{version}.json")

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.folder) if n.removesuffix(".json").isdigit())

    def _listing(self, version: int) -> dict:
        if not version:
            return {}
        with open(self._file(version), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = {path: [mtime, size] for path, _, mtime, size in repo.list_files(self.root) if not is_own(path)}
        last = max(self._versions(), default=0)
        if files == self._listing(last):
            return {"version": last}
        temp = os.path.join(self.folder, "next")
        with open(temp, "w", encoding="utf-8") as f:
            json.dump(files, f)
        os.replace(temp, self._file(last + 1))
        return {"version": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._listing(start["version"]), self._listing(end["version"])
        rows = [(p, "insert" if p not in old else "update", *v) for p, v in new.items() if old.get(p) != v]
        rows = sorted([*rows, *[(p, "delete", 0, 0) for p in old if p not in new]])
        return [_Span(rows[i : i + ROWS_A_TASK]) for i in range(0, len(rows), ROWS_A_TASK)] or [_Span([])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for version in self._versions():
            if version < end["version"]:
                os.remove(self._file(version))


class RepoChanges(DataSource):
    """spark.readStream.format("repo_changes").option("listings", folder).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repo_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        root = self.options["path"]
        return _Reader(root, self.options.get("listings", os.path.join(root, ".trellis", "listings")))


def is_own(path: str) -> bool:
    return any(part in IGNORED for part in path.split("/"))


def changes(spark: SparkSession, root: str, listings: str | None = None) -> DataFrame:
    """listings: where versions are kept; a stream of its own each, and the same again for a stream that goes on."""
    spark.dataSource.register(RepoChanges)
    reader = spark.readStream.format("repo_changes")
    return (reader.option("listings", listings) if listings else reader).load(root)


class LiveIndex:
    """Rebuilds the graph for each batch of changes; version counts the rebuilds.

    The files of the version before stay for those who still read it; older ones are deleted."""

    def __init__(self, spark: SparkSession, root: str, publish: Callable[["LiveIndex"], None] = lambda live: None):
        self.spark, self.root, self.publish = spark, root, publish
        self.version, self.graph, self.extractions = 0, None, None
        self._steps: list[list[str]] = []

    def refresh(self, batch: DataFrame | None = None, batch_id: int | None = None) -> None:
        if batch is not None and batch.isEmpty():
            return
        with materialize.recorded() as made:
            self.graph, self.extractions = store.index(self.spark, self.root, self.extractions, self.graph)
            self.version += 1
            self.publish(self)
        self._steps.append(made)
        while len(self._steps) > 2:
            for path in self._steps.pop(0):
                materialize.remove(self.spark, path)

    def start(self, checkpoint: str, interval: str = DEBOUNCE):
        return changes(self.spark, self.root, os.path.join(checkpoint, "listings")).writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def bursts(events: DataFrame, by: str, at: str, gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """Changes with less than a gap between neighbours as one row; for streams and tables."""
    return events.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("burst")).agg(F.count("*").alias("changes"))
