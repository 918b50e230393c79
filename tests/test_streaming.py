import os
import time

from tests.test_repo import make
from trellis.streaming import watch


def test_changes_and_live_index(spark, tmp_path):
    root = make(tmp_path / "r", {"a.py": "import b\n", "b.py": "", "target/x.py": ""})
    seen, live = [], watch.LiveIndex(spark, root)

    def each(batch, batch_id):
        seen.append({(r["path"], r["action"]) for r in batch.collect()})
        live.refresh(batch)

    start = lambda: watch.changes(spark, root, str(tmp_path / "versions")).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()
    query = start()
    try:
        query.processAllAvailable()
        assert seen == [{("a.py", "insert"), ("b.py", "insert")}] and live.version == 1
        time.sleep(0.01)
        make(root, {"a.py": "import b, c\n", "c.py": ""})
        os.remove(f"{root}/b.py")
        query.processAllAvailable()
        assert set().union(*seen[1:]) == {("a.py", "update"), ("c.py", "insert"), ("b.py", "delete")}
        assert [tuple(r) for r in live.graph.dependency_pairs().collect()] == [("a.py", "c.py")]
    finally:
        query.stop()
    before = len(seen)
    make(root, {"d.py": "import a\n"})
    query = start()  # goes on from its checkpoint
    try:
        query.processAllAvailable()
        assert set().union(*seen[before:]) == {("d.py", "insert")} and len(os.listdir(tmp_path / "versions")) <= 3
    finally:
        query.stop()


def test_large_batches_are_parted(tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "ROWS_A_TASK", 2)
    reader = watch._Reader(make(tmp_path / "r", {f"{c}.py": "" for c in "abcde"}), str(tmp_path / "v"))
    first = reader.initialOffset()
    assert [len(p.rows) for p in reader.partitions(first, reader.latestOffset())] == [2, 2, 1]
    assert reader.latestOffset() == {"version": 1} and [len(p.rows) for p in reader.partitions({"version": 1}, {"version": 1})] == [0]


def test_bursts(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 100), ("a", 900), ("b", 0)], "path string, ms long").selectExpr("path", "timestamp_millis(ms) as at")
    assert sorted((r["path"], r["changes"]) for r in watch.bursts(rows, "path", "at").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_own_folders():
    assert watch.is_own("a/.git/x") and watch.is_own("target/y") and not watch.is_own("src/targets.rs")
