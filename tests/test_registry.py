"""Registered graph queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_queries_match_sql(spark):
    import duckdb

    from trellis.plans import registry

    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    for name, sql in registry.oracle_sql().items():
        want, got = con.execute(sql).df(), registry.queries()[name](spark, SF).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        rows = lambda d: sorted(str([None if x != x else x for x in r]) for r in d[columns].astype(object).values.tolist())  # noqa: B023, E731
        assert rows(want) == rows(got), name


def test_queries_without_sql_read_all_orders(spark):
    import duckdb

    from trellis.plans import registry, workloads

    graph = workloads.SQL.replace("select * from lineitem", f"select * from '{SF}/lineitem.parquet'")
    graph = graph.replace("from part)", f"from '{SF}/part.parquet')").replace("from labels", f"from '{SF}/labels.parquet'")
    want = duckdb.connect().execute(f"with {graph} select (select count(*) from imports), (select count(*) from symbols), (select count(*) from calls)").fetchone()
    row = registry.queries()["graph_stats"](spark, SF).first()
    assert (row["imports"], row["symbol_count"], row["calls"]) == want and want[0] > 2500


def test_shortest_path_of_two_files(spark, tmp_path):
    import duckdb

    from trellis.plans import registry

    con = duckdb.connect()
    for name, rows, kinds in (
        ("part", [(1, "A", "Brand#1", "x"), (2, "B", "Brand#1", "y")], "p_partkey long, p_type string, p_brand string, p_name string"),
        ("lineitem", [(20, 1, 1, 1, "N"), (20, 2, 2, 1, "N")], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string"),
        ("labels", [(0, 0)], "doc_id long, toxic long"),
    ):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["shortest_path"]).fetchall()
    got = registry.queries()["shortest_path"](spark, str(tmp_path))
    assert sorted((r["position"], r["file"]) for r in got.collect()) == sorted(want) and len(want) == 2
