"""Analytics on top of the graph: audit, guard, sessions, and what a visual map shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trellis.functions import paths
from trellis.operators.materialize import cut
from trellis.plans.codegraph import CodeGraph

GUARD_FLOOR = 4


def audit(graph: CodeGraph) -> DataFrame:
    """One row: problems are cycles and broken imports, smells are hubs and isolated files.

    Cycles are counted as sets of files and hubs as bridges; no cycle's path and no degree is looked for."""
    graph.links  # written once for all that follows
    found = {"cycle": graph.cycles(), "broken": graph.broken_imports(), "hub": graph.bridges.join(graph.files, "file_id"), "isolated": graph.isolated_files()}
    parts = [df.agg(F.count("*").alias(f"{name}_count")) for name, df in found.items()]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))
    row = row.withColumn("problem_count", F.col("cycle_count") + F.col("broken_count")).withColumn("smell_count", F.col("hub_count") + F.col("isolated_count"))
    return row.withColumn("clean", F.col("problem_count") + F.col("smell_count") == 0)


def elide(df: DataFrame, limit: int = 20) -> tuple[DataFrame, int]:
    """The first rows of a report and how many more there are; 0 shows all."""
    if not limit:
        return df, 0
    return df.limit(limit), max(0, df.count() - limit)


def in_degrees(graph: CodeGraph) -> DataFrame:
    """(file_id, path, in_degree): imports of each file with multiplicity, 0 for none."""
    return graph.files.join(graph.in_degrees, "file_id", "left").select("file_id", "path", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def guard_threshold(graph: CodeGraph, override: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row (threshold): the in-degree at index floor(0.9 n) in sorted order, at least GUARD_FLOOR.

    Found from the histogram of in-degrees, so no task sorts all files; known are in_degrees(), where they are written."""
    if override is not None and override >= 1:
        return graph.spark.range(1).select(F.lit(override).cast("long").alias("threshold"))
    histogram = (in_degrees(graph) if known is None else known).groupBy("in_degree").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("in_degree"))  # one row for each distinct in-degree
    total = histogram.agg(F.sum("n").alias("total"))
    rows = histogram.withColumn("upto", upto).join(F.broadcast(total))
    at = rows.where(F.col("upto") > F.least(F.floor(F.col("total") * 9 / 10), F.col("total") - 1))
    least = F.min("in_degree")
    return at.agg(F.when(least.isNotNull(), F.greatest(least, F.lit(GUARD_FLOOR))).alias("threshold")).select(F.coalesce("threshold", F.lit(2**63 - 1)).cast("long").alias("threshold"))


def guard_decisions(graph: CodeGraph, override: int | None = None, warned: DataFrame | None = None, block: bool = False) -> DataFrame:
    """(file, in_degree, is_hub, decision, reason) for central files; warned (path) files are let through once told."""
    bridges = graph.bridges  # in-degrees are found with them
    known = cut(in_degrees(graph), "in-degrees")
    rows = known.join(bridges.select("file_id", "bridged"), "file_id", "left").withColumn("is_hub", F.col("bridged").isNotNull())
    rows = rows.join(F.broadcast(guard_threshold(graph, override, known))).where("is_hub or in_degree >= threshold")
    if block and warned is not None:
        rows = rows.join(warned.select("path").distinct(), "path", "left_anti")
    why = F.when(F.col("is_hub"), F.concat(F.lit("bridges "), "bridged", F.lit(" parts; imported by "), "in_degree")).otherwise(F.concat(F.lit("imported by "), "in_degree"))
    return rows.select(F.col("path").alias("file"), "in_degree", "is_hub", F.lit("deny" if block else "ask").alias("decision"), why.alias("reason"))


def session_dedup(prompts: DataFrame) -> DataFrame:
    """prompts (session_id, seq, path, text) -> each with shown: whether the session sees the path for the first time."""
    order = W.partitionBy("session_id", "path").orderBy("seq")
    rows = prompts.withColumn("shown", F.row_number().over(order) == 1)
    return rows.withColumn("est_tokens", paths.estimated_tokens(F.col("text")))


def token_events(prompts: DataFrame) -> DataFrame:
    """(session_id, seq, files_injected, files_deduped, est_tokens_injected, est_tokens_saved) for each prompt."""
    rows = session_dedup(prompts).withColumn("bytes", F.octet_length("text"))
    injected = F.coalesce(F.sum(F.when(F.col("shown"), F.col("bytes"))), F.lit(0))
    full = F.coalesce(F.sum("bytes"), F.lit(0))
    return rows.groupBy("session_id", "seq").agg(
        F.count_if("shown").alias("files_injected"), F.count_if(~F.col("shown")).alias("files_deduped"),
        F.floor(injected / 4).alias("est_tokens_injected"), F.floor(F.greatest(full - injected, F.lit(0)) / 4).alias("est_tokens_saved"),
    )


def token_rollup(events: DataFrame) -> DataFrame:
    """Sums for each session and, under a null session, for all; missing fields count as 0."""
    named = {"injected": "est_tokens_injected", "saved": "est_tokens_saved"}
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in named.items()]
    return events.rollup("session_id").agg(*sums, F.count("*").alias("events"), F.grouping("session_id").cast("int").alias("is_total"))


def keep_last(log: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each log."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def safe_sessions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("session_id", paths.safe_session_id(F.col("session_id")))


# The visual map


def viz_nodes(graph: CodeGraph) -> DataFrame:
    return named_nodes(graph.graph_nodes())


def named_nodes(rows: DataFrame) -> DataFrame:
    """Nodes by the names a map uses, with their top folder."""
    return rows.withColumnsRenamed({"is_hub": "isHub", "symbol_kind": "symbolKind"}).withColumn("folder", paths.top_folder(F.col("id")))


def viz_edges(graph: CodeGraph) -> DataFrame:
    """Edges by id `source|kind|target`; of parallel ones the first's confidence stays."""
    rows = graph._edge_paths().select(F.concat_ws("|", "file", F.lit("import"), "target").alias("id"), F.col("file").alias("source"), "target", "confidence", "seq")
    return rows.groupBy("id", "source", "target").agg(F.min_by("confidence", F.struct("seq", "confidence")).alias("confidence"))


def viz_payload(graph: CodeGraph) -> DataFrame:
    """(part, json): nodes and edges as JSON rows."""
    rows = viz_nodes(graph).select(F.lit("node").alias("part"), F.to_json(F.struct("*")).alias("json"))
    return rows.unionByName(viz_edges(graph).select(F.lit("edge").alias("part"), F.to_json(F.struct("*")).alias("json")))


def legend(nodes: DataFrame, by: str) -> DataFrame:
    """nodes (label, degree, <by>) -> (<by>, count, label of the most connected), most files first."""
    rows = nodes.groupBy(by).agg(F.count("*").alias("count"), F.min_by("label", F.struct((-F.col("degree")).alias("d"), "label")).alias("label"))
    return rows.orderBy(F.desc("count"), by)


def legend_of(graph: CodeGraph, by: str) -> DataFrame:
    """(label, count, shared): a map's legend by community, folder or language, larger first.

    A community is named for the folder of its most connected file; files that bridge communities are one more row.
    Folders and languages are counted from the files alone."""
    if by != "community":
        key = {"folder": paths.top_folder(F.col("path")), "language": F.coalesce("language", F.lit(""))}[by]
        none = F.lit("(root)" if by == "folder" else "(unknown)")
        out = graph.files.groupBy(key.alias("key")).agg(F.count("*").alias("count"))
        return out.select(F.when(F.col("key") == "", none).otherwise(F.col("key")).alias("label"), "count", F.lit(False).alias("shared")).orderBy(F.desc("count"), "label")
    loops = graph.links.where("src = dst").groupBy(F.col("src").alias("file_id")).agg((F.count("*") * 2).alias("loops"))
    rows = graph.homes.join(loops, "file_id", "left").withColumn("degree", F.col("ends") + F.coalesce("loops", F.lit(0)))
    folder = paths.folder_label(F.col("path"))
    name = F.when(folder != "", folder).otherwise(paths.basename(F.col("path")))
    rows = cut(rows.select(F.col("least").alias("group"), F.col("path").alias("id"), "degree", "is_hub", name.alias("name")), "legend")
    out = rows.groupBy("group").agg(F.min_by("name", F.struct((-F.col("degree")).alias("d"), "id")).alias("label"), F.count("*").alias("count"))
    out = out.select("label", "count", F.lit(False).alias("shared"))
    hubs = rows.where("is_hub").agg(F.count("*").alias("count")).where("count > 0")
    out = out.unionByName(hubs.select(F.lit("shared (hubs)").alias("label"), "count", F.lit(True).alias("shared")))
    return out.orderBy("shared", F.desc("count"), "label")


def search(graph: CodeGraph, text: str) -> DataFrame:
    """(file, matched): files whose path holds the text, and their neighbours."""
    hits = graph.files.where(F.contains(F.lower("path"), F.lit(text.lower()))).select("file_id")
    links = graph.imports.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(graph.imports.select("dst", "src"))
    near = links.join(hits.withColumnRenamed("file_id", "a"), "a", "left_semi").select(F.col("b").alias("file_id"))
    kept = hits.withColumn("matched", F.lit(True)).unionByName(near.withColumn("matched", F.lit(False))).groupBy("file_id").agg(F.max("matched").alias("matched"))
    return kept.join(graph.files, "file_id").select(F.col("path").alias("file"), "matched")


def reconcile(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, action): what turns one snapshot into the next; unchanged rows are left out."""
    a, b = old.select(key, F.struct(*values).alias("before")), new.select(key, F.struct(*values).alias("after"))
    rows = a.join(b, key, "full_outer")
    action = F.when(F.col("after").isNull(), "delete").when(F.col("before").isNull(), "insert").when(F.col("before") != F.col("after"), "update")
    return rows.select(key, action.alias("action")).where("action is not null")


def node_sizes(graph: CodeGraph) -> DataFrame:
    return graph.files.join(graph.degrees, "file_id", "left").select("file_id", (12 + 6 * F.sqrt(F.coalesce("degree", F.lit(0)))).alias("size"))


def snapshot_html(graph: CodeGraph, title: str = "code map", limit: int = 5000) -> str:
    """A small page with the map inlined: the `limit` most connected files, as it goes to a browser, and all edges
    between them."""
    nodes = cut(viz_nodes(graph).orderBy(F.desc("degree"), "id").limit(limit), "map-nodes")
    shown = nodes.select("id")
    edges = viz_edges(graph).join(F.broadcast(shown.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(shown.withColumnRenamed("id", "target")), "target", "left_semi")
    part = lambda df: "[" + ",".join(x.replace("</", "<\\/") for x in df.toJSON().collect()) + "]"
    return f"<!DOCTYPE html><title>{title}</title><script>window.MAP={{nodes:{part(nodes)},edges:{part(edges)}}}</script>"
