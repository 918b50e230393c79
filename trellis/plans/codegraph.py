"""CodeGraph: the queries over files, symbols, imports, calls and diagnostics, each a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from trellis import schema
from trellis.functions import paths
from trellis.operators import kernels
from trellis.operators.materialize import cut

TOP = 10
CONTEXT_SYMBOLS, CONTEXT_DEPENDENTS = 15, 25
#: Communities up to this number are found from the least ids that come first; beyond, all are numbered.
FIRST_COMMUNITIES = 1000


class CodeGraph:
    """Base tables keep parallel edges; only queries that ask for sets remove them."""

    def __init__(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, diagnostics: DataFrame, listing: str = ""):
        """listing says of which state of a tree the tables are, where that is known."""
        self.files, self.symbols, self.imports, self.calls, self.diagnostics = files, symbols, imports, calls, diagnostics
        self.listing = listing

    @property
    def spark(self):
        return self.files.sparkSession

    @cached_property
    def written(self) -> DataFrame:
        """The imports as a written table, for queries that read them more than once."""
        return cut(self.imports, "imports")

    @cached_property
    def links(self) -> DataFrame:
        """(src, dst): the imports' ends, written once for communities and what stands on them."""
        return self.written if "written" in self.__dict__ else cut(self.imports.select("src", "dst"), "imports")

    @property
    def edges(self) -> DataFrame:
        """The imports' ends, from a written table where there is one."""
        return self.__dict__.get("written", self.__dict__.get("links", self.imports))

    @cached_property
    def degrees(self) -> DataFrame:
        return kernels.degrees(self.imports)

    @cached_property
    def pairs(self) -> DataFrame:
        """(src, dst, w): imports between two files, counted once."""
        return cut(kernels.pairs(self.edges), "pairs")

    @cached_property
    def placed(self) -> DataFrame:
        """What is found of files part by part, as kernels.placed says; once for all queries that need it."""
        return kernels.placed(self.files, self.links)

    @cached_property
    def communities(self) -> DataFrame:
        """(file_id, community), computed once for all queries that need it."""
        return cut(kernels.numbered(self.files, self.placed), "communities")

    @property
    def bridges(self) -> DataFrame:
        """(file_id, bridged): files whose neighbours lie in three communities or more."""
        return self.placed.where(F.col("bridged") >= kernels.HUB_COMMUNITIES).select("file_id", "bridged")

    @property
    def homes(self) -> DataFrame:
        """(file_id, path, language, least, ends, is_hub): files with what placed says of them. least stands for a community as its
        number does; a file without links is the least of its own."""
        rows = self.files.where("file_id is not null").join(self.placed.select("file_id", "least", "ends", "bridged"), "file_id", "left")
        hub = F.coalesce("bridged", F.lit(0)) >= kernels.HUB_COMMUNITIES
        return rows.select("file_id", "path", "language", F.coalesce("least", "file_id").alias("least"), F.coalesce("ends", F.lit(0)).alias("ends"), hub.alias("is_hub"))

    @cached_property
    def housed(self) -> DataFrame:
        """What community() reads of homes, written once."""
        return cut(self.homes.select("path", "least", "is_hub"), "homes")

    @property
    def link_degrees(self) -> DataFrame:
        """degrees of files with links, from placed and the imports of a file by itself."""
        loops = self.links.where("src = dst").groupBy(F.col("src").alias("file_id")).agg((F.count("*") * 2).alias("degree"))
        return self.placed.select("file_id", F.col("ends").alias("degree")).unionByName(loops).groupBy("file_id").agg(F.sum("degree").alias("degree"))

    @property
    def in_degrees(self) -> DataFrame:
        """(file_id, in_degree): imports of each file with multiplicity, from placed and its other imports where it is there."""
        if "placed" not in self.__dict__:
            return self.edges.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("in_degree"))
        others = self.links.where("src = dst or src is null").groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("in_degree"))
        return self.placed.select("file_id", F.col("came").alias("in_degree")).unionByName(others).groupBy("file_id").agg(F.sum("in_degree").alias("in_degree"))

    def _paths(self, column: str, name: str) -> DataFrame:
        return self.files.select(F.col("file_id").alias(column), F.col("path").alias(name))

    def _edge_paths(self) -> DataFrame:
        return self.imports.join(self._paths("src", "file"), "src").join(self._paths("dst", "target"), "dst")

    def file_id(self, path: str):
        row = self.files.where(F.col("path") == path).select("file_id").first()
        return row and row[0]

    # Counts

    def language_stats(self) -> DataFrame:
        return self.files.groupBy("language").agg(F.count("*").alias("file_count")).orderBy(F.desc("file_count"), "language")

    def top_connected(self, k: int = TOP) -> DataFrame:
        """Files with edges by degree, then path."""
        return self.files.join(self.degrees, "file_id").select(F.col("path").alias("file"), "degree").orderBy(F.desc("degree"), "file").limit(k)

    def most_connected(self, k: int = TOP) -> DataFrame:
        """All files by degree, then id; also those without edges."""
        rows = self.files.join(self.degrees, "file_id", "left").select("file_id", "path", F.coalesce("degree", F.lit(0)).alias("degree"))
        return rows.orderBy(F.desc("degree"), "file_id").limit(k)

    def overview(self) -> DataFrame:
        """One row of counts; languages and the most connected files are queries of their own."""
        counts = [df.agg(F.count("*").alias(name)) for name, df in (("file_count", self.files), ("symbol_count", self.symbols), ("import_count", self.imports), ("diagnostic_count", self.diagnostics))]
        out = counts[0]
        for c in counts[1:]:
            out = out.join(F.broadcast(c))  # single rows
        return out

    def confidence_counts(self) -> DataFrame:
        one = lambda df, name: df.agg(F.count("*").alias(name), F.count_if(F.col("confidence") == schema.HEURISTIC).alias(f"heuristic_{name}"))
        return one(self.imports, "imports").join(F.broadcast(one(self.calls, "calls")))

    def graph_stats(self, counted: DataFrame | None = None) -> DataFrame:
        """counted: one row of counts that take the place of those made from symbols and calls."""
        alone = self.files.join(self.placed, "file_id", "left").select(F.coalesce("least", "file_id").alias("least"))  # each community's least file
        groups = alone.agg(F.countDistinct("least").alias("communities"))
        hubs = self.bridges.agg(F.count("*").alias("hubs"))
        row = self.overview().join(F.broadcast(self.confidence_counts()))
        if counted is not None:
            row = row.drop(*counted.columns).join(F.broadcast(counted)).select(row.columns)
        return row.join(F.broadcast(groups)).join(F.broadcast(hubs))

    # Neighbourhoods

    def dependency_pairs(self) -> DataFrame:
        """(file, target): distinct imports by path."""
        return self._edge_paths().select("file", "target").distinct()

    def file_dependencies(self, path: str) -> DataFrame | None:
        """(direction, file), sorted; None where the file isn't mapped."""
        focus = self.file_id(path)
        if focus is None:
            return None
        out = self.imports.where(F.col("src") == focus).select(F.lit("dependency").alias("direction"), F.col("dst").alias("file_id"))
        back = self.imports.where(F.col("dst") == focus).select(F.lit("dependent").alias("direction"), F.col("src").alias("file_id"))
        return out.unionAll(back).distinct().join(self._paths("file_id", "file"), "file_id").select("direction", "file").orderBy("direction", "file")

    def broken_imports(self) -> DataFrame:
        rows = self.diagnostics.where(F.col("kind") == schema.UNRESOLVED_IMPORT).join(self._paths("file_id", "file"), "file_id")
        return rows.select("file", "message", "seq").orderBy("seq")

    def isolated_files(self) -> DataFrame:
        touched = self.edges.select(F.explode(F.array("src", "dst")).alias("file_id")).unionAll(
            self.diagnostics.where(F.col("kind") == schema.UNRESOLVED_IMPORT).select("file_id")
        )
        return self.files.join(touched.distinct(), "file_id", "left_anti").select(F.col("path").alias("file")).orderBy("file")

    def subgraph(self, path: str, depth: int = 1) -> tuple[DataFrame, DataFrame] | None:
        """(files with levels, directed edges with both ends inside); None where the file isn't mapped."""
        focus = self.file_id(path)
        if focus is None:
            return None
        seen = cut(kernels.k_hop(self.imports, self.files.where(F.col("file_id") == focus).select(F.col("file_id").alias("node")), depth), "subgraph")
        nodes = seen.join(self._paths("node", "file"), "node").select("file", "level").orderBy("file")
        inside = seen.select("node")
        edges = self.imports.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
        edges = edges.select("src", "dst").distinct().join(self._paths("src", "file"), "src").join(self._paths("dst", "target"), "dst")
        return nodes, edges.select("file", "target").orderBy("file", "target")

    def shortest_path(self, start: str, end: str) -> DataFrame | None:
        """(position, file) along the least of the shortest undirected paths; None where there is none."""
        a, b = self.file_id(start), self.file_id(end)
        if a is None or b is None:
            return None
        found = kernels.shortest_paths(self.imports, a, b).where(F.col("node") == b)
        rows = found.select(F.posexplode("path").alias("position", "file_id")).join(self._paths("file_id", "file"), "file_id")
        rows = rows.select("position", "file").orderBy("position")
        return None if rows.isEmpty() else rows

    # Views

    def graph_nodes(self) -> DataFrame:
        rows = self.files.join(self.communities, "file_id").join(self.link_degrees, "file_id", "left").join(self.bridges.select("file_id", "bridged"), "file_id", "left")
        return rows.select(
            F.col("path").alias("id"), paths.basename(F.col("path")).alias("label"), F.lit("File").alias("kind"), "language", F.lit(None).cast("string").alias("symbol_kind"),
            F.col("community").alias("group"), F.col("bridged").isNotNull().alias("is_hub"), F.coalesce("degree", F.lit(0)).alias("degree"),
        )

    def graph_edges(self) -> DataFrame:
        return self._edge_paths().select(F.col("file").alias("source"), "target", F.lit("Import").alias("kind"), "confidence")

    def symbol_nodes(self) -> DataFrame:
        called = self.calls.select(F.explode(F.array("src", "dst")).alias("symbol_id")).groupBy("symbol_id").agg(F.count("*").alias("degree"))
        homes = self.files.select("file_id", "language").join(self.communities, "file_id")
        rows = self.symbols.join(homes, "file_id").join(called, "symbol_id", "left")
        extra = rows.select(
            F.concat(F.lit("sym:"), "symbol_id").alias("id"), F.col("name").alias("label"), F.lit("Symbol").alias("kind"), "language", F.col("kind").alias("symbol_kind"),
            F.col("community").alias("group"), F.lit(False).alias("is_hub"), F.coalesce("degree", F.lit(0)).alias("degree"),
        )
        return self.graph_nodes().unionByName(extra)

    def symbol_edges(self) -> DataFrame:
        name = lambda c: F.concat(F.lit("sym:"), c)
        defines = self.symbols.join(self._paths("file_id", "source"), "file_id").select("source", name("symbol_id").alias("target"), F.lit("Defines").alias("kind"), F.lit(schema.RESOLVED).alias("confidence"))
        calls = self.calls.select(name("src").alias("source"), name("dst").alias("target"), F.lit("Calls").alias("kind"), "confidence")
        return self.graph_edges().unionByName(defines).unionByName(calls)

    def hubs(self) -> DataFrame:
        rows = self.bridges.join(self.files, "file_id").join(self.degrees, "file_id")
        return rows.select(F.col("path").alias("file"), "bridged", "degree").orderBy(F.desc("bridged"), F.desc("degree"), "file")

    def community(self, number: int) -> DataFrame | None:
        """(file, is_hub) of one community, sorted; None where it is empty."""
        leasts = self.housed.select("least").distinct()
        if 0 <= number < FIRST_COMMUNITIES:
            found = leasts.orderBy("least").limit(number + 1).collect()[number:]
        else:
            found = kernels.dense_ids(leasts, ["least"], "community").where(F.col("community") == number).select("least").collect()
        if not found:
            return None
        return self.housed.where(F.col("least") == found[0]["least"]).select(F.col("path").alias("file"), "is_hub").orderBy("file")

    # Cycles

    def cycle_members(self) -> DataFrame:
        """(node, scc, path) for files on import cycles, a lone self-importing file too."""
        scc = kernels.strong_components(self.links)
        loops = self.links.where("src = dst").select(F.col("src").alias("node")).distinct().join(scc, "node", "left_anti")
        every = scc.select("node", "scc").unionByName(loops.withColumn("scc", F.col("node")))
        return every.join(self._paths("node", "path"), "node").select("node", "scc", "path")

    def cycles(self) -> DataFrame:
        """(scc): the sets of cycle_members, from the parts that communities are found in where all of these say so."""
        if not self.placed.where("scc is null").isEmpty():
            return self.cycle_members().select("scc").distinct()
        sizes = self.placed.groupBy("scc").agg(F.count("*").alias("size"))
        every = self.placed.join(sizes, "scc").select(F.col("file_id").alias("node"), "scc", "size")
        loops = self.links.where("src = dst").select(F.col("src").alias("node")).distinct().join(every.where("size > 1"), "node", "left_anti")
        every = every.where("size > 1").select("node", "scc").unionByName(loops.withColumn("scc", F.col("node")))
        return every.join(self._paths("node", "path"), "node").select("scc").distinct()

    def import_cycles(self) -> DataFrame:
        """(files, path, size, heuristic), larger first, then by files."""
        self.written  # what cycle_members reads then, too
        members = cut(self.cycle_members(), "members")
        sets = members.groupBy("scc").agg(F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("size"))
        larger = members.join(sets.where("size > 1").select("scc"), "scc", "left_semi").select("node", "scc", "path")
        cycles = kernels.cycle_paths(self.written, larger)
        inner = self.written.join(members.select(F.col("node").alias("src"), "scc"), "src").join(members.select(F.col("node").alias("dst"), F.col("scc").alias("scc2")), "dst").where("scc = scc2")
        guessed = inner.groupBy("scc").agg(F.bool_or(F.col("confidence") == schema.HEURISTIC).alias("heuristic"))
        rows = sets.join(cycles, "scc", "left").join(guessed, "scc", "left")
        return rows.select("files", F.coalesce("cycle", "files").alias("path"), "size", "heuristic").orderBy(F.desc("size"), "files")

    # Context

    def context(self, seeds: Sequence[str] = (), query: str = "", max_files: int = 10) -> DataFrame:
        """(rank, file_id, selected_by): seeds if any are given; else a query's matches; else the most connected."""
        n = max(1, max_files)
        if seeds:
            return self.context_by_seeds(seeds, n).withColumn("selected_by", F.lit("seeds"))
        if query.strip():
            found = self.context_by_query(query, n)
            if not found.isEmpty():
                return found.select("rank", "file_id").withColumn("selected_by", F.lit("query"))
        rank = F.row_number().over(W.orderBy(F.desc("degree"), "file_id"))  # of n rows
        return self.most_connected(n).withColumn("rank", rank).select("rank", "file_id").withColumn("selected_by", F.lit("centrality"))

    def context_by_seeds(self, seeds: Sequence[str], n: int) -> DataFrame:
        """Mapped seeds as given, then their neighbours by degree without self-loops, then id."""
        given = self.spark.createDataFrame(list(enumerate(dict.fromkeys(seeds))), "place int, path string")
        mapped = self.files.join(F.broadcast(given), "path").select("file_id", F.lit(0).alias("ring"), F.lit(0).cast("long").alias("near"), "place")
        links = kernels.undirected(self.imports)
        sizes = links.groupBy(F.col("a").alias("file_id")).agg(F.count("*").alias("near"))
        ring = links.join(mapped.select(F.col("file_id").alias("a")), "a", "left_semi").select(F.col("b").alias("file_id")).distinct().join(mapped, "file_id", "left_anti")
        ring = ring.join(sizes, "file_id").select("file_id", F.lit(1).alias("ring"), "near", F.lit(0).alias("place"))
        rows = mapped.unionByName(ring).orderBy("ring", "place", F.desc("near"), "file_id").limit(n)
        return rows.withColumn("rank", F.row_number().over(W.orderBy("ring", "place", F.desc("near"), "file_id"))).select("rank", "file_id")

    def query_scores(self, query: str) -> DataFrame:
        """(file_id, score) of files that match a term: 5 for the path, up to 3 for symbols, then a tenth of the degree."""
        terms = self.spark.range(1).select(F.explode(paths.query_terms(F.lit(query))).alias("term"))
        in_path = self.files.join(F.broadcast(terms), F.contains(F.lower("path"), F.col("term"))).select("file_id", F.lit(5.0).alias("points"))
        in_names = self.symbols.join(F.broadcast(terms), F.contains(F.lower("name"), F.col("term"))).groupBy("file_id", "term").agg(F.least(F.count("*"), F.lit(3)).cast("double").alias("points"))
        hits = in_path.unionByName(in_names.select("file_id", "points")).groupBy("file_id").agg(F.sum("points").alias("points"))
        rows = hits.join(self.degrees, "file_id", "left")
        return rows.select("file_id", (F.col("points") + F.coalesce("degree", F.lit(0)) * 0.1).alias("score"))

    def context_by_query(self, query: str, n: int) -> DataFrame:
        rows = self.query_scores(query).orderBy(F.desc("score"), "file_id").limit(n)
        return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "file_id")))

    def context_files(self, chosen: DataFrame) -> DataFrame:
        """What a context shows of files (file_id): symbols, dependencies and dependents."""
        ids = chosen.select("file_id").distinct()
        first = lambda c, by, n: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(by, c))), 1, n), lambda x: x[c])
        symbols = self.symbols.join(ids, "file_id", "left_semi").groupBy("file_id").agg(first("name", "symbol_id", CONTEXT_SYMBOLS).alias("symbols"))
        out = self.imports.select(F.col("src").alias("file_id"), F.col("dst").alias("other")).distinct().join(ids, "file_id", "left_semi").join(self._paths("other", "p"), "other")
        back = self.imports.select(F.col("dst").alias("file_id"), F.col("src").alias("other")).distinct().join(ids, "file_id", "left_semi").join(self._paths("other", "p"), "other")
        out = out.groupBy("file_id").agg(F.array_sort(F.collect_set("p")).alias("depends_on"))
        back = back.groupBy("file_id").agg(F.slice(F.array_sort(F.collect_set("p")), 1, CONTEXT_DEPENDENTS).alias("dependents"))
        rows = self.files.join(ids, "file_id", "left_semi").select("file_id", "path", "language")
        for part in (symbols, out, back):
            rows = rows.join(part, "file_id", "left")
        none = F.expr("cast(array() as array<string>)")
        return rows.select("file_id", "path", "language", *[F.coalesce(c, none).alias(c) for c in ("symbols", "depends_on", "dependents")])

    def context_markdown(self, chosen: DataFrame) -> DataFrame:
        """(rank, path, line): one line of markdown for each chosen file (rank, file_id)."""
        rows = self.context_files(chosen).join(F.broadcast(chosen.select("rank", "file_id")), "file_id")  # as many as a context shows
        part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f" — {label}: "), F.array_join(c, ", "))).otherwise("")
        line = F.concat(F.lit("- "), "path", F.lit(" ["), F.coalesce("language", F.lit("?")), F.lit("]"), part("symbols", "symbols"), part("imports", "depends_on"), part("imported by", "dependents"))
        return rows.select("rank", "path", line.alias("line"))
