"""Every graph query by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trellis.functions import paths
from trellis.operators import kernels
from trellis.plans import analytics, sample_repo, workloads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, recursive: bool = False):
    """Register a function by its name; sql goes behind the graph's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {'recursive ' * recursive}{workloads.SQL}{sql}"
        return f

    return add


def _plain(sql: str):
    """Register with SQL that stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_FOCUS = "select path, file_id from files join degrees using (file_id) order by degree desc, path limit 1"


def _focus(g) -> str:
    return g.top_connected(1).first()["file"]


# Counts


@_query(" select (select count(*) from files) as file_count, (select count(*) from symbols) as symbol_count, (select count(*) from imports) as import_count, (select count(*) from diagnostics) as diagnostic_count")
def overview(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).overview()


@_query(" select language, count(*) as file_count from files group by 1")
def language_stats(spark, sf_dir):
    return workloads.graph(spark, sf_dir).language_stats()


@_query(" select path as file, degree from files join degrees using (file_id) order by degree desc, path limit 10")
def top_connected(spark, sf_dir):
    return workloads.graph(spark, sf_dir).top_connected()


@_query(" select file_id, path, coalesce(degree, 0) as degree from files left join degrees using (file_id) order by 3 desc, 1 limit 10")
def most_connected(spark, sf_dir):
    return workloads.graph(spark, sf_dir).most_connected()


@_query(" select * from degrees")
def degrees(spark, sf_dir):
    return workloads.graph(spark, sf_dir).degrees


@_query(" select (select count(*) from imports) as imports, (select count(*) from imports where confidence = 'Heuristic') as heuristic_imports, (select count(*) from calls) as calls, (select count(*) from calls where confidence = 'Heuristic') as heuristic_calls")
def confidence_counts(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).confidence_counts()


@_query()
def graph_stats(spark, sf_dir):
    g, counted = workloads.counted(spark, sf_dir)
    return g.graph_stats(counted)


# Neighbourhoods


@_query(" select distinct f.path as file, t.path as target from imports join files f on f.file_id = src join files t on t.file_id = dst")
def dependency_pairs(spark, sf_dir):
    return workloads.graph(spark, sf_dir).dependency_pairs()


@_query(f", focus as ({_FOCUS}) select distinct direction, files.path as file from (select 'dependency' as direction, dst as f from imports, focus where src = focus.file_id union all select 'dependent', src from imports, focus where dst = focus.file_id) join files on files.file_id = f")
def file_dependencies(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    return g.file_dependencies(_focus(g))


@_query(" select path as file, message, seq from diagnostics join files using (file_id)")
def broken_imports(spark, sf_dir):
    return workloads.graph(spark, sf_dir).broken_imports()


@_query(" select path as file from files where file_id not in (select src from imports union select dst from imports union select file_id from diagnostics)")
def isolated_files(spark, sf_dir):
    return workloads.graph(spark, sf_dir).isolated_files()


_LEVELS = f", focus as ({_FOCUS}), l0 as (select file_id as n from focus)" + "".join(
    f", l{k} as (select distinct b as n from l{k - 1} join links on a = n where b not in ({' union all '.join(f'select n from l{j}' for j in range(k))}))" for k in (1, 2)
)
_NEAR = "select n, 0 as level from l0 union all select n, 1 from l1 union all select n, 2 from l2"


@_query(f"{_LEVELS} select path as file, level from ({_NEAR}) join files on file_id = n")
def subgraph_files(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    return g.subgraph(_focus(g), 2)[0]


@_query(f"{_LEVELS}, seen as ({_NEAR}) select distinct f.path as file, t.path as target from imports join files f on f.file_id = src join files t on t.file_id = dst where src in (select n from seen) and dst in (select n from seen)")
def subgraph_edges(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    return g.subgraph(_focus(g), 2)[1]


#: Breadth first to the end: each round's new nodes with the least path; USING KEY keeps one row a node.
_PATHS = f", focus as ({_FOCUS}), paths(n, p) using key (n) as (select file_id, [file_id] from focus union select b, min(list_append(p, b)) from paths join links on a = n where b not in (select n from recurring.paths) group by b)"


@_query(f"{_PATHS} select n as node, array_to_string(p, '>') as path from paths", recursive=True)
def shortest_paths(spark, sf_dir):
    """From the most connected file to every file that can be reached."""
    g = workloads.graph(spark, sf_dir)
    found = kernels.shortest_paths(g.imports, g.file_id(_focus(g)))
    return found.select("node", F.array_join("path", ">").alias("path"))


@_query(f"{_PATHS}, goal as (select p from paths order by len(p) desc, n desc limit 1) select i - 1 as position, path as file from (select unnest(p) as n, generate_subscripts(p, 1) as i from goal) join files on file_id = n", recursive=True)
def shortest_path(spark, sf_dir):
    """From the most connected file to the farthest that can be reached, the greatest id among these."""
    g = workloads.graph(spark, sf_dir)
    start = _focus(g)
    far = kernels.shortest_paths(g.imports, g.file_id(start)).agg(F.max(F.struct(F.size("path"), "node")).alias("m")).first()["m"]["node"]
    return g.shortest_path(start, g.files.where(F.col("file_id") == far).first()["path"])


@_query(
    ", c(node, component) using key (node) as (select distinct a, a from links union select b, min(x.component) from recurring.c x join links on links.a = x.node join recurring.c y on y.node = links.b"
    " where x.component < y.component group by b) select node, component from c",
    recursive=True,
)
def connected_components(spark, sf_dir):
    return kernels.components(workloads.imports(spark, sf_dir))


_CLOSURE = ", steps as materialized (select distinct src, dst from imports where src <> dst), reach as (select src, dst from steps union select reach.src, steps.dst from reach join steps on steps.src = reach.dst)"
_SCC = f"{_CLOSURE}, strong as materialized (select x.src as node, least(x.src, min(x.dst)) as scc from reach x join reach y on x.src = y.dst and x.dst = y.src where x.src <> x.dst group by x.src)"


@_query(f"{_SCC} select node, scc from strong", recursive=True)
def strong_components(spark, sf_dir):
    return kernels.strong_components(workloads.imports(spark, sf_dir))


_CYCLES = (
    f"{_SCC}, members as materialized (select node, scc, path from strong join files on file_id = node"
    " union all select distinct src, src, path from imports join files on file_id = src where src = dst and src not in (select node from strong)),"
    " sets as (select scc, list(path order by path) as files, count(*) as size from members group by scc),"
    " guessed as (select a.scc, bool_or(confidence = 'Heuristic') as heuristic from imports join members a on a.node = src join members b on b.node = dst where a.scc = b.scc group by 1)"
)


@_query(
    f"{_CYCLES}, inner_links as materialized (select distinct a.scc, src, dst, b.path as name from imports join members a on a.node = src join members b on b.node = dst where a.scc = b.scc and src <> dst),"
    " firsts as (select scc, arg_min(node, path) as start, min(path) as name from members group by scc),"
    " walks(scc, n, p) using key (scc, n) as (select scc, start, [name] from firsts union select l.scc, l.dst, min(list_append(p, l.name)) from walks w join inner_links l on l.scc = w.scc and l.src = w.n"
    " where (l.scc, l.dst) not in (select (scc, n) from recurring.walks) group by all),"
    " closed as (select w.scc, arg_min(p, (len(p), p)) as p from walks w join inner_links l on l.scc = w.scc and l.src = w.n join firsts f on f.scc = w.scc and f.start = l.dst group by 1)"
    " select array_to_string(files, ',') as files, array_to_string(coalesce(p, files), '>') as path, size, heuristic from sets left join closed using (scc) left join guessed using (scc)",
    recursive=True,
)
def import_cycles(spark, sf_dir):
    rows = workloads.graph(spark, sf_dir).import_cycles()
    return rows.select(F.array_join("files", ",").alias("files"), F.array_join("path", ">").alias("path"), "size", "heuristic")


@_query(f"{_CYCLES} select array_to_string(files, ',') as files, size, coalesce(heuristic, false) as heuristic from sets left join guessed using (scc)", recursive=True)
def cycle_sets(spark, sf_dir):
    rows = workloads.graph(spark, sf_dir).import_cycles()
    return rows.select(F.array_join("files", ",").alias("files"), "size", F.coalesce("heuristic", F.lit(False)).alias("heuristic"))


# Communities: sequential by definition, so there is no SQL; tests hold them against plain Python.


@_query()
def communities(spark, sf_dir):
    return workloads.graph(spark, sf_dir).communities


@_query()
def hubs(spark, sf_dir):
    return workloads.graph(spark, sf_dir).hubs()


@_query()
def community(spark, sf_dir):
    return workloads.graph(spark, sf_dir).community(0)


@_query()
def graph_view_files(spark, sf_dir):
    return workloads.graph(spark, sf_dir).graph_nodes().drop("symbol_kind")


@_query()
def graph_view_symbols(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).symbol_nodes()


@_query(" select f.path as source, t.path as target, 'Import' as kind, confidence from imports join files f on f.file_id = src join files t on t.file_id = dst")
def graph_edges(spark, sf_dir):
    return workloads.graph(spark, sf_dir).graph_edges()


@_query(
    " select f.path as source, t.path as target, 'Import' as kind, confidence from imports join files f on f.file_id = src join files t on t.file_id = dst"
    " union all select path, 'sym:' || symbol_id, 'Defines', 'Resolved' from symbols join files using (file_id) union all select 'sym:' || src, 'sym:' || dst, 'Calls', confidence from calls"
)
def symbol_edges(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).symbol_edges()


@_query(" select src, dst, confidence, seq from calls")
def call_resolution(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).calls


# Context

_SCORES = (
    ", hits as (select file_id, 5.0::double as points from files, terms where contains(lower(path), term)"
    " union all select file_id, least(count(*), 3)::double from symbols, terms where contains(lower(name), term) group by file_id, term),"
    " scored as (select file_id, sum(points) + coalesce(any_value(degree), 0) * 0.1::double as score from hits left join degrees using (file_id) group by file_id)"
)


@_query(f", terms as (select unnest(['steel', 'brand12', 's12']) as term){_SCORES} select row_number() over (order by score desc, file_id) as rank, file_id, round(score, 6) as score from scored order by rank limit 25")
def context_by_query(spark, sf_dir):
    rows = workloads.graph(spark, sf_dir, True).context_by_query("Steel brand12, S12", 25)
    return rows.select("rank", "file_id", F.round("score", 6).alias("score"))


@_query(f", terms as (select unnest(['steel', 'brand', 'copper']) as term){_SCORES} select file_id, round(score, 6) as score from scored")
def query_scores(spark, sf_dir):
    return workloads.graph(spark, sf_dir, True).query_scores("Steel, BRAND: copper steel (x)").select("file_id", F.round("score", 6).alias("score"))


_SEEDS = ", near as (select a as file_id, count(*) as near from (select src as a from imports where src <> dst union all select dst from imports where src <> dst) group by 1), seeds as (select file_id, row_number() over (order by degree desc, path) as place from files join degrees using (file_id) order by place limit 2)"


@_query(
    f"{_SEEDS}, rows as (select file_id, 0 as ring, 0 as near, place from seeds union all select distinct b, 1, n.near, 0 from links join seeds on a = seeds.file_id join near n on n.file_id = b where b not in (select file_id from seeds))"
    " select row_number() over (order by ring, place, near desc, file_id) as rank, file_id from rows order by rank limit 12"
)
def context_by_seeds(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    return g.context_by_seeds([r["file"] for r in g.top_connected(2).collect()], 12)


@_query(
    " select path, language, coalesce((select string_agg(name, ',' order by symbol_id) from (select * from symbols s where s.file_id = files.file_id order by symbol_id limit 15)), '') as symbols,"
    " coalesce((select string_agg(p, ',' order by p) from (select distinct t.path as p from imports join files t on t.file_id = dst where src = files.file_id)), '') as depends_on,"
    " coalesce((select string_agg(p, ',' order by p) from (select distinct t.path as p from imports join files t on t.file_id = src where dst = files.file_id order by p limit 25)), '') as dependents from files"
)
def context_files(spark, sf_dir):
    g = workloads.graph(spark, sf_dir, True)
    rows = g.context_files(g.files)
    return rows.select("path", "language", *[F.array_join(c, ",").alias(c) for c in ("symbols", "depends_on", "dependents")])


@_query(
    f", terms as (select unnest(['steel', 'brand']) as term){_SCORES}, chosen as (select row_number() over (order by score desc, file_id) as rank, file_id from scored order by rank limit 10),"
    " parts as (select rank, path, language, (select string_agg(name, ', ' order by symbol_id) from (select * from symbols s where s.file_id = files.file_id order by symbol_id limit 15)) as symbols,"
    " (select string_agg(p, ', ' order by p) from (select distinct t.path as p from imports join files t on t.file_id = dst where src = files.file_id)) as depends_on,"
    " (select string_agg(p, ', ' order by p) from (select distinct t.path as p from imports join files t on t.file_id = src where dst = files.file_id order by p limit 25)) as dependents from chosen join files using (file_id))"
    " select rank, path, '- ' || path || ' [' || language || ']' || coalesce(' — symbols: ' || symbols, '') || coalesce(' — imports: ' || depends_on, '') || coalesce(' — imported by: ' || dependents, '') as line from parts"
)
def context_markdown(spark, sf_dir):
    g = workloads.graph(spark, sf_dir, True)
    return g.context_markdown(g.context(query="steel brand"))


# Audit and guard


@_query()
def audit(spark, sf_dir):
    return analytics.audit(workloads.graph(spark, sf_dir))


@_query(" select file_id, path, coalesce(n, 0)::bigint as in_degree from files left join (select dst, count(*) as n from imports group by 1) on dst = file_id")
def guard_in_degrees(spark, sf_dir):
    return analytics.in_degrees(workloads.graph(spark, sf_dir))


_THRESHOLD = "select greatest(4, (select d from (select coalesce(n, 0) as d, row_number() over (order by coalesce(n, 0)) - 1 as i from files left join (select dst, count(*) as n from imports group by 1) on dst = file_id) where i = (select least(count(*) * 9 // 10, count(*) - 1) from files)))::bigint as threshold"


@_query(f" {_THRESHOLD}")
def guard_threshold(spark, sf_dir):
    return analytics.guard_threshold(workloads.graph(spark, sf_dir))


@_query(f", limits as ({_THRESHOLD}) select path as file, count(*)::bigint as in_degree from imports join files on file_id = dst group by path having count(*) >= (select threshold from limits)")
def guard_central(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    rows = analytics.in_degrees(g).join(F.broadcast(analytics.guard_threshold(g)))
    return rows.where("in_degree >= threshold").select(F.col("path").alias("file"), "in_degree")


@_query()
def guard_decisions(spark, sf_dir):
    return analytics.guard_decisions(workloads.graph(spark, sf_dir))


# Visual map


@_query(" select f.path || '|import|' || t.path as id, f.path as source, t.path as target, arg_min(confidence, (seq, confidence)) as confidence from imports join files f on f.file_id = src join files t on t.file_id = dst group by all")
def viz_edges(spark, sf_dir):
    return analytics.viz_edges(workloads.graph(spark, sf_dir))


@_query()
def viz_nodes(spark, sf_dir):
    return analytics.viz_nodes(workloads.graph(spark, sf_dir)).drop("symbolKind")


@_query(
    " select folder, count(*) as count, arg_min(label, (-degree, label)) as label from (select split_part(path, '/', 1) as folder, split_part(path, '/', -1) as label, coalesce(degree, 0) as degree from files left join degrees using (file_id)) group by 1"
)
def legend_folders(spark, sf_dir):
    g = workloads.graph(spark, sf_dir)
    rows = g.files.join(g.degrees, "file_id", "left").select(paths.top_folder(F.col("path")).alias("folder"), paths.basename(F.col("path")).alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return analytics.legend(rows, "folder")


@_query(" select coalesce(language, '(unknown)') as label, count(*) as count, false as shared from files group by 1")
def legend_languages(spark, sf_dir):
    return analytics.legend_of(workloads.graph(spark, sf_dir), "language")


@_query(" select split_part(path, '/', 1) as label, count(*) as count, false as shared from files group by 1")
def legend_top_folders(spark, sf_dir):
    return analytics.legend_of(workloads.graph(spark, sf_dir), "folder")


@_query()
def legend_communities(spark, sf_dir):
    return analytics.legend_of(workloads.graph(spark, sf_dir), "community")


@_query(", hits as (select file_id from files where contains(lower(path), 'brand12')) select path as file, max(matched) as matched from (select file_id, true as matched from hits union all select b, false from links join hits on a = file_id) x join files using (file_id) group by path")
def search(spark, sf_dir):
    return analytics.search(workloads.graph(spark, sf_dir), "BRAND12")


@_query(" select coalesce(o.path, n.path) as path, case when n.path is null then 'delete' when o.path is null then 'insert' else 'update' end as action from (select path, language from files where file_id % 10 <> 0) o full join (select path, case when file_id % 7 = 0 then 'x' else language end as language from files where file_id % 10 <> 1) n on o.path = n.path where o.path is null or n.path is null or o.language <> n.language")
def reconcile(spark, sf_dir):
    f = workloads.files(spark, sf_dir)
    new = f.where("file_id % 10 <> 1").withColumn("language", F.when(F.expr("file_id % 7 = 0"), "x").otherwise(F.col("language")))
    return analytics.reconcile(f.where("file_id % 10 <> 0"), new, "path", ["language"])


@_query(" select file_id, round(12 + 6 * sqrt(coalesce(degree, 0)), 9) as size from files left join degrees using (file_id)")
def node_sizes(spark, sf_dir):
    return analytics.node_sizes(workloads.graph(spark, sf_dir)).select("file_id", F.round("size", 9).alias("size"))


@_query(" select file_id, regexp_replace(path, '/[^/]*$', '') as parent, split_part(path, '/', -1) as base, 'part' as extension, split_part(path, '/', 1) as top, split_part(path, '/', -2) as folder from files")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return workloads.files(spark, sf_dir).select(
        "file_id", paths.parent_dir(p).alias("parent"), paths.basename(p).alias("base"), paths.extension(p).alias("extension"), paths.top_folder(p).alias("top"), paths.folder_label(p).alias("folder")
    )


@_query(" select file_id, split_part(path, '/', 1) || '/' || split_part(path, '/', -1) as path from files")
def path_collapse(spark, sf_dir):
    parts = F.split("path", "/")
    messy = F.concat(F.lit("./../"), F.get(parts, F.lit(0)), F.lit("//"), F.get(parts, F.lit(1)), F.lit("/./../"), F.get(parts, F.lit(2)))
    return workloads.files(spark, sf_dir).select("file_id", paths.collapse(messy).alias("path"))


# Sessions


def _prompts(spark, sf_dir):
    rows = workloads.table(spark, sf_dir, "conversations")
    return rows.select(F.concat(F.lit("s/"), "conv_id").alias("session_id"), F.col("turn").alias("seq"), F.md5("text").alias("path"), "text")


_PROMPTS = "with prompts as (select 's/' || conv_id as session_id, turn as seq, md5(text) as path, octet_length(encode(text)) as bytes, row_number() over (partition by conv_id, md5(text) order by turn) = 1 as shown from conversations)"


@_plain(f"{_PROMPTS} select session_id, seq, shown, (bytes // 4)::bigint as est_tokens from prompts")
def session_dedup(spark, sf_dir):
    return analytics.session_dedup(_prompts(spark, sf_dir)).select("session_id", "seq", "shown", "est_tokens")


_EVENTS = (
    f"{_PROMPTS}, events as (select session_id, seq, count(*) filter (where shown) as files_injected, count(*) filter (where not shown) as files_deduped,"
    " (coalesce(sum(bytes) filter (where shown), 0) // 4)::bigint as est_tokens_injected, ((sum(bytes) - coalesce(sum(bytes) filter (where shown), 0)) // 4)::bigint as est_tokens_saved from prompts group by 1, 2)"
)


@_plain(f"{_EVENTS} select * from events")
def token_events(spark, sf_dir):
    return analytics.token_events(_prompts(spark, sf_dir))


@_plain(f"{_EVENTS} select session_id, sum(est_tokens_injected)::bigint as injected, sum(est_tokens_saved)::bigint as saved, count(*) as events, grouping(session_id)::int as is_total from events group by rollup (session_id)")
def token_rollup(spark, sf_dir):
    return analytics.token_rollup(analytics.token_events(_prompts(spark, sf_dir)))


@_plain(f"{_EVENTS} select session_id, seq from (select *, row_number() over (partition by session_id order by seq desc) as n from events) where n <= 3")
def session_log(spark, sf_dir):
    return analytics.keep_last(analytics.token_events(_prompts(spark, sf_dir)), ["session_id"], "seq", 3).select("session_id", "seq")


@_plain("select distinct 's_' || conv_id as session_id from conversations")
def session_ids(spark, sf_dir):
    return analytics.safe_sessions(_prompts(spark, sf_dir).select("session_id").distinct())


# Streams, as batches


@_plain(
    "with e as (select user_id, event_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),"
    " s as (select *, sum(fresh) over (partition by user_id order by ts) as session from e) select user_id, count(*) as changes, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from s group by user_id, session"
)
def debounce(spark, sf_dir):
    """Bursts of changes with less than a gap between neighbours."""
    rows = workloads.table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours"))
    return rows.agg(F.count("*").alias("changes"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us")).drop("session_window")


@_plain("select page_id, href, case when regexp_matches(href, '^[a-z][a-z0-9+.-]*:') then 'external' when regexp_matches(href, '^/[A-Za-z]') then 'internal' else 'unresolved' end as status, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) group by all")
def page_links(spark, sf_dir):
    rows = workloads.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    status = F.when(F.col("href").rlike("^[a-z][a-z0-9+.-]*:"), "external").when(F.col("href").rlike("^/[A-Za-z]"), "internal").otherwise("unresolved")
    return rows.groupBy("page_id", "href", status.alias("status")).agg(F.count("*").alias("n"))


@_plain(
    "with w as (select p_partkey as path, p_size as size, case when p_partkey % 5 = 0 then 0 else p_partkey * 1000 + (p_partkey % 3) end as mtime_ns from part), c as (select p_partkey as path, p_size + (p_partkey % 11 = 0)::int as size, p_partkey * 1000 + 1 as mtime_ns from part where p_partkey % 4 <> 0)"
    " select w.path, case when c.path is not null then 'reuse' else 'parse' end as action from w left join c on c.path = w.path and c.size = w.size and c.mtime_ns = w.mtime_ns and w.mtime_ns <> 0"
)
def incremental_plan(spark, sf_dir):
    from trellis.sources import extract

    part = workloads.table(spark, sf_dir, "part")
    walked = part.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.when(F.expr("p_partkey % 5 = 0"), 0).otherwise(F.expr("p_partkey * 1000 + p_partkey % 3")).alias("mtime_ns"))
    cached = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") + F.expr("int(p_partkey % 11 = 0)")).alias("size"), F.expr("p_partkey * 1000 + 1").alias("mtime_ns"))
    return extract.plan_reuse(walked, cached).select("path", "action")


# A tree of sources in all languages


@_plain(sample_repo.values("path, name, kind, row", sample_repo.SYMBOLS))
def repo_symbols(spark, sf_dir):
    return sample_repo.symbols(spark)


@_plain(sample_repo.values("file, target, confidence", sample_repo.IMPORTS))
def repo_imports(spark, sf_dir):
    return sample_repo.graph(spark)._edge_paths().select("file", "target", "confidence")


@_plain(sample_repo.values("file, message", sample_repo.BROKEN))
def repo_broken_imports(spark, sf_dir):
    return sample_repo.graph(spark).broken_imports().select("file", "message")


@_plain(sample_repo.values("caller, callee, confidence", sample_repo.CALLS))
def repo_calls(spark, sf_dir):
    g = sample_repo.graph(spark)
    name = lambda c, n: g.symbols.select(F.col("symbol_id").alias(c), F.col("name").alias(n))
    return g.calls.join(name("src", "caller"), "src").join(name("dst", "callee"), "dst").select("caller", "callee", "confidence")


@_plain(sample_repo.values("language, file_count", sample_repo.LANGUAGES))
def repo_languages(spark, sf_dir):
    return sample_repo.graph(spark).language_stats()


@_plain(sample_repo.values("language, place", [(n, i) for i, n in enumerate(("go", "python", "java", "csharp", "typescript", "rust", "kotlin", "ruby", "php", "c"))]))
def languages(spark, sf_dir):
    from trellis import lang

    return spark.createDataFrame([(n, i) for i, n in enumerate(lang.names())], "language string, place int")
