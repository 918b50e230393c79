"""Kernels and queries on hand-built graphs, and against plain Python on random ones."""

import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis import schema
from trellis.operators import jvm, kernels
from trellis.plans import analytics, codegraph, workloads
from trellis.plans.codegraph import CodeGraph

#: Two triangles and a pair of files, each with one link to `shared/clock.go`.
BRIDGED = ["shared/clock.go", "cart/item.go", "cart/price.go", "cart/total.go", "mail/send.go", "mail/queue.go", "mail/retry.go", "page/home.go", "page/menu.go"]
LINKS = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (6, 4), (7, 8), (1, 0), (4, 0), (7, 0)]


def graph(spark, names, links, broken=(), calls=()):
    links = [(a, b, *(c or ["Resolved"]), i) for i, (a, b, *c) in enumerate(links)]
    return CodeGraph(
        spark.createDataFrame([(i, n, "rust", 0) for i, n in enumerate(names)], schema.FILES),
        spark.createDataFrame([(0, "tick", "Function", 0, None), (1, "cart_menu", "Function", 7, None)], schema.SYMBOLS),
        spark.createDataFrame(links, schema.IMPORTS),
        spark.createDataFrame([(*c, i) for i, c in enumerate(calls)], schema.CALLS),
        spark.createDataFrame([("UnresolvedImport", f, "m", i) for i, f in enumerate(broken)], schema.DIAGNOSTICS),
    )


@pytest.fixture(scope="module")
def bridged(spark):
    return graph(spark, BRIDGED, [*LINKS, (7, 8, "Heuristic")], calls=[(0, 1, "Resolved"), (1, 0, "Heuristic")])


def column(df, name):
    return [r[name] for r in df.collect()]


def test_communities_and_hub(spark, bridged):
    plain = graph(spark, BRIDGED, LINKS)
    groups = {r["file_id"]: r["community"] for r in plain.communities.collect()}
    assert len(set(groups.values())) == 3 and groups[1] == groups[2] == groups[3] != groups[4] == groups[5] == groups[6] and groups[7] == groups[8]
    assert [r.asDict() for r in plain.hubs().collect()] == [{"file": "shared/clock.go", "bridged": 3, "degree": 3}]
    assert {r["file"]: r["is_hub"] for r in plain.community(groups[4]).collect()} == {"mail/queue.go": False, "mail/retry.go": False, "mail/send.go": False}
    assert plain.community(9) is None
    nodes = {r["id"]: r for r in plain.graph_nodes().collect()}
    assert {p: (r["group"], r["is_hub"], r["degree"], r["label"]) for p, r in nodes.items()} == {
        p: (groups[i], i == 0, sum(i in x for x in LINKS), p.split("/")[1]) for i, p in enumerate(BRIDGED)
    }
    extra = {r["id"]: (r["label"], r["group"], r["degree"]) for r in bridged.symbol_nodes().where("kind = 'Symbol'").collect()}
    assert extra == {"sym:0": ("tick", nodes["shared/clock.go"]["group"], 2), "sym:1": ("cart_menu", nodes["page/home.go"]["group"], 2)}
    stats = bridged.graph_stats().first().asDict()
    assert (stats["imports"], stats["heuristic_imports"], stats["calls"], stats["heuristic_calls"], stats["communities"], stats["hubs"]) == (11, 1, 2, 1, 3, 1)


def test_hub_in_audit_and_guard(spark):
    """The mail files form a circle; the clock bridges three communities, which three imports alone would not show."""
    g = graph(spark, [*BRIDGED, "alone.go"], LINKS, broken=[2])
    row = analytics.audit(g).first().asDict()
    assert row == {"cycle_count": 1, "broken_count": 1, "hub_count": 1, "isolated_count": 1, "problem_count": 2, "smell_count": 2, "clean": False}
    rows = [r.asDict() for r in analytics.guard_decisions(g).collect()]
    assert rows == [{"file": "shared/clock.go", "in_degree": 3, "is_hub": True, "decision": "ask", "reason": "bridges 3 parts; imported by 3"}]
    assert {r["file"] for r in analytics.guard_decisions(g, override=2).collect()} == {"shared/clock.go", "cart/total.go"}
    cycle = g.import_cycles().first()
    assert cycle["path"] == ["mail/queue.go", "mail/retry.go", "mail/send.go"] and cycle["size"] == 3


def test_neighbourhoods(bridged):
    assert column(bridged.subgraph("cart/item.go", 1)[0], "file") == ["cart/item.go", "cart/price.go", "cart/total.go", "shared/clock.go"]
    assert column(bridged.subgraph("cart/item.go", 0)[0], "file") == ["cart/item.go"]
    path = column(bridged.shortest_path("cart/total.go", "mail/queue.go"), "file")
    assert path == ["cart/total.go", "cart/item.go", "shared/clock.go", "mail/send.go", "mail/queue.go"]
    assert column(bridged.shortest_path("page/home.go", "page/home.go"), "file") == ["page/home.go"]
    assert bridged.shortest_path("page/home.go", "nope") is None and bridged.subgraph("nope") is None and bridged.file_dependencies("nope") is None
    assert [tuple(r) for r in bridged.file_dependencies("page/home.go").collect()] == [("dependency", "page/menu.go"), ("dependency", "shared/clock.go")]
    assert [tuple(r) for r in bridged.file_dependencies("cart/price.go").collect()] == [("dependency", "cart/total.go"), ("dependent", "cart/item.go")]


def test_context(bridged):
    ids = lambda df: [r["file_id"] for r in df.orderBy("rank").collect()]
    # "cart" is in three paths (5 points) and in a symbol of page/home.go (1); then a tenth of the degree.
    assert ids(bridged.context(query="cart", max_files=4)) == [1, 2, 3, 7]
    assert len(ids(bridged.context(max_files=2))) == 2 and len(ids(bridged.context(max_files=0))) == 1
    assert ids(bridged.context(seeds=["page/menu.go", "nope", "mail/retry.go"], max_files=4)) == [8, 6, 4, 7]
    assert ids(bridged.context(seeds=["nope"])) == []
    assert bridged.context(query="zzz").first()["selected_by"] == "centrality"
    lines = column(bridged.context_markdown(bridged.context(seeds=["page/home.go"], max_files=1)), "line")
    assert lines == ["- page/home.go [rust] — symbols: cart_menu — imports: page/menu.go, shared/clock.go"]


@pytest.mark.parametrize("shuffle", [0, 1])
def test_cycles(spark, shuffle):
    names, links = [f"{c}.rs" for c in "abcdefgh"], [(0, 1), (1, 0, "Heuristic"), (2, 3), (3, 4), (4, 2), (5, 6), (6, 7), (7, 7), (3, 0)]
    if shuffle:
        random.Random(1).shuffle(links)
    rows = [tuple(r) for r in graph(spark, names, links).import_cycles().collect()]
    assert rows == [
        (["c.rs", "d.rs", "e.rs"], ["c.rs", "d.rs", "e.rs"], 3, False), (["a.rs", "b.rs"], ["a.rs", "b.rs"], 2, True), (["h.rs"], ["h.rs"], 1, False),
    ]


def test_isolated_and_audit(spark):
    g = graph(spark, ["a", "b", "lonely", "selfish", "broken"], [(0, 1), (3, 3)], broken=[4])
    assert column(g.isolated_files(), "file") == ["lonely"]
    row = analytics.audit(g).first().asDict()
    assert (row["cycle_count"], row["broken_count"], row["hub_count"], row["isolated_count"], row["clean"]) == (1, 1, 0, 1, False)
    empty = graph(spark, [], [])
    assert empty.import_cycles().count() == 0 and empty.isolated_files().count() == 0 and empty.hubs().count() == 0
    assert analytics.guard_threshold(empty).first()[0] == 2**63 - 1


def test_guard(spark):
    g = graph(spark, ["util", *"abcdef"], [(i, 0) for i in range(1, 7)])
    assert [tuple(r)[:2] for r in analytics.guard_decisions(g).collect()] == [("util", 6)]
    assert analytics.guard_threshold(g, 3).first()[0] == 3
    warned = spark.createDataFrame([("util",)], "path string")
    assert analytics.guard_decisions(g, warned=warned, block=True).count() == 0
    assert analytics.guard_decisions(g, block=True).first()["decision"] == "deny"


def test_map(spark, bridged):
    edges = analytics.viz_edges(bridged).collect()
    assert len(edges) == 10 and {e["confidence"] for e in edges} == {"Resolved"}
    page = analytics.snapshot_html(bridged)
    assert page.count('"source"') == 10
    rows = {r["file"]: r["matched"] for r in analytics.search(bridged, "CLOCK").collect()}
    assert rows == {"shared/clock.go": True, "cart/item.go": False, "mail/send.go": False, "page/home.go": False}


def reach(n, links):
    out = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            for s in out.values():
                if a in s and b not in s:
                    s.add(b)
                    changed = True
    return out


def test_strong_components_without_a_local_finish(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0), (6, 6)], "src long, dst long")
    got = {r["node"]: r["scc"] for r in kernels.strong_components(edges, local_edges=0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def quality(n, links, group):
    inside = sum(group[a] == group[b] for a, b in links) / len(links)
    mass = Counter(group[x] for link in links for x in link)
    return inside - sum((m / (2 * len(links))) ** 2 for m in mass.values())


def test_parallel_communities(spark):
    """Groups that are plain to see are found; on random graphs modularity is near that of one move at a time."""
    files = spark.range(12).withColumnRenamed("id", "file_id")
    cliques = [(a, b) for base in (0, 5) for a in range(base, base + 5) for b in range(base, a)] + [(0, 5)]
    got = {r["file_id"]: r["community"] for r in kernels.parallel_communities(files, spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert got == {i: 0 if i < 5 else 1 if i < 10 else i - 8 for i in range(12)}
    rng = random.Random(6)
    links = [(a, b) for a in range(60) for b in range(a) if rng.random() < (0.4 if a // 15 == b // 15 else 0.02)]
    edges, files = spark.createDataFrame(links, "src long, dst long"), spark.range(60).withColumnRenamed("id", "file_id")
    found = {r["file_id"]: r["community"] for r in kernels.parallel_communities(files, edges).collect()}
    exact = {r["file_id"]: r["community"] for r in kernels.communities(files, edges).collect()}
    assert len(found) == 60 and quality(60, links, found) > 0.9 * quality(60, links, exact)


def best_communities(n, links):
    """Modularity by exact fractions of the whole partition: nodes in order move to the smallest best community."""
    group, total = {i: i for i in range(n)}, 2 * len(links)
    if not total:
        return group

    def modularity(of, edges, names):
        inside = sum(w for (a, b), w in edges.items() if of[a] == of[b])
        mass = Counter()
        for (a, _), w in edges.items():
            mass[of[a]] += w
        return Fraction(inside, total) - sum(Fraction(m * m, total * total) for m in mass.values())

    edges = Counter()
    for a, b in links:
        edges[a, b] += 1
        edges[b, a] += 1
    names = list(range(n))
    while True:
        of, moved = {x: x for x in names}, True
        while moved:
            moved = False
            for x in names:
                own, now = of[x], modularity(of, edges, names)
                best = own
                for c in sorted({of[b] for a, b in edges if a == x and b != x}):
                    score = modularity({**of, x: c}, edges, names)
                    if score > now:
                        best, now = c, score
                if best != own:
                    of[x], moved = best, True
        number: dict = {}
        at = {x: number.setdefault(of[x], len(number)) for x in names}
        group = {i: at[g] for i, g in group.items()}
        if len(number) in (1, len(names)):
            return group
        merged = Counter()
        for (a, b), w in edges.items():
            merged[at[a], at[b]] += w
        edges, names = merged, list(range(len(number)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    edges = spark.createDataFrame(links, "src long, dst long")
    to = reach(n, links)
    want = {i: min(j for j in range(n) if j in to[i] and i in to[j]) for i in range(n)}
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    for local in (0, kernels.LOCAL_EDGES):
        scc = {r["node"]: r["scc"] for r in kernels.strong_components(edges, local_edges=local).collect()}
        assert scc == {i: c for i, c in want.items() if sizes[c] > 1}
    both = reach(n, [*links, *[(b, a) for a, b in links]])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in kernels.components(edges).collect()} == {i: min(both[i]) for i in linked}
    files = spark.range(n).withColumnRenamed("id", "file_id")
    got = {r["file_id"]: r["community"] for r in kernels.communities(files, edges).collect()}
    found = best_communities(n, [(a, b) for a, b in links if a != b])
    number: dict = {}
    assert got == {i: number.setdefault(found[i], len(number)) for i in range(n)}
    near = {i: sorted({b for a, b in [*links, *[(y, x) for x, y in links]] if a == i and b != i}) for i in range(n)}
    seen, level = {links[0][0]: [links[0][0]]}, [[links[0][0]]]
    while level:
        step = {}
        for path in level:
            for b in near[path[-1]]:
                if b not in seen:
                    step[b] = min(step.get(b, [n * 9]), [*path, b])
        seen |= step
        level = list(step.values())
    assert {r["node"]: r["path"] for r in kernels.shortest_paths(edges, links[0][0]).collect()} == seen


def plain_louvain(n, links):
    """One node at a time with every node weighed in every sweep; for weights that are whole numbers."""
    group, total, edges = list(range(n)), float(2 * len(links)), Counter()
    for a, b in links:
        edges[a, b] += 1
        edges[b, a] += 1
    while True:
        size = len(set(group))
        near: list[dict] = [{} for _ in range(size)]
        for (a, b), w in edges.items():
            near[a][b] = w
        k = [float(sum(x.values())) for x in near]
        home, mass, moved = list(range(size)), k[:], True
        while moved:
            moved = False
            for x in range(size):
                pull: dict = {}
                for b, w in near[x].items():
                    if b != x:
                        pull[home[b]] = pull.get(home[b], 0.0) + w
                mass[home[x]] -= k[x]
                own, best = home[x], pull.get(home[x], 0.0) - mass[home[x]] * k[x] / total
                for c in sorted(pull):
                    if (gain := pull[c] - mass[c] * k[x] / total) > best + 1e-12:
                        own, best = c, gain
                moved, home[x] = moved or own != home[x], own
                mass[own] += k[x]
        number: dict = {}
        at = [number.setdefault(h, len(number)) for h in home]
        group = [at[g] for g in group]
        if len(number) in (1, size):
            return group
        merged = Counter()
        for (a, b), w in edges.items():
            merged[at[a], at[b]] += w
        edges = merged


def test_louvain_weighs_few_nodes():
    """The same as weighing every node in every sweep, in less time than that takes in plain Python."""
    rng = random.Random(8)
    n = 3000
    links = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(12 * n)) if a != b]
    edges = Counter(x for a, b in links for x in ((a, b), (b, a)))
    a, b = np.array(list(edges)).T
    began = time.process_time()
    got = kernels.louvain(np.arange(n), a, b, np.array(list(edges.values()), float), float(2 * len(links)))
    taken, began = time.process_time() - began, time.process_time()
    assert got.tolist() == plain_louvain(n, links)
    assert taken < time.process_time() - began


def test_large_parts_are_dealt_apart(spark):
    """Eight equal parts in eight tasks, where hashes would put some together; small parts stay whole."""
    nodes = [(100 * c + i, 100 * c) for c in range(8) for i in range(20)] + [(10_000 + i, 10_000 + i // 2 * 2) for i in range(20)]
    parts = spark.createDataFrame(nodes, "node long, component long")
    rows = kernels.dealt(parts, parts, 8).withColumn("p", F.spark_partition_id()).groupBy("component").agg(F.collect_set("p").alias("p"), F.count("*").alias("n")).collect()
    at = {r["component"]: r["p"] for r in rows}
    assert len(at) == 18 and sum(r["n"] for r in rows) == len(nodes) and all(len(p) == 1 for p in at.values())
    assert len({at[100 * c][0] for c in range(8)}) == 8


def test_parts_are_found_on_few_links(spark, monkeypatch):
    """Communities look for connected parts on some links a file, however dense the imports are; one table of pairs
    serves all that is asked of a graph."""
    met, plain = [], kernels._components
    monkeypatch.setattr(kernels, "_components", lambda links: (met.append(links.count()), plain(links))[1])
    links = [(a, b) for a in range(120) for b in range(a)] + [(a, b) for a in range(200, 203) for b in range(200, 203)]
    g = graph(spark, [f"{i}.rs" for i in range(210)], [*links, (1, 0)])
    found = {r["file_id"]: r["community"] for r in g.communities.collect()}
    assert len(set(found.values())) == 89 and len({found[i] for i in range(120)}) == 1 and found[200] == found[202] != found[0]
    assert met[0] <= 2 * 121 * g.pairs.rdd.getNumPartitions() < 7000
    assert {(r["src"], r["dst"]): r["w"] for r in g.pairs.where("w > 1 or src = dst").collect()} == {(0, 1): 2, **{(a, b): 1 + (a != b) for a in range(200, 203) for b in range(a, 203)}}
    want = {r["file_id"]: r["degree"] for r in g.degrees.collect()}
    assert {r["file_id"]: r["degree"] for r in kernels.pair_degrees(g.pairs).collect()} == want


def test_stars():
    """Portions folded one after the other connect what all links connect; the smallest node is each part's middle."""
    rng = random.Random(4)
    links = np.array([(rng.randrange(300), rng.randrange(300)) for _ in range(160)])
    links = links[links[:, 0] != links[:, 1]]
    a, b = kernels._stars(*links[:80].T)
    a, b = kernels._stars(np.concatenate([a, links[80:, 0]]), np.concatenate([b, links[80:, 1]]))
    both = reach(300, [*links.tolist(), *links[:, ::-1].tolist()])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: min(both[i]) for i in range(300) if min(both[i]) != i}


def test_nodes_take_degrees_from_pairs(spark):
    """Files on a map have the degrees that imports give, counted on the pairs that communities wrote."""
    g = graph(spark, BRIDGED, [*LINKS, (7, 8, "Heuristic"), (8, 7), (2, 2)])
    got = {r["id"]: r["degree"] for r in g.graph_nodes().collect()}
    assert "degrees" not in g.__dict__ and got == {BRIDGED[i]: n for i, n in {**{r["file_id"]: r["degree"] for r in g.degrees.collect()}}.items()}


def test_guard_counts_imports_once(spark, bridged, monkeypatch):
    calls, plain = [], analytics.in_degrees
    monkeypatch.setattr(analytics, "in_degrees", lambda g: (calls.append(g), plain(g))[1])
    assert analytics.guard_decisions(bridged, override=2).count() and len(analytics.guard_decisions(bridged).collect()) == 1
    assert len(calls) == 2  # one for each of the two queries, though both need a threshold or rows


def test_legend_reads_written_nodes(spark, bridged):
    """Groups and the hubs' row are counted on one written table of nodes."""
    rows = analytics.legend_of(bridged, "community")
    assert [tuple(r) for r in rows.collect()] == [("cart", 3, False), ("mail", 3, False), ("page", 3, False), ("shared (hubs)", 1, True)]
    assert all("-legend/" in f for f in rows.inputFiles())


def test_strong_components_are_folded_first(spark, monkeypatch):
    """Tasks find components among their own edges, batch by batch; rounds and the last task meet what is left."""
    met, plain = [], kernels._strong_components
    monkeypatch.setattr(kernels, "_strong_components", lambda todo, most: (met.append(todo.count()), plain(todo, most))[1])
    rng = random.Random(1)
    links = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a != b]
    links += [(100 + a, 100 + b) for a in range(20) for b in range(20) if a != b] + [(119, 0), (1, 200), (200, 201)]
    to = reach(210, links)
    want = {i: min(j for j in to[i] if i in to[j]) for i in {x for link in links for x in link}}
    sizes = Counter(want.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = {r["node"]: r["scc"] for r in kernels.strong_components(spark.createDataFrame(links, "src long, dst long"), local_edges=90).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: c for i, c in want.items() if sizes[c] > 1}
    assert met[0] < len(set(links)) - 300
    line = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 2)], "src long, dst long")
    assert kernels.strong_components(line, local_edges=3).count() == 0


def test_audit_counts_without_paths(spark, monkeypatch):
    """Cycles, self-imports too, and hubs are counted as before, without cycles' paths or degrees; imports are written once."""
    names, links = [*BRIDGED, "self.go", "alone.go"], [*LINKS, (3, 2), (9, 9), (8, 7, "Heuristic"), (7, 8)]
    plain = graph(spark, names, links, broken=[2])
    want = {"cycle_count": plain.import_cycles().count(), "hub_count": plain.hubs().count(), "isolated_count": plain.isolated_files().count(), "broken_count": 1}
    monkeypatch.setattr(kernels, "cycle_paths", None)
    g = graph(spark, names, links, broken=[2])
    row = analytics.audit(g).first().asDict()
    assert {k: row[k] for k in want} == want == {"cycle_count": 4, "hub_count": 1, "isolated_count": 1, "broken_count": 1}
    assert "degrees" not in g.__dict__ and all("-imports/" in f for f in g.edges.inputFiles())


def test_symbols_are_written_once(spark):
    """Ids are added as the numbered rows are read, without a second table or a join."""
    rows = kernels.dense_ids(spark.range(50, 0, -1).repartition(3), ["id"], "n", 1)
    assert {r["id"]: r["n"] for r in rows.collect()} == {i: i for i in range(1, 51)}
    assert "Join" not in rows._jdf.queryExecution().toString() and kernels.dense_ids(spark.range(0), ["id"], "n").count() == 0
    named = workloads.graph(spark, "/root/testdata/sf0.001", True).symbols
    assert all("-numbered/" in f for f in named.inputFiles())


@pytest.mark.parametrize("seed", range(3))
def test_louvain_in_the_jvm(spark, seed, monkeypatch):
    """The JVM's loops give what kernels.louvain gives: ties, weights, several parts, and with a larger graph's total."""
    rng = random.Random(seed)
    rows = [(c * 1000 + rng.randrange(n), c * 1000 + rng.randrange(n)) for c, n in enumerate((3, 40, 300, 600)) for _ in range((2 + seed) * n)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    files = spark.range(4000).withColumnRenamed("id", "file_id")
    assert jvm.louvain(spark) is not None
    made = []
    for most in (kernels.JVM_LINKS, 100, 0):  # all, small parts, none
        monkeypatch.setattr(kernels, "JVM_LINKS", most)
        made.append(dict(map(tuple, kernels.communities(files, edges).collect())))
    assert made[0] == made[1] == made[2] and len(made[0]) == 4000
    links = kernels._Level(600, *(np.array(x) for x in zip(*[(a - 3000, b - 3000, 1.0) for x in rows if x[0] >= 3000 and x[0] != x[1] for a, b in (x, x[::-1])])))
    parts = [bytearray(x.astype(t).tobytes()) for x, t in ((links.starts, "<i4"), (links.others, "<i4"), (links.weights, "<f8"))]
    row = spark.createDataFrame([tuple(parts)], "a binary, b binary, c binary")
    for total in (links.weights.sum(), 7.5 * links.weights.sum(), 60 * links.weights.sum()):
        found = row.select(jvm.louvain(spark)(F.col("a"), F.col("b"), F.col("c"), F.lit(float(total)))).first()[0]
        assert np.frombuffer(found, "<i4").tolist() == kernels.louvain(np.arange(600), links.owners, links.others, links.weights, total).tolist()


def test_lines_are_joined_by_hash(spark, tmp_path, monkeypatch):
    """Lines meet the next ones of their order without a sort, in as many parts as their number asks for; repeated and
    null keys as in a plain join."""
    rows = [(1, 1, 5), (1, 2, 6), (1, 2, 7), (1, 3, 8), (2, 1, 5), (None, 1, 5), (None, 2, 6), (3, None, 5), (3, 1, None), (3, 2, 9)]
    lines = spark.createDataFrame([(*r, 0, "R") for r in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(workloads, "JOIN_ROWS", 3)
    got = workloads.imports(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and plan.count(", 4), REPARTITION_BY_NUM") == 2
    want = [(a[2], b[2]) for a in rows for b in rows if None not in (a[0], a[1], b[0], b[1]) and a[0] == b[0] and b[1] == a[1] + 1]
    assert Counter((r["src"], r["dst"]) for r in got.collect()) == Counter(want)


@pytest.mark.parametrize("few", [False, True])
def test_parts_say_all_of_their_files(spark, monkeypatch, few):
    """Bridges, degrees, in-degrees and cycles come with communities from one pass over imports that are written once:
    with parallel, null and self-imports, an unknown file, and where parts are too large for the JVM or a broadcast."""
    if few:
        for name in ("JVM_LINKS", "LOCAL_LINKS", "BROADCAST_NODES"):
            monkeypatch.setattr(kernels, name, 20)
    rng = random.Random(6)
    links = [(100 * c + rng.randrange(n), 100 * c + rng.randrange(n)) for c, n in enumerate((40, 30, 20, 3)) for _ in range(5 * n // 3)]
    links += [links[0]] * 3 + [(None, 5), (7, None), (50, 50), (1, 500), (2, 500), (500, 3)]
    files = spark.range(330).select(F.col("id").alias("file_id"), F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("language"))
    edges = spark.createDataFrame([(*x, "Resolved", i) for i, x in enumerate(links)], "src long, dst long, confidence string, seq long")
    g = CodeGraph(files, spark.createDataFrame([], schema.SYMBOLS), edges, spark.createDataFrame([], schema.CALLS), spark.createDataFrame([], schema.DIAGNOSTICS))
    home, near, came, ends = dict(map(tuple, g.communities.collect())), {}, Counter(), Counter()
    for a, b in links:
        came[b] += 1
        if a is not None and b is not None:
            ends.update((a, b))
            if a != b:
                near.setdefault(a, set()).update({home[b]} if b in home else ())
                near.setdefault(b, set()).update({home[a]} if a in home else ())
    assert {r["file_id"]: r["bridged"] for r in g.bridges.collect()} == {i: len(x) for i, x in near.items() if len(x) >= 3} and max(map(len, near.values())) > 2
    assert {r["file_id"]: r["degree"] for r in g.link_degrees.collect()} == ends
    assert {r["file_id"]: r["in_degree"] for r in g.in_degrees.collect() if r["file_id"] is not None} == {i: n for i, n in came.items() if i is not None} | {i: 0 for i in near if not came[i]}
    assert all("-placed/" in f or "-imports/" in f for f in g.in_degrees.inputFiles())
    plain = CodeGraph(files, g.symbols, edges, g.calls, g.diagnostics)
    assert g.cycles().count() == plain.cycle_members().select("scc").distinct().count() > 3
    assert {r["scc"] for r in g.placed.select("scc").distinct().collect()} >= ({None} if few else set())


def test_stats_count_calls_without_ids(spark, tmp_path, monkeypatch):
    """What graph_stats counts under names is what numbered symbols and resolved calls give: shared, unique and own names,
    negative and null orders, several parts; neighbouring lines are read from one table."""
    rng = random.Random(8)
    one = lambda: (rng.choice([None, -999, -3, -2, *range(1, 60), *range(998, 1040)]), rng.randrange(1, 5), rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice("RA"))
    rows = [one() for _ in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(12).select(F.col("id").alias("p_partkey"), F.lit("T").alias("p_type"), F.lit("B#1").alias("p_brand"), F.lit("n").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(workloads, "JOIN_ROWS", 100)
    want = workloads.graph(spark, str(tmp_path), True).graph_stats().first().asDict()
    g, counted = workloads.counted(spark, str(tmp_path))
    assert g.graph_stats(counted).first().asDict() == want and want["calls"] > want["heuristic_calls"] > 0
    assert all("-imports/" in f for f in g.links.inputFiles())


@pytest.mark.parametrize("most", [10, 10_000_000])
def test_parts_are_sent_as_bytes(spark, monkeypatch, most):
    """Links of parts that a broadcast takes go to their partition as bytes, few rows a task; portions, parallel and
    directed links, unknown and unlinked files, and parts too large for the JVM give what rows by row give."""
    rng = random.Random(9)
    links = [(1000 * c + rng.randrange(n), 1000 * c + rng.randrange(n)) for c, n in enumerate((60, 40, 30, 3, 2)) for _ in range(3 * n)]
    links += [links[0]] * 3 + [(4000, 4001), (4001, 4000), (50, 50), (2, 999), (999, 1), (-7, 1005)]
    edges = spark.createDataFrame(links, "src long, dst long").repartition(3)
    files = spark.createDataFrame([(i,) for i in range(4500) if i % 11], "file_id int")
    monkeypatch.setattr(kernels, "JVM_LINKS", most)
    monkeypatch.setattr(kernels, "BROADCAST_NODES", 0)
    want = {tuple(r) for r in kernels.placed(files, edges).collect()}
    monkeypatch.setattr(kernels, "BROADCAST_NODES", 1000)
    monkeypatch.setattr(kernels, "STAR_LINKS", 50)
    sent, plain = [], kernels._packed
    monkeypatch.setattr(kernels, "_packed", lambda *args: (sent.append(args[3]), plain(*args))[1])
    got = kernels.placed(files, edges).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100 and len(sent) == 1
    empty = kernels.placed(files, edges.where("src = dst"))
    assert empty.isEmpty()


def test_partitions_take_whole_parts():
    component = np.repeat([0, 100, 200, 300, 500, 501], [40, 40, 40, 40, 1, 2])
    share = kernels._shares(component, 4)
    assert len({share[component == c][0] for c in (0, 100, 200, 300)}) == 4 and all(len(set(share[component == c])) == 1 for c in component)


def test_equal_rows_are_numbered_once(spark):
    """Rows are dealt once, in order, and made distinct where they lie; nulls count as one value, as in distinct()."""
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *"abc"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x long, y string").repartition(3)
    got = kernels.dense_ids(df, ["x", "y"], "id", 1, 5).collect()
    order = sorted(set(rows), key=lambda r: [(v is not None, v) for v in r])
    assert {(r["x"], r["y"]): r["id"] for r in got} == {r: i + 1 for i, r in enumerate(order)} and len(got) == len(order)


@pytest.mark.parametrize("first", [0, 1000])
def test_community_and_legend_without_numbering(spark, monkeypatch, first):
    """One community and the legend say what numbered communities of all files give, without numbering these."""
    rng = random.Random(11)
    links = [(20 * c + rng.randrange(n), 20 * c + rng.randrange(n)) for c, n in enumerate((15, 12, 9)) for _ in range(3 * n)]
    links += [(50, 50), (58, 58), (58, 58), (None, 3), (3, None), (3, 99)]
    files = spark.createDataFrame([(i, f"d{i % 4}/f{i}" if i and i % 5 else f"f{i}", "x") for i in (None, *range(2, 60))], "file_id long, path string, language string")
    edges = spark.createDataFrame([(*x, "Resolved", i) for i, x in enumerate(links)], "src long, dst long, confidence string, seq long")
    make = lambda: CodeGraph(files, spark.createDataFrame([], schema.SYMBOLS), edges, spark.createDataFrame([], schema.CALLS), spark.createDataFrame([], schema.DIAGNOSTICS))
    nodes = make().graph_nodes().collect()
    groups = {}
    for r in nodes:
        groups.setdefault(r["group"], []).append(r)
    hubs = sum(r["is_hub"] for r in nodes)
    assert len(nodes) == 58 and max(map(len, groups.values())) > 3
    name = lambda r: r["id"].split("/")[0]
    want = sorted(((name(min(rs, key=lambda r: (-r["degree"], r["id"]))), len(rs), False) for rs in groups.values()), key=lambda x: (-x[1], x[0]))
    want += [("shared (hubs)", hubs, True)] if hubs else []
    monkeypatch.setattr(codegraph, "FIRST_COMMUNITIES", first)
    monkeypatch.setattr(kernels, "numbered", None)
    g = make()
    assert [tuple(r) for r in analytics.legend_of(g, "community").collect()] == want
    for number in (0, 1, len(groups) - 1):
        assert [tuple(r) for r in g.community(number).collect()] == sorted((r["id"], r["is_hub"]) for r in groups[number])
    assert g.community(len(groups)) is None and g.community(-1) is None


def test_places():
    """Where values stand in sorted nodes, -1 for others: dense and spread ids, values beyond both ends."""
    for nodes in ([5], [-3, -2, 0, 1, 7], [-(1 << 62), 0, 9, 1 << 62]):
        values = [-(1 << 63), (1 << 63) - 1, -4, 8, *nodes, *[n + 1 for n in nodes], *[n - 1 for n in nodes]]
        got = kernels._places(np.array(nodes))(np.array(values))
        assert got.tolist() == [nodes.index(v) if v in nodes else -1 for v in values]
