"""URL filters: rules by host suffix and path prefix, and link-graph propagation for the rest.

Hosts are nodes. Links between hosts, counted over all pages before any shuffle of them, and the steps between a
host and its parent domain are edges. Trust is a personalised PageRank from hosts whose pages allow rules fit;
distrust is the same over the reversed edges from hosts whose pages block rules fit. Both run as one join and one
grouped sum a round over a table keyed by direction and host, until a round moves next to nothing. A host is blocked where distrust is the greater part
of the two by `threshold`; hosts that neither reaches are allowed.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; a null
page has no links; relative links stay on their host and count for nothing; links to hosts without pages are edges
too; of rules that fit, the longest wins (equal lengths can't both fit); repeated rows count again; an empty table
gives an empty result; extra columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trellis.llm.common import ascii_lower, col, cut
from trellis.operators.materialize import done_with

DAMPING = 0.85
#: Propagation ends once no more than this of the rank (1 a way) is still on its way; ranks are off by less.
TOLERANCE = 1e-5
#: Rounds between two tests, which are one job.
ROUNDS_A_STEP = 4
THRESHOLD = 0.8
#: Hosts whose verdicts are broadcast to the pages (some 100 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the registered query.
RULES = (
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict to rows with host and path.

    Each distinct host is matched with the rules of its suffixes by an equi-join; then only paths are compared."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, p string, text string, verdict string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = pages.select("host").distinct().where("host <> ''").select("host", F.explode(suffixes).alias("suffix"))
    fits = hosts.join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct(F.length("text").alias("n"), "p", "text", "verdict")).alias("rules"))
    fits = cut(fits.withColumn("rules", F.sort_array("rules", asc=False)), "rules")
    if fits.count() <= BROADCAST_HOSTS:
        fits = F.broadcast(fits)
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["p"])), F.lit(0))
    return pages.join(fits, "host", "left").withColumn("_r", first).withColumn("rule", F.col("_r.text")).withColumn("rule_verdict", F.col("_r.verdict")).drop("rules", "_r")


def links(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n) between different hosts."""
    target = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    raw = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(target).alias("dst")).withColumn("dst", ascii_lower(F.col("dst")))
    return raw.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_steps(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): every host and its parent domains with two labels or more, both ways."""
    up = hosts.select("host", F.split("host", "[.]").alias("l")).where(F.size("l") > 2)
    up = up.select("host", F.explode(F.expr("sequence(1, size(l) - 2)")).alias("k"), "l")
    up = up.select(F.array_join(F.expr("slice(l, k, size(l))"), ".").alias("src"), F.array_join(F.expr("slice(l, k + 1, size(l))"), ".").alias("dst"))
    return up.union(up.select("dst", "src")).distinct().withColumn("n", F.lit(1).cast("long"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges (src, dst, n), seeds (way, host, weight), way 0 trust along edges and 1 distrust against them
    -> (way, host, rank), to the tolerance. Weights are scaled to 1 a way; rank at hosts without edges returns to nobody.

    A round shrinks what is still to be moved by the damping, so rounds are bounded by log(tolerance) / log(damping)."""
    total = seeds.groupBy("way").agg(F.sum("weight").alias("total"))
    teleport = cut(seeds.join(F.broadcast(total), "way").where("total > 0").select("way", "host", (F.col("weight") / F.col("total")).alias("rank")), "seeds")
    both = edges.select(F.lit(0).alias("way"), "src", "dst", "n").union(edges.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("way", "src").agg(F.sum("n").alias("all"))
    steps = both.join(out, ["way", "src"]).select("way", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * damping).alias("share"))
    # Each host also sends its rank to itself, so a round reads the state once.
    hosts = steps.select("way", "host").union(steps.select("way", "dst")).union(teleport.select("way", "host")).distinct()
    steps = cut(steps.withColumn("own", F.lit(False)).union(hosts.select("way", "host", "host", F.lit(0.0), F.lit(True))), "edges")
    # moved is what a host got in the last round; of all that it ever got, 1 - damping stays as its rank.
    state = teleport.select("way", "host", F.col("rank").alias("moved"), (F.col("rank") * (1 - damping)).alias("rank"))
    while True:
        before = state
        for _ in range(ROUNDS_A_STEP):
            sent = state.join(steps, ["way", "host"]).groupBy("way", F.col("dst").alias("host"))
            state = sent.agg(F.sum(F.col("moved") * F.col("share")).alias("moved"), F.coalesce(F.sum(F.when(F.col("own"), F.col("rank"))), F.lit(0.0)).alias("rank"))
            state = state.select("way", "host", "moved", (F.col("rank") + F.col("moved") * (1 - damping)).alias("rank"))
        state = cut(state, "rank")
        done_with(before)
        if state.agg(F.coalesce(F.sum("moved"), F.lit(0.0))).first()[0] <= tolerance:
            return state.select("way", "host", "rank")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row."""
    named = pages.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    matched = match_rules(named, rules)
    hosts = cut(
        matched.where("host <> ''").groupBy("host").agg(
            F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"), F.count("*").alias("pages")
        ),
        "hosts",
    )
    with_links = pages.select(host_of(col(url_col)).alias("host"), col(html_col).alias("html")).where("html is not null")
    edges = links(with_links, "html").union(domain_steps(hosts)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    seeds = hosts.select(F.lit(0).alias("way"), "host", (F.col("allowed") / F.col("pages")).alias("weight")).union(hosts.select(F.lit(1).alias("way"), "host", F.col("blocked") / F.col("pages"))).where("weight > 0")
    rank = propagate(cut(edges, "links"), seeds)
    scored = rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("way") == w, F.col("rank"))), F.lit(0.0)).alias(name) for w, name in enumerate(("trust", "distrust"))])
    known = cut(hosts.select("host").join(scored, "host", "left"), "scores")
    if known.count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)
    out = matched.join(known, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    both = F.col("trust") + F.col("distrust")
    method = F.when((both > 0) & (F.col("distrust") >= threshold * both), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "trust", "distrust")
