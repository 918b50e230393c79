"""PII (native): seed entities, and a bootstrap that learns their contexts and shapes.

Seeds are e-mail addresses, IPv4 addresses, payment cards and phone numbers, and values that are given to a name such
as `token` or `password`. Every token with a digit or an @ is a candidate. Its patterns are the word before it, the
word and the sign before it, the word after it, its own prefix up to `=` or `:`, and the shape of its characters.

Over the graph of patterns and distinct instances, an instance's confidence is the noisy-or of its patterns', and a
pattern's is the share of its occurrences that are identifiers, each instance judged by its other patterns. A word's
occurrences are all that the corpus has of it, whatever stands beside them; of a shape those that are known, and
unknown ones by half. Seeds stay at 1; what is too short for an identifier stays at 0. Confidences only grow, so
rounds end where none grows any more. Candidates in patterns of high confidence and enough confirmed instances are new
identifiers (kind `ident`), which in turn confirm other patterns.

Only texts with a digit or an @ are exploded, into rows of single matches; offsets are running sums over the pieces
between them, in code points. Edges are counted before they are shuffled; a context that a third of all candidates
share is a key of aggregations with a partial step and of joins that are split by size.

Defined cases: null text is empty; texts without spans have zero counts and the digest of the empty string; very
long texts give more rows, not larger ones, and all patterns are linear in the text; rows equal in id and text get
equal results; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trellis.llm.common import WS, WS_CHARS, ascii_lower, col, cut, join_groups
from trellis.operators.materialize import done_with

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Possessive forms of the public patterns: what they match is the same, but no text makes them go back. A match
#: starts where the last one ended or at the start of a run of its first characters.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": "text like '%@%'", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": r"text rlike '[+][0-9]'"}
CANDIDATE = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
IDENT = "ident"
#: Names whose values are secrets.
SECRETS = ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "access_key", "access-key", "secret_key", "secret-key", "auth_token", "access_token", "client_secret", "private_key")
#: A word, a sign between a name and its value, and what begins a token as both.
_WORD, _SIGN, _NAMED = r"\p{L}++[,;:]?", "(?:=|:|:=|=>|->)", r"\p{L}[\p{L}_-]*[=:]"
MIN_CONFIDENCE = 0.6
MIN_SUPPORT = 3
MIN_CHARS = 6
MIN_DIGITS = 2
#: Rounds end once no pattern's confidence grows by more.
STEP = 0.01


def _valid() -> Column:
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split("m", "[.]"), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))),
        F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return (
        F.when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", n.between(16, 19) & F.when(n.between(16, 19), total % 10 == 0))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .otherwise(F.lit(True))
    )


def matches(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, m, near, far, after): all matches of the kinds and the candidates, these with the two
    tokens before and the one after. One generator serves all kinds, so each text is read once."""
    rows = docs.where(F.col("text").rlike("[0-9@]"))
    zips = []
    for kind, pattern, guard in [*((k, PATTERNS[k], GUARDS[k]) for k in PATTERNS), ("candidate", CANDIDATE, "true")]:
        pieces = F.split("text", pattern)
        zipped = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"))
        zips.append(F.struct(F.lit(kind).alias("kind"), F.when(F.expr(guard), zipped).alias("parts")))
    rows = rows.select("key", F.explode(F.array(*zips)).alias("x")).where("x.parts is not null and size(x.parts) > 1")
    rows = rows.select("key", "x.kind", F.posexplode("x.parts").alias("i", "y")).where("y.m is not null")
    # The piece's end is enough where it holds two whole tokens; matches begin at the starts of tokens only.
    end = F.expr("right(y.p, 80)")
    piece = F.when(F.length("y.p") <= 80, F.col("y.p")).when(end.rlike(rf"[{WS}][^{WS}]++[{WS}]++[^{WS}]++[{WS}]*+$"), end).otherwise(F.col("y.p"))
    rows = rows.withColumn("piece", F.when(F.col("kind") == "candidate", piece))
    rows = rows.select(
        "key", "kind", "i", F.length("y.p").alias("gap"), F.length("y.m").alias("size"), "y.m",
        ascii_lower(F.regexp_extract("piece", rf"(?<![^{WS}])([^{WS}]++)[{WS}]++$", 1)).alias("near"),
        ascii_lower(F.regexp_extract("piece", rf"(?<![^{WS}])([^{WS}]++)[{WS}]++[^{WS}]++[{WS}]++$", 1)).alias("far"),
        F.when(F.col("kind") == "candidate", ascii_lower(F.regexp_extract("y.q", rf"^[{WS}]++([^{WS}]++)", 1))).alias("after"),
    ).distinct()
    so_far = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    return rows.select("key", "kind", "start", "end", "m", "near", "far", "after")


def _shape(token: Column) -> Column:
    """Letters and digits of one alphabet by their number; else each character by its class."""
    coded = F.when(token.rlike("^(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]{16,}|(?=.*[A-F])[0-9A-F]{16,})$"), F.lit("hex")).when(
        token.rlike("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]{20,}={0,2}$"), F.lit("base64")
    )
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")
    return F.concat(F.lit("S:"), F.coalesce(F.concat(coded, F.length(token).cast("string")), plain))


def _candidates(found: DataFrame, base: DataFrame) -> DataFrame:
    """Candidate tokens without the punctuation around them: (key, start, end, instance, patterns, seed, fits), seed where
    a base span overlaps, fits where it is long enough for an identifier."""
    lead = F.length(F.regexp_extract("m", r"^[^\p{L}\p{N}+]*+", 0))
    core = F.regexp_extract("m", r"^[^\p{L}\p{N}+]*+(.*?)[^\p{L}\p{N}]*$", 1)
    rows = found.where(F.col("kind") == "candidate").withColumn("core", core)
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length("core"))
    fits = (F.length("core") >= MIN_CHARS) & (F.length(F.regexp_replace("core", "[^0-9]", "")) >= MIN_DIGITS)
    named = lambda label, *parts: F.concat(F.lit(label), F.concat_ws(" ", *parts))
    own = F.regexp_extract("core", f"^({_NAMED})", 1)
    patterns = F.array(
        F.when(F.col("near").rlike(f"^{_WORD}$"), named("L:", "near")),
        F.when(F.col("near").rlike(f"^{_SIGN}$") & (F.col("far") != ""), named("L:", "far", "near")),
        F.when(F.col("after").rlike(f"^{_WORD}$"), named("R:", "after")),
        F.when(own != "", named("P:", ascii_lower(own))),
        F.when(fits, _shape(F.col("core"))),
    )
    rows = rows.select("key", "start", "end", ascii_lower(F.col("core")).alias("instance"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"), fits.alias("fits"))
    spans = base.select("key", "start", "end", F.lit(None).cast("string").alias("instance"), F.expr("cast(null as array<string>)").alias("patterns"), F.lit(True).alias("fits"))
    every = rows.unionByName(spans)
    order = W.partitionBy("key").orderBy("start")
    is_base = F.col("instance").isNull()
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rangeBetween(W.unboundedPreceding, 0))
    following = F.min(F.when(is_base, F.col("start"))).over(order.rangeBetween(0, W.unboundedFollowing))
    every = every.withColumn("seed", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False)))
    return every.where("instance is not null")


def secret_patterns() -> list[str]:
    """Patterns that are trusted from the start: `token = value`, `token: value`, `token=value`."""
    return [x for name in SECRETS for x in (f"L:{name} =", f"L:{name} :", f"L:{name}:", f"P:{name}=", f"P:{name}:")]


def occurrences(rows: DataFrame) -> DataFrame:
    """(pattern, total): how often all texts hold what the lexical patterns name, whatever stands beside it."""
    tokens = rows.select(F.explode(F.split(F.btrim("text", F.lit(WS_CHARS)), rf"[{WS}]+")).alias("t")).groupBy(ascii_lower(F.col("t")).alias("t")).agg(F.count("*").alias("n"))
    tokens = cut(tokens, "tokens")
    word = tokens.where(F.col("t").rlike(f"^{_WORD}$")).select(F.explode(F.array(F.concat(F.lit("L:"), "t"), F.concat(F.lit("R:"), "t"))).alias("pattern"), "n")
    own = tokens.select(F.regexp_extract("t", f"^[^\\p{{L}}\\p{{N}}+]*+({_NAMED})", 1).alias("own"), "n").where("own <> ''").select(F.concat(F.lit("P:"), "own").alias("pattern"), "n")
    pair = F.regexp_extract_all("text", F.lit(rf"(?<![^{WS}])[^{WS}]++[{WS}]++{_SIGN}(?![^{WS}])"), F.lit(0))
    pairs = rows.where(F.col("text").rlike(rf"[{WS}]{_SIGN}[{WS}]")).select(F.explode(pair).alias("x"))
    pairs = pairs.groupBy(F.concat(F.lit("L:"), ascii_lower(F.regexp_replace("x", rf"[{WS}]+", " "))).alias("pattern")).agg(F.count("*").alias("n"))
    return word.unionByName(own).unionByName(pairs).groupBy("pattern").agg(F.sum("n").alias("total"))


def score_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """edges (pattern, instance, n, seed, fits), distinct by the first two; totals (pattern, total)
    -> (pattern, confidence, support): support counts the instances that are more likely identifiers than not."""
    known = cut(edges.groupBy("instance").agg(F.max("seed").alias("is_seed"), F.max("fits").alias("may"), F.count("*").alias("degree")), "instances")
    edges = join_groups(edges.select("pattern", "instance", "n"), known, ["instance"], "degree").join(totals, "pattern", "left")
    edges = cut(edges.drop("degree"), "graph")
    first = F.col("pattern").isin(secret_patterns())
    patterns = cut(edges.select("pattern").distinct().select("pattern", F.when(first, 1.0).otherwise(0.0).alias("confidence"), F.lit(0).cast("long").alias("support")), "patterns")
    while True:
        doubt = F.log(1 - F.least("confidence", F.lit(0.999)))
        trusted = patterns.where((F.col("support") >= MIN_SUPPORT) | first).select("pattern", doubt.alias("doubt"))
        held = edges.join(trusted, "pattern", "left").withColumn("doubt", F.coalesce("doubt", F.lit(0.0)))
        sums = cut(held.groupBy("instance").agg(F.sum("doubt").alias("sum"), F.count("*").alias("degree")), "doubts")
        held = join_groups(held, sums, ["instance"], "degree")
        c = F.when(F.col("is_seed"), 1.0).when(~F.col("may"), 0.0).otherwise(1 - F.exp(F.col("sum") - F.col("doubt")))
        held = held.withColumn("c", c).withColumn("open", F.when(F.col("is_seed") | ~F.col("may"), 0.0).otherwise(1 - F.col("c")))
        sure = F.sum(F.col("n") * F.col("c"))
        whole = F.when(F.max("total").isNotNull(), F.greatest(F.max("total"), F.sum("n"))).otherwise(F.sum(F.col("n") * (1 - F.col("open") / 2)))
        new = held.groupBy("pattern").agg((sure / (whole + 1)).alias("found"), F.count_if(F.col("c") >= 0.5).alias("support"))
        new = new.select("pattern", F.when(first, 1.0).otherwise(F.col("found")).alias("confidence"), "support")
        new = cut(new.join(patterns.select("pattern", F.col("confidence").alias("before")), "pattern"), "patterns")
        growth = new.agg(F.max(F.col("confidence") - F.col("before"))).first()[0]
        done_with(patterns, sums)
        patterns = new
        if growth is None or growth <= STEP:
            return patterns.select("pattern", "confidence", "support")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """All rows as (key), key a struct of id and text hash; and the spans as (key, kind, start, end), end exclusive."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = cut(matches(rows), "matches")
    base = found.where(F.col("kind") != "candidate").where(_valid()).select("key", "kind", "start", "end")
    candidates = cut(_candidates(found, base), "candidates")
    edges = candidates.select("instance", "seed", "fits", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance")
    edges = cut(edges.agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("fits").alias("fits")), "edges")
    totals = occurrences(rows).join(edges.select("pattern").distinct(), "pattern", "left_semi")
    scored = score_patterns(edges, cut(totals, "totals"))
    secret = F.col("pattern").isin(secret_patterns())
    good = scored.where(secret | ((F.col("confidence") >= min_confidence) & (F.col("support") >= MIN_SUPPORT))).select("pattern")
    fresh = candidates.where("fits and not seed").select("key", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    return rows.select("key"), base.unionByName(fresh.select("key", F.lit(IDENT).alias("kind"), "start", "end").distinct())


def summarize(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>..., base, all): counts and sorted spans for each row."""
    names = [*PATTERNS, IDENT]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("kind")).cast("int")
    per = spans.groupBy("key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in names],
        F.array_sort(F.collect_list(F.struct(number.alias("k"), "start", "end"))).alias("all"),
    )
    joined = rows.join(per.withColumnRenamed("key", "fkey"), F.col("key").eqNullSafe(F.col("fkey")), "left")
    empty = F.expr("cast(array() as array<struct<k:int,start:bigint,end:bigint>>)")
    return joined.select("key.doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in names], F.coalesce("all", empty).alias("all"))


def joined_spans(spans: str, base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, [*PATTERNS, IDENT]))
    kept = F.filter(spans, lambda x: x["k"] <= len(PATTERNS)) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["k"] - 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
