"""Quality rules (native): one pass measures every rule, a bitmask ledger holds what failed.

Every rule is evaluated once a document; its failures are bits of one long beside the measurements. A policy is a
versioned set of rules, applied to the ledger by one bitwise AND, so changing a policy or asking what each rule
costs (ablation) reads the ledger and never the texts again.

Defined cases: a null or blank text has no words and fails `few_words`; texts of any length stay in one row, and
all work on them is linear or a sort of 8-byte integers; repeated rows are measured alike; an empty table gives
an empty ledger; other columns of the input are left alone and never read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trellis.llm.common import WS, WS_CHARS, pinned


@dataclass(frozen=True)
class Rule:
    """A document fails where the SQL condition over the measurements is true."""

    name: str
    fails: str


#: The position in this list is the bit; append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "n_words > 0 and 10 * word_chars < 22 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_letters", "n_words > 0 and 100 * n_letters < 50 * word_chars"),
    Rule("huge", "n_words > 1000000"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words", "few_letters")),
    )
}
CURRENT = "v1"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its measurements; no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stage = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    stage = stage.withColumn("trimmed", F.btrim("t", F.lit(WS_CHARS)))
    stage = stage.select(
        "doc_id",
        F.expr(rf"case when trimmed = '' then cast(array() as array<string>) else split(trimmed, r'[{WS}]+') end").alias("w"),
        F.expr(rf"filter(split(t, '\n'), l -> l rlike r'[^{WS}]')").alias("lines"),
        F.length(F.regexp_replace("trimmed", rf"[{WS}]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    stage = stage.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("length(bin(size(w)))").alias("s"),
    )
    # Window hash above, position below, in one long: sorting primitive longs brings equal windows together.
    stage = stage.withColumn(
        "h",
        pinned(
            F.expr(
                "case when n_words < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, size(w) - 3),"
                " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), s) | cast(i as bigint))) end"
            )
        ),
    )
    stage = stage.select("doc_id", "n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", _repeated().alias("n_repeat_words"))
    return stage


def _covered(places: str) -> str:
    """SQL: how many words lie in three-word windows that begin at the sorted places."""
    return f"aggregate({places}, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"


def _repeated() -> Column:
    """Words in three-word windows that the text holds twice or more.

    Neighbours in the sorted hashes are compared by hash and then word for word. A text in which different windows share
    a hash, which may stand between equal ones, is done again with its windows sorted by their words."""
    at = "cast({0} & (shiftleft(1L, s) - 1) as int)"
    words = "w[{a}] = w[{b}] and w[{a} + 1] = w[{b} + 1] and w[{a} + 2] = w[{b} + 2]"
    hashes = "shiftrightunsigned(x, s) = shiftrightunsigned({0}, s)"
    before, after = "get(h, j - 1)", "get(h, j + 1)"
    alike = lambda y: words.format(a=at.format("x"), b=at.format(y))
    pair = lambda y: f"({hashes.format(y)} and {alike(y)})"
    hit = f"filter(h, (x, j) -> (j > 0 and {pair(before)}) or (j < size(h) - 1 and {pair(after)}))"
    fast = _covered(f"sort_array(transform({hit}, x -> x & (shiftleft(1L, s) - 1)))")
    collisions = f"size(filter(h, (x, j) -> j > 0 and {hashes.format(before)} and not ({alike(before)})))"
    sorted_ = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'i', cast(i as bigint))))"
    same = "(x.a = {0}.a and x.b = {0}.b and x.c = {0}.c)"
    exact = f"filter(v, (x, j) -> (j > 0 and {same.format('get(v, j - 1)')}) or (j < size(v) - 1 and {same.format('get(v, j + 1)')}))"
    slow = _covered(f"sort_array(transform(flatten(transform(array({sorted_}), v -> {exact})), x -> x.i))")
    return F.expr(f"case when {collisions} > 0 then {slow} else {fast} end")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failed`, a long with one bit for each failed rule."""
    bits = " | ".join(f"if({rule.fails}, {BIT[rule.name]}L, 0L)" for rule in RULES)
    return measure(docs, id_col, text_col).withColumn("failed", F.expr(bits))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds kept and policy; the texts aren't needed."""
    mask = POLICIES[version].mask
    return rows.withColumn("kept", (F.col("failed").bitwiseAND(F.lit(mask)) == 0)).withColumn("policy", F.lit(version))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """What each rule of a policy rejects, alone and in company.

    The ledger is first counted by its distinct masks (at most 2^rules rows, combined before the shuffle)."""
    policy = POLICIES[version]
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in policy.rules])).alias("r")
    one = masks.select("m", "n", rules).select("m", "n", "r.*")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return one.groupBy("rule", "bit").agg(
        part(hit)("rejected"),
        part(F.col("m") == F.col("bit"))("rejected_alone"),
        part((F.col("m") == 0) | (F.col("m") == F.col("bit")))("kept_without"),
        part(F.col("m") == 0)("kept"),
        F.bit_or(F.when(hit, F.col("m"))).alias("seen_with"),
    )


def filter_documents(docs: DataFrame, version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns; measured in place, without a join."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("body"))
    kept = apply_policy(ledger(inner, "row", "body"), version).where("kept")
    return kept.select("doc_id.*")
