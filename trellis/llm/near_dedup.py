"""b-bit MinHash near-duplicate groups.

Each document becomes the set of its distinct word shingles and 200 minima of it. Minima in bands of five give
candidate buckets; four low bits of 128 minima are packed into eight longs. For a candidate pair the share of equal
4-bit fields, corrected for the 1/16 that agree by chance, estimates the similarity; pairs clearly below the
threshold (by six standard deviations) are dropped and all others are confirmed on the full sets.

Groups of any size cost linear work: equal sets are one node from the start; each bucket pairs its members with one
pseudo-random leader, other in each bucket; a node first tries its most similar leader, then components that star
pairs still join are tried, best pair first. What then shares
a bucket in different components is compared exactly: in small buckets as pairs whose estimate is computed in the
join, around components with large buckets as blocks of at most some hundred sets, where a task counts all overlaps of
two blocks as one matrix product and returns no more than the links that join components. Two sets at the threshold
share no bucket with a chance of 1.3e-7, and what shares one is dropped only where the sizes or the estimate rule it
out.

Defined cases: null, empty or blank texts have the empty set and are linked with nothing; a text with fewer words
than a shingle is one shingle; copies and repeated rows share a component; ties go to the smallest id; a row without
an id is linked like others, goes where its component has an id, and else stays under a null component; an empty
table gives an empty result; extra columns are not read and may have any names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trellis.llm.common import col, components, cut, join_groups

BANDS, ROWS = 40, 5
FIELDS, BITS = 128, 4
MARGIN = 0.25
#: Ids that a scan over texts may take as a broadcast (16 bytes each); beyond, the scan is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets in a block, and the size up to which a bucket's strays are paired in a join.
BLOCK, PAIRED = 128, 16
#: Shingles that a block holds on average at most (8 bytes each): longer sets make more blocks.
BLOCK_SHINGLES = 1 << 19
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, width)
    acc = h[: n - size + 1] + np.uint64(size)
    for j in range(1, size):
        acc = _mix(acc * _M1) + h[j : n - size + 1 + j]
    return np.unique(_mix(acc * _M1))


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    draw = lambda: rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64, endpoint=True)[:, None]
    return draw() * np.uint64(2) + np.uint64(1), draw()


def minima(s: np.ndarray) -> np.ndarray:
    a, b = _multipliers()
    best = (a * s[:256] + b).min(axis=1)
    for i in range(256, len(s), 256):
        np.minimum(best, (a * s[i : i + 256] + b).min(axis=1), out=best)
    return best


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band buckets, packed low bits) of a set with members."""
    m = _mix(minima(s))
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for column in m.reshape(BANDS, ROWS).T:
        acc = _mix(acc + column) * _M1
    fields = (m[:FIELDS] & np.uint64(15)).reshape(8, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return acc.view(np.int64), np.bitwise_or.reduce(fields, axis=1).view(np.int64)


def _profile(docs: DataFrame, width: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                sizes.append(len(s))
                if len(s):
                    band, sig = signature(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band)
                    sigs.append(sig)
                else:
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sigs, longs)],
                names=["doc_id", "h", "n_shingles", "key", "bands", "sig"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(task, "doc_id long, h long, n_shingles long, key binary, bands array<long>, sig array<long>")


def similarity(a: str, b: str) -> Column:
    """The collision-corrected estimate from two packed signatures."""
    ones = int("1" * 16, 16)
    unequal = []
    for i in range(8):
        x = f"({a}[{i}] ^ {b}[{i}])"
        spread = " | ".join([x, *[f"shiftrightunsigned({x}, {k})" for k in (1, 2, 3)]])
        unequal.append(f"bit_count(({spread}) & {ones}L)")
    chance = 1 / 2**BITS
    return (F.lit(1.0) - F.expr(" + ".join(unequal)) / F.lit(float(FIELDS)) - chance) / (1 - chance)


def _fits(threshold: int) -> Column:
    """The length bound: sets whose sizes differ too much can't reach the threshold."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold


class Linker:
    """Confirms pairs of nodes on their full sets and keeps the components so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, threshold: int):
        self.docs, self.nodes, self.width, self.threshold = docs, nodes, width, threshold
        self.edges: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(nid, members) for distinct nodes, computed again from their texts."""
        wanted = cut(self.nodes.select("nid", "first_id", "key").join(wanted, "nid", "left_semi"), "wanted")
        ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
        few = wanted.count() <= BROADCAST_IDS
        ids = F.broadcast(ids) if few else ids
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        width = self.width

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, members = [], []
                for text in batch.column(0):
                    s = shingles(text.as_py(), width)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(members, pa.binary())], names=["key", "members"])

        made = texts.select("text").mapInArrow(task, "key binary, members binary")
        keyed = wanted.select("nid", "key")
        return cut(made.join(F.broadcast(keyed) if few else keyed, "key").select("nid", "members").dropDuplicates(["nid"]), "sets")

    def confirm(self, pairs: DataFrame) -> int:
        """Test pairs (a, b) exactly; how many are links. Updates the components if any is."""
        pairs = cut(pairs.select("a", "b"), "pairs")
        if not pairs.limit(1).count():
            return 0
        sets, threshold = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()), self.threshold
        both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("nid").alias("b"), F.col("members").alias("mb")), "b")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    linked.append(100 * common >= threshold * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

        judged = cut(both.select("a", "b", "ma", "mb").mapInArrow(task, "a long, b long, linked boolean"), "judged")
        self.tested = judged.select("a", "b") if self.tested is None else self.tested.union(judged.select("a", "b"))
        return self.add(judged.where("linked").select("a", "b"))

    def add(self, links: DataFrame) -> int:
        found = links.count()
        if found:
            self.edges = links if self.edges is None else self.edges.union(links)
            self.labels = components(self.edges)
        return found

    def across(self, pairs: DataFrame) -> DataFrame:
        """The untested pairs whose ends lie in different components, with these."""
        if self.labels is not None:
            for end in ("a", "b"):
                pairs = pairs.join(self.labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
                pairs = pairs.withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        else:
            pairs = pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
        pairs = pairs.where("ca <> cb")
        return pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")

    def settle(self, pairs: DataFrame) -> None:
        """Test pairs (a, b, estimate): the best for each two components first, then what is still apart."""
        rest = cut(self.across(pairs), "across")
        best = rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("estimate", "a", "b")).alias("m"))
        if self.confirm(best.select("m.a", "m.b")):
            rest = cut(self.across(rest.drop("ca", "cb")), "across")
            self.confirm(rest)
        else:
            self.confirm(rest if self.tested is None else rest.join(self.tested, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; threshold is a percentage of Jaccard similarity."""
    return _judged(docs, id_col, text_col, width, threshold).drop("h")


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> DataFrame:
    """near_duplicates' rows with h, a hash of the text: id and h tell which rows are alike."""
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    profile = cut(_profile(docs, width), "profile")
    nodes = profile.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    nodes = cut(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("nid", F.explode("bands").alias("bucket"))
    # The smallest id after an exclusive or with the bucket: another member for each bucket, found without a sort.
    shared = members.groupBy("bucket").agg(F.min(F.col("nid").bitwiseXOR(F.col("bucket"))).alias("m"), F.count("*").alias("size")).where("size > 1")
    shared = shared.select("bucket", F.col("m").bitwiseXOR(F.col("bucket")).alias("leader"), "size")
    grouped = cut(members.join(shared, "bucket"), "grouped")

    ends = nodes.select("nid", "n", "sig")
    stars = grouped.where("nid <> leader").select(F.least("nid", "leader").alias("a"), F.greatest("nid", "leader").alias("b")).distinct()
    stars = stars.join(ends.toDF("a", "na", "sa"), "a").join(ends.toDF("b", "nb", "sb"), "b").where(_fits(threshold))
    stars = stars.withColumn("estimate", similarity("sa", "sb")).where(F.col("estimate") >= threshold / 100 - MARGIN)
    stars = cut(stars.select("a", "b", "estimate"), "stars")

    linker = Linker(docs, nodes, width, threshold)
    each = stars.select(F.col("a").alias("nid"), "estimate", "a", "b").union(stars.select("b", "estimate", "a", "b"))
    nearest = each.groupBy("nid").agg(F.max(F.struct("estimate", "a", "b")).alias("m"))
    linker.confirm(nearest.select("m.a", "m.b").distinct())
    linker.settle(stars)
    apart = _apart(grouped, linker)
    linker.settle(cut(_strays(apart.where(F.col("size") <= PAIRED), ends, threshold), "strays"))
    _join_blocks(apart.where(F.col("size") > PAIRED).join(nodes.select("nid", "n"), "nid"), linker)

    named = nodes.select("key", "nid", "first_id")
    if linker.labels is None:
        named = named.select("key", F.col("first_id").alias("component_id"))
    else:
        named = named.join(linker.labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
        named = cut(named, "named")
        firsts = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "firsts")
        named = join_groups(named, firsts, ["component"], "members").select("key", "component_id")
    out = profile.select("doc_id", "h", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _apart(grouped: DataFrame, linker: Linker) -> DataFrame:
    """(bucket, size, nid, component, main) of buckets of three or more that stars didn't join; main is the bucket's
    largest component. Two members are each other's star, so smaller buckets are done."""
    rows = grouped.where("size > 2").select("bucket", "size", "nid")
    if linker.labels is not None:
        rows = rows.join(linker.labels.select(F.col("node").alias("nid"), "component"), "nid", "left")
        rows = rows.withColumn("component", F.coalesce("component", "nid"))
    else:
        rows = rows.withColumn("component", F.col("nid"))
    parts = rows.groupBy("bucket", "component").count()
    main = parts.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(main.select("bucket", F.col("top.component").alias("main")), "bucket")
    return cut(rows.select("bucket", "size", "nid", "component", "main"), "apart")


def _strays(apart: DataFrame, ends: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, estimate) of members outside their bucket's main component with all others."""
    rows = apart.join(ends, "nid").select("nid", "bucket", "component", "main", "n", "sig")
    left = rows.where("component <> main").toDF(*["a", "bucket", "ca", "main", "na", "sa"])
    right = rows.toDF(*["b", "bucket", "cb", "main2", "nb", "sb"]).drop("main2")
    pairs = left.join(right, "bucket").where("ca <> cb and (cb = main or ca < cb)").where(_fits(threshold))
    pairs = pairs.withColumn("estimate", similarity("sa", "sb")).where(F.col("estimate") >= threshold / 100 - MARGIN)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "estimate").distinct()


def _join_blocks(apart: DataFrame, linker: Linker) -> None:
    """Compare strays with all nodes of the large buckets around a main component, block by block, on full sets."""
    nodes = cut(apart.select("main", "nid", "component", "n").distinct(), "block-nodes")
    if nodes.isEmpty():
        return
    stray = F.col("component") != F.col("main")
    blocks = lambda who: F.greatest(F.ceil(F.count_if(who) / BLOCK), F.ceil(F.sum(F.when(who, F.col("n")).otherwise(0)) / BLOCK_SHINGLES))
    sizes = nodes.groupBy("main").agg(blocks(F.lit(True)).alias("blocks"), blocks(stray).alias("stray_blocks"))
    sizes = cut(sizes, "block-sizes")
    nodes = nodes.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "main")
    of = lambda n: F.pmod(F.xxhash64("nid"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = nodes.where(stray).withColumn("i", of(F.col("stray_blocks"))).withColumn("j", each(F.col("blocks"))).withColumn("is_left", F.lit(True))
    right = nodes.where("stray_blocks > 0").withColumn("j", of(F.col("blocks"))).withColumn("i", each(F.col("stray_blocks"))).withColumn("is_left", F.lit(False))
    rows = left.unionByName(right).select("main", "i", "j", "is_left", "nid", "component")
    rows = rows.join(linker.sets(nodes.select("nid").distinct()), "nid").select("main", "i", "j", "is_left", "nid", "component", "members")
    threshold = linker.threshold

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        links = block_links(
            [np.frombuffer(m, np.uint64) for m in pdf["members"]], pdf["nid"].tolist(), pdf["component"].tolist(), pdf["is_left"].to_numpy(bool), threshold
        )
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    linker.add(cut(rows.groupBy("main", "i", "j").applyInPandas(compare, "a long, b long"), "block-links"))


def block_links(sets: list[np.ndarray], nids: list[int], home: list[int], is_left: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between left and right sets that join components (home): at most one fewer than there are components."""
    sides = [np.flatnonzero(is_left), np.flatnonzero(~is_left)]
    if not len(sides[0]) or not len(sides[1]):
        return []
    shared = np.intersect1d(*[np.concatenate([sets[k] for k in side]) for side in sides])
    common = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        held = []
        for side in sides:
            m = np.zeros((len(side), len(part)), np.float32)
            for row, k in enumerate(side):
                m[row, np.searchsorted(part, np.intersect1d(sets[k], part, assume_unique=True))] = 1
            held.append(m)
        common += held[0] @ held[1].T
    n = np.array([len(x) for x in sets], np.float32)
    linked = 100 * common >= threshold * (n[sides[0]][:, None] + n[sides[1]][None, :] - common)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for p, q in zip(*np.nonzero(linked), strict=True):
        x, y = sides[0][p], sides[1][q]
        c, d = find(home[x]), find(home[y])
        if c != d:
            root[max(c, d)] = min(c, d)
            out.append((nids[x], nids[y]))
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """The documents without later members of each group, with their own columns."""
    dropped = cut(_judged(docs, id_col, text_col, width, threshold).where("not kept").select("doc_id", "h").distinct(), "dropped")
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col).cast("string")).alias("g"))
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h")), "left_anti").select("row.*")
