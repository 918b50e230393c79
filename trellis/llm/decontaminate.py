"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

An item's windows are its runs of ten consecutive words (a shorter item is one window). Each distinct window is a row.
Its set holds its shingles, the pairs of neighbouring words (a window of one word: the word). Spark counts how often
the documents hold each shingle; this orders the shingles by rarity. A document that contains a window contains the
window's rarest shingle, so at containment 1 this one is the necessary prefix; a window with a shingle that no
document holds is dropped at once. Documents meet windows in an equi-join on the prefix token. Where the token stands
says where the window would begin and end (positional and length bounds), and the words around it, which travel with
it, are compared with the window's (exact containment).

What a task holds of the items is a filter of FILTER_BITS bits, whatever the number of items: it keeps most tokens out of
the join, and a full filter costs time and no result. Tokens that make up more than one of HOT_PARTS of all prefix
places are fewer than HOT_PARTS; their places are salted, and their windows repeated for each salt.

Defined cases: a null or empty text has no words and no hits; items without words are ignored; equal items all
count; an item without an id makes documents hit and contaminated and isn't listed; a text of any length leaves a
task in parts; no items leave every document clean; rows repeated in either table are judged alike (the same item_id
counts once); extra columns may have any names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from trellis.llm.common import HOT_PARTS, col, cut

WINDOW = 10
#: Bits of the filter that tasks hold (2 MB).
FILTER_BITS = 1 << 24
SALTS = 64
#: Candidate places in a row that leaves a task, and keys that are broadcast (some 30 bytes each).
PLACES_A_ROW, BROADCAST_KEYS = 4096, 1_000_000
#: Bytes that part words once A-Z are lower: all of ASCII but digits and letters.
_BREAKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only) as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, single: bool) -> np.ndarray:
    """Tokens of hashed words: of each one, or of each two neighbours."""
    return (_mix(h + _M1) if single else _mix(_mix(h[:-1] * _M1) + h[1:])).view(np.int64)


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(wid, body, size, tokens, items): the distinct windows with the sorted items that hold them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                ws = words(text.as_py())
                size = min(window, len(ws))
                if not size:
                    continue
                tokens = shingles(_hashes(ws), size == 1)
                starts = np.arange(len(ws) - size + 1)
                for at in range(0, len(starts), 8192):  # a long item leaves in parts
                    part = starts[at : at + 8192].tolist()
                    held = max(1, size - 1)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * held, pa.int32()), pa.array(np.concatenate([tokens[s : s + held] for s in part])))
                    bodies = pa.array([b" ".join(ws[s : s + size]) for s in part], pa.binary())
                    own = batch.column(0).take(pa.array([i] * len(part)))
                    yield pa.RecordBatch.from_arrays([own, bodies, pa.array([size] * len(part), pa.int32()), listed], names=["item", "body", "size", "tokens"])

    rows = items.select(col(item_col).alias("item"), col(text_col).cast("string").alias("text"))
    out = StructType([rows.schema["item"], StructField("body", BinaryType()), StructField("size", IntegerType()), StructField("tokens", ArrayType(LongType()))])
    grouped = rows.mapInArrow(task, out).groupBy("body").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))
    return cut(grouped.withColumn("wid", F.monotonically_increasing_id()), "windows")


class Filter:
    """A bit set that all wanted tokens pass, and few others; at most FILTER_BITS / 64 rows come to the driver."""

    def __init__(self, tokens: DataFrame):
        place = F.explode(F.array(F.col("token").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("token", 36).bitwiseAND(FILTER_BITS - 1))).alias("p")
        parts = tokens.select(place).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        self.bits = np.zeros(FILTER_BITS // 64, np.uint64)
        got = parts.toArrow()
        self.bits[got.column("i").to_numpy()] = got.column("v").to_numpy().view(np.uint64)

    def passes(self, tokens: np.ndarray) -> np.ndarray:
        t = tokens.view(np.uint64)
        out = None
        for p in (t & np.uint64(FILTER_BITS - 1), (t >> np.uint64(36)) & np.uint64(FILTER_BITS - 1)):
            hit = (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
            out = hit if out is None else out & hit
        return out.astype(bool)


def token_counts(texts: DataFrame, wanted: DataFrame, single: bool) -> DataFrame:
    """(token, n): how often the texts hold each wanted token. single: whether tokens of one word are wanted too."""
    shared = texts.sparkSession.sparkContext.broadcast(Filter(wanted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            found = [np.empty(0, np.int64)]
            for text in batch.column(0):
                h = _hashes(words(text.as_py()))
                for one in (False, True)[: 1 + single]:
                    t = shingles(h, one)
                    found.append(t[wanted.passes(t)])
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n.astype(np.int64))], names=["token", "n"])

    counted = texts.mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return cut(counted.join(wanted, "token", "left_semi"), "rarity")


_PLACE = pa.struct([("token", pa.int64()), ("salt", pa.int32()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.binary()))])


def _places(rows: DataFrame, prefixes: DataFrame, hot: list[int], window: int, single: bool) -> DataFrame:
    """(row, first, doc_id, n_words, places): a row for each document, more for those with many candidate places.

    A place carries the words around it, as many as a window can reach."""
    shared = rows.sparkSession.sparkContext.broadcast((Filter(prefixes.select("token").distinct()), np.array(sorted(hot), np.int64)))
    kind = StructType([StructField("row", LongType()), StructField("first", BooleanType()), rows.schema["doc_id"], StructField("n_words", LongType())])
    names = to_arrow_schema(kind).names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hot = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, of, first, sizes, listed = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ws = words(text.as_py())
                h = _hashes(ws)
                places = []
                for one in (False, True)[: 1 + single]:
                    tokens = shingles(h, one)
                    hits = np.flatnonzero(wanted.passes(tokens))
                    salts = np.where(np.isin(tokens[hits], hot), (row + hits) % SALTS, 0)
                    for p, t, salt in zip(hits.tolist(), tokens[hits].tolist(), salts.tolist(), strict=True):
                        before = 0 if one else min(p, window - 2)
                        places.append({"token": t, "salt": salt, "at": p, "before": before, "around": ws[p - before : p + (1 if one else window)]})
                for k in range(0, max(1, len(places)), PLACES_A_ROW):
                    at.append(row)
                    of.append(i)
                    first.append(k == 0)
                    sizes.append(len(ws))
                    listed.append(places[k : k + PLACES_A_ROW])
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(first, pa.bool_()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(_PLACE))],
                names=[*names, "places"],
            )

    place = StructType([StructField("token", LongType()), StructField("salt", IntegerType()), StructField("at", LongType()), StructField("before", IntegerType()), StructField("around", ArrayType(BinaryType()))])
    return cut(rows.mapInArrow(task, StructType([*kind.fields, StructField("places", ArrayType(place))])), "places")


def _hits(places: DataFrame, prefixes: DataFrame, hot: list[int]) -> DataFrame:
    """(row, a, b, items): every occurrence of a window, as words [a, b)."""
    salts = F.when(F.col("token").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    windows = prefixes.select("token", "offset", "size", "body", "items", F.explode(salts).alias("salt"))
    rows = places.where(F.size("places") > 0).select("row", F.explode("places").alias("x")).select("row", "x.*").join(windows, ["token", "salt"])
    start = F.col("before") - F.col("offset")
    rows = rows.where((start >= 0) & (start + F.col("size") <= F.size("around")))
    part = F.transform(F.slice("around", start + 1, F.col("size")), lambda w: w.cast("string"))
    rows = rows.where(F.array_join(part, " ") == F.col("body").cast("string"))
    return rows.select("row", (F.col("at") - F.col("offset")).alias("a"), (F.col("at") - F.col("offset") + F.col("size")).alias("b"), "items")


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted), spans (merged word ranges), contaminated.

    id_col may be a column of any type; it is carried along."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    windows = item_windows(items, item_col, item_text_col, window)
    single = not windows.where("size = 1").isEmpty()
    wanted = cut(windows.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    counts = token_counts(rows.select("text"), wanted, single)
    spread = windows.select("wid", F.posexplode("tokens").alias("offset", "token")).join(counts, "token", "left")
    rarest = spread.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("m")).where("m.n > 0")
    prefixes = cut(windows.drop("tokens").join(rarest.select("wid", "m.*"), "wid"), "prefixes")
    each = prefixes.select("token", "n").distinct()
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["token"] for r in each.where(F.col("n") * hot_parts > total).collect()]  # fewer than hot_parts
    found = _places(rows, prefixes, hot, window, single)
    hits = cut(_hits(found, prefixes, hot), "hits")

    order = W.partitionBy("row").orderBy("a", "b")
    spans = hits.select("row", "a", "b").distinct().withColumn("reach", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("a"), 0).otherwise(1)).over(order)).groupBy("row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("n_hit"))
    owners = hits.select("row", "items").distinct().groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = found.where("first").select("row", "doc_id", "n_words").join(spans.join(owners, "row"), "row", "left")
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    listed = F.coalesce("items", F.array().cast(hits.schema["items"].dataType))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), listed.alias("items"), F.coalesce("spans", none).alias("spans"), F.col("spans").isNotNull().alias("contaminated"))


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents without a benchmark window, with their own columns. Texts are known by two hashes and their length."""
    key = F.struct(F.xxhash64(col(text_col)).alias("p"), F.xxhash64(F.lit(1), col(text_col)).alias("q"), F.length(col(text_col)).alias("n"))
    texts = docs.select(key.alias("key"), col(text_col).alias("text"))
    gone = cut(find_leaks(texts, items, "key").where("contaminated").select(F.col("doc_id").alias("gone")).distinct(), "leaks")
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"), key.alias("key"))
    few = gone.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
