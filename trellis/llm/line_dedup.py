"""Line dedup (native): a suffix array over line ids finds repeated runs of lines; later copies are deleted.

Lines are trimmed of ASCII white space and blank ones are set aside. A line's id is its rank among the lines that
the corpus holds more than once; a line that occurs once ends every run and leaves the work at once. Prefix
doubling then ranks, round by round, the suffixes by their first 2, 4, 8 ... lines: a pair of ranks at distance h
gets the rank of its place in the sorted distinct pairs. Pairs are counted before the shuffle, those that occur
once are dropped (nothing longer repeats there), and the sort is over distinct pairs, so a line or passage that a
third of the documents share is one row of it.

A run counts when it has `min_words` words. What has to be known at a place is thus only its longest-common-prefix
interval at the depth where `min_words` is reached: m lines, at most min_words of them. Two overlapping ranks of
2^k <= m lines name this interval exactly, and its first place, by document id and line, is the original. Every line of a
maximal repeated run lies in such a window inside the run, starting at or ending with some line, so the union of
windows whose interval began earlier is the union of all later copies of maximal runs. Rounds stop at min_words
lines, or once no pair repeats.

Defined cases: null and empty texts have no lines and stay as they are; blank lines are kept between kept lines and
go with a run that surrounds them; very long texts are rows of lines like others; a copy inside one document is a
later copy too; rows equal in id and text count as one document and get the same result; rows that share an id but
not a text are ordered by a hash of the text; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trellis.llm.common import WS, WS_CHARS, col, cut, join_groups, pinned

MIN_WORDS = 30
#: Documents with runs and runs, together, that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_RUNS = 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, i, raw, line, n): the non-blank lines by gapless number i and place raw, with their numbers of words."""
    places = F.expr("filter(transform(split(text, '\n'), (l, k) -> named_struct('raw', cast(k as bigint), 'line', btrim(l, ws))), x -> x.line <> '')")
    rows = docs.withColumn("ws", F.lit(WS_CHARS)).select("doc", pinned(places).alias("places")).select("doc", F.posexplode("places").alias("i", "x"))
    words = F.size(F.split("x.line", rf"[{WS}]+")).cast("long")
    line = F.struct(F.xxhash64("x.line"), F.xxhash64(F.lit(1), "x.line"), F.length("x.line"))
    return rows.select("doc", F.col("i").cast("long").alias("i"), "x.raw", line.alias("line"), words.alias("n"))


def _ranked(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct groups with ids that grow in their order: a range sort, then row numbers within each part."""
    ordered = groups.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """lines (doc, i, line, n), i gapless -> the same for repeated lines with r0, r1, ...: the rank of the suffix at
    the place by its first 2^k lines, null where these don't repeat. And the number of ranks."""
    repeated = lines.groupBy("line").count().where("count > 1").select("line")
    rows = lines.join(_ranked(repeated, ["line"], "r0"), "line").drop("line")
    rows = cut(rows.dropDuplicates(["doc", "i"]), "suffixes")
    k = 0
    while 2 ** (k + 1) <= depth:
        after = W.partitionBy("doc").orderBy("i").rangeBetween(2**k, 2**k)
        rows = rows.withColumn("next", F.when(F.col(f"r{k}").isNotNull(), F.first(f"r{k}").over(after)))
        pairs = rows.where("next is not null").groupBy(f"r{k}", "next").count().where("count > 1").drop("count")
        ranked = _ranked(pairs, [f"r{k}", "next"], f"r{k + 1}")
        if not ranked.limit(1).count():
            rows = rows.drop("next")
            break
        rows = cut(rows.join(ranked, [f"r{k}", "next"], "left").drop("next"), "suffixes")
        k += 1
    return rows, k + 1


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of min_words words from each line on, and up to each line: (doc, i, m)."""
    doc = W.partitionBy("doc").orderBy("i")
    rows = rows.withColumn("seg", F.col("i") - F.row_number().over(doc))  # the same for neighbours
    seg = W.partitionBy("doc", "seg")
    rows = rows.withColumn("e", F.sum("n").over(seg.orderBy("i").rowsBetween(W.unboundedPreceding, 0))).withColumn("s", F.col("e") - F.col("n"))
    rows = rows.withColumn("all", F.sum("n").over(seg))
    # Lines that begin before min_words words are over; each has a word, so a frame has min_words lines at most.
    ahead = F.count("*").over(seg.orderBy("s").rangeBetween(0, min_words - 1))
    back = F.count("*").over(seg.orderBy("e").rangeBetween(1 - min_words, 0))
    rows = rows.withColumn("ahead", F.when(F.col("all") - F.col("s") >= min_words, ahead)).withColumn("back", F.when(F.col("e") >= min_words, back))
    both = F.array(F.struct(F.col("i").alias("i"), F.col("ahead").alias("m")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("m")))
    return rows.select("doc", F.explode(F.array_distinct(F.filter(both, lambda x: x["m"].isNotNull()))).alias("x")).select("doc", "x.i", "x.m").distinct()


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, a, b): maximal runs of lines [a, b) that are later copies, in gapless line numbers."""
    ranks, levels = suffix_ranks(lines, min_words)
    windows = _windows(ranks.select("doc", "i", "n"), min_words)
    windows = windows.where(F.col("m") < 2**levels).withColumn("k", F.expr("length(bin(m)) - 1"))
    here = ranks.select("doc", "i", F.array(*[f"r{k}" for k in range(levels)]).alias("r"))
    windows = windows.withColumn("j", F.col("i") + F.col("m") - F.expr("shiftleft(1L, k)"))
    named = windows.join(here, ["doc", "i"]).withColumn("x", F.expr("r[k]")).drop("r").where("x is not null")
    named = named.join(here.withColumnRenamed("i", "j"), ["doc", "j"]).withColumn("y", F.expr("r[k]")).drop("r").where("y is not null")
    named = cut(named.select("doc", "i", "m", "x", "y"), "windows")
    firsts = named.groupBy("m", "x", "y").agg(F.min(F.struct("doc", "i")).alias("first"), F.count("*").alias("c")).where("c > 1")
    late = join_groups(named, cut(firsts, "intervals"), ["m", "x", "y"], "c").where(F.struct("doc", "i") > F.col("first")).select("doc", "i", (F.col("i") + F.col("m")).alias("z"))
    order = W.partitionBy("doc").orderBy("i", "z")
    late = late.distinct().withColumn("reach", F.max("z").over(order.rowsBetween(W.unboundedPreceding, -1)))
    late = late.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("i"), 0).otherwise(1)).over(order))
    return late.groupBy("doc", "run").agg(F.min("i").alias("a"), F.max("z").alias("b")).drop("run")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, runs): for documents with later copies, the sorted runs [a, b) over their lines as split by newline.

    doc is a struct of the id and a hash of the text."""
    docs = docs.select(F.struct(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h")).alias("doc"), col(text_col).alias("text")).where("text is not null")
    lines = cut(_lines(docs), "lines")
    runs = cut(later_copies(lines.drop("raw"), min_words), "copies")
    ends = runs.select("doc", F.explode(F.array(F.col("a"), F.col("b") - 1)).alias("i")).distinct()
    place = lines.select("doc", "i", "raw").distinct().join(ends, ["doc", "i"])
    runs = runs.join(place.toDF("doc", "a", "from"), ["doc", "a"]).withColumn("last", F.col("b") - 1)
    runs = runs.join(place.toDF("doc", "last", "to"), ["doc", "last"])
    return runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("a"), (F.col("to") + 1).alias("b")))).alias("runs"))


def _edited(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, text, runs): each row as a struct, so no name clashes, its text without the runs, and the runs."""
    found = cut(find_runs(docs, id_col, text_col, min_words), "runs").select(F.col("doc.id").alias("fid"), F.col("doc.h").alias("fh"), "runs")
    n, runs = found.select(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    if n + runs <= BROADCAST_RUNS:  # 32 bytes a document and 16 a run
        found = F.broadcast(found)
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("h"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    rows = rows.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split("text", "\n")))
    # Keep what lies between the runs: from each run's end to the next one's start.
    parts = F.expr("transform(runs, (r, k) -> slice(lines, cast(r.b as int) + 1, cast(coalesce(get(runs, k + 1).a, cast(size(lines) as bigint)) - r.b as int)))")
    left = F.concat(F.expr("slice(lines, 1, cast(runs[0].a as int))"), F.flatten(parts))
    empty = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    return rows.select("row", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.coalesce("runs", empty).alias("runs"))


def _unpacked(docs: DataFrame, text_col: str) -> list:
    return [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, runs_col: str = "line_runs") -> DataFrame:
    """All rows with the text changed in place and one column more, runs_col: the removed ranges of lines, empty for none.

    runs_col must not be one of the rows' own columns; those may have any names."""
    if runs_col in docs.columns:
        raise ValueError(f"the rows have a column {runs_col}; choose another name")
    return _edited(docs, id_col, text_col, min_words).select(*_unpacked(docs, text_col), F.col("runs").alias(runs_col))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of runs; those of which nothing but white space is left go."""
    gone = (F.size("runs") > 0) & (F.btrim("text", F.lit(WS_CHARS)) == "")
    return _edited(docs, id_col, text_col, min_words).where(~gone).select(*_unpacked(docs, text_col))
