"""Call resolution: a callee's name meets the same file's first definition, else the only symbol of that name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trellis import schema


def resolve_calls(symbols: DataFrame, raw: DataFrame) -> DataFrame:
    """symbols (symbol_id, name, file_id), raw (file_id, caller, callee, seq) -> (src, dst, confidence, seq).

    Names that are ambiguous elsewhere are dropped; calls of oneself are dropped after the target is chosen. Symbols
    are grouped before the join, so a name that a third of all symbols share is one row."""
    local = symbols.groupBy("file_id", F.col("name").alias("callee")).agg(F.min("symbol_id").alias("local"))
    anywhere = symbols.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("only")).where("n = 1").drop("n")
    rows = raw.join(local, ["file_id", "callee"], "left").join(anywhere, "callee", "left")
    target = F.coalesce("local", "only")
    confidence = F.when(F.col("local").isNotNull(), schema.RESOLVED).otherwise(schema.HEURISTIC)
    rows = rows.select(F.col("caller").alias("src"), target.alias("dst"), confidence.alias("confidence"), "seq")
    return rows.where("dst is not null and dst <> src")


def counted(symbols: DataFrame, raw: DataFrame, wide: int) -> DataFrame:
    """One row (symbol_count, calls, heuristic_calls): distinct symbols (file_id, name), and how many of raw (file_id, name,
    callee), whose callers are symbols, resolve_calls keeps. name and callee are of any one type.

    All that decides on a call lies under its callee's name, so one shuffle into `wide` parts by name is enough, and no
    symbol is numbered. A name that very many files share is one task's."""
    called = raw.where("file_id is not null and name <> callee")  # one that names its caller is local, and of oneself
    rows = symbols.select("name", "file_id", F.lit(0).cast("long").alias("n")).unionAll(called.select("callee", "file_id", F.lit(1).cast("long")))
    rows = rows.repartition(wide, "name").groupBy("name", "file_id").agg(F.min("n").alias("foreign"), F.sum("n").alias("n"))
    here, away = F.when(F.col("foreign") == 0, F.col("n")).otherwise(0), F.when(F.col("foreign") == 1, F.col("n")).otherwise(0)
    names = rows.groupBy("name").agg(F.sum(1 - F.col("foreign")).alias("symbols"), F.sum(here).alias("here"), F.sum(away).alias("away"))
    guessed = F.coalesce(F.sum(F.when(F.col("symbols") == 1, F.col("away"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return names.agg(total("symbols").alias("symbol_count"), (total("here") + guessed).alias("calls"), guessed.alias("heuristic_calls"))
