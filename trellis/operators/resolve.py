"""Import resolution as joins: candidates with priorities meet the files' paths, the least priority wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trellis import schema
from trellis.functions import paths
from trellis.sources import configs

TS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
TS_INDEX = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: What a written extension may stand for.
TS_WRITTEN = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}

_KEY = ["file_id", "ordinal"]


def _cands(rows: DataFrame, cand: Column, priority: Column | int = 0, whole_dir: bool = False, confidence: str = schema.RESOLVED, root: Column | None = None) -> DataFrame:
    """Candidates of imports; the least root wins, then the least priority."""
    p = F.lit(priority) if isinstance(priority, int) else priority
    first = F.lit("") if root is None else root
    return rows.select(*_KEY, first.alias("root"), p.cast("int").alias("priority"), cand.alias("cand"), F.lit(whole_dir).alias("whole_dir"), F.lit(confidence).alias("confidence"))


def _several(rows: DataFrame, *cands: Column) -> DataFrame:
    """One candidate for each expression, in order; null ones drop out."""
    listed = rows.select(*_KEY, F.posexplode(F.array(*cands)).alias("priority", "cand")).where("cand is not null")
    return _cands(listed, F.col("cand"), F.col("priority"))


def _source_root(directory: Column, package: Column) -> Column:
    """The directory without the package's path at its end (a plain suffix)."""
    tail = F.regexp_replace(F.coalesce(package, F.lit("")), r"\.", "/")
    cut = F.rtrim(F.substr(directory, F.lit(1), F.length(directory) - F.length(tail)), F.lit("/"))
    return F.when((tail != "") & F.endswith(directory, tail), cut).otherwise(directory)


def _own_roots(files: DataFrame, language: str, suffix: str) -> DataFrame:
    rows = files.where(F.col("language") == language).where(F.endswith("path", F.lit(suffix)))
    return rows.select(_source_root(F.col("dir"), F.col("package")).alias("root")).distinct()


def _below(places: DataFrame, roots: DataFrame) -> DataFrame:
    """places (place), roots (root) -> (place, root, rest) for each root that a place lies below.

    A place has as many folders above it as its path has parts, so this is one row for each of them and an equi-join,
    however many roots there are."""
    parts, k = F.split("place", "/"), F.sequence(F.lit(0), F.size(F.split("place", "/")) - 1)
    above = F.transform(k, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("root"), F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "/").alias("rest")))
    return places.select("place", F.explode(above).alias("x")).select("place", "x.root", "x.rest").join(roots, "root")


def _python(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, str]:
    packages = files.where(paths.basename(F.col("path")) == "__init__.py").select("dir").distinct()
    parents = packages.select(paths.parent_dir(F.col("dir")).alias("root"), "dir")
    roots = parents.join(packages.select(F.col("dir").alias("root")), "root", "left_anti").select("root").union(files.sparkSession.createDataFrame([("",)], "root string")).distinct()
    sub = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    relative = rows.where(F.startswith("specifier", F.lit(".")))
    base = paths.go_up(F.col("dir"), dots - 1)
    joined = F.when(base == "", sub).when(sub == "", base).otherwise(F.concat(base, F.lit("/"), sub))
    inits = F.when(joined == "", F.lit("__init__.py")).otherwise(F.concat(joined, F.lit("/__init__.py")))
    near = _several(relative, F.when(sub != "", F.concat(joined, F.lit(".py"))), inits)
    absolute = rows.where(~F.startswith("specifier", F.lit("."))).select(*_KEY, sub.alias("sub"))
    found = _below(files.where(F.endswith("path", F.lit(".py"))).select(F.col("path").alias("place")), roots)
    init = F.endswith("rest", F.lit("/__init__.py"))
    module = F.regexp_replace("rest", r"(?:/__init__)?\.py$", "")
    found = found.select("place", "root", F.explode(F.array(F.struct(module.alias("sub"), init.cast("int").alias("q")), F.struct(F.regexp_replace("rest", r"\.py$", "").alias("sub"), F.lit(0).alias("q")))).alias("x"))
    far = absolute.join(found.select("place", "root", "x.*").distinct(), "sub")
    return near.unionByName(_cands(far, F.col("place"), F.col("q"), root=F.col("root"))), "relative import resolves to no file in the repo"


def _java(rows: DataFrame, files: DataFrame) -> DataFrame:
    roots = _own_roots(files, "java", ".java")
    wild = F.endswith("specifier", F.lit(".*"))
    named = rows.select(*_KEY, wild.alias("wild"), F.regexp_replace(F.regexp_replace("specifier", r"\.\*$", ""), r"\.", "/").alias("sub"))
    folders = _below(files.select(F.col("dir").alias("place")).distinct(), roots).withColumnRenamed("rest", "sub")
    sources = _below(files.where(F.endswith("path", F.lit(".java"))).select(F.col("path").alias("place")), roots).withColumn("sub", F.regexp_replace("rest", r"\.java$", ""))
    all_of = _cands(named.where("wild").join(folders, "sub"), F.col("place"), 0, True, schema.HEURISTIC)
    return all_of.unionByName(_cands(named.where("not wild").join(sources, "sub"), F.col("place"), 0, False, schema.HEURISTIC, F.col("root")))


def _csharp(rows: DataFrame, files: DataFrame) -> DataFrame:
    folders = _below(files.select(F.col("dir").alias("place")).distinct(), _own_roots(files, "csharp", ".cs")).withColumnRenamed("rest", "sub")
    named = rows.select(*_KEY, F.regexp_replace("specifier", r"\.", "/").alias("sub"))
    return _cands(named.join(folders, "sub"), F.col("place"), 0, True, schema.HEURISTIC)


def _kotlin(rows: DataFrame, files: DataFrame) -> DataFrame:
    root = _source_root(F.col("dir"), F.col("package"))
    wild = F.endswith("specifier", F.lit(".*"))
    full = paths.join_path(root, F.regexp_replace(F.regexp_replace("specifier", r"\.\*$", ""), r"\.", "/"))
    return _cands(rows.where(wild), full, 0, True).unionByName(_cands(rows.where(~wild), F.concat(full, F.lit(".kt"))))


def _relative(rows: DataFrame, ending: str = "") -> DataFrame:
    path = paths.collapse(paths.join_path(F.col("dir"), F.col("specifier")))
    return _cands(rows, F.when(F.endswith(path, F.lit(ending)), path).otherwise(F.concat(path, F.lit(ending))) if ending else path)


def _go(rows: DataFrame, prefixes: list[tuple[str, str, int]]) -> DataFrame:
    """The first prefix that fits decides; its folder is the candidate."""
    spark = rows.sparkSession
    table = spark.createDataFrame(prefixes, "prefix string, folder string, p int")
    inside = (F.col("specifier") == F.col("prefix")) | F.startswith("specifier", F.concat("prefix", F.lit("/")))
    hit = rows.join(F.broadcast(table), inside)  # a module and its local replacements
    rest = F.regexp_replace(F.substr(F.col("specifier"), F.length("prefix") + 1), "^/", "")
    folder = F.when(rest == "", F.col("folder")).otherwise(paths.join_path(F.col("folder"), rest))
    first = hit.select(*_KEY, "p", folder.alias("folder")).groupBy(*_KEY).agg(F.min_by("folder", "p").alias("folder"))
    return _cands(first, F.col("folder"), 0, True)


def _ts_forms(base: Column) -> list[Column]:
    written = [F.when(F.endswith(base, F.lit(old)), F.concat(F.substr(base, F.lit(1), F.length(base) - len(old)), F.lit(new))) for old, news in TS_WRITTEN.items() for new in news]
    return [base, *written, *[F.concat(base, F.lit(e)) for e in (*TS_ENDINGS, *TS_INDEX)]]


def _typescript(rows: DataFrame, aliases: list[tuple]) -> DataFrame:
    relative = F.startswith("specifier", F.lit("."))
    near = rows.where(relative).withColumn("base", paths.collapse(paths.join_path(F.col("dir"), F.col("specifier"))))
    out = _several(near, *_ts_forms(F.col("base")))
    if aliases:
        table = rows.sparkSession.createDataFrame(aliases, "dir string, prefix string, suffix string, star boolean, target string, p int")
        fits = F.when(F.col("star"), F.startswith("specifier", F.col("prefix")) & F.endswith("specifier", F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
        far = rows.where(~relative).join(table, "dir").where(F.coalesce(fits, F.col("specifier") == F.col("prefix")))
        middle = F.substr(F.col("specifier"), F.length("prefix") + 1, F.length("specifier") - F.length("prefix") - F.length("suffix"))
        far = far.withColumn("base", paths.collapse(F.when(F.col("star"), F.replace("target", F.lit("*"), middle)).otherwise(F.col("target"))))
        forms = far.select(*_KEY, "p", F.posexplode(F.array(*_ts_forms(F.col("base")))).alias("q", "cand")).where("cand is not null")
        out = out.unionByName(_cands(forms, F.col("cand"), F.col("p") * 100 + F.col("q")))
    return out


def _rust(rows: DataFrame, crates: list[tuple[str, str]]) -> DataFrame:
    stem = F.regexp_replace(paths.basename(F.col("path")), r"\.rs$", "")
    base = F.when(stem.isin("lib", "main", "mod"), F.col("dir")).otherwise(paths.join_path(F.col("dir"), stem))
    mods = rows.where(~F.startswith("specifier", F.lit("use:"))).withColumn("base", paths.join_path(base, F.col("specifier")))
    out = _several(mods, F.concat("base", F.lit(".rs")), F.concat("base", F.lit("/mod.rs")))
    if crates:
        table = rows.sparkSession.createDataFrame(crates, "crate string, lib string")
        used = rows.where(F.startswith("specifier", F.lit("use:"))).withColumn("crate", F.substr(F.col("specifier"), F.lit(5)))
        out = out.unionByName(_cands(used.join(F.broadcast(table), "crate"), F.col("lib")))  # a workspace's members
    return out


def resolve_imports(files: DataFrame, raw: DataFrame, read: Callable[[str], str | None], known_paths: Callable[[], list[str]]) -> DataFrame:
    """files (file_id, path, language, package), raw (file_id, ordinal, specifier) ->
    (file_id, ordinal, specifier, status, dst, confidence, reason), one row for each target or miss.

    read gives a project file's text; known_paths lists files where a project file names folders by `*`."""
    spark: SparkSession = files.sparkSession
    files = files.withColumn("dir", paths.parent_dir(F.col("path")))
    rows = raw.join(files, "file_id")
    of = lambda name: rows.where(F.col("language") == name)
    python, python_reason = _python(of("python"), files)
    parts = [python, _java(of("java"), files), _csharp(of("csharp"), files), _kotlin(of("kotlin"), files), _relative(of("ruby"), ".rb"), _relative(of("php"), ".php"), _relative(of("c"))]
    prefixes = configs.go_prefixes(read)
    go = _go(of("go"), prefixes) if prefixes else None
    if go is not None:
        parts.append(go)
    folders = [r["dir"] for r in files.where("language = 'typescript'").select("dir").distinct().collect()]
    parts.append(_typescript(of("typescript"), configs.ts_aliases(read, sorted(folders))))
    crates = configs.crate_libs(read, known_paths()) if read("Cargo.toml") else []
    parts.append(_rust(of("rust"), crates))
    cands = parts[0]
    for p in parts[1:]:
        cands = cands.unionByName(p)

    by_path = cands.where("not whole_dir").join(files.select(F.col("path").alias("cand"), F.col("file_id").alias("dst")), "cand")
    best = by_path.groupBy(*_KEY).agg(F.min(F.struct("root", "priority", "dst", "confidence")).alias("m")).select(*_KEY, "m.dst", "m.confidence")
    by_dir = cands.where("whole_dir").join(files.select(F.col("dir").alias("cand"), F.col("file_id").alias("dst")), "cand").select(*_KEY, "dst", "confidence").distinct()
    hits = best.unionByName(by_dir)
    out = rows.select(*_KEY, "specifier", "language").join(hits, _KEY, "left")
    inner = F.col("language") == "python"
    reason = (
        F.when(inner & F.startswith("specifier", F.lit(".")), python_reason)
        .when(F.col("language") == "ruby", "require_relative resolves to no .rb file")
        .when((F.col("language") == "rust") & ~F.startswith("specifier", F.lit("use:")), "`mod` declaration resolves to no .rs file")
    )
    if go is not None:
        tried = go.select(*_KEY, F.lit(True).alias("internal")).distinct()
        out = out.join(tried, _KEY, "left")
        reason = F.when((F.col("language") == "go") & F.col("internal"), "internal import resolves to no mapped Go files").otherwise(reason)
    out = out.withColumn("reason", F.when(F.col("dst").isNull(), reason))
    status = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("reason").isNotNull(), "unresolved").otherwise("external")
    return out.select(*_KEY, "specifier", status.alias("status"), "dst", "confidence", "reason")
