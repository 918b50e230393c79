"""Path and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Directory names that say nothing on their own.
GENERIC_DIRS = ("app", "build", "dist", "lib", "source", "sources", "src")


def normalize(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def parent_dir(path: Column) -> Column:
    """The text before the last slash, or empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def top_folder(path: Column) -> Column:
    """The first of two segments or more, else empty; both kinds of slashes part."""
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise("")


def folder_label(path: Column) -> Column:
    """The parent's last segment, skipping one generic name where another stands before it."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda s: s != "")
    n = F.size(parts)
    skip = F.when((n > 2) & F.lower(F.get(parts, n - 2)).isin(*GENERIC_DIRS), 3).otherwise(2)
    return F.coalesce(F.get(parts, n - skip), F.lit(""))


def collapse(path: Column) -> Column:
    """Resolve `.`, `..` and empty segments; `..` stops at the root."""
    none = F.expr("cast(array() as array<string>)")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def join_path(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def go_up(directory: Column, levels: Column) -> Column:
    """The directory so many levels above, clamped at the root."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def query_terms(query: Column) -> Column:
    """Distinct lower-case words of three bytes or more, in order."""
    words = F.filter(F.split(query, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)
    return F.array_distinct(F.transform(words, F.lower))


def safe_session_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def relative_to(path: Column, root: Column) -> Column:
    """The rest behind root on a slash boundary, or null."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def estimated_tokens(text: Column) -> Column:
    """UTF-8 bytes by four, rounded down."""
    return F.floor(F.octet_length(text) / 4)
