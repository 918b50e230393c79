"""Walking a source tree with ignore rules."""

from __future__ import annotations

import os
import re
from functools import cached_property

import xxhash
from pyspark.sql import DataFrame, SparkSession

from trellis import lang

WALKED = "path string, abs string, mtime_ns bigint, size bigint"


class IgnoreRules:
    """The rules of one ignore file, for paths relative to its folder."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def rules(self) -> list[tuple[re.Pattern, bool, bool]]:
        """(pattern, keeps, folders only), in order."""
        out = []
        for line in self.text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keeps = line.startswith("!")
            line = line[keeps:].removeprefix("\\")
            folders = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            out.append((re.compile(("" if anchored else "(?:.*/)?") + _glob(line.lstrip("/")) + r"\Z", re.S), keeps, folders))
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True for ignored, False for kept again, None where no rule fits; the last that fits counts."""
        out = None
        for pattern, keeps, folders in self.rules:
            if (is_dir or not folders) and pattern.match(path):
                out = not keeps
        return out


def _glob(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif text[i:] == "**" and i and text[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    return out


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def _in_git(root: str) -> bool:
    at = os.path.abspath(root)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return True
        if os.path.dirname(at) == at:
            return False
        at = os.path.dirname(at)


def list_files(root: str) -> list[tuple[str, str, int, int]]:
    """(path, abs, mtime_ns, size) of regular files: no hidden ones, no links, none that ignore files name.

    `.ignore` files always count, `.gitignore` and `.git/info/exclude` inside a git checkout; rules of deeper folders
    come last. Unreadable folders are skipped; unreadable metadata are zeros."""
    names = [".gitignore", ".ignore"] if _in_git(root) else [".ignore"]
    out = []

    def visit(folder: str, rel: str, rules: list[tuple[str, IgnoreRules]]) -> None:
        for name in names:
            if (text := _read(os.path.join(folder, name))) is not None:
                rules = [*rules, (rel, IgnoreRules(text))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name.startswith(".") or e.is_symlink():
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            verdicts = (r.verdict(path[len(base) + 1 if base else 0 :], is_dir) for base, r in reversed(rules))
            if next((v for v in verdicts if v is not None), False):
                continue
            if is_dir:
                visit(e.path, path, rules)
            elif e.is_file(follow_symlinks=False):
                try:
                    stat = e.stat(follow_symlinks=False)
                    out.append((path, e.path, stat.st_mtime_ns, stat.st_size))
                except OSError:
                    out.append((path, e.path, 0, 0))

    exclude = _read(os.path.join(root, ".git", "info", "exclude"))
    visit(root, "", [("", IgnoreRules(exclude))] if exclude else [])
    return out


def signature(rows: list[tuple[str, str, int, int]]) -> str:
    """What a listing's paths, times and sizes are; empty where a time is unknown."""
    if any(not mtime for _, _, mtime, _ in rows):
        return ""
    return xxhash.xxh3_128_hexdigest("\0".join(f"{path}\0{mtime}\0{size}" for path, _, mtime, size in rows).encode("utf-8", "surrogateescape"))


def walk(spark: SparkSession, rows: list[tuple[str, str, int, int]], files_a_task: int = 500) -> DataFrame:
    """The files of a listing; contents are read in tasks."""
    return spark.createDataFrame(rows, WALKED).repartition(max(1, -(-len(rows) // files_a_task)))


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime_ns, size) from any store that Spark reads, without ignore rules; Spark skips empty files."""
    from pyspark.sql import functions as F

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z][a-z0-9+.-]*:/*|^/+", "", root).rstrip("/")
    rel = F.expr("substring_index(path, '{}/', -1)".format(base.replace("'", "\\'")))
    return rows.select(rel.alias("path"), "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def find_root(path: str, marker: str = ".trellis/_meta.json") -> str | None:
    """The nearest folder above that holds an index."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, marker)):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def known(path: str) -> bool:
    return lang.detect(path) is not None
