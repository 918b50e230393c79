"""Python by its own parser; files it can't parse are read line by line."""

from __future__ import annotations

import ast
import re
import warnings

from trellis.lang.base import Extraction, LanguageSpec, Source, register


class _Walk:
    def __init__(self, text: str):
        self.source, self.out = Source(text), Extraction()
        self.bytes = text.encode("utf-8", "surrogatepass")
        self.rows = [0, *(i + 1 for i, b in enumerate(self.bytes) if b == 10)]

    def span(self, row: int, col: int, size: int) -> dict:
        start = self.rows[row - 1] + col
        return {"start_byte": start, "end_byte": start + size, "start_row": row - 1, "start_col": col}

    def _name(self, node, keyword: str) -> dict:
        """The span of the name behind def or class."""
        start = self.rows[node.lineno - 1] + node.col_offset
        m = re.compile(rb"(?:async\s+)?" + keyword.encode() + rb"\s+").match(self.bytes, start)
        at = m.end() if m else start
        row = self.bytes.count(b"\n", 0, at)
        return {"start_byte": at, "end_byte": at + len(node.name.encode()), "start_row": row, "start_col": at - self.rows[row]}

    def visit(self, node, in_class: bool) -> None:
        if isinstance(node, ast.ClassDef):
            self.out.symbols.append({"name": node.name, "kind": "Class", "span": self._name(node, "class")})
            in_class = True
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            self.out.symbols.append({"name": node.name, "kind": "Method" if in_class else "Function", "span": self._name(node, "def")})
            in_class = False
        elif isinstance(node, ast.Import):
            for a in node.names:
                self.out.imports.append({"specifier": a.name, "span": self.span(a.lineno, a.col_offset, len(a.name.encode()))})
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            start = self.rows[node.lineno - 1] + node.col_offset
            at = self.bytes.find(name.encode(), start + 4) if name else -1
            row = self.bytes.count(b"\n", 0, max(at, start))
            self.out.imports.append({"specifier": name, "span": {"start_byte": max(at, start), "end_byte": max(at, start) + len(name.encode()), "start_row": row, "start_col": max(at, start) - self.rows[row]}})
        for child in ast.iter_child_nodes(node):
            self.visit(child, in_class)


def _by_lines(text: str) -> Extraction:
    source, out, at = Source(text), Extraction(), 0
    classes: list[int] = []
    functions: list[int] = []
    for line in text.splitlines(keepends=True):
        if m := re.match(r"(\s*)(?:async\s+)?(class|def)\s+(\w+)", line):
            indent = len(m[1].expandtabs())
            classes = [c for c in classes if c < indent]
            functions = [f for f in functions if f < indent]
            inner = bool(classes) and (not functions or max(classes) > max(functions))
            kind = "Class" if m[2] == "class" else "Method" if inner else "Function"
            out.symbols.append({"name": m[3], "kind": kind, "span": source.span(at + m.start(3), at + m.end(3))})
            (classes if m[2] == "class" else functions).append(indent)
        elif m := re.match(r"\s*from\s+(\.*[\w.]*)\s+import\b", line):
            out.imports.append({"specifier": m[1], "span": source.span(at + m.start(1), at + m.end(1))})
        elif m := re.match(r"\s*import\s+(.+)", line):
            for part in re.finditer(r"([\w.]+)(?:\s+as\s+\w+)?\s*(?:,|$|#)", m[1]):
                a = at + m.start(1) + part.start(1)
                out.imports.append({"specifier": part[1], "span": source.span(a, a + len(part[1]))})
        at += len(line)
    return out


def python(text: str) -> Extraction:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        walk = _Walk(text)
        walk.visit(tree, False)
        return walk.out
    except (SyntaxError, ValueError, RecursionError):
        return _by_lines(text)


register(LanguageSpec("python", ("py", "pyi"), python, ("python",)))
