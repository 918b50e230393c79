"""Languages with braces, read as tokens with a stack of open blocks."""

from __future__ import annotations

import re

from trellis.lang.base import Extraction, LanguageSpec, Lexicon, Source, Token, register, tokenize

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, (")", "]", "}")


class Reader:
    """Tokens of a text with helpers to look around."""

    def __init__(self, text: str, lex: Lexicon):
        self.source, self.tokens, self.out = Source(text), tokenize(text, lex), Extraction()

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("end", "", 0, 0)

    def text(self, i: int) -> str:
        t = self.at(i)
        return t.text if t.kind in ("id", "op") else ""

    def is_id(self, i: int) -> bool:
        return self.at(i).kind == "id"

    def symbol(self, i: int, kind: str) -> None:
        t = self.at(i)
        self.out.symbols.append({"name": t.text, "kind": kind, "span": self.source.span(t.start, t.end)})

    def imported(self, specifier: str, first: int, last: int) -> None:
        self.out.imports.append({"specifier": specifier, "span": self.source.span(self.at(first).start, self.at(last).end)})

    def closing(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        depth = 0
        for k in range(i, len(self.tokens)):
            t = self.tokens[k]
            if t.kind == "op":
                depth += (t.text in _OPEN) - (t.text in _CLOSE)
                if depth == 0:
                    return k
        return len(self.tokens)

    def angle_end(self, i: int) -> int:
        """Behind the type parameters that may open at i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for k in range(i, len(self.tokens)):
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            if depth == 0:
                return k + 1
        return i

    def find(self, i: int, *texts: str) -> int:
        """The next of these operators on the same bracket level."""
        k = i
        while k < len(self.tokens):
            s = self.text(k)
            if s in texts:
                return k
            if s in _CLOSE:
                return k
            k = self.closing(k) + 1 if s in _OPEN else k + 1
        return k

    def dotted(self, i: int, sep: str = ".") -> tuple[str, int]:
        """A name with separators from i on, and the place behind it."""
        parts, k = [self.at(i).text], i + 1
        while self.text(k) == sep and self.is_id(k + 1):
            parts.append(self.at(k + 1).text)
            k += 2
        return sep.join(parts), k


class Blocks:
    """What each open brace belongs to: a kind and what its owner set."""

    def __init__(self):
        self.stack: list[tuple[str, object]] = []
        self.pending: tuple[str, object] | None = None

    def step(self, text: str) -> None:
        if text == "{":
            self.stack.append(self.pending or ("block", None))
            self.pending = None
        elif text == "}" and self.stack:
            self.stack.pop()

    @property
    def kind(self) -> str:
        return self.stack[-1][0] if self.stack else "top"


# Go


def go(text: str) -> Extraction:
    r = Reader(text, Lexicon(strings=(('"', '"', True), ("`", "`", False), ("'", "'", True))))
    depth, i = 0, 0
    kinds = {"struct": "Struct", "interface": "Interface"}
    while i < len(r.tokens):
        s = r.text(i)
        if s == "import":
            last = r.closing(i + 1) if r.text(i + 1) == "(" else next((k for k in range(i + 1, i + 4) if r.at(k).kind == "str"), i)
            for k in range(i + 1, last + 1):
                if r.at(k).kind == "str":
                    r.imported(r.at(k).text, k, k)
            i = last
        elif s == "func" and r.text(i + 1) == "(" and r.is_id(j := r.closing(i + 1) + 1) and r.text(j + 1) in ("(", "["):
            r.symbol(j, "Method")
        elif s == "func" and r.is_id(i + 1):
            r.symbol(i + 1, "Function")
        elif s == "type":
            grouped = r.text(i + 1) == "("
            k, end = (i + 2, r.closing(i + 1)) if grouped else (i + 1, i + 2)
            while k < end and r.is_id(k):
                body = k + 1
                if r.text(body) == "[" and r.is_id(body + 1) and r.is_id(body + 2):  # type parameters
                    body = r.closing(body) + 1
                if r.text(body) == "=":
                    body += 1
                else:
                    r.symbol(k, kinds.get(r.text(body), "Other"))
                if not grouped:
                    break
                row = r.source.span(r.at(k).start, r.at(k).end)["start_row"]
                k = body
                while k < end and r.source.span(r.at(k).start, r.at(k).end)["start_row"] == row:
                    k = r.closing(k) + 1 if r.text(k) in _OPEN else k + 1
        depth += (s == "{") - (s == "}")
        i += 1
    return r.out


# Java and C#: members are what stands between `;`, `{` and `}` of a type's body.

_CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "try", "do", "synchronized", "lock", "using", "foreach", "when", "base", "this", "super", "assert"}


def _members(text: str, lex: Lexicon, types: dict[str, str], head) -> Extraction:
    r, blocks, start, i = Reader(text, lex), Blocks(), 0, 0
    while i < len(r.tokens):
        s = r.text(i)
        skip = head(r, i, blocks)
        if skip:
            i = start = skip
            continue
        if s in types and r.is_id(i + 1) and r.text(i - 1) not in (".", "::") and blocks.kind != "method":
            name = i + 2 if r.text(i + 1) in ("struct", "class") and r.is_id(i + 2) else i + 1
            r.symbol(name, types[s])
            end = r.find(name + 1, "{", ";")
            if r.text(end) == "{":
                blocks.pending = ("type", s)
            i = end
            continue
        if s == "(" and blocks.kind == "type":
            name, close = i - 1, r.closing(i)
            if r.text(name) == ">":  # type parameters stand before the list
                while name > start and r.text(name) != "<":
                    name -= 1
                name -= 1
            if r.text(name - 1) == "@":
                i = close + 1
                continue
            body = r.find(close + 1, "{", ";", "=>", "=", ",")
            plain = not any(r.text(k) in ("=", "=>") for k in range(start, i))
            if r.is_id(name) and r.text(name) not in _CONTROL and plain and r.text(body) in ("{", ";", "=>") and r.text(name - 1) != "~":
                r.symbol(name, "Method")
                if r.text(body) == "{":
                    blocks.pending = ("method", None)
                elif r.text(body) == "=>":
                    body = r.find(body, ";")
                i = body
                continue
            i = close + 1
            continue
        if s == "{" and blocks.pending is None and blocks.kind == "type":
            blocks.pending = ("method", None)  # initializers, properties
        blocks.step(s)
        if s in ("{", "}", ";"):
            start = i + 1
        i += 1
    return r.out


def java(text: str) -> Extraction:
    def head(r: Reader, i: int, blocks: Blocks) -> int:
        if r.text(i) == "import" and not blocks.stack:
            first = i + 2 if r.text(i + 1) == "static" else i + 1
            name, k = r.dotted(first)
            if r.text(k) == "." and r.text(k + 1) == "*":
                name, k = name + ".*", k + 2
            r.imported(name, i, k)
            return k + 1
        return 0

    lex = Lexicon(strings=(('"""', '"""', True), ('"', '"', True), ("'", "'", True)))
    return _members(text, lex, {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Struct"}, head)


def csharp(text: str) -> Extraction:
    def head(r: Reader, i: int, blocks: Blocks) -> int:
        if r.text(i) == "using" and r.text(i + 1) != "(" and blocks.kind in ("top", "block"):
            first = i + 2 if r.text(i + 1) in ("static", "unsafe") else i + 1
            name, k = r.dotted(first)
            end = r.find(k, ";")
            if r.text(k) in (";", "="):  # an alias stands for itself
                r.imported(name, i, end)
                return end + 1
        return 0

    lex = Lexicon(line_comments=("//", "#"), strings=(('"""', '"""', False), (r'(?:\$@|@\$|@)"', '"', False), (r'\$?"', '"', True), ("'", "'", True)))
    return _members(text, lex, {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Struct", "struct": "Struct"}, head)


# TypeScript and JavaScript


def typescript(text: str) -> Extraction:
    r = Reader(text, Lexicon(strings=(('"', '"', True), ("'", "'", True), ("`", "`", True)), regexes=True))
    blocks, i = Blocks(), 0
    plain = {"interface": "Interface", "enum": "Enum"}
    while i < len(r.tokens):
        s, before = r.text(i), r.text(i - 1)
        member = before in (".", "?.")
        if s in ("import", "require") and r.text(i + 1) == "(" and not member and r.at(i + 2).kind == "str" and r.at(i + 2).quote != "`" and r.at(i + 2).text:
            r.imported(r.at(i + 2).text, i + 2, i + 2)
        elif s in ("import", "export") and not member and blocks.kind in ("top", "block") and r.text(i + 1) not in (".", "("):
            k = i + 1
            if r.at(k).kind != "str":
                if r.text(k) == "type" and (r.is_id(k + 1) or r.text(k + 1) in ("{", "*")) and r.text(k + 2) != "=":
                    k += 1
                while r.is_id(k) and r.text(k) not in ("from", "function", "class", "const", "let", "var", "default", "async", "abstract", "interface", "enum", "type", "declare", "namespace") or r.text(k) in ("*", ",", "as"):
                    k += 1
                if r.text(k) == "{":
                    k = r.closing(k) + 1
                k = k + 1 if r.text(k) == "from" else -1
            if k > 0 and r.at(k).kind == "str" and r.at(k).text:
                r.imported(r.at(k).text, k, k)
                i = k
        elif s == "function" and not member:
            name = i + 2 if r.text(i + 1) == "*" else i + 1
            declared = before in ("", ";", "{", "}", "export", "default", "async", "declare", ")")
            if r.is_id(name) and declared:
                r.symbol(name, "Function")
            blocks.pending = ("body", None)
        elif s == "class" and not member:
            if r.is_id(i + 1) and r.text(i + 1) not in ("extends", "implements") and before not in ("=", "(", ",", "return", ":", "?"):
                r.symbol(i + 1, "Class")
            blocks.pending = ("class", None)
        elif s in plain and r.is_id(i + 1) and not member and blocks.kind != "class" and before in ("", ";", "{", "}", "export", "declare", "const", "default", ")", "]", "\n"):
            r.symbol(i + 1, plain[s])
            blocks.pending = ("shape", None)
        elif s == "type" and r.is_id(i + 1) and r.text(r.angle_end(i + 2)) == "=" and not member and blocks.kind != "class":
            r.symbol(i + 1, "Other")
        elif s == "(" and blocks.kind == "class":
            name = i - 1
            if r.text(name) == ">":
                while name > 0 and r.text(name) != "<":
                    name -= 1
                name -= 1
            close = r.closing(i)
            body = r.find(close + 1, "{", ";", "=", ",", "=>")
            while r.text(body) == "{" and r.text(body - 1) in (":", "|", "&", "<"):  # an object type
                body = r.find(r.closing(body) + 1, "{", ";", "=", ",", "=>")
            if (r.is_id(name) or r.at(name).kind in ("str", "num")) and r.text(name - 1) not in (".", "=", "new", "@") and r.text(body) == "{":
                r.symbol(name, "Method")
                blocks.pending = ("body", None)
                i = body
                continue
            i = close + 1
            continue
        blocks.step(r.text(i))
        i += 1
    return r.out


# Rust


def rust(text: str) -> Extraction:
    lex = Lexicon(nested_comments=True, strings=((r'b?r(#*)"', r'"\1', False), ('b?"', '"', True)), lifetimes=True)
    r, blocks, seen, i = Reader(text, lex), Blocks(), set(), 0
    kinds = {"struct": "Struct", "union": "Struct", "enum": "Enum", "type": "Other", "const": "Constant", "static": "Constant"}

    def crate(name: str, first: int, last: int) -> None:
        if name not in ("crate", "self", "super", "Self", "") and name not in seen:
            seen.add(name)
            r.imported(f"use:{name}", first, last)

    def caller() -> int | None:
        return next((owner for kind, owner in reversed(blocks.stack) if kind == "fn"), None)

    while i < len(r.tokens):
        s, before = r.text(i), r.text(i - 1)
        if s == "fn" and r.is_id(i + 1):
            body = r.find(r.angle_end(i + 2), "{", ";")
            if r.text(body) == "{":
                owner = next((k for k, _ in reversed(blocks.stack) if k in ("fn", "impl", "mod")), "mod")
                r.symbol(i + 1, "Method" if owner == "impl" else "Function")
                index = len(r.out.symbols) - 1
                _rust_paths(r, i + 2, body, crate)
                blocks.pending, i = ("fn", index), body
                continue
        elif s in ("impl", "trait") and before not in ("->", ":", "&", "(", "<", ",", "=", "+") and (s == "trait" or r.text(i + 1) != "("):
            if s == "trait" and r.is_id(i + 1):
                r.symbol(i + 1, "Interface")
            body = r.find(r.angle_end(i + 1), "{", ";")
            if r.text(body) == "{":
                _rust_paths(r, i + 1, body, crate)
                blocks.pending, i = ("impl", None), body
                continue
        elif s == "mod" and r.is_id(i + 1) and r.text(i + 2) in (";", "{"):
            r.symbol(i + 1, "Module")
            if r.text(i + 2) == ";":
                r.imported(r.at(i + 1).text, i + 1, i + 1)
            else:
                blocks.pending = ("mod", None)
            i += 2
            continue
        elif s == "use" and before not in (".", "::"):
            end = r.find(i + 1, ";")
            first = i + 2 if r.text(i + 1) == "::" else i + 1
            if r.is_id(first):
                crate(r.text(first), i, end)
            i = end
            continue
        elif s == "extern" and r.text(i + 1) == "crate" and r.is_id(i + 2):
            crate(r.text(i + 2), i, r.find(i + 2, ";"))
            i = r.find(i + 2, ";")
            continue
        elif s in kinds and r.is_id(i + 1) and before not in (".", "*", "'") and not (s == "union" and not r.is_id(i + 1)):
            name = i + 2 if r.text(i + 1) == "mut" else i + 1
            if r.text(name) not in ("fn", "unsafe", "_") and (s not in ("const", "static") or r.text(name + 1) == ":"):
                r.symbol(name, kinds[s])
                i = name + 1
                continue
        elif r.is_id(i) and before not in ("::", ".") and r.text(i + 1) == "::" and s[:1].islower() and s.isidentifier():
            crate(s, i, i)
        elif r.is_id(i) and r.text(i + 1) == "(" and before not in (".", "::", "fn", "!", "struct", "enum", "#") and s not in ("if", "while", "match", "for", "in", "return", "loop", "move", "as", "let", "else", "impl", "Fn", "FnMut", "FnOnce", "pub"):
            owner = caller()
            if owner is not None:
                close = min(r.closing(i + 1), len(r.tokens) - 1)
                r.out.calls.append({"caller": owner, "callee": s, "span": r.source.span(r.at(i).start, r.at(close).end)})
        blocks.step(s)
        i += 1
    return r.out


def _rust_paths(r: Reader, first: int, last: int, crate) -> None:
    """Crate roots in a signature."""
    for k in range(first, last):
        s = r.text(k)
        if r.is_id(k) and r.text(k + 1) == "::" and r.text(k - 1) not in ("::", ".") and s[:1].islower():
            crate(s, k, k)


# Kotlin


def kotlin(text: str) -> Extraction:
    r = Reader(text, Lexicon(nested_comments=True, strings=(('"""', '"""', False), ('"', '"', True), ("'", "'", True))))
    blocks, i = Blocks(), 0
    while i < len(r.tokens):
        s, before = r.text(i), r.text(i - 1)
        if s == "import" and not blocks.stack and r.is_id(i + 1):
            name, k = r.dotted(i + 1)
            if r.text(k) == "." and r.text(k + 1) == "*":
                name, k = name + ".*", k + 2
            r.imported(name, i, k - 1)
            i = k
            continue
        if s in ("class", "interface", "object") and before not in (".", "::", "?.") and r.is_id(i + 1):
            words = {r.text(k) for k in range(max(0, i - 3), i + 1)}
            back = i
            while back > 0 and r.is_id(back - 1) and r.text(back - 1) in ("enum", "data", "sealed", "open", "abstract", "inner", "value", "annotation", "fun", "private", "public", "internal", "companion"):
                back -= 1
            words = {r.text(k) for k in range(back, i + 1)}
            r.symbol(i + 1, "Class" if s == "object" else "Interface" if "interface" in words else "Enum" if "enum" in words else "Class")
            k = r.angle_end(i + 2)
            while r.text(k) in ("(", "private", "internal", "constructor", "@"):
                k = r.closing(k) + 1 if r.text(k) == "(" else k + 1
            if r.text(k) == ":":  # supertypes up to the body, if one follows
                k += 1
                while r.is_id(k) or r.text(k) in (".", ",", "<", "("):
                    if r.text(k) in ("class", "interface", "object", "fun", "val", "var", "import", "enum", "data"):
                        break
                    k = r.closing(k) + 1 if r.text(k) == "(" else r.angle_end(k) if r.text(k) == "<" else k + 1
            if r.text(k) == "{":
                blocks.pending, i = ("class", None), k
                continue
        elif s == "object" and r.text(i + 1) in ("{", ":"):
            blocks.pending = ("class", None) if before == "companion" else None
        elif s == "fun" and before not in (".", "::"):
            k = r.angle_end(i + 1)
            if r.is_id(k):
                name = k
                k = r.angle_end(k + 1)
                while r.text(k) in (".", "?", "?.") or r.is_id(k) and r.text(k - 1) in (".", "?."):
                    name = k if r.is_id(k) else name
                    k = r.angle_end(k + 1)
                if r.text(k) == "(":
                    r.symbol(name, "Method" if next((b for b, _ in reversed(blocks.stack) if b in ("class", "fun")), "") == "class" else "Function")
                    k = r.closing(k) + 1
                    while r.text(k) in (":", ".", "?", ",", "<", "(") or r.is_id(k) and r.text(k - 1) in (":", ".", ","):
                        k = r.angle_end(k) if r.text(k) == "<" else r.closing(k) + 1 if r.text(k) == "(" else k + 1
                    if r.text(k) == "{":
                        blocks.pending, i = ("fun", None), k
                        continue
        blocks.step(s)
        i += 1
    return r.out


# PHP


def php(text: str) -> Extraction:
    opened = text.find("<?")
    blank = text if opened < 0 else re.sub(r"[^\n]", " ", text[:opened]) + text[opened:]
    r = Reader(blank, Lexicon(line_comments=("//", "#"), strings=(('"', '"', True), ("'", "'", True), (r"<<<[\"']?(\w+)[\"']?\n", r"\1", False))))
    blocks, i = Blocks(), 0
    types = {"class": "Class", "trait": "Class", "interface": "Interface", "enum": "Enum"}
    includes = ("require", "require_once", "include", "include_once")
    while i < len(r.tokens):
        s, before = r.text(i), r.text(i - 1)
        if s in includes and r.at(i + 1).kind == "str" and r.at(i + 1).quote == "'" and r.text(i + 2) != ".":
            r.imported(r.at(i + 1).text, i, i + 1)
        elif s in types and r.is_id(i + 1) and before not in ("->", "::", "new", "$") and r.text(i + 1) not in ("extends", "implements"):
            r.symbol(i + 1, types[s])
            blocks.pending = ("class", None)
        elif s == "class" and before == "new":
            blocks.pending = ("class", None)
        elif s == "function" and r.is_id(j := i + 2 if r.text(i + 1) == "&" else i + 1) and r.text(j + 1) == "(":
            r.symbol(j, "Method" if blocks.kind == "class" else "Function")
            body = r.find(r.closing(j + 1) + 1, "{", ";")
            if r.text(body) == "{":
                blocks.pending, i = ("body", None), body
                continue
        blocks.step(s)
        i += 1
    return r.out


# C


def c(text: str) -> Extraction:
    includes = [(m.start(), m.end(), m[1]) for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*"([^"\n]*)"', text, re.M)]
    blank = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.M)
    r, depth, start, i = Reader(blank, Lexicon()), 0, 0, 0
    for a, b, name in includes:
        r.out.imports.append({"specifier": name, "span": r.source.span(a, b)})
    while i < len(r.tokens):
        s = r.text(i)
        if s in ("struct", "union", "enum") and r.is_id(i + 1):
            body = r.find(i + 2, "{", ";", "=", ",") if r.text(i + 2) == ":" else i + 2
            if r.text(body) == "{":
                r.symbol(i + 1, "Enum" if s == "enum" else "Struct")
        elif s == "{" and depth == 0 and start < i:
            close = i - 1
            if r.text(close) == ")" and not any(r.text(k) == "=" for k in range(start, i)):
                name = _declarator(r, start, i)
                if name is not None and r.text(name) not in ("if", "while", "for", "switch"):
                    r.symbol(name, "Function")
        depth = max(0, depth + (s == "{") - (s == "}"))
        if depth == 0 and s in (";", "}"):
            start = i + 1
        i += 1
    return r.out


def _declarator(r: Reader, start: int, end: int) -> int | None:
    """The name before the first parameter list; `(*name(...))(...)` looks inside."""
    for k in range(start, end):
        if r.text(k) == "(":
            if r.is_id(k - 1) and k - 1 >= start and r.text(k + 1) != "*" and r.text(k - 1) not in ("__attribute__", "__declspec"):
                return k - 1
            inner = _declarator(r, k + 1, r.closing(k))
            if inner is not None:
                return inner
    return None


def _line(pattern: str):
    compiled = re.compile(pattern, re.M)

    def find(text: str) -> str | None:
        m = compiled.search(text)
        return m[1].strip() if m else None

    return find


register(LanguageSpec("go", ("go",), go))
register(LanguageSpec("java", ("java",), java, package=_line(r"^[ \t]*package ([^;\n]*)")))
register(LanguageSpec("csharp", ("cs",), csharp, package=_line(r"^[ \t]*namespace ([\w.]+)")))
register(LanguageSpec("typescript", ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs"), typescript, ("node",)))
register(LanguageSpec("rust", ("rs",), rust))
register(LanguageSpec("kotlin", ("kt", "kts"), kotlin, package=_line(r"^[ \t]*package (.*)$")))
register(LanguageSpec("php", ("php",), php, ("php",)))
register(LanguageSpec("c", ("c", "h"), c))
