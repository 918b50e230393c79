"""The plug-in point of a language, and tokens with byte positions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguageSpec:
    """extract: source text -> Extraction. shebangs are parts of a first line that starts with #!."""

    name: str
    extensions: tuple[str, ...]
    extract: Callable[[str], "Extraction"]
    shebangs: tuple[str, ...] = ()
    package: Callable[[str], str | None] = lambda text: None


@dataclass
class Extraction:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)


#: In the order in which they were registered; the first that owns an extension wins.
LANGUAGES: dict[str, LanguageSpec] = {}
EXTENSIONS: dict[str, str] = {}


def register(spec: LanguageSpec) -> LanguageSpec:
    LANGUAGES[spec.name] = spec
    for extension in spec.extensions:
        EXTENSIONS.setdefault(extension, spec.name)
    return spec


def detect(path: str, first_line: str | None = None) -> str | None:
    """By extension, case-sensitively; else by a shebang, if a first line is given."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    if dot and stem and extension in EXTENSIONS:
        return EXTENSIONS[extension]
    if first_line and first_line.startswith("#!"):
        return next((s.name for s in LANGUAGES.values() if any(x in first_line for x in s.shebangs)), None)
    return None


class Source:
    """Turns character places into spans of UTF-8 bytes."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()

    def _bytes(self, a: int, b: int) -> int:
        return b - a if self.ascii else len(self.text[a:b].encode("utf-8", "surrogatepass"))

    def span(self, start: int, end: int) -> dict:
        row = bisect_right(self.lines, start) - 1
        first = self._bytes(0, start)
        return {"start_byte": first, "end_byte": first + self._bytes(start, end), "start_row": row, "start_col": self._bytes(self.lines[row], start)}


@dataclass(frozen=True)
class Token:
    """kind: id, str, num or op. For strings, text is what stands between the quotes and quote is what opens it."""

    kind: str
    text: str
    start: int
    end: int
    quote: str = ""


@dataclass(frozen=True)
class Lexicon:
    """What a language takes for comments and strings. strings: (opening pattern, closing pattern, escapes)."""

    line_comments: tuple[str, ...] = ("//",)
    nested_comments: bool = False
    strings: tuple[tuple[str, str, bool], ...] = (('"', '"', True), ("'", "'", True))
    lifetimes: bool = False
    regexes: bool = False


_ID = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_NUM = re.compile(r"\d[\w.]*")
_BLANK = re.compile(r"\s+")
_CHAR = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def tokenize(text: str, lex: Lexicon) -> list[Token]:
    out: list[Token] = []
    openers = [(re.compile(a), b, escapes) for a, b, escapes in lex.strings]
    at, n = 0, len(text)
    while at < n:
        if m := _BLANK.match(text, at):
            at = m.end()
        elif any(text.startswith(c, at) for c in lex.line_comments):
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("/*", at):
            at = _skip_comment(text, at, lex.nested_comments)
        elif lex.lifetimes and text[at] == "'":
            m = _CHAR.match(text, at)
            end = m.end() if m else at + 1
            out.append(Token("str" if m else "op", text[at:end], at, end, "'"))
            at = end
        elif found := next(((m, b, e) for a, b, e in openers if (m := a.match(text, at))), None):
            opened, closing, escapes = found
            closing = re.escape(opened.expand(closing))
            body = re.compile(rf"(?:\\.|(?!{closing}).)*" if escapes else rf"(?:(?!{closing}).)*", re.S).match(text, opened.end())
            end = min(n, body.end() + len(opened.expand(found[1])))
            out.append(Token("str", body[0], at, end, opened[0]))
            at = end
        elif lex.regexes and text[at] == "/" and _regex_may_start(out) and (m := _REGEX.match(text, at)):
            at = m.end()
        elif m := _ID.match(text, at):
            out.append(Token("id", m[0], at, m.end()))
            at = m.end()
        elif m := _NUM.match(text, at):
            out.append(Token("num", m[0], at, m.end()))
            at = m.end()
        else:
            size = 2 if text[at : at + 2] in ("::", "=>", "->", "==", "!=", "<=", ">=", "&&", "||", "?.") else 1
            out.append(Token("op", text[at : at + size], at, at + size))
            at += size
    return out


def _skip_comment(text: str, at: int, nested: bool) -> int:
    depth, at = 1, at + 2
    while depth:
        close, more = text.find("*/", at), text.find("/*", at) if nested else -1
        if close < 0:
            return len(text)
        if 0 <= more < close:
            depth, at = depth + 1, more + 2
        else:
            depth, at = depth - 1, close + 2
    return at


def _regex_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.kind == "op" and last.text not in (")", "]", "}") or last.kind == "id" and last.text in ("return", "typeof", "case", "in", "of")
