"""Ruby, by tokens of each line and a stack of what `end` closes."""

from __future__ import annotations

import re

from trellis.lang.base import Extraction, LanguageSpec, Lexicon, Source, register, tokenize

_LEX = Lexicon(line_comments=("#",), strings=(('"', '"', True), ("'", "'", True), ("`", "`", True)))
_OPENERS = ("if", "unless", "while", "until", "case", "begin", "for")


def ruby(text: str) -> Extraction:
    text = re.sub(r"^=begin\b.*?^=end\b", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)
    source, out, stack = Source(text), Extraction(), []
    tokens = tokenize(text, _LEX)
    row_of = lambda t: source.span(t.start, t.end)["start_row"]
    rows = [row_of(t) for t in tokens]
    loops: set[int] = set()
    skip = -1
    for i, t in enumerate(tokens):
        if i <= skip or t.kind != "id":
            continue
        before = tokens[i - 1] if i and rows[i - 1] == rows[i] else None
        if before and before.text in (".", ":", "::", "&.", "@", "$"):
            continue
        follow = tokens[i + 1] if i + 1 < len(tokens) else None
        if follow and follow.text == ":" and follow.start == t.end:
            continue
        first = before is None or before.text in (";", "=", "(", "[", "|", "{", "do", "then", "else", "&&", "||", "return", "private", "protected", "public", "module_function", "<")
        if t.text in ("class", "module") and before is None:
            if t.text == "class" and follow and follow.text == "<":
                stack.append("other")  # class << self
                continue
            j = i + 1
            while j + 3 < len(tokens) and tokens[j + 1].text in ("::",):
                j += 2
            if j < len(tokens) and tokens[j].kind == "id":
                out.symbols.append({"name": tokens[j].text, "kind": "Class" if t.text == "class" else "Module", "span": source.span(tokens[j].start, tokens[j].end)})
                stack.append("class")
                skip = j
        elif t.text == "def" and first:
            j, own = i + 1, False
            if j + 2 < len(tokens) and tokens[j].kind == "id" and tokens[j + 1].text == "." and tokens[j + 2].kind == "id":
                j, own = j + 2, True
            if j < len(tokens):
                end = tokens[j].end
                if end < len(text) and text[end] in "?!" or end + 1 < len(text) and text[end] == "=" and text[end + 1] in "( ":
                    end += text[end] in "?!" or text[end + 1] == "("
                inner = next((s for s in reversed(stack) if s in ("class", "def")), "") == "class"
                out.symbols.append({"name": text[tokens[j].start : end], "kind": "Method" if own or inner else "Function", "span": source.span(tokens[j].start, end)})
                rest = [k for k in range(j + 1, min(len(tokens), j + 60)) if rows[k] == rows[j]]
                endless, depth = False, 0
                for k in rest:
                    depth += (tokens[k].text == "(") - (tokens[k].text == ")")
                    endless = endless or depth == 0 and tokens[k].text == "=" and tokens[k].start > end
                if not endless:
                    stack.append("def")
                skip = j
        elif t.text in _OPENERS and first:
            stack.append("other")
            if t.text in ("while", "until", "for"):
                loops.add(rows[i])
        elif t.text == "do" and rows[i] not in loops:
            stack.append("other")
        elif t.text == "end" and stack:
            stack.pop()
        elif t.text == "require_relative":
            arg = next((x for x in tokens[i + 1 : i + 3] if x.kind == "str"), None)
            if arg is not None and (tokens[i + 1] is arg or tokens[i + 1].text == "("):
                out.imports.append({"specifier": arg.text, "span": source.span(t.start, arg.end)})
    return out


register(LanguageSpec("ruby", ("rb",), ruby, ("ruby",)))
