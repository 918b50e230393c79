"""Plain Python versions of the contracts, one text at a time."""

from __future__ import annotations

import hashlib
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple:
    ws = WORDS.findall(low(text))
    hit, owners = set(), set()
    for item, body in items:
        own = WORDS.findall(low(body))
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for p in range(len(ws) - size + 1):
            if tuple(ws[p : p + size]) in wanted:
                hit.update(range(p, p + size))
                owners.add(item)
    return len(ws), len(hit), len(owners), sha(",".join(sorted(map(str, owners)))), bool(hit)


def license_places(text: str | None) -> tuple:
    ws = WORDS.findall(low(text))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        starts += found
        if found:
            labels.add(label)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def quality(text: str | None) -> tuple:
    text = text or ""
    ws = TOKENS.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if TOKENS.search(line):
            dup += line in seen
            seen.add(line)
    count: dict[tuple, int] = {}
    for i in range(len(ws) - 2):
        count[tuple(ws[i : i + 3])] = count.get(tuple(ws[i : i + 3]), 0) + 1
    repeat = set()
    for i in range(len(ws) - 2):
        if count[tuple(ws[i : i + 3])] > 1:
            repeat.update((i, i + 1, i + 2))
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def shingle_set(text: str | None, width: int) -> frozenset:
    ws = TOKENS.findall(low(text))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)])


def groups(rows: list[tuple[int, str | None]], width: int = 2, threshold: int = 80) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            p, q = sets[a], sets[b]
            if p and q and 100 * min(len(p), len(q)) >= threshold * max(len(p), len(q)):
                common = len(p & q)
                if 100 * common >= threshold * (len(p) + len(q) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text: str | None) -> tuple:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    counts, spans = [], []
    for kind, pattern, fits in kinds:
        found = [m.span() for m in re.finditer(pattern, text) if fits(m)]
        counts.append(len(found))
        spans += [f"{kind}:{a}:{b}" for a, b in found]
    return (*counts, sha(",".join(spans)))


def judge(url: str | None) -> tuple:
    rest = url.partition("://")[2] if url and "://" in url else None
    if rest is None:
        host, path = "", ""
    else:
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = low(host)
    best = None
    for rule, verdict in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def warc_rows(pages: list[tuple[int, str | None]]) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for page, html in sorted(pages):
        first.setdefault((html or "").encode(), page)
    out = {}
    for page, html in pages:
        body = (html or "").encode()
        origin = first[body] if len(body) >= 100 and first[body] != page else None
        out[page] = (len(body), hashlib.sha256(body).hexdigest(), "response" if origin is None else "revisit", origin)
    return out


def line_runs(rows: list[tuple[int, str | None]], min_words: int) -> dict[int, set[int]]:
    """Removed lines, by comparing every pair of places: each maximal run that begins at an earlier place too."""
    lines = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        own = [(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate((t or "").split("\n"))]
        lines.append((d, [(i, x, len(TOKENS.findall(x))) for i, x in own if x]))
    starts: dict[str, list[tuple[int, int]]] = {}
    for k, (_, own) in enumerate(lines):
        for p, (_, x, _) in enumerate(own):
            starts.setdefault(x, []).append((k, p))
    gone: dict[int, set[int]] = {d: set() for d, _ in lines}
    for k, (d, own) in enumerate(lines):
        for p, (_, x, _) in enumerate(own):
            for k2, p2 in starts[x]:
                if (k2, p2) >= (k, p):
                    continue
                other, n = lines[k2][1], 0
                while p + n < len(own) and p2 + n < len(other) and own[p + n][1] == other[p2 + n][1]:
                    n += 1
                if sum(w for *_, w in own[p : p + n]) >= min_words:
                    a, b = own[p][0], own[p + n - 1][0]
                    gone[d].update(range(a, b + 1))
    return gone


def base_scores(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    import math
    import zlib
    from collections import Counter

    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*TOKENS.findall(low(t)), None] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if not out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (out(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens.items()}


def ranks(pages: list[tuple[int, str, str]], good: set[str], bad: set[str], damping: float = 0.85) -> tuple[dict, dict]:
    """Personalised PageRank of hosts and of the reversed links, by dense matrices until nothing changes."""
    import numpy as np

    links: dict[tuple[str, str], int] = {}
    named = [(judge(url)[0], html) for _, url, html in pages]
    for host, html in named:
        for target in re.findall(r"//([^/?#\"'\s>]+)", html):
            if target != host:
                links[host, target] = links.get((host, target), 0) + 1
    up = set()
    for host, _ in named:
        parts = host.split(".")
        for k in range(len(parts) - 2):
            up.add((".".join(parts[k:]), ".".join(parts[k + 1 :])))
    for a, b in up | {(b, a) for a, b in up}:
        links[a, b] = links.get((a, b), 0) + 1
    hosts = sorted({h for x in links for h in x} | {h for h, _ in named})
    at = {h: i for i, h in enumerate(hosts)}
    out = []
    for way, seeds in ((0, good), (1, bad)):
        m = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in links.items():
            m[(at[b], at[a]) if way == 0 else (at[a], at[b])] = n
        sums = m.sum(0)
        m = m / np.where(sums, sums, 1)
        start = np.array([float(any(h == s or h.endswith("." + s) for s in seeds) and h in {x for x, _ in named}) for h in hosts])
        start /= start.sum()
        rank = start * (1 - damping)
        for _ in range(400):
            rank = damping * (m @ rank) + (1 - damping) * start
        out.append(dict(zip(hosts, rank.tolist(), strict=True)))
    return out[0], out[1]
