"""Project files that name modules: go.mod, Cargo.toml, tsconfig.json. Read once a repository, on the driver."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterable

Read = Callable[[str], str | None]


def _clean(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def go_prefixes(read: Read) -> list[tuple[str, str, int]]:
    """(prefix, folder, priority): the module, then its local replacements in order."""
    text = read("go.mod") or ""
    text = re.sub(r"//.*", "", text)
    out = []
    if m := re.search(r"^\s*module\s+\"?([^\s\"]+)", text, re.M):
        out.append((m[1], ""))
    block = re.compile(r"^\s*replace\s*\((.*?)\)", re.S | re.M)
    lines = [line for b in block.findall(text) for line in b.splitlines()]
    lines += [line.strip().removeprefix("replace") for line in block.sub("", text).splitlines() if re.match(r"\s*replace\s", line)]
    for line in lines:
        old, arrow, new = line.partition("=>")
        if arrow and old.split() and new.split() and new.split()[0].startswith("."):
            out.append((old.split()[0], _clean(new.split()[0])))
    return [(prefix, folder, i) for i, (prefix, folder) in enumerate(out)]


def crate_libs(read: Read, paths: Iterable[str]) -> list[tuple[str, str]]:
    """(crate, library file) of a workspace's members and its root package, where the file is mapped.

    paths: the repository's files, for members that end in `/*`."""
    known = set(paths)
    folders = sorted({p.rsplit("/", 1)[0] for p in known if "/" in p} | {"/".join(p.split("/")[:i]) for p in known for i in range(1, p.count("/") + 1)})

    def parse(path: str) -> dict:
        try:
            return tomllib.loads(read(path) or "")
        except tomllib.TOMLDecodeError:
            return {}

    root = parse("Cargo.toml")
    members = [""] if "package" in root else []
    for member in root.get("workspace", {}).get("members", []):
        member = member.rstrip("/")
        if member.endswith("/*"):
            base = _clean(member[:-2])
            members += [f for f in folders if f.rpartition("/")[0] == base]
        else:
            members.append(_clean(member))
    out = []
    for folder in members:
        at = f"{folder}/" if folder else ""
        manifest = parse(f"{at}Cargo.toml")
        name, lib = manifest.get("package", {}).get("name"), manifest.get("lib", {})
        if name:
            path = _clean(at + lib.get("path", "src/lib.rs"))
            if path in known:
                out.append((str(lib.get("name", name)).replace("-", "_"), path))
    return out


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    pattern = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    text = pattern.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.S)


def ts_aliases(read: Read, folders: Iterable[str]) -> list[tuple[str, str, str, bool, str, int]]:
    """(folder, prefix, suffix, has a star, target, priority) for each folder, from its nearest tsconfig.json that
    parses and has paths."""
    found: dict[str, list | None] = {}

    def own(folder: str) -> list | None:
        if folder not in found:
            text = read(f"{folder}/tsconfig.json" if folder else "tsconfig.json")
            try:
                options = json.loads(strip_jsonc(text or "")).get("compilerOptions", {})
                aliases = options.get("paths") or {}
            except (ValueError, AttributeError):
                aliases, options = {}, {}
            base = _clean(f"{folder}/{options.get('baseUrl', '.')}")
            found[folder] = [(key, _clean(f"{base}/{t}")) for key, targets in aliases.items() for t in targets] or None
        return found[folder]

    out = []
    for folder in folders:
        at = folder
        while own(at) is None and at:
            at = at.rpartition("/")[0]
        for i, (key, target) in enumerate(own(at) or []):
            prefix, star, suffix = key.partition("*")
            out.append((folder, prefix, suffix, bool(star), target, i))
    return out
