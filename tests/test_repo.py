"""Small repositories, from files to graph."""

import os

import pytest
from pyspark.sql import functions as F

from trellis.sources import configs, extract, repo, store

REPOS = {
    "go": ({"go.mod": "module ex.com/d\nreplace ex.com/r => ./vendor/r\n", "main.go": 'package main\nimport "ex.com/d/util"\nimport "fmt"\nimport "ex.com/r/x"\nimport "ex.com/d/none"\n', "util/util.go": "package util\n", "vendor/r/x/x.go": "package x\n"},
           {("main.go", "util/util.go"), ("main.go", "vendor/r/x/x.go")}, ["ex.com/d/none"]),
    "python": ({"src/app/__init__.py": "", "src/app/main.py": "import os\nimport app.util\nfrom .gone import x\nfrom . import y\n", "src/app/util.py": ""},
               {("src/app/main.py", "src/app/util.py"), ("src/app/main.py", "src/app/__init__.py")}, [".gone"]),
    "java": ({"m1/src/com/x/a/Main.java": "package com.x.a;\nimport com.x.u.Helper;\nimport com.x.u.*;\nimport java.util.List;\n", "m2/src/com/x/u/Helper.java": "package com.x.u;\n"},
             {("m1/src/com/x/a/Main.java", "m2/src/com/x/u/Helper.java")}, []),
    "csharp": ({"src/Co/App/P.cs": "using Co.Util;\nusing System;\nnamespace Co.App { class P {} }\n", "src/Co/Util/H.cs": "namespace Co.Util { class H {} }\n"}, {("src/Co/App/P.cs", "src/Co/Util/H.cs")}, []),
    "typescript": ({"tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "one": ["src/b.ts"],}},}', "src/a.ts": 'import "./b.js";\nimport "@/c";\nimport "one";\nimport "react";\nimport "./gone";\n', "src/b.ts": "", "src/c/index.tsx": ""},
                   {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c/index.tsx")}, []),
    "rust": ({"Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n', "crates/a-b/Cargo.toml": '[package]\nname = "a-b"\n', "crates/a-b/src/lib.rs": "mod x;\nmod gone;\n", "crates/a-b/src/x/mod.rs": "mod y;\n", "crates/a-b/src/x/y.rs": "", "crates/z/Cargo.toml": '[package]\nname = "z"\n', "crates/z/src/lib.rs": "use a_b::t;\nuse std::fmt;\n"},
             {("crates/a-b/src/lib.rs", "crates/a-b/src/x/mod.rs"), ("crates/a-b/src/x/mod.rs", "crates/a-b/src/x/y.rs"), ("crates/z/src/lib.rs", "crates/a-b/src/lib.rs")}, ["gone"]),
    "kotlin": ({"s/com/x/a/M.kt": "package com.x.a\nimport com.x.u.H\nimport com.x.u.*\n", "s/com/x/u/H.kt": "package com.x.u\n"}, {("s/com/x/a/M.kt", "s/com/x/u/H.kt")}, []),
    "ruby": ({"a/main.rb": "require_relative '../util'\nrequire_relative 'gone'\n", "util.rb": ""}, {("a/main.rb", "util.rb")}, ["gone"]),
    "php": ({"index.php": "<?php require_once 'lib/u.php'; include 'gone';", "lib/u.php": "<?php"}, {("index.php", "lib/u.php")}, []),
    "c": ({"src/main.c": '#include "../inc/u.h"\n#include "gone.h"\n', "inc/u.h": ""}, {("src/main.c", "inc/u.h")}, []),
}


def make(root, files):
    for path, text in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)
    return str(root)


def test_all_repositories_resolve(spark, tmp_path):
    for name, (files, edges, broken) in REPOS.items():
        graph, _ = store.index(spark, make(tmp_path / name, files))
        got = {(r["file"], r["target"]) for r in graph.dependency_pairs().collect()}
        assert got == edges, name
        messages = [r["message"] for r in graph.broken_imports().collect()]
        assert [m.split("`")[1] for m in messages] == broken, name
        kinds = {r["confidence"] for r in graph.imports.select("confidence").distinct().collect()}
        assert kinds == ({"Heuristic"} if name in ("java", "csharp") else {"Resolved"}), name


def test_calls(spark, tmp_path):
    """The same file's first definition wins; a name that only one other file defines is a guess; others and calls of oneself drop out."""
    files = {
        "store.rs": "fn open_store() {}\nfn flush() {}\nfn write_all() { open_store(); flush(); write_all(); }\n",
        "cache.rs": "fn flush() {}\nfn evict() { flush(); open_store(); }\n",
        "cli.rs": "fn run() { flush(); write_all(); missing(); }\n",
    }
    graph, _ = store.index(spark, make(tmp_path, files))
    s = graph.symbols.join(graph.files, "file_id").select("symbol_id", F.concat("path", F.lit(":"), "name").alias("n"))
    rows = graph.calls.join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst")
    assert {(r["a"], r["b"], r["confidence"]) for r in rows.collect()} == {
        ("store.rs:write_all", "store.rs:open_store", "Resolved"), ("store.rs:write_all", "store.rs:flush", "Resolved"),
        ("cache.rs:evict", "cache.rs:flush", "Resolved"), ("cache.rs:evict", "store.rs:open_store", "Heuristic"), ("cli.rs:run", "store.rs:write_all", "Heuristic"),
    }


def test_roots_in_order(spark, tmp_path):
    """Of modules below several roots the least root's wins, a file before a package; folders count for all roots."""
    files = {
        "a/lib/__init__.py": "", "a/lib/x.py": "", "b/lib/__init__.py": "", "b/lib/x.py": "", "b/lib/y/__init__.py": "", "b/lib/y.py": "", "main.py": "import lib.x\nimport lib.y\nimport lib\nimport a.lib.x\n",
        "one/src/com/q/A.java": "package com.q;\n", "two/src/com/q/B.java": "package com.q;\nimport com.q.*;\nimport com.q.A;\n",
    }
    graph, _ = store.index(spark, make(tmp_path, files))
    got = {(r["file"], r["target"]) for r in graph.dependency_pairs().collect()}
    assert got == {("main.py", "a/lib/x.py"), ("main.py", "b/lib/y.py"), ("main.py", "a/lib/__init__.py"), ("two/src/com/q/B.java", "one/src/com/q/A.java")}


def test_incremental(spark, tmp_path):
    root = make(tmp_path / "r", {"a.py": "import b\n", "b.py": "def f(): pass\n", "c.py": ""})
    _, first = store.index(spark, root)
    poisoned = first.withColumn("language", F.when(F.col("path") == "b.py", "poison").otherwise(F.col("language")))
    make(root, {"a.py": "import c\n# longer\n", "d.py": ""})
    os.remove(f"{root}/c.py")
    graph, second = store.index(spark, root, poisoned)
    assert {(r["path"], r["language"]) for r in second.collect()} == {("a.py", "python"), ("b.py", "poison"), ("d.py", "python")}
    assert graph.dependency_pairs().count() == 0


def test_store(spark, tmp_path):
    folder = str(tmp_path / ".trellis")
    assert store.load(spark, folder) is None and not store.exists(spark, folder)
    graph, made = store.index(spark, make(tmp_path / "r", REPOS["ruby"][0]))
    store.save(graph, made, folder)
    again = store.load(spark, folder)
    assert again.dependency_pairs().count() == 1 and store.load_extractions(spark, folder).count() == 2
    assert again.listing == graph.listing != ""
    same, _ = store.index(spark, str(tmp_path / "r"), store.load_extractions(spark, folder), again)
    assert same is again  # nothing changed
    make(tmp_path / "r", {"other.txt": "x"})
    assert store.index(spark, str(tmp_path / "r"), made, again)[0] is not again
    remote = f"file://{tmp_path}/as-uri"
    store.save(graph, made, remote)
    assert store.load(spark, remote).dependency_pairs().count() == 1
    with open(f"{folder}/_meta.json", "w") as f:
        f.write('{"version": 0}')
    os.remove(f"{folder}/._meta.json.crc")
    assert store.load(spark, folder) is None
    with open(f"{folder}/_meta.json", "w") as f:
        f.write("broken")
    assert store.load(spark, folder) is None


def test_walk_and_ignore_rules(tmp_path):
    root = make(tmp_path, {".gitignore": "*.log\n/build\n!keep.log\ndocs/**/x.py\n", "a.log": "", "keep.log": "", "build/a.py": "", "s/build/a.py": "", "docs/u/v/x.py": "", ".hidden/a.py": "", "s/.ignore": "b*.py\n", "s/b1.py": "", "s/c.py": ""})
    listed = lambda: [p for p, *_ in repo.list_files(root)]
    assert "a.log" in listed()  # no checkout: only .ignore counts
    os.mkdir(f"{root}/.git")
    assert listed() == ["keep.log", "s/build/a.py", "s/c.py"]


def test_binary_files(spark, tmp_path):
    root = make(tmp_path, {"p/a.py": "import p.b\n", "p/b.py": "x = 1\n"})
    rows = extract.extract(repo.binary_files(spark, f"file://{root}"))
    assert store.build(rows).dependency_pairs().collect()[0].asDict() == {"file": "p/a.py", "target": "p/b.py"}


def test_go_prefixes_and_jsonc():
    text = "module m // c\nreplace (\n a => ./x\n b => other v1\n)\nreplace c => ../y\n"
    assert configs.go_prefixes(lambda p: text) == [("m", "", 0), ("a", "x", 1), ("c", "y", 2)]
    assert configs.strip_jsonc('{"a": "//x,}", /* b */ "c": [1,],}').replace(" ", "") == '{"a":"//x,}","c":[1]}'


@pytest.mark.parametrize("prior", [None, 3])
def test_empty_repository(spark, tmp_path, prior):
    graph, _ = store.index(spark, str(tmp_path))
    assert graph.overview().first().asDict() == {"file_count": 0, "symbol_count": 0, "import_count": 0, "diagnostic_count": 0}
