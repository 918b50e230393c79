"""A small tree with all languages, and what its index holds: a workload that needs no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trellis.plans.codegraph import CodeGraph
from trellis.sources import extract, store

FILES = {
    "go.mod": "module ex.com/d\n",
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"ex.com/d/util"\n\t"ex.com/d/none"\n)\n\nfunc main() { fmt.Println(util.V) }\n',
    "util/util.go": "package util\n\ntype V struct{}\n\nfunc (v V) Get() int { return 1 }\n",
    "app/__init__.py": "",
    "app/main.py": "import os\nimport app.util\nfrom .gone import x\n\n\nclass App:\n    def run(self):\n        pass\n",
    "app/util.py": "def helper():\n    return 1\n",
    "java/com/x/a/Main.java": "package com.x.a;\nimport com.x.u.Helper;\nimport java.util.List;\npublic class Main { public static void main(String[] a) {} }\n",
    "java/com/x/u/Helper.java": "package com.x.u;\ninterface Helper { int size(); }\n",
    "cs/Co/App/P.cs": "using Co.Util;\nusing System;\nnamespace Co.App { class P { void Run() {} } }\n",
    "cs/Co/Util/H.cs": "namespace Co.Util { struct H {} }\n",
    "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["web/*"],}}} // aliases\n',
    "web/a.ts": 'import "./b.js";\nimport { c } from "@/c";\nimport React from "react";\nexport function start() {}\n',
    "web/b.ts": "export type Id = string;\n",
    "web/c/index.tsx": "export class View { render() { return 1; } }\n",
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n',
    "crates/a-b/Cargo.toml": '[package]\nname = "a-b"\n',
    "crates/a-b/src/lib.rs": "mod x;\nmod gone;\npub fn top() { inner(); }\nfn inner() {}\n",
    "crates/a-b/src/x.rs": "pub const K: u8 = 1;\n",
    "crates/z/Cargo.toml": '[package]\nname = "z"\n',
    "crates/z/src/lib.rs": "use a_b::top;\nfn call() { top(); }\n",
    "kt/com/x/a/M.kt": "package com.x.a\nimport com.x.u.*\nobject M { fun go() {} }\n",
    "kt/com/x/u/H.kt": "package com.x.u\nenum class H { A }\n",
    "rb/main.rb": "require 'json'\nrequire_relative 'util'\nrequire_relative 'gone'\nmodule Tool\n  def self.run; end\nend\n",
    "rb/util.rb": "def util\nend\n",
    "php/index.php": "<?php\nrequire_once 'lib/u.php';\nfunction page() {}\n",
    "php/lib/u.php": "<?php\ntrait U { function u() {} }\n",
    "c/main.c": '#include "u.h"\n#include <stdio.h>\nint main(void) { return 0; }\n',
    "c/u.h": "struct u { int x; };\nenum e { A };\n",
}


def tree(spark: SparkSession) -> DataFrame:
    """(path, content, mtime_ns, size)"""
    rows = [(path, bytearray(text.encode()), i + 1, len(text)) for i, (path, text) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "path string, content binary, mtime_ns long, size long")


def graph(spark: SparkSession) -> CodeGraph:
    return store.build(extract.extract(tree(spark)), FILES.get)


def symbols(spark: SparkSession) -> DataFrame:
    g = graph(spark)
    return g.symbols.join(g.files, "file_id").select("path", "name", "kind", F.col("span.start_row").alias("row"))


def values(columns: str, rows: list[tuple]) -> str:
    """Known rows as SQL."""
    listed = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"select * from (values {listed}) t({columns})"


#: What the tree holds.
SYMBOLS = [
    ("main.go", "main", "Function", 8), ("util/util.go", "V", "Struct", 2), ("util/util.go", "Get", "Method", 4), ("app/main.py", "App", "Class", 5), ("app/main.py", "run", "Method", 6),
    ("app/util.py", "helper", "Function", 0), ("java/com/x/a/Main.java", "Main", "Class", 3), ("java/com/x/a/Main.java", "main", "Method", 3), ("java/com/x/u/Helper.java", "Helper", "Interface", 1),
    ("java/com/x/u/Helper.java", "size", "Method", 1), ("cs/Co/App/P.cs", "P", "Class", 2), ("cs/Co/App/P.cs", "Run", "Method", 2), ("cs/Co/Util/H.cs", "H", "Struct", 0),
    ("web/a.ts", "start", "Function", 3), ("web/b.ts", "Id", "Other", 0), ("web/c/index.tsx", "View", "Class", 0), ("web/c/index.tsx", "render", "Method", 0),
    ("crates/a-b/src/lib.rs", "x", "Module", 0), ("crates/a-b/src/lib.rs", "gone", "Module", 1), ("crates/a-b/src/lib.rs", "top", "Function", 2), ("crates/a-b/src/lib.rs", "inner", "Function", 3),
    ("crates/a-b/src/x.rs", "K", "Constant", 0), ("crates/z/src/lib.rs", "call", "Function", 1), ("kt/com/x/a/M.kt", "M", "Class", 2), ("kt/com/x/a/M.kt", "go", "Method", 2), ("kt/com/x/u/H.kt", "H", "Enum", 1),
    ("rb/main.rb", "Tool", "Module", 3), ("rb/main.rb", "run", "Method", 4), ("rb/util.rb", "util", "Function", 0), ("php/index.php", "page", "Function", 2), ("php/lib/u.php", "U", "Class", 1), ("php/lib/u.php", "u", "Method", 1),
    ("c/main.c", "main", "Function", 2), ("c/u.h", "u", "Struct", 0), ("c/u.h", "e", "Enum", 1),
]
IMPORTS = [
    ("main.go", "util/util.go", "Resolved"), ("app/main.py", "app/util.py", "Resolved"), ("java/com/x/a/Main.java", "java/com/x/u/Helper.java", "Heuristic"), ("cs/Co/App/P.cs", "cs/Co/Util/H.cs", "Heuristic"),
    ("web/a.ts", "web/b.ts", "Resolved"), ("web/a.ts", "web/c/index.tsx", "Resolved"), ("crates/a-b/src/lib.rs", "crates/a-b/src/x.rs", "Resolved"), ("crates/z/src/lib.rs", "crates/a-b/src/lib.rs", "Resolved"),
    ("kt/com/x/a/M.kt", "kt/com/x/u/H.kt", "Resolved"), ("rb/main.rb", "rb/util.rb", "Resolved"), ("php/index.php", "php/lib/u.php", "Resolved"), ("c/main.c", "c/u.h", "Resolved"),
]
BROKEN = [
    ("main.go", "unresolved import `ex.com/d/none`: internal import resolves to no mapped Go files"), ("app/main.py", "unresolved import `.gone`: relative import resolves to no file in the repo"),
    ("crates/a-b/src/lib.rs", "unresolved import `gone`: `mod` declaration resolves to no .rs file"), ("rb/main.rb", "unresolved import `gone`: require_relative resolves to no .rb file"),
]
CALLS = [("top", "inner", "Resolved"), ("call", "top", "Heuristic")]
LANGUAGES = [("go", 2), ("python", 3), ("java", 2), ("csharp", 2), ("typescript", 3), ("rust", 3), ("kotlin", 2), ("ruby", 2), ("php", 2), ("c", 2)]
