"""Extraction of each language from small samples of our own."""

import pytest

from trellis import lang


def found(language, text):
    e = lang.LANGUAGES[language].extract(text)
    return sorted((s["name"], s["kind"]) for s in e.symbols), [i["specifier"] for i in e.imports], [(e.symbols[c["caller"]]["name"], c["callee"]) for c in e.calls]


CASES = [
    ("go", 'package p\nimport fm "fmt"\nimport (\n\t"a/b"\n\t_ `c`\n)\n// func no() {}\ntype (\n\tA struct{ X int }\n\tB interface{ M() }\n\tC = int\n\tD map[string]int\n)\nfunc (a *A) M[T any]() {}\nfunc F() { s := "func g() {}"; _ = s }\n',
     [("A", "Struct"), ("B", "Interface"), ("D", "Other"), ("F", "Function"), ("M", "Method")], ["fmt", "a/b", "c"]),
    ("python", "import a.b as c, d\nfrom ..x import y\nfrom . import z\nclass K:\n    if True:\n        def m(self):\n            def inner(): pass\n    @deco\n    async def n(self): pass\ndef f(): pass\n",
     [("K", "Class"), ("f", "Function"), ("inner", "Function"), ("m", "Method"), ("n", "Method")], ["a.b", "d", "..x", "."]),
    ("python", "import q\nclass K:\n  def m(self):\n    print 'old'\ndef f(:\n", [("K", "Class"), ("f", "Function"), ("m", "Method")], ["q"]),
    ("java", 'package a.b;\nimport static x.Y.z;\nimport x.*;\n/* class No {} */\npublic class A<T> extends B {\n  private int f = g(1);\n  A() { this.x = new C() { }; }\n  public <R> R map(Fn<R> f) throws E { if (x) { call(); } return null; }\n  @Ann(1) void n() {}\n  interface I { void q(); }\n}\n',
     [("A", "Class"), ("A", "Method"), ("I", "Interface"), ("map", "Method"), ("n", "Method"), ("q", "Method")], ["x.Y.z", "x.*"]),
    ("csharp", 'using J = X.Y;\nusing static S.T;\nnamespace N;\npublic record struct P(int A);\nclass C {\n  public int V { get; set; }\n  public C(int a) : base(a) {}\n  int Twice(int x) => x * 2;\n  void U() { using (var q = F()) { G(); } }\n}\n',
     [("C", "Class"), ("C", "Method"), ("P", "Struct"), ("Twice", "Method"), ("U", "Method")], ["J", "S.T"]),
    ("typescript", "import type { A } from './a';\nimport './b';\nexport * from \"./c\";\nconst d = require('./d');\nconst e = await import('./e');\nexport default class K extends B {\n  constructor(private x: number) { super(); }\n  get v(): { a: number } { return {a: 1}; }\n  f = () => 1;\n  async g<T>(x: T) { return /\"/.test('x'); }\n  abstract h(): void;\n}\nexport async function fn() {}\nconst arrow = () => {};\ntype T<X> = X | 1;\ninterface I { m(): void }\n",
     [("I", "Interface"), ("K", "Class"), ("T", "Other"), ("constructor", "Method"), ("fn", "Function"), ("g", "Method"), ("v", "Method")], ["./a", "./b", "./c", "./d", "./e"]),
    ("rust", "mod a;\nmod b { pub fn in_b() {} }\nuse std::{fmt, io};\nuse crate::x;\nextern crate other_one;\nstruct S<'a>(&'a str);\nimpl<'a> S<'a> {\n    pub const K: u8 = 1;\n    fn m(&self) -> char { '{' }\n}\ntrait T { fn sig(&self); fn def(&self) { helper(); } }\nfn helper() -> Vec<u8> { let r = r#\"fn no() {}\"#; lib_x::go(r); plain(1, inner(2)); x.method(); A::path(); vec![] }\n",
     [("K", "Constant"), ("S", "Struct"), ("T", "Interface"), ("a", "Module"), ("b", "Module"), ("def", "Method"), ("helper", "Function"), ("in_b", "Function"), ("m", "Method")],
     ["a", "use:std", "use:other_one", "use:lib_x"]),
    ("kotlin", "package a.b\nimport x.Y\nimport x.z.*\nsealed interface S\ndata class D(val a: Int) : B(a), S { fun m() { fun local() {} } }\nobject O { val x = 1 }\nenum class E { A }\nfun String.ext(): Int = 1\nfun <T> gen(x: T) {}\n",
     [("D", "Class"), ("E", "Enum"), ("O", "Class"), ("S", "Interface"), ("ext", "Function"), ("gen", "Function"), ("local", "Function"), ("m", "Method")], ["x.Y", "x.z.*"]),
    ("ruby", "require 'json'\nrequire_relative 'a/b'\nmodule M\n  class C < B\n    def m?(x)\n      return 1 if x\n      [1].each do |y| puts y end\n      if x then 2 end\n    end\n    def self.s; end\n  end\nend\ndef f\n  while true do break end\nend\n",
     [("C", "Class"), ("M", "Module"), ("f", "Function"), ("m?", "Method"), ("s", "Method")], ["a/b"]),
    ("php", "<html><?php\nuse A\\B;\nrequire 'a.php';\ninclude_once __DIR__ . '/b.php';\nrequire \"c.php\";\nabstract class C { abstract function a(); function &b() { $f = function() {}; } }\ntrait T {}\nenum E: string { case A = 'a'; }\nfunction f() { $x = new class { function inner() {} }; }\n",
     [("C", "Class"), ("E", "Enum"), ("T", "Class"), ("a", "Method"), ("b", "Method"), ("f", "Function"), ("inner", "Method")], ["a.php"]),
    ("c", '#include "a.h"\n#include <b.h>\n#define F(x) int x() {}\nstruct fwd;\nstruct s { int x; } v;\nenum e { A };\nint proto(int);\nstatic char *f(int a) { if (a) { g(); } return 0; }\nint (*fp(void))(int) { return 0; }\nint arr[] = { 1, 2 };\n',
     [("e", "Enum"), ("f", "Function"), ("fp", "Function"), ("s", "Struct")], ["a.h"]),
]


@pytest.mark.parametrize("language,text,symbols,imports", CASES, ids=lambda x: x if isinstance(x, str) and len(x) < 12 else "")
def test_extracts(language, text, symbols, imports):
    got = found(language, text)
    assert got[0] == symbols
    assert got[1] == imports


def test_rust_calls_are_plain_and_have_a_caller():
    calls = found("rust", CASES[6][1])[2]
    assert calls == [("def", "helper"), ("helper", "plain"), ("helper", "inner")]


def test_spans_are_bytes():
    e = lang.LANGUAGES["go"].extract('package p\n// é\nfunc é() {}\nfunc G() {}\n')
    assert e.symbols[1]["span"] == {"start_byte": 34, "end_byte": 35, "start_row": 3, "start_col": 5}
    p = lang.LANGUAGES["python"].extract("x = 'é'; import os\nclass É:\n  def f(self): pass\n")
    assert p.imports[0]["span"]["start_col"] == 17 and p.symbols[1]["span"]["start_row"] == 2 and p.symbols[1]["span"]["start_col"] == 6


def test_detection():
    assert lang.names() == ["go", "python", "java", "csharp", "typescript", "rust", "kotlin", "ruby", "php", "c"]
    assert lang.detect("a/b.tsx") == "typescript" and lang.detect("x.PY") is None and lang.detect("Makefile") is None
    assert lang.detect("run", "#!/usr/bin/env python3") == "python" and lang.detect("run", "python") is None


def test_broken_texts_do_not_fail():
    for name in lang.names():
        for text in ("", "\x00", '"', "/*", "{{{{", "}}}}", "class", "fn (", "func (", "import", "def", "'", "type (", "a\\", "<?php <<<X\n"):
            lang.LANGUAGES[name].extract(text)
