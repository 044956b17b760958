"""Comments, strings and declarations over several lines, by language."""

import pytest

from fathom.sources.lexer import code_of
from fathom.sources.parsers import parse, use_tree


def names(path, text):
    symbols, imports, errors = parse(path, text)
    assert errors == []
    return [(s["kind"], s["name"], s["line"]) for s in symbols], [(i["imported_name"], i["local_name"], i["source_path"]) for i in imports]


@pytest.mark.parametrize(("language", "text", "want"), [
    ("typescript", "a /* x\ny */ b // c\nd", "a     \n     b     \nd"),
    ("typescript", "f(`a ${g(`b\n${{c: '}'}}`)} \nclass X {`) + 1", "f(`" + " " * 8 + "\n" + " " * 15 + "\n" + " " * 9 + "`) + 1"),
    ("typescript", "x = /['\"`]/.test(y) // z", "x = /['\"`]/.test(y)     "),
    ("typescript", "a = b / c / d; e = '/*'; f", "a = b / c / d; e = '/*'; f"),
    ("typescript", "s = 'it\\'s // no comment'; t", "s = 'it\\'s // no comment'; t"),
    ("rust", "fn f<'a>(x: &'a str) { '\"' } /* a /* b */ c */ d", "fn f<'a>(x: &'a str) { '\"' }                   d"),
    ("rust", 'let s = r#"a "b\n// c"#; e', 'let s = r              \n     #; e'.replace("r              ", "r" + " " * 6)),
    ("go", "x := `a\nfunc f() {}\n` // y", "x := ` \n           \n`     "),
    ("ruby", "x = <<~SQL\n  class A\nSQL\ny # z", "x = <        \n         \n  L\ny    ".replace("x = <        ", "x = <     ")),
    ("c", "int a; /* open", "int a;        "),
])
def test_code(language, text, want):
    got = code_of(language, text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n") and got == want


def test_classes_in_comments_and_templates_do_not_count():
    text = "/*\nclass A {}\n*/\nconst t = `\nclass B {}\n${x ? `\nfunction c() {}\n` : ''}\n`\nclass D {}\n// class E {}\n"
    assert names("a.ts", text)[0] == [("const", "t", 4), ("class", "D", 10)]
    assert names("a.java", "/** class A */\npublic class B {\n  String s = \"\"\"\n  class C {\n  \"\"\";\n}\n")[0][0] == ("class", "B", 2) and "C" not in str(names("a.java", '/** x */\npublic class B {\n  String s = """\n  class C {\n  """;\n}\n')[0])


def test_heads_over_several_lines():
    ts = "export class A {\n  public async load(\n    id: string,\n    { a, b }: Options = {},\n  ): Promise<void> {\n    await call(\n      id,\n    );\n  }\n}\nexport function f(\n  x: number,\n) {\n}\nexport const g = async (\n  y: string,\n) => {\n}\ndescribe('x', () => {\n  const inner = 1\n})\n"
    assert names("a.ts", ts)[0] == [("class", "A", 1), ("method", "load", 2), ("function", "f", 11), ("function", "g", 15), ("const", "inner", 20)]
    assert names("a.rs", "pub fn f(\n    x: u8,\n) -> u8 {\n}\n")[0] == [("function", "f", 1)]
    assert names("a.java", "public class A {\n    public void f(\n        int x,\n        int y) {\n    }\n}\n")[0] == [("class", "A", 1), ("method", "f", 2)]
    assert names("a.c", "static int f(int x,\n             int y)\n{\n}\n")[0] == [("function", "f", 1)]


def test_use_trees():
    assert list(use_tree("a::{b::{c, d as e}, f, g::*, self}", "::")) == [("a::b::c", None), ("a::b::d", "e"), ("a::f", None), ("a::g::*", None), ("a", None)]
    assert names("a.rs", "use a::{b::{c, d}, e};\nuse std::io::{self, Read as R};\nuse x::*;\n")[1] == [("c", "c", "a::b::c"), ("d", "d", "a::b::d"), ("e", "e", "a::e"), ("io", "io", "std::io"), ("Read", "R", "std::io::Read"), ("*", "*", "x::*")]
    assert names("a.rs", "use a::{\n    b, // why\n    c::{d},\n};\n")[1] == [("b", "b", "a::b"), ("d", "d", "a::c::d")]
    assert names("a.php", "<?php\nuse A\\{B, C as D};\nuse E\\F, G;\nuse function A\\f;\nuse \\H\\I as J;\nclass K {\n    use L;\n}\n$x = function () use ($y) {};\n")[1] == [("B", "B", "A\\B"), ("D", "D", "A\\C"), ("F", "F", "E\\F"), ("G", "G", "G"), ("f", "f", "A\\f"), ("J", "J", "H\\I")]


def test_required_modules():
    text = "const a = require('x')\nconst { b, c: d, e = 1 } = require(\"./y\")\nrequire('z')\n// require('no')\nimport q, { r } from 's'\n"
    assert names("a.js", text)[1] == [("*", "a", "x"), ("b", "b", "./y"), ("c", "d", "./y"), ("e", "e", "./y"), ("*", "*", "z"), ("default", "q", "s"), ("r", "r", "s")]


def test_groups_of_declarations_stay_lines():
    assert names("a.go", 'package p\nimport (\n  "fmt"\n  io "a/b"\n)\nconst (\n  A = 1\n)\nfunc f(\n  x int,\n) {\n}\n')[1] == [("*", "fmt", "fmt"), ("*", "io", "a/b")]
    assert ("function", "f", 9) in names("a.go", 'package p\nimport (\n  "fmt"\n  io "a/b"\n)\nconst (\n  A = 1\n)\nfunc f(\n  x int,\n) {\n}\n')[0]
