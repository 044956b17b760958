"""Symbols and imports of source files: Python by its own parser, the other languages by tables of line patterns.

A lexer first blanks comments and strings of several lines and joins declarations and imports that go on in further lines.
The patterns cover declarations that start on a line of their own; they are approximations, without scopes of nested
blocks beyond the enclosing type.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.lexer import code_of, head_end
from fathom.sources.scan import EXTENSION_LANGUAGE

SYMBOL = "struct<name:string,kind:string,line:int,column:int,exported:boolean,scope:string>"
IMPORT = "struct<imported_name:string,local_name:string,source_path:string,is_default:boolean,is_namespace:boolean,is_type:boolean,line:int>"


@dataclass
class Rules:
    """``symbols``: (kind, pattern with the groups name and maybe vis). ``exported``: from the match and its name."""

    symbols: list[tuple[str, str]]
    imports: list[tuple[str, str]]
    exported: object = None
    types: tuple[str, ...] = ("class", "interface", "enum")
    compiled: list = field(default_factory=list)

    def __post_init__(self):
        self.compiled = [(k, re.compile(p)) for k, p in self.symbols]
        self.imports = [(k, re.compile(p)) for k, p in self.imports]


def _vis(*words: str):
    return lambda m: any(w in (m.groupdict().get("vis") or "").split() for w in words)


def _no(*words: str):
    return lambda m: not any(w in (m.groupdict().get("vis") or "").split() for w in words)


ALWAYS = lambda m: True
MODS = r"(?P<vis>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|readonly|open|data|fileprivate|inline|suspend|lateinit|const|export|default|declare|synchronized|native|extern|unsafe|mutating|lazy|weak|required|convenience|annotation|inner|value|expect|actual)\s+)*)"
NAME = r"(?P<name>[A-Za-z_$][\w$]*)"

SCRIPT = Rules(
    [
        ("class", rf"^\s*{MODS}class\s+{NAME}"),
        ("interface", rf"^\s*{MODS}interface\s+{NAME}"),
        ("enum", rf"^\s*{MODS}(?:const\s+)?enum\s+{NAME}"),
        ("type", rf"^\s*{MODS}type\s+{NAME}\s*(?:<[^=]*>)?\s*="),
        ("function", rf"^\s*{MODS}(?:async\s+)?function\s*\*?\s*{NAME}"),
        ("function", rf"^\s*(?P<vis>(?:export\s+)?)(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
        ("const", rf"^\s*(?P<vis>(?:export\s+)?)const\s+{NAME}"),
        ("variable", rf"^\s*(?P<vis>(?:export\s+)?)(?:let|var)\s+{NAME}"),
        ("method", rf"^\s+{MODS}(?:get\s+|set\s+)?\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\s*\(\s*\)\s*;){NAME}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{{;]+)?\{{"),
        ("property", rf"^\s+(?P<vis>(?:public|private|protected|readonly|static)\s+(?:readonly\s+|static\s+)*){NAME}\s*[?!]?\s*[:=]"),
    ],
    [
        ("es", r"^\s*(?:import|export)\s+(?P<type>type\s+)?(?P<what>[\w$*{][^'\"]*?)\s+from\s+['\"](?P<path>[^'\"]+)['\"]"),
        ("bare", r"^\s*import\s+['\"](?P<path>[^'\"]+)['\"]"),
        ("require", r"^\s*(?:export\s+)?(?:(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*(?::[^=]+)?=\s*)?require\(\s*['\"](?P<path>[^'\"]+)['\"]\s*\)"),
        ("es", r"^\s*export\s+(?P<type>)(?P<what>\*)\s+from\s+['\"](?P<path>[^'\"]+)['\"]"),
    ],
    lambda m: "export" in (m.groupdict().get("vis") or ""),
)
GO = Rules(
    [("method", rf"^func\s+\(\s*\w*\s*\*?(?P<scope>\w+)[^)]*\)\s*{NAME}\s*[\[(]"), ("function", rf"^func\s+{NAME}\s*[\[(]"), ("class", rf"^type\s+{NAME}(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+{NAME}\s+interface\b"), ("type", rf"^type\s+{NAME}\s"), ("const", rf"^const\s+{NAME}\b"), ("variable", rf"^var\s+{NAME}\b")],
    [("go", r"^\s*(?:import\s+)?(?P<alias>[\w.]+\s+)?\"(?P<path>[^\"]+)\"\s*$")],
    lambda m: m["name"][:1].isupper(),
)
RUST_VIS = r"(?P<vis>(?:pub(?:\([^)]*\))?\s+)?)"
RUST = Rules(
    [("function", rf"^{RUST_VIS}(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"\w+\"\s+)?)*fn\s+{NAME}"), ("method", rf"^\s+{RUST_VIS}(?:const\s+|async\s+|unsafe\s+)*fn\s+{NAME}"), ("class", rf"^\s*{RUST_VIS}struct\s+{NAME}"), ("enum", rf"^\s*{RUST_VIS}enum\s+{NAME}"), ("interface", rf"^\s*{RUST_VIS}(?:unsafe\s+)?trait\s+{NAME}"), ("type", rf"^\s*{RUST_VIS}type\s+{NAME}"), ("const", rf"^\s*{RUST_VIS}const\s+{NAME}"), ("variable", rf"^\s*{RUST_VIS}static\s+(?:mut\s+)?{NAME}"), ("namespace", rf"^\s*{RUST_VIS}mod\s+{NAME}")],
    [("rust", r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);"), ("crate", r"^\s*extern\s+crate\s+(?P<path>\w+)(?:\s+as\s+(?P<alias>\w+))?")],
    lambda m: bool(m["vis"]),
)
JAVA = Rules(
    [("class", rf"^\s*{MODS}(?:class|record)\s+{NAME}"), ("interface", rf"^\s*{MODS}@?interface\s+{NAME}"), ("enum", rf"^\s*{MODS}enum\s+{NAME}"), ("const", rf"^\s+(?P<vis>(?:public|private|protected)?\s*(?:static\s+final|final\s+static)\s+)[\w<>\[\],.? ]+\s+{NAME}\s*="), ("method", rf"^\s+{MODS}(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)?{NAME}\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?[{{;]"), ("property", rf"^\s+(?P<vis>(?:public|private|protected)\s+(?:final\s+|static\s+|volatile\s+|transient\s+)*)[\w<>\[\],.?]+\s+{NAME}\s*[=;]")],
    [("java", r"^\s*import\s+(?P<static>static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;")],
    _vis("public"),
)
CSHARP = Rules(
    [("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("class", rf"^\s*{MODS}(?:class|struct|record(?:\s+struct)?)\s+{NAME}"), ("interface", rf"^\s*{MODS}interface\s+{NAME}"), ("enum", rf"^\s*{MODS}enum\s+{NAME}"), ("type", rf"^\s*{MODS}delegate\s+[\w<>\[\],.?]+\s+{NAME}"), ("property", rf"^\s+{MODS}[\w<>\[\],.?]+\s+{NAME}\s*\{{\s*(?:get|set|init)"), ("method", rf"^\s+{MODS}(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)?{NAME}\s*(?:<[^>]*>)?\([^;=]*\)\s*(?:[{{;]|=>|$)"), ("property", rf"^\s+(?P<vis>(?:public|private|protected|internal)\s+(?:static\s+|readonly\s+|const\s+)*)[\w<>\[\],.?]+\s+{NAME}\s*[=;]")],
    [("cs", r"^\s*(?:global\s+)?using\s+(?P<static>static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;")],
    _vis("public", "internal"),
)
KOTLIN = Rules(
    [("enum", rf"^\s*{MODS}enum\s+class\s+{NAME}"), ("interface", rf"^\s*{MODS}(?:fun\s+)?interface\s+{NAME}"), ("class", rf"^\s*{MODS}(?:class|object)\s+{NAME}"), ("type", rf"^\s*{MODS}typealias\s+{NAME}"), ("function", rf"^{MODS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>.?]+\.)?{NAME}\s*\("), ("method", rf"^\s+{MODS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>.?]+\.)?{NAME}\s*\("), ("const", rf"^\s*(?P<vis>(?:private\s+|internal\s+|public\s+)?const\s+)val\s+{NAME}"), ("property", rf"^\s+{MODS}va[lr]\s+{NAME}"), ("variable", rf"^{MODS}va[lr]\s+{NAME}")],
    [("kotlin", r"^\s*import\s+(?P<path>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?")],
    _no("private", "internal"),
)
SWIFT = Rules(
    [("class", rf"^\s*{MODS}(?:class|struct|actor|extension)\s+{NAME}"), ("interface", rf"^\s*{MODS}protocol\s+{NAME}"), ("enum", rf"^\s*{MODS}(?:indirect\s+)?enum\s+{NAME}"), ("type", rf"^\s*{MODS}typealias\s+{NAME}"), ("function", rf"^{MODS}func\s+{NAME}"), ("method", rf"^\s+{MODS}(?:class\s+)?func\s+{NAME}"), ("method", rf"^\s+{MODS}(?P<name>init|deinit|subscript)\b"), ("property", rf"^\s+{MODS}(?:let|var)\s+{NAME}"), ("const", rf"^{MODS}let\s+{NAME}"), ("variable", rf"^{MODS}var\s+{NAME}")],
    [("swift", r"^\s*(?:@testable\s+)?import\s+(?P<kind>(?:struct|class|enum|protocol|func|var|let|typealias)\s+)?(?P<path>[\w.]+)")],
    _no("private", "fileprivate"),
)
RUBY = Rules(
    [("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"), ("namespace", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), ("method", r"^\s+def\s+(?:self\.)?(?P<name>[\w?!=\[\]<>+*/-]+)"), ("function", r"^def\s+(?:self\.)?(?P<name>[\w?!=]+)"), ("const", r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*="), ("variable", r"^\s*(?P<name>@@?\w+)\s*=")],
    [("ruby", r"^\s*(?:require|require_relative|load)\s*\(?\s*['\"](?P<path>[^'\"]+)['\"]")],
    ALWAYS,
)
PHP = Rules(
    [("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"), ("class", rf"^\s*{MODS}(?:class|trait)\s+{NAME}"), ("interface", rf"^\s*{MODS}interface\s+{NAME}"), ("enum", rf"^\s*{MODS}enum\s+{NAME}"), ("method", rf"^\s+{MODS}function\s+&?{NAME}"), ("function", rf"^\s*function\s+&?{NAME}"), ("const", rf"^\s*(?P<vis>(?:public\s+|private\s+|protected\s+|final\s+)*)const\s+{NAME}"), ("property", rf"^\s+(?P<vis>(?:public|private|protected|var)\s+(?:static\s+|readonly\s+)*)(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)")],
    [("php", r"^use\s+(?:function\s+|const\s+)?(?P<path>[^;()]+);")],
    lambda m: not re.search(r"\b(private|protected)\b", m.groupdict().get("vis") or "") ,
)
C_TYPE = r"(?P<vis>(?:(?:static|extern|inline|const|unsigned|signed|struct|enum|union|volatile|virtual|constexpr|explicit|friend)\s+)*)"
C = Rules(
    [("const", rf"^\s*#\s*define\s+{NAME}"), ("type", rf"^\s*typedef\b.*?\b{NAME}\s*;"), ("class", rf"^\s*(?:typedef\s+)?(?:struct|union)\s+{NAME}\s*\{{?\s*$"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{NAME}"), ("function", rf"^{C_TYPE}[A-Za-z_][\w:<>]*(?:\s*[*&]+\s*|\s+){NAME}\s*\([^;]*\)\s*\{{?\s*$"), ("variable", rf"^{C_TYPE}[A-Za-z_]\w*(?:\s*\*+\s*|\s+){NAME}\s*(?:\[[^\]]*\])?\s*(?:=|;)")],
    [("include", r"^\s*#\s*include\s+[<\"](?P<path>[^>\"]+)[>\"]")],
    _no("static", "extern"),
)
CPP = Rules(
    [("namespace", rf"^\s*namespace\s+{NAME}"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+{NAME}\s*(?:final\s*)?(?::[^;]*)?\{{?\s*$"), ("type", rf"^\s*using\s+{NAME}\s*="), ("method", rf"^{C_TYPE}[A-Za-z_][\w:<>&*, ]*?\b(?P<scope>\w+)::{NAME}\s*\("), ("method", rf"^\s+{C_TYPE}[A-Za-z_][\w:<>]*(?:\s*[*&]+\s*|\s+){NAME}\s*\([^;]*\)\s*(?:const)?\s*(?:override)?\s*[{{;]"), *C.symbols],
    [("include", r"^\s*#\s*include\s+[<\"](?P<path>[^>\"]+)[>\"]")],
    _no("static"),
)
ELIXIR = Rules(
    [("namespace", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("interface", r"^\s*defprotocol\s+(?P<name>[\w.]+)"), ("function", r"^\s*(?P<vis>def|defmacro|defp|defmacrop)\s+(?P<name>[a-z_]\w*[?!]?)"), ("const", r"^\s*@(?P<name>[a-z_]\w*)\s+\S")],
    [("elixir", r"^\s*(?P<how>import|alias|require|use)\s+(?P<path>[\w.]+)(?:.*\bas:\s*(?P<alias>\w+))?")],
    lambda m: (m.groupdict().get("vis") or "def") in ("def", "defmacro"),
)
ZIG = Rules(
    [("function", rf"^\s*(?P<vis>pub\s+)?(?:export\s+|inline\s+|extern\s+)*fn\s+{NAME}"), ("type", rf"^\s*(?P<vis>pub\s+)?const\s+{NAME}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"), ("const", rf"^\s*(?P<vis>pub\s+)?const\s+{NAME}\s*(?::[^=]+)?="), ("variable", rf"^\s*(?P<vis>pub\s+)?var\s+{NAME}"), ("function", r"^\s*test\s+\"(?P<name>[^\"]+)\"(?P<vis>)")],
    [("zig", r"^\s*(?:pub\s+)?const\s+(?P<alias>\w+)\s*=\s*@import\(\"(?P<path>[^\"]+)\"\)")],
    lambda m: bool((m.groupdict().get("vis") or "").strip()),
)
RULES = {"typescript": SCRIPT, "tsx": SCRIPT, "javascript": SCRIPT, "jsx": SCRIPT, "go": GO, "rust": RUST, "java": JAVA, "csharp": CSHARP, "kotlin": KOTLIN, "swift": SWIFT, "ruby": RUBY, "php": PHP, "c": C, "cpp": CPP, "elixir": ELIXIR, "zig": ZIG}


def _import(name, local, path, line, default=False, namespace=False, of_type=False) -> dict:
    return {"imported_name": name, "local_name": local, "source_path": path, "is_default": default, "is_namespace": namespace, "is_type": of_type, "line": line}


def use_tree(text: str, separator: str) -> Iterator[tuple[str, str | None]]:
    """(full path, alias) of each leaf of a tree such as ``a::{b::{c, d as e}, self}``; ``self`` is the branch itself."""
    prefixes, at = [""], 0
    for m in re.finditer(r"[^{},]+|[{},]", text):
        part = m.group()
        if part == "{":
            at += 1
        elif part == "}":
            prefixes.pop()
            at -= 1
        elif part != "," and (part := " ".join(part.split())):
            name, _, local = part.partition(" as ")
            if text[m.end() : m.end() + 1] == "{":
                prefixes.append(prefixes[-1] + name.strip())
            elif name.strip() == "self" and at:
                yield prefixes[-1].removesuffix(separator), local.strip() or None
            else:
                yield prefixes[-1] + name.strip(), local.strip() or None


def _imports(kind: str, m: re.Match, line: int) -> Iterator[dict]:
    g = m.groupdict()
    path, alias = g["path"].strip(), (g.get("alias") or "").strip() or None
    last = re.split(r"[./\\:]+", path.rstrip("*.:/\\"))[-1] if path else path
    if kind == "es":
        what, typed = g["what"], bool(g.get("type"))
        if star := re.match(r"\*(?:\s+as\s+([\w$]+))?", what):
            yield _import("*", star[1] or "*", path, line, namespace=bool(star[1]), of_type=typed)
            return
        head, _, braces = what.partition("{")
        if default := head.strip().rstrip(",").strip():
            both = re.match(r"([\w$]+)\s*,\s*\*\s+as\s+([\w$]+)", default)
            yield _import("default", both[1] if both else default, path, line, default=True, of_type=typed)
            if both:
                yield _import("*", both[2], path, line, namespace=True, of_type=typed)
        for part in braces.rstrip("} ").split(","):
            if part := part.strip():
                own = part.startswith("type ")
                name, _, local = part.removeprefix("type ").partition(" as ")
                yield _import(name.strip(), (local or name).strip(), path, line, of_type=typed or own)
    elif kind == "bare":
        yield _import("*", "*", path, line)
    elif kind == "require":
        what = g["what"]
        if what is None or not what.startswith("{"):
            yield _import("*", what or "*", path, line, namespace=what is not None)
            return
        for part in filter(None, (x.strip() for x in what.strip("{} ").split(","))):
            name, _, local = part.partition(":")
            yield _import(name.split("=")[0].strip().removeprefix("..."), (local or name).split("=")[0].strip().removeprefix("..."), path, line)
    elif kind == "rust":
        for name, local in use_tree(path, "::"):
            end = name.split("::")[-1]
            yield _import(end, local or end, name, line, namespace=end == "*")
    elif kind == "php":
        for name, local in use_tree(re.sub(r"\b(?:function|const)\s+", "", path), "\\"):
            last = name.split("\\")[-1]
            yield _import(local or last, local or last, name.lstrip("\\"), line, of_type=True)
    elif kind == "go":
        yield _import("*", "*" if alias == "." else alias or last, path, line, namespace=True)
    elif kind in ("java", "kotlin"):
        wild = path.endswith("*")
        yield _import("*" if wild else last, alias or ("*" if wild else last), path.removesuffix(".*"), line, namespace=wild, of_type=kind == "java" and not wild and not g.get("static"))
    elif kind == "include":
        base = re.sub(r"\.(h|c|hpp|hxx|hh)$", "", path.split("/")[-1])
        yield _import("*", base, path, line, namespace=True)
    else:
        whole = kind in ("cs", "swift", "elixir", "zig", "ruby", "crate") and not g.get("static") and not g.get("kind") and g.get("how") not in ("require", "use")
        yield _import("*" if whole else last, alias or last, path, line, namespace=whole)


# A statement that goes on in the next lines, by what begins it and what ends it.
OPEN = {
    "script": (re.compile(r"^\s*(?:import\s+(?:type\s+)?[\w$,\s*]*|export\s+(?:type\s+)?)\{[^}]*$"), "}"),
    "rust": (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*$"), ";"),
    "php": (re.compile(r"^\s*use\s[^;]*$"), ";"),
}
LONGEST = 500  # lines of one statement


def logical_lines(language: str, text: str) -> Iterator[tuple[int, str]]:
    """Number and text of each line of code; an import or the head of a declaration over several lines is one, at its first."""
    opens, end = OPEN.get("script" if RULES[language] is SCRIPT else language, (None, ""))
    lines = code_of(language, text).split("\n")
    at = 0
    while at < len(lines):
        first = at
        if opens and opens.match(lines[at]):
            while end not in lines[at] and at + 1 < min(len(lines), first + LONGEST):
                at += 1
            at = at if end in lines[at] else first
        if at == first:
            at = head_end(lines, at)
        yield first + 1, lines[first] if at == first else " ".join(x.strip() if k else x.rstrip() for k, x in enumerate(lines[first : at + 1]))
        at += 1


def parse_lines(language: str, text: str) -> tuple[list[dict], list[dict]]:
    rules = RULES[language]
    symbols, imports = [], []
    scope: list[tuple[int, str]] = []
    hidden = False
    in_block = False
    for number, line in logical_lines(language, text):
        bare = line.strip()
        if not bare or bare.startswith(("//", "*", "/*", "--")) or (bare.startswith("#") and language not in ("c", "cpp", "csharp", "rust")):
            continue
        if language == "go":
            in_block = (in_block or bare.startswith("import (")) and bare != ")"
        if language == "ruby" and bare in ("private", "protected", "public"):
            hidden = bare != "public"
        matched = False
        for kind, pattern in rules.imports:
            if (m := pattern.match(line)) and (language != "go" or in_block or bare.startswith("import")):
                imports += _imports(kind, m, number)
                matched = True
                break
        if matched and language != "zig":
            continue
        indent = len(line) - len(line.lstrip())
        while scope and scope[-1][0] >= indent:
            scope.pop()
            hidden = False
        for kind, pattern in rules.compiled:
            if m := pattern.match(line):
                name = m["name"]
                outer = m.groupdict().get("scope") or (scope[-1][1] if scope else None)
                symbols.append({"name": name, "kind": kind, "line": number, "column": m.start("name"), "exported": bool(rules.exported(m)) and not (hidden and kind in ("method", "function")), "scope": outer})
                if kind in (*rules.types, "namespace"):
                    scope.append((indent, name))
                break
    return symbols, imports


def parse_python(text: str) -> tuple[list[dict], list[dict]]:
    symbols, imports = [], []

    def add(name: str, kind: str, node: ast.AST, scope: str | None) -> None:
        public = not name.startswith("_") or (kind in ("function", "method") and name.startswith("__") and name.endswith("__"))
        symbols.append({"name": name, "kind": kind, "line": node.lineno, "column": node.col_offset, "exported": public, "scope": scope})

    def assigned(node: ast.stmt) -> list[ast.Name]:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        return [t for t in targets if isinstance(t, ast.Name)]

    def walk(body: list[ast.stmt], scope: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                marks = {getattr(d, "id", getattr(d, "attr", "")) for d in node.decorator_list}
                add(node.name, "function" if scope is None else "property" if "property" in marks else "method", node, scope)
            elif isinstance(node, ast.ClassDef):
                add(node.name, "class", node, scope)
                walk(node.body, node.name)
            elif isinstance(node, ast.If | ast.Try):
                walk([*node.body, *node.orelse], scope)
            else:
                for t in assigned(node):
                    add(t.id, "property" if scope else "const" if t.id.isupper() else "variable", t, scope)

    tree = ast.parse(text)
    walk(tree.body, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [_import("*", a.asname or a.name, a.name, node.lineno, namespace=True) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            path = "." * node.level + (node.module or "")
            imports += [_import(a.name, a.asname or a.name, path, node.lineno, namespace=a.name == "*") for a in node.names]
    return symbols, imports


def parse(path: str, text: str) -> tuple[list[dict], list[dict], list[str]]:
    """Symbols, imports and errors; files of unknown kinds give nothing."""
    language = EXTENSION_LANGUAGE.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if language is None:
        return [], [], []
    try:
        return (*(parse_python(text) if language == "python" else parse_lines(language, text)), [])
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], [f"{path}: {e}"]


def parse_files(files: DataFrame) -> DataFrame:
    """file_path, symbols, imports, errors of each file (file_path, content as bytes)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [parse(p, bytes(c or b"").decode("utf-8", "replace")) for p, c in zip(part["file_path"], part["content"], strict=True)]
            yield pd.DataFrame({"file_path": part["file_path"], "symbols": [r[0] for r in rows], "imports": [r[1] for r in rows], "errors": [r[2] for r in rows]})

    return files.select("file_path", "content").mapInPandas(run, f"file_path string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, errors array<string>")


def symbol_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.*")


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("imports").alias("i")).select("file_path", "i.*")
