"""File scans: listing, exclusion, .gitignore, aliases, project types and manifests."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that no scan enters.
EXCLUDED = ["node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt", ".output", ".cache", "__pycache__", "vendor", ".turbo", ".vercel", "target", "bin", "pkg", ".bundle", "venv", ".venv", "env", ".tox", ".mypy_cache", ".pytest_cache", "Pods", "obj", "out"]

# Language of each extension.
LANGUAGES = {
    "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"], "python": ["py", "pyw", "pyi"], "go": ["go"], "rust": ["rs"], "java": ["java"], "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"], "ruby": ["rb", "rake", "gemspec"], "php": ["php"], "csharp": ["cs", "csx"], "kotlin": ["kt", "kts"], "swift": ["swift"], "elixir": ["ex", "exs"], "zig": ["zig"],
}
EXTENSION_LANGUAGE = {e: name for name, es in LANGUAGES.items() for e in es}

# Files that tell a project's type; the first twelve types can be indexed.
PROJECTS = [
    ("TypeScript/JavaScript", ["package.json", "tsconfig.json", "jsconfig.json"], True), ("Python", ["pyproject.toml", "setup.py", "requirements.txt", "Pipfile"], True), ("Go", ["go.mod"], True), ("Rust", ["Cargo.toml"], True),
    ("Java/Kotlin", ["pom.xml", "build.gradle", "build.gradle.kts"], True), ("Swift", ["Package.swift"], True), ("C#", ["*.csproj", "*.sln", "*.slnx", "global.json"], True), ("Ruby", ["Gemfile"], True), ("PHP", ["composer.json"], True),
    ("Elixir", ["mix.exs"], True), ("Zig", ["build.zig"], True), ("C/C++", ["CMakeLists.txt", "Makefile", "configure.ac"], True), ("Deno", ["deno.json", "deno.jsonc"], False), ("Dart", ["pubspec.yaml"], False), ("Perl", ["Makefile.PL", "cpanfile"], False),
    ("Julia", ["Project.toml"], False), ("Haskell", ["stack.yaml", "cabal.project"], False), ("Erlang", ["rebar.config"], False), ("Clojure", ["project.clj", "deps.edn"], False), ("Scala", ["build.sbt"], False), ("D", ["dub.json", "dub.sdl"], False),
    ("PureScript", ["spago.dhall", "spago.yaml"], False), ("Crystal", ["shard.yml"], False), ("V", ["v.mod"], False), ("Gleam", ["gleam.toml"], False), ("ReasonML", ["esy.json"], False),
]

# Dependencies that tell a framework.
FRAMEWORKS = {
    "react": ["react", "react-dom", "next", "@remix-run/react", "gatsby"], "vue": ["vue", "nuxt", "@vue/cli"], "angular": ["@angular/core"], "svelte": ["svelte", "@sveltejs/kit"], "express": ["express"], "fastify": ["fastify"], "hono": ["hono"], "nestjs": ["@nestjs/core"], "koa": ["koa"],
    "fastapi": ["fastapi"], "django": ["django"], "flask": ["flask"], "starlette": ["starlette"], "actix": ["actix-web"], "axum": ["axum"], "rocket": ["rocket"], "warp": ["warp"],
    "gin": ["github.com/gin-gonic/gin"], "echo": ["github.com/labstack/echo"], "fiber": ["github.com/gofiber/fiber"], "chi": ["github.com/go-chi/chi"],
}
# Test frameworks by their packages.
TEST_FRAMEWORKS = {"jest": ["jest", "@jest/core"], "vitest": ["vitest"], "mocha": ["mocha"], "pytest": ["pytest"], "unittest": ["unittest"], "cargo-test": ["#[test]"], "go-test": ["testing"], "bun": ["bun:test"]}
# Packages of interfaces.
API_DEPS = ["express", "fastify", "hono", "koa", "fastapi", "flask", "django", "actix-web", "axum", "gin"]
# Packages of command lines.
CLI_DEPS = ["commander", "yargs", "clap", "cobra", "click", "argparse"]


def scan_files(spark: SparkSession, root: str, most_bytes: int = 1 << 20, tests: bool = False, globs: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """file_path, mtime (ms), size, content, hash of the source files under ``root``."""
    ends = "|".join(sorted(EXTENSION_LANGUAGE))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.split("://")[-1].rstrip("/"))
    path = F.regexp_replace("path", f"^.*?{base}/", "")
    rows = found.select(path.alias("file_path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    rows = rows.where(F.col("file_path").rlike(rf"\.({ends})$") & (F.col("size") <= most_bytes) & ~excluded(F.col("file_path"), tests, globs, ignore))
    return rows.withColumn("hash", F.sha2("content", 256))


def exclude_regex(glob: str) -> str:
    return "^" + re.sub(r"\*\*|\*|\.", lambda m: {"**": ".*", "*": "[^/]*", ".": r"\."}[m[0]], glob) + r"\z"


def excluded(path: Column, tests: bool = False, globs: list[str] = (), ignore: list[str] = (), minified: bool = False) -> Column:
    """Whether a scan leaves the path out: excluded folders, globs, tests, declaration files, .gitignore patterns."""
    every = [*globs, "**/*.d.ts", "**/*.d.mts", "**/*.d.cts"]
    if not tests:
        every += [f"**/*.{kind}.{end}" for kind in ("test", "spec") for end in ("ts", "tsx", "js", "jsx")] + ["**/__tests__/**", "**/__mocks__/**"]
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))
    regexes = [exclude_regex(g) for g in every if "*" in g] + list(ignore)
    out = out | path.rlike("|".join(f"(?:{r})" for r in regexes))
    for part in every:
        if "*" not in part:
            out = out | path.contains(part)
    return out | path.rlike(r"\.(min|bundle)\.") if minified else out


def gitignore_patterns(text: str) -> list[str]:
    """Regular expressions of a .gitignore file; comments and negations are skipped."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if not line or line[0] in "#!":
            continue
        glob = line.removesuffix("/")
        body = re.sub(r"\*\*|\*|\?|[.+^${}()|\[\]\\]", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], "\\" + m[0]), glob)
        out.append(rf"^{body[1:]}(/|\z)" if line.startswith("/") else rf"(^|/){body}(/|\z)")
    return out


def path_aliases(config: str) -> list[tuple[str, str]]:
    """Alias and target prefixes of a tsconfig or jsconfig text, in order; only the first target of each counts."""
    try:
        options = json.loads(re.sub(r"//.*$", "", config, flags=re.M)).get("compilerOptions", {})
    except ValueError:
        return []
    base = options.get("baseUrl", ".")
    out = []
    for alias, targets in (options.get("paths") or {}).items():
        if targets:
            out.append((re.sub(r"/?\*$", "", alias) + "*", posixpath.normpath(posixpath.join(base, re.sub(r"/?\*$", "", targets[0]))) + "*"))
    return out


def project_types(listing: DataFrame) -> DataFrame:
    """root, project, indexable of each root by the names of its files (root, name)."""
    spark = listing.sparkSession
    markers = spark.createDataFrame([(p, m.replace("*.", "%.", 1) if m.startswith("*") else m, ok) for p, ms, ok in PROJECTS for m in ms], "project string, marker string, indexable boolean")
    met = listing.join(F.broadcast(markers), F.expr("name = marker OR (startswith(marker, '%') AND endswith(name, substring(marker, 2)))"))
    return met.groupBy("root", "project").agg(F.bool_or("indexable").alias("indexable"))


def session_indexable(listing: DataFrame) -> DataFrame:
    """The other test of a root: without Pipfile, project files of C# and configure.ac; C and C++ need sources too."""
    plain = sorted({m for p, ms, ok in PROJECTS if ok and p != "C/C++" for m in ms if not m.startswith("*") and m != "Pipfile"})
    name = F.col("name")
    one = F.bool_or(name.isin(plain))
    build = F.bool_or(name.isin("CMakeLists.txt", "Makefile"))
    source = F.bool_or(name.rlike(r"(?i)^(src/)?[^/]*\.(c|cpp|cc|cxx|h|hpp|hxx)$"))
    return listing.groupBy("root").agg((one | (build & source)).alias("indexable"))


def frameworks_of(deps: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(deps, F.array(*map(F.lit, ps))), F.lit(f)) for f, ps in FRAMEWORKS.items()]))


def test_framework_of(deps: Column) -> Column:
    return F.coalesce(*[F.when(F.arrays_overlap(deps, F.array(*map(F.lit, ps))), F.lit(f)) for f, ps in TEST_FRAMEWORKS.items()])


def patterns_of(deps: Column, files: Column) -> Column:
    """monorepo, api, cli and library, from dependencies and the names of a root's files."""
    met = lambda xs, names: F.arrays_overlap(xs, F.array(*map(F.lit, names)))
    return F.array_compact(F.array(
        F.when(met(files, ["pnpm-workspace.yaml", "lerna.json", "nx.json"]), "monorepo"), F.when(met(deps, API_DEPS), "api"), F.when(met(deps, CLI_DEPS), "cli"),
        F.when(met(files, ["tsconfig.build.json"]) | met(deps, ["tsup", "rollup"]), "library"),
    ))


def fingerprint_text(name: Column, languages: Column, frameworks: Column, patterns: Column, dependencies: Column) -> Column:
    parts = [("project", F.array(name)), ("languages", languages), ("frameworks", frameworks), ("patterns", patterns), ("dependencies", F.slice(dependencies, 1, 10))]
    texts = F.array(*[F.concat(F.lit(k + ": "), F.array_join(v, ", ")) for k, v in parts])
    return F.array_join(F.filter(texts, lambda t: ~t.endswith(": ")), " | ")


def manifests(files: DataFrame) -> DataFrame:
    """root, name, deps, dev_deps, language of each manifest (root, file, text): package.json, Cargo.toml, pyproject.toml, requirements.txt, go.mod."""
    text = F.col("text")
    keys = lambda c: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, c), "map<string,string>")), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    section = lambda head: F.regexp_extract(text, rf"(?s)\[{head}\]\s*\n(.*?)(?:\n\[|\z)", 1)
    toml_keys = lambda head: F.regexp_extract_all(section(head), F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="), F.lit(1))
    quoted = F.regexp_extract_all(F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit("[\"']([A-Za-z0-9_.-]+)"), F.lit(1))
    listed = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-Za-z0-9_.-]+)"), F.lit(1))
    modules = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([A-Za-z0-9_.-]+\.[a-z]+/\S+)\s+v"), F.lit(1))
    kind = F.col("file")
    deps = F.when(kind == "package.json", keys("$.dependencies")).when(kind == "Cargo.toml", toml_keys("dependencies")).when(kind == "pyproject.toml", F.array_distinct(F.concat(quoted, F.filter(toml_keys(r"tool\.poetry\.dependencies"), lambda d: d != "python")))).when(kind == "requirements.txt", listed).when(kind == "go.mod", modules).otherwise(none)
    dev = F.when(kind == "package.json", keys("$.devDependencies")).when(kind == "Cargo.toml", toml_keys("dev-dependencies")).otherwise(none)
    name = F.when(kind == "package.json", F.get_json_object(text, "$.name")).when(kind == "go.mod", F.element_at(F.split(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1), "/"), -1)).otherwise(F.regexp_extract(text, r'(?m)^name\s*=\s*["\']([^"\']+)', 1))
    rows = files.select("root", "file", name.alias("name"), deps.alias("deps"), dev.alias("dev_deps"))
    language = F.when(F.col("file") == "package.json", F.when(F.array_contains("dev_deps", "typescript"), "typescript").otherwise("javascript")).when(F.col("file") == "Cargo.toml", "rust").when(F.col("file") == "go.mod", "go").otherwise("python")
    return rows.withColumn("language", language)


def fingerprints(files: DataFrame, listing: DataFrame) -> DataFrame:
    """One row a root: name, languages, frameworks, patterns, dependencies, test framework and text."""
    rows = manifests(files)
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", c))), lambda s: s[c])))
    each = rows.groupBy("root").agg(F.min_by("name", "file").alias("name"), F.array_sort(F.collect_set("language")).alias("languages"), flat("deps").alias("deps"), flat("dev_deps").alias("dev"))
    names = listing.groupBy("root").agg(F.collect_set("name").alias("files"))
    every = F.concat("deps", "dev")
    out = each.join(names, "root", "left").select("root", "name", "languages", frameworks_of(every).alias("frameworks"), patterns_of(every, F.coalesce("files", F.array().cast("array<string>"))).alias("patterns"), F.slice("deps", 1, 30).alias("dependencies"), test_framework_of(every).alias("test_framework"))
    return out.withColumn("text", fingerprint_text(*[F.col(c) for c in ("name", "languages", "frameworks", "patterns", "dependencies")]))
