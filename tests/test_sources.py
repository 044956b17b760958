from pyspark.sql import functions as F

from fathom.operators.memory import NO_MATCH
from fathom.plans.api import Engine
from fathom.sources import config, parsers, scan, schemas
from fathom.sources.store import Store


def names(path, text):
    symbols, imports, errors = parsers.parse(path, text)
    assert not errors
    return {(s["name"], s["kind"], s["exported"]) for s in symbols}, {(i["imported_name"], i["local_name"], i["source_path"]) for i in imports}


def test_parsers():
    s, i = names("a.ts", 'import D, { x as y } from "./m";\nimport * as n from "n";\nexport interface I {}\nenum E {}\nexport const go = async (a) => a;\n')
    assert s == {("I", "interface", True), ("E", "enum", False), ("go", "function", True)} and i == {("default", "D", "./m"), ("x", "y", "./m"), ("*", "n", "n")}
    s, i = names("a.py", "from .x import y as z\nclass A:\n  def _p(self): pass\n  @property\n  def q(self): return 1\nX = 1\n_y = 2\n")
    assert s == {("A", "class", True), ("_p", "method", False), ("q", "property", True), ("X", "const", True), ("_y", "variable", False)} and i == {("y", "z", ".x")}
    s, i = names("a.go", 'import "fmt"\nfunc (s *T) Run() {}\ntype T struct {\n}\n')
    assert s == {("Run", "method", True), ("T", "class", True)} and i == {("*", "fmt", "fmt")}
    s, _ = names("a.rs", "pub struct S {\n}\nimpl S {\n    pub fn f(&self) {}\n    fn g() {}\n}\npub(crate) trait T {}\n")
    assert s == {("S", "class", True), ("f", "method", True), ("g", "method", False), ("T", "interface", True)}
    s, i = names("A.java", "import a.b.C;\npublic class A {\n  private int x;\n  public void f() {\n  }\n}\n")
    assert s == {("A", "class", True), ("x", "property", False), ("f", "method", True)} and i == {("C", "C", "a.b.C")}
    s, _ = names("a.cs", "namespace N;\ninternal class A {\n  public int P { get; }\n  private void M() {\n  }\n}\n")
    assert {("A", "class", True), ("P", "property", True), ("M", "method", False)} <= s
    s, _ = names("a.kt", "class A {\n  private val x = 1\n  fun f() {}\n}\nfun g() {}\n")
    assert s == {("A", "class", True), ("x", "property", False), ("f", "method", True), ("g", "function", True)}
    s, _ = names("a.swift", "protocol P {\n}\nprivate func f() {}\nlet c = 1\n")
    assert s == {("P", "interface", True), ("f", "function", False), ("c", "const", True)}
    s, i = names("a.rb", "require 'json'\nmodule M\n  class A\n    def f\n    end\n    private\n    def g\n    end\n  end\nend\n")
    assert s == {("M", "namespace", True), ("A", "class", True), ("f", "method", True), ("g", "method", False)} and i == {("*", "json", "json")}
    s, _ = names("a.php", "<?php\nnamespace N;\nclass A {\n  private $x;\n  public function f() {\n  }\n}\n")
    assert {("A", "class", True), ("x", "property", False), ("f", "method", True)} <= s
    s, i = names("a.c", '#include "u.h"\n#define MAX 1\nstatic int f(int a) {\n}\nint g(void) {\n}\n')
    assert s == {("MAX", "const", True), ("f", "function", False), ("g", "function", True)} and i == {("*", "u", "u.h")}
    s, _ = names("a.cpp", "namespace n {\nclass A {\n};\n}\nvoid A::f() {\n}\n")
    assert {("n", "namespace", True), ("A", "class", True), ("f", "method", True)} <= s
    s, _ = names("a.ex", "defmodule M do\n  def f(x) do\n  end\n  defp g(x) do\n  end\nend\n")
    assert s == {("M", "namespace", True), ("f", "function", True), ("g", "function", False)}
    s, i = names("a.zig", 'const std = @import("std");\npub fn f() void {}\nvar x: u8 = 1;\n')
    assert {("f", "function", True), ("x", "variable", False)} <= s and i == {("*", "std", "std")}
    assert parsers.parse("a.py", "def (")[2] and parsers.parse("a.txt", "x") == ([], [], [])


def test_gitignore_and_aliases():
    import re

    pats = scan.gitignore_patterns("# c\n*.log\n/root\nlib/\n!keep\na?c")
    hit = lambda p: any(re.search(x.replace("\\z", "\\Z"), p) for x in pats)
    assert hit("x/y.log") and hit("root/a") and not hit("x/root") and hit("q/lib/z") and hit("abc") and not hit("keep")
    assert scan.path_aliases('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "x/*"]}}} // c') == [("@*", "src*")]


def test_manifests(spark):
    rows = [("r", "package.json", '{"name": "app", "dependencies": {"react": "1"}, "devDependencies": {"typescript": "5", "vitest": "1"}}'), ("s", "Cargo.toml", '[package]\nname = "c"\n\n[dependencies]\naxum = "1"\n'), ("g", "go.mod", "module github.com/x/app\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9\n)\n")]
    files = spark.createDataFrame(rows, "root string, file string, text string")
    listing = files.select("root", F.col("file").alias("name"))
    found = {r.root: r for r in scan.fingerprints(files, listing).collect()}
    assert found["r"].text == "project: app | languages: typescript | frameworks: react | dependencies: react" and found["r"].test_framework == "vitest"
    assert found["s"].frameworks == ["axum"] and found["s"].patterns == ["api"] and found["g"].name == "app" and found["g"].frameworks == ["gin"]
    assert {r.root: r.indexable for r in scan.session_indexable(listing).collect()} == {"r": True, "s": True, "g": True}


def test_config():
    c = config.merge(config.DEFAULTS, {"search": {"limit": 9}, "index": {"exclude": ["a"]}})
    assert config.get(c, "search.limit") == 9 and config.get(c, "search.least") == 0.3 and config.get(c, "no.such", 1) == 1
    assert config.get(config.put(c, "search.limit", "12"), "search.limit") == 12 and ("search.limit", "9", "int") in config.flatten(c)
    assert config.problems({"least": 2, "scope": "x"}, schemas.ENUMS) == [{"path": "least", "message": "must be from 0.0 to 1.0"}, {"path": "scope", "message": "must be one of global, stack, repo"}]


def test_conform_and_diagnose(spark):
    old = spark.createDataFrame([("s1", "p", 9)], "id string, problem string, junk int")
    new = schemas.conform(old, "solutions")
    assert new.columns == [f.name for f in schemas.schema("solutions")] and new.first().score == 0.5 and new.first().category is None
    bad = spark.createDataFrame([("a", "global", 11), ("b", "nowhere", 3), ("c", "repo", 3)], "id string, scope string, complexity int")
    assert {r.id: r.faults for r in schemas.violations(bad).collect()} == {"a": ["complexity"], "b": ["scope"]}
    assert {r.name: r.status for r in schemas.diagnose({"solutions": new}).collect()}["table solutions"] == "pass"


def test_engine(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("import { b } from './b';\nexport function a() {}\n")
    (root / "src" / "b.ts").write_text("import { a } from './a';\nexport function b() {}\n")
    (root / "src" / "lone.ts").write_text("export function lone() {}\n")
    engine = Engine(spark, str(tmp_path / "store"), dimension=2)
    assert engine.reindex(str(root), "r1") == {"added": 3}
    assert [r.file_path for r in engine.find_definition("a").collect()] == ["src/a.ts"]
    assert [r.file_path for r in engine.find_callers("b").collect()] == ["src/a.ts"]
    assert [r.file_path for r in engine.find_dead_code()["orphaned_files"].collect()] == ["src/lone.ts"]
    assert [list(r.cycle) for r in engine.find_circular_deps().collect()] == [["src/a.ts", "src/b.ts", "src/a.ts"]]
    (root / "src" / "lone.ts").unlink()
    assert engine.reindex(str(root), "r1") == {"deleted": 1, "unchanged": 2} and engine.index_status().first().files == 2
    assert engine.remember("s1", "p", "fix", "global", vector=[1.0, 0.0])["status"] == "stored"
    assert engine.remember("s2", "p", "fix", "global", vector=[1.0, 0.01])["id"] == "s1"
    engine.reward("s1", "success")
    assert abs(engine.recall(vector=[1.0, 0.0]).first().score - 0.55) < 1e-9
    assert engine.failure("build", "line 1", vector=[1.0, 0.0])["status"] == "stored" and engine.failure("build", "line 2")["status"] == "updated"
    engine.warn_add("w1", "file", "src/*", "careful")
    assert engine.warn_check("file", "src/x").count() == 1
    engine.warn_remove("w1")
    assert engine.warn_list().count() == 0


def test_engine_reports_and_fixes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), dimension=2)
    first = engine.doctor({"permissions": {"never": ["warn_add", "warn_list", "Write"]}})
    assert not first["healthy"] and len(first["checks"]) == 12
    mended = engine.doctor({"permissions": {"never": ["warn_add", "warn_list", "Write"]}}, fix=True, listing=["package.json"], skills=[])
    assert mended["healthy"] and {c["name"]: c["status"] for c in mended["checks"] if c["status"] != "pass"} == {"Code Index": "warn"}
    assert mended["config"]["permissions"]["never"] == ["warn", "Write"] and mended["config"]["search"] == config.DEFAULTS["search"]
    assert engine.recall_with_hints(vector=[1.0, 0.0])["hints"].first().hints == [NO_MATCH]
    engine.remember("s1", "p", "fix", "global", vector=[1.0, 0.0], tags=["a", "b"], complexity=8)
    engine.failure("build", "line 1", vector=[1.0, 0.0])
    report = engine.recall_with_hints(vector=[1.0, 0.0])
    assert report["solutions"].count() == report["failures"].count() == 1
    assert [h[:12] for h in report["hints"].first().hints] == ["It is comple", "Close match:", "Known errors"]
    status = engine.status_report()
    assert {r.tag for r in status["tags"].collect()} == {"a", "b"} and [r.id for r in status["recent"].collect()] == ["s1"] and status["version"].first().current == schemas.VERSION
    listing = spark.createDataFrame([("/w/app", "package.json"), ("/w/doc", "readme.md")], "root string, name string")
    assert {r.root: r.indexable for r in engine.session_start(listing, "2").collect()} == {"/w/app": True, "/w/doc": False}
    engine.session_start(listing, "3")
    assert {r.key: r.value for r in engine.store.read("plugin_meta").collect()} == {"install_source": "plugin", "version": "3"}
    row = ("/w/app", "app", ["ts"], [], [], [], None, [1.0, 0.0])
    detected = "path string, name string, languages array<string>, frameworks array<string>, dependencies array<string>, patterns array<string>, test_framework string, fingerprint_embedding array<float>"
    engine.put_repos(spark.createDataFrame([row], detected))
    known = engine.store.read("repos").first()
    engine.put_repos(spark.createDataFrame([("/w/app", "other name", *row[2:])], detected))
    assert engine.store.read("repos").first() == known and known.id.startswith("repo_")
    engine.store.vacuum("repos", 1)
    assert engine.store.read("repos").count() == 1


def test_index_of_a_repository_can_be_cleared(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), dimension=2)
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.ts").write_text("import { b } from './b';\nexport function a() {}\n")
        (tmp_path / name / "b.ts").write_text("import { a } from './a';\nexport function b() {}\n")
        engine.reindex(str(tmp_path / name), name)
    assert tuple(engine.circular_summary().first()) == (2, 2, 2)
    engine.clear_repo("one")
    assert tuple(engine.index_status().select("files", "symbols", "imports").first()) == (2, 2, 2)
    assert engine.dead_code_summary().first().orphaned_files == 0


def test_export_forms(spark, tmp_path):
    from fathom.sources.store import export

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    for form in ("json", "csv", "parquet", "orc"):
        export(df, str(tmp_path / form), form)
        back = spark.read.format(form).option("header", True).load(str(tmp_path / form))
        assert {(int(r["id"]), r["name"]) for r in back.select("id", "name").collect()} == {(1, "a"), (2, None)}


def test_store_keeps_old_snapshot_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))
    assert sorted(r.id for r in store.read("t").collect()) == [1, 2]


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_change_writes_what_it_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path), most_segments=4)
    store.write("t", spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.when(F.col("id") > 2, F.col("id") % 7).alias("g")), note=1)
    whole, before = size(tmp_path / "t"), store.read("t")
    store.change("t", ["id"], spark.createDataFrame([(5, "new", 0), (-1, "more", None)], "id long, v string, g long"), spark.createDataFrame([(6, "x")], "id long, y string"), note=2)
    assert size(tmp_path / "t") - whole < whole / 500 and store.note("t") == 2
    assert before.count() == 100_000 and store.read("t").count() == 100_000
    assert {r.id: r.v for r in store.read("t").where("id IN (-1, 5, 6)").collect()} == {-1: "more", 5: "new"}
    store.change("t", ["g"], gone=spark.createDataFrame([(None,), (0,)], "g long"))
    left = store.read("t")
    assert left.where("g IS NULL OR g = 0").isEmpty() and left.count() == sum(k % 7 != 0 for k in range(3, 100_000) if k not in (5, 6))
    store.append("t", spark.createDataFrame([(6, "back", 0)], "id long, v string, g long"))  # what comes after a change stays
    assert store.read("t").where("g = 0").count() == 1 and len(store.pointer("t")["segments"]) == 4
    store.change("t", ["id"], gone=spark.createDataFrame([(8,)], "id long"), note=3)
    assert len(store.pointer("t")["segments"]) == 1 and store.note("t") == 3 and store.read("t").count() == left.count()
    store.vacuum("t", 1)
    assert store.read("t").count() == left.count() and len(list((tmp_path / "t").iterdir())) == 1


def test_streams(spark, tmp_path):
    from fathom.streaming.state import counted_failures, first_runs

    src = tmp_path / "in"
    spark.createDataFrame([("build", "line 1", None, None, 1), ("build", "line 2", None, "fix", 2)], "error_type string, error_message string, root_cause string, fix_applied string, seq int").withColumn("ts", F.expr("timestamp'2024-01-01'")).write.parquet(str(src))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    counted_failures(stream, store).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert store.read("failures").first().occurrences == 2
    runs = spark.readStream.schema("hook_name string, session_id string, executed_at timestamp").parquet(str(tmp_path / "runs"))if (tmp_path / "runs").mkdir() is None else None
    assert first_runs(runs).isStreaming
