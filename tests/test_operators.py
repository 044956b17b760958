from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathom.operators import codeindex as C
from fathom.operators import imports as G
from fathom.operators import memory as M
from fathom.operators import review as V
from fathom.operators import rules as R

PATHS = ["src/index.ts", "src/a.ts", "src/b.ts", "src/c.ts", "src/util/index.ts", "src/orphan.ts", "src/self.ts", "app.config.ts", "lib/x.py"]
LINKS = [("src/index.ts", "./a", "A", "named"), ("src/a.ts", "./b", "B", "default"), ("src/a.ts", "./util", "u", "named"), ("src/b.ts", "./c", "C", "namespace"), ("src/b.ts", "lodash", "_", "default"), ("src/c.ts", "./a", "A", "named"), ("src/c.ts", "./b.js", "B2", "named"), ("src/self.ts", "./self", "s", "named"), ("lib/x.py", ".utils", "y", "named")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, 1, p) for k, p in enumerate(PATHS)], "file_id long, repo_id long, file_path string")


@pytest.fixture(scope="module")
def imported(spark):
    rows = [(k, PATHS.index(p), n, n, s, f == "default", f == "namespace", False, k + 1) for k, (p, s, n, f) in enumerate(LINKS)]
    return spark.createDataFrame(rows, "import_id long, file_id long, imported_name string, local_name string, source_path string, is_default boolean, is_namespace boolean, is_type boolean, line int")


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(1, 1, "A", "class", True, 1), (2, 2, "other", "function", True, 1), (3, 3, "C", "class", True, 1), (4, 5, "lonely", "function", True, 2), (5, 5, "hidden", "function", False, 3)]
    return spark.createDataFrame(rows, "symbol_id long, file_id long, name string, kind string, exported boolean, line int")


def test_import_edges_and_orphans(spark, files, imported, symbols):
    graph = G.edges(imported, files)
    assert {(r.src, r.dst) for r in graph.collect()} == {("src/index.ts", "src/a.ts"), ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/util/index.ts"), ("src/b.ts", "src/c.ts"), ("src/c.ts", "src/a.ts"), ("src/self.ts", "src/self.ts")}
    assert [r.file_path for r in G.orphans(files, graph, symbols).collect()] == ["lib/x.py", "src/orphan.ts"]
    assert [r.file_path for r in G.orphans(files, G.edges(imported, files, "src/b"), symbols, "src/b").collect()] == ["src/b.ts"]


def test_cycles(spark, files, imported):
    graph = G.edges(imported, files)
    found = lambda depth: {tuple(r.cycle) for r in G.cycles_by_search(graph, depth).collect()}
    triangle, loop = ("src/a.ts", "src/b.ts", "src/c.ts", "src/a.ts"), ("src/self.ts", "src/self.ts")
    assert found(10) == {triangle, loop} == {tuple(r.cycle) for r in G.all_cycles(graph).collect()}
    summary = G.cycle_summary(G.all_cycles(graph)).first()
    assert (summary.cycles, summary.files, summary.longest) == (2, 4, 3)


def test_search_misses_cycles_that_the_full_mode_finds(spark):
    graph = spark.createDataFrame([(1, a, b) for a, b in [("1", "2"), ("2", "1"), ("1", "3"), ("3", "2")]], "repo_id long, src string, dst string")
    assert {tuple(r.cycle) for r in G.cycles_by_search(graph).collect()} == {("1", "2", "1")}
    assert {tuple(r.cycle) for r in G.all_cycles(graph).collect()} == {("1", "2", "1"), ("1", "3", "2", "1")}


def test_callers_and_dead_exports(spark, files, imported, symbols):
    defs = C.top_definition(symbols, files)
    calls = {(r.def_id, r.file_path) for r in C.callers(defs, imported, files).collect()}
    assert {p for d, p in calls if d == 1} == {"src/index.ts", "src/c.ts"}
    assert {p for d, p in calls if d == 2} == {"src/a.ts"}
    assert [r.name for r in C.dead_exports(symbols, imported, files, G.is_entry(F.col("file_path"))).collect()] == ["lonely"]


def test_symbol_search_order(spark, files):
    rows = [(k, 0, n, "function", e, 1) for k, (n, e) in enumerate([("req", False), ("Request", True), ("handleRequest", True), ("reqId", False), ("REQ", True)])]
    symbols = spark.createDataFrame(rows, "symbol_id long, file_id long, name string, kind string, exported boolean, line int")
    assert [r.name for r in C.search_symbols(symbols, files, "req").collect()] == ["req", "REQ", "Request", "reqId", "handleRequest"]
    assert C.search_symbols(symbols, files, "hReq").count() == 0


def test_diff(spark):
    scanned = spark.createDataFrame([("a", 10, "h1"), ("b", 20, "h2"), ("c", 20, "h3"), ("d", 20, "h4x"), ("f", 5, "h6"), ("g", 5, "h7x")], "file_path string, mtime long, hash string")
    indexed = spark.createDataFrame([("a", 10, "h1"), ("b", 10, "h2"), ("c", 10, None), ("d", 10, "h4"), ("e", 10, "h5"), ("g", 10, "h7")], "file_path string, mtime long, hash string")
    found = {r.file_path: r.status for r in C.diff(scanned, indexed).collect()}
    assert found == {"a": "unchanged", "b": "unchanged", "c": "modified", "d": "modified", "e": "deleted", "f": "added", "g": "unchanged"}


def test_recall_order(spark):
    def unit(c):
        return [c, (1 - c * c) ** 0.5]

    rows = [("A", unit(0.9), "r1", 0.5), ("B", unit(0.8), "r2", 0.7), ("C", unit(0.95), None, 0.6), ("D", unit(0.29), None, 1.0)]
    solutions = spark.createDataFrame([(i, v, "p", r, s, 0, 0, None) for i, v, r, s in rows], "id string, embedding array<double>, problem string, repo_id string, score double, successes int, failures int, supersedes string")
    repos = spark.createDataFrame([("r1", [1.0, 0.0]), ("r2", unit(0.8))], "repo_id string, vector array<double>")
    found = M.recall(solutions, repos, [1.0, 0.0], "r1", 3, 0.3).collect()
    assert [(r.id, r.similarity) for r in found] == [("B", 0.864), ("C", 0.95), ("A", 0.99)]
    assert M.recall(solutions, repos, [1.0, 0.0], "r1", 1, 0.3).first().total_found == 3


def test_dedup_modes(spark):
    import math

    rows = spark.createDataFrame([(k, [math.cos(a), math.sin(a)]) for k, a in enumerate([0, 0.4, 0.8, 3])], "id long, embedding array<double>")
    assert [r.id for r in M.dedup_all(rows, 0.9).orderBy("id").collect()] == [0, 3]
    assert [r.id for r in M.dedup_greedy(rows, 0.9).orderBy("id").collect()] == [0, 2, 3]


def test_unused_imports_are_not_broadcast(spark):
    names = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 2), ("a", "*", 3), ("b", "z", 1), ("c", "q", 1), ("d", "w", 1), ("e", None, 1)], "file_path string, local_name string, line int")
    texts = spark.createDataFrame([("a", "import x\nimport y\nimport *\nx1(x)"), ("b", "import z"), ("b", "-\n$z + z"), ("c", None), ("e", "-")], "file_path string, text string")
    found = V.unused_imports(names, texts)
    assert sorted((r.file_path, r.local_name) for r in found.collect()) == [("a", "y"), ("a", "y"), ("c", "q")]
    assert found.columns == names.columns and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_dedup_in_chunks_sends_no_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 150, 0) + rng.normal(size=(150, 8)) * 0.05, rng.normal(size=(250, 8)), np.zeros((2, 8))])[rng.permutation(402)]
    y = M.unit_rows(x.tolist())
    near = np.tril(y @ y.T >= 0.6, -1)
    kept = []
    for k in range(len(x)):
        if not near[k, kept].any():
            kept.append(k)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(402, None)], "id long, embedding array<double>").repartition(5)
    for chunk in (16, 64, 1000):
        assert [int(k) for own in M.kept_chunks(rows, 0.6, chunk) for k in own["id"]] == [*kept, 402], chunk
    assert sorted(r.id for r in M.dedup_greedy(rows, 0.6).collect()) == [*kept, 402]
    assert sorted(r.id for r in M.dedup_all(rows, 0.6).collect()) == [*np.flatnonzero(~near.any(1)).tolist(), 402]


def test_warnings_order(spark):
    rows = [("w1", "file", "src/legacy/*", None, None, "block", ""), ("w2", "file", "src/legacy/a.ts", None, "r1", "info", ""), ("w3", "file", "src/legacy/*.ts", None, None, "warn", "")]
    warnings = spark.createDataFrame(rows, "id string, type string, target string, ecosystem string, repo_id string, severity string, reason string")
    probes = spark.createDataFrame([("src/legacy/a.ts", "r1"), ("src/legacy/deep/x.ts", "r1")], "probe string, repo_id string")
    found = R.check_warnings(probes, warnings).orderBy("probe", "place").collect()
    assert [(r.probe, r.id) for r in found] == [("src/legacy/a.ts", "w2"), ("src/legacy/a.ts", "w3"), ("src/legacy/a.ts", "w1"), ("src/legacy/deep/x.ts", "w3"), ("src/legacy/deep/x.ts", "w1")]


def test_cache_boundary(spark):
    now = datetime(2024, 1, 2)
    cache = spark.createDataFrame([("edge", "x", datetime(2024, 1, 1), 1), ("new", "y", datetime(2024, 1, 1, 1), 2), ("old", "z", datetime(2023, 12, 31), 3)], "cache_key string, response string, created_at timestamp, seq int")
    assert {r.cache_key for r in R.cache_get(cache, F.lit(now)).collect()} == {"new"}
    assert {r.cache_key for r in R.cache_purge(cache, F.lit(now)).collect()} == {"new", "edge"}


def test_review_parts(spark):
    lines = V.lines_of(spark.createDataFrame([("a.ts", "import {x, y} from 'z';\n// foo();\nconsole.log(x)\n// TODO: go")], "file_path string, text string"))
    assert [r.line for r in V.debug_leftovers(lines).collect()] == [3]
    assert [r.line for r in V.commented_code(lines).collect()] == [2]
    names = spark.createDataFrame([("a.ts", n, n, "z", 1) for n in ("x", "y")], "file_path string, imported_name string, local_name string, source_path string, line int")
    texts = spark.createDataFrame([("a.ts", "import {x, y} from 'z';\nconsole.log(x)")], "file_path string, text string")
    assert [r.local_name for r in V.unused_imports(names, texts).collect()] == ["y"]
    dates = spark.createDataFrame([("a.ts", 4, datetime(2023, 1, 1))], "file_path string, line int, written timestamp")
    assert V.todos(lines, dates, F.lit(datetime(2024, 2, 1))).first().tier == "stale"


def test_risk_of_a_change(spark):
    targets = spark.createDataFrame([("src/a.ts",), ("src/alone.ts",), ("test/x.test.ts",), ("src/api/u.ts",)], "target string")
    reach = spark.createDataFrame([("src/a.ts", "b", 1), ("src/a.ts", "c", 2), ("src/a.ts", "d", 3), ("test/x.test.ts", "y.spec.ts", 1)] + [("src/api/u.ts", f"f{k}", 1) for k in range(14)], "target string, file string, degree int")
    covered = spark.createDataFrame([("src/alone.ts",)], "target string")
    found = {r.target: (r.points, r.risk, r.score) for r in G.risk(targets, reach, covered, G.boundaries(targets, reach)).collect()}
    # 10 for the change, 5, 2 and 1 by degree; 30 % more uncovered, 50 % more at a boundary, 20 % less for tests alone
    assert found == {"src/a.ts": (23.4, "medium", 4), "src/alone.ts": (10.0, "low", 2), "test/x.test.ts": (16.5, "low", 3), "src/api/u.ts": (144.0, "critical", 10)}


def test_debug_leftovers_are_calls_of_the_console(spark):
    rows = [("src/a.ts", "please print this page"), ("src/a.ts", "console.trace(x)"), ("src/a.ts", "console.dir(x);"), ("src/client.ts", "console.log(1)"), ("scripts/b.ts", "console.log(1)"), ("src/logger.ts", "console.log(1)"),
            ("cli.ts", "console.table(t)"), ("src/a.ts", "console.error(e)"), ("src/a.ts", "if (DEBUG) console.log(2)"), ("src/a.ts", "if (process.env.NODE_ENV === 'development') console.debug(2)"), ("src/bin/x.ts", "console.log(1)")]
    lines = spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate(rows)], "file_path string, line int, text string")
    assert sorted(r.line for r in V.debug_leftovers(lines).collect()) == [1, 2, 3]


def test_rules_compile_where_they_run(spark):
    rules = [{"name": n, "event": "bash", "pattern": p, "action": "block", "message": n} for n, p in (("java", "(?<n>x)"), ("python", "(?P<n>x)"), ("open", "("))]
    subjects = spark.createDataFrame([(1, "an X"), (2, None)], "id int, subject string")
    assert {r.id: (r.matched, r.blocked) for r in R.evaluate_rules(subjects, rules, "bash").collect()} == {1: (["java"], True), 2: ([], False)}


def test_cleanup_confidence_and_modes(spark):
    rows = [(1, "dead_export", ["no_callers"], False), (2, "dead_export", ["reexported"], False), (3, "circular_dependency", [], False), (4, "orphaned_file", ["entry_point"], True), (5, "commented_code", ["license", "doc"], False), (6, "unused_package", [], None)]
    findings = spark.createDataFrame(rows, "id int, category string, flags array<string>, safe boolean")
    assert {r.id: (r.score, r.tier) for r in V.cleanup_confidence(findings).collect()} == {1: (95, 1), 2: (45, 3), 3: (100, 1), 5: (0, 3), 6: (75, 2)}
    assert {r.id for r in V.cleanup_confidence(findings, "safe").collect()} == {1, 3}
    assert {r.id for r in V.cleanup_confidence(findings, "aggressive").collect()} == {1, 3, 6}


def test_renamed_copies_are_equal_when_names_do_not_count(spark):
    a = "const total = price * 2;\nif (total > 10) {\n  send(total);\n}\nreturn total;"
    b = "const sum = cost * 3;\nif (sum > 99) {\n  post(sum);\n}\nreturn sum;"
    lines = V.lines_of(spark.createDataFrame([("a.ts", a), ("b.ts", b)], "file_path string, text string"))
    assert V.copied_blocks(lines).count() == 0 and [r.copies for r in V.copied_blocks(lines, loose=True).collect()] == [2]


def test_paths_that_a_cleanup_may_touch(spark):
    paths = ["src/a.ts", "src/index.ts", "src/api/b.ts", "x.config.ts", "gen/c.ts", "src/d.stories.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "file_path string")
    assert [r.file_path for r in V.safe_paths(rows, ["gen/"]).collect()] == ["src/a.ts"]


def test_small_texts(spark):
    from fathom.functions import prompts as P
    from fathom.functions.scalar import duration

    rows = spark.createDataFrame([("Implement OAuth with Google across the entire codebase", 500), ("hello", 61_000), ("fix typo", 1500)], "prompt string, ms int")
    found = rows.select(P.prompt_reasoning(F.col("prompt")).alias("why"), duration(F.col("ms")).alias("took")).collect()
    assert [r.took for r in found] == ["500ms", "1.0m", "1.5s"] and found[1].why == "standard task" and found[2].why == "simple task" and found[0].why.startswith("implementation task")
    assert spark.createDataFrame([("a.ts", "x")], "p string, c string").select(R.edit_subject(F.col("p"), F.col("c"))).first()[0] == "a.ts\nx"


def test_depth_first_search_is_not_complete(spark):
    graph = spark.createDataFrame([(1, a, b) for a, b in (("1", "2"), ("2", "1"), ("1", "3"), ("3", "2"))], "repo_id long, src string, dst string")
    assert [list(r.cycle) for r in G.cycles_by_search(graph).collect()] == [["1", "2", "1"]]
    assert sorted(list(r.cycle) for r in G.all_cycles(graph).collect()) == [["1", "2", "1"], ["1", "3", "2", "1"]]


def test_warnings_that_start_with_wildcards(spark):
    rows = [("w1", "file", "*.Env", None, None, "warn", ""), ("w2", "file", "*", None, None, "info", ""), ("w3", "file", "a?", None, None, "block", ""), ("w4", "file", "src/*/deep*.ts", None, None, "warn", "")]
    warnings = spark.createDataFrame(rows, "id string, type string, target string, ecosystem string, repo_id string, severity string, reason string")
    probes = spark.createDataFrame([("app/.env", None), ("ab", None), ("SRC/x/deeper.ts", None), ("", None)], "probe string, repo_id string")
    found = {}
    for r in R.check_warnings(probes, warnings).orderBy("place").collect():
        found.setdefault(r.probe, []).append(r.id)
    assert found == {"app/.env": ["w1", "w2"], "ab": ["w2", "w3"], "SRC/x/deeper.ts": ["w4", "w2"], "": ["w2"]}


def test_package_issues(spark):
    packages = spark.createDataFrame([("a", "npm"), ("a", "pip"), ("b", "npm"), ("b", "npm"), ("c", "npm")], "package string, ecosystem string")
    warnings = spark.createDataFrame([("package", "a", None, "block", "bad"), ("package", "a", "pip", "info", "old"), ("file", "b", None, "warn", "no")], "type string, target string, ecosystem string, severity string, reason string")
    advisories = spark.createDataFrame([("a", "npm", "Critical"), ("a", "npm", "low"), ("a", "npm", "high"), ("z", "npm", "low")], "package string, ecosystem string, level string")
    facts = spark.createDataFrame([("a", "gone " * 40, 10, 5), ("b", "", 500_000, 1), ("c", None, 512_001, 2048)], "package string, deprecated string, size long, gzip long")
    got = {tuple(r) for r in R.package_issues(packages, warnings, advisories, facts).collect()}
    assert got == {
        ("a", "npm", "cve", "critical", "1 critical"), ("a", "npm", "cve", "warn", "2 of lower levels"), ("a", "npm", "warning", "critical", "bad"), ("a", "pip", "warning", "critical", "bad"), ("a", "pip", "warning", "info", "old"),
        ("a", "npm", "deprecated", "warn", ("gone " * 40)[:100]), ("c", "npm", "size", "info", "500 KB, gzip 2 KB"),
    }
    assert not any(r.type == "deprecated" for r in R.package_issues(packages, warnings, advisories, facts, deprecations=False).collect())
