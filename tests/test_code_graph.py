"""References that keep code alive, strongly connected components, similar blocks, composable rewards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import graphs as N
from fathom.operators import imports as G
from fathom.operators import references as E
from fathom.operators import review as V
from fathom.operators import rewards as W
from fathom.operators import similar as Y

LINES = [
    ("src/index.ts", "export { api } from './api/users';"), ("src/a.ts", "const p = await import('./lazy/page');"), ("src/a.ts", 'const c = require("../legacy/old.js")'), ("src/b.ts", "export * from './barrel';"),
    ("src/b.ts", "export * as all from './starred'; export type { T } from './typed/index'"), ("src/c.ts", "container.resolve('Factory'); use(\"two words\", 'has-dash')"), ("src/d.ts", "@Injectable()"), ("src/d.ts", "  @Input() x"), ("src/e.ts", "/** @public */"), ("src/e.ts", "const mail = 'me@public.org';"),
    ("src/lazy/page.ts", "import('./page')"), ("src/f.ts", "reimport('./not'); xrequire('./not')"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, p, k, x) for k, (p, x) in enumerate(LINES)] + [(2, "src/z.ts", 1, "import('./other-repo')"), (1, "src/n.ts", 2, None)], "repo_id long, file_path string, line int, text string")


def test_postings(lines):
    got = {(r.repo_id, r.kind, r.key, r.lo, r.hi) for r in E.postings(lines).collect()}
    assert {(k, key) for repo, k, key, _, _ in got if repo == 1 and k != "string"} == {
        ("dynamic", "page"), ("dynamic", "old"), ("reexport", "users"), ("reexport", "barrel"), ("reexport", "starred"), ("reexport", "typed"), ("decorator", "Injectable"), ("decorator", "Input"), ("tag", "public"),
    }
    assert {key for repo, k, key, _, _ in got if k == "string"} == {"Factory"}
    assert (1, "dynamic", "page", "src/a.ts", "src/lazy/page.ts") in got and (2, "dynamic", "other-repo", "src/z.ts", "src/z.ts") in got


def test_evidence_and_findings(spark, lines):
    rows = [("src/lazy/page.ts", "Page"), ("src/legacy/old.ts", "old"), ("src/barrel/index.ts", "b"), ("src/typed.ts", "T"), ("src/x.ts", "Factory"), ("src/d.ts", "D"), ("src/e.ts", "E"), ("src/api/users.ts", "u"), ("src/index.ts", "i"), ("src/other-repo.ts", "o"), ("src/plain.ts", "_p"), ("src/not.ts", "n"), ("src/listed.ts", "l")]
    dead = spark.createDataFrame([(1, p, n, k) for k, (p, n) in enumerate(rows)], "repo_id long, file_path string, name string, id long")
    listed = spark.createDataFrame([(1, "src/listed.ts")] * 2, "repo_id long, file_path string")
    got = {r.file_path: {c for c in E.FLAGS if r[c]} for r in E.evidence(dead, lines, listed).collect()}
    assert got == {
        "src/lazy/page.ts": {"dynamic_import"}, "src/legacy/old.ts": {"dynamic_import"}, "src/barrel/index.ts": {"reexported"}, "src/typed.ts": {"reexported"}, "src/x.ts": {"string_named"}, "src/d.ts": {"decorated"}, "src/e.ts": {"public_doc"},
        "src/api/users.ts": {"reexported", "public_folder"}, "src/index.ts": {"root_index"}, "src/other-repo.ts": set(), "src/plain.ts": set(), "src/not.ts": set(), "src/listed.ts": {"listed"},
    }
    lone = spark.createDataFrame([(1, "src/lazy/page.ts", 0, 100), (1, "src/plain.ts", 0, 101), (1, "src/q.ts", 2, 102), (1, "src/d.ts", 1, 103)], "repo_id long, file_path string, exports long, id long")
    scores = {r.id: (r.score, r.tier) for r in V.cleanup_confidence(E.dead_code(dead, lone, lines, listed)).collect()}
    assert scores == {2: (55, 3), 3: (55, 3), 6: (35, 3), 7: (5, 3), 9: (95, 1), 10: (100, 1), 11: (95, 1), 100: (50, 3), 101: (90, 1), 102: (80, 2)}


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_against_reachability(spark):
    rng = random.Random(1)
    edges = {(f"n{rng.randrange(16):02}", f"n{rng.randrange(16):02}") for _ in range(22)} | {(f"p{k:02}", f"p{k + 1:02}") for k in range(9)} | {("p07", "p03"), ("n00", "p00")}
    graph = spark.createDataFrame([(r, a, b) for r in (1, 2) for a, b in edges if r == 1 or a[0] == "p"], "repo_id long, src string, dst string")
    got = N.strong_components(graph).collect()
    for repo in (1, 2):
        want = brute_components([e for e in edges if repo == 1 or e[0][0] == "p"])
        assert {r.node: r.component for r in got if r.repo_id == repo} == want
        assert all(r.size == sum(c == r.component for c in want.values()) for r in got if r.repo_id == repo)


def test_cycles_of_several_repositories(spark):
    graph = spark.createDataFrame([(1, "b", "a"), (1, "a", "b"), (2, "a", "b"), (2, "b", "c"), (3, "c", "c"), (3, "x", "c"), (3, "c", "y")], "repo_id long, src string, dst string")
    assert {(r.repo_id, tuple(r.cycle)) for r in G.cycles_by_search(graph).collect()} == {(1, ("a", "b", "a")), (3, ("c", "c"))}
    assert G.cycles_by_search(graph.limit(0)).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_blocks_against_all_pairs(spark):
    rng = random.Random(8)
    rows, bases = [], [[[rng.choice(["if", "x1", "foo", "(", ")", "é", "7", *map(str, range(20))]) for _ in range(rng.randint(1, 6))] for _ in range(6)] for _ in range(4)]
    for k in range(24):
        own = [[rng.choice(["if", "y", "9"]) if rng.random() < 0.08 else t for t in line] for line in bases[k % 4]]
        rows += [(f"f{k:02}", n, "  ".join(line) + "  ") for n, line in enumerate(own)] + [(f"f{k:02}", 99, " \t ")]
    df = spark.createDataFrame(rows, "file_path string, line int, text string")
    classes = {r.digest: r for r in Y.blocks(df, 3).collect()}
    want = {}
    for a, x in classes.items():
        for b, y in classes.items():
            most = max(len(x.tokens), len(y.tokens))
            same = 100 * (most - distance(x.tokens, y.tokens))
            if a < b and same > 80 * most and min(x.lo, y.lo) != max(x.hi, y.hi):
                want[a, b] = same // most
    got = {(r.a, r.b): r.similarity for r in Y.similar_blocks(df, 3).collect()}
    assert got == want and len(want) > 10 and 81 in {*want.values(), 81}


def test_blocks_that_share_tokens_alone_are_no_pairs_sent(spark, monkeypatch):
    rng, sent = random.Random(3), []
    keep = Y.stored
    monkeypatch.setattr(Y, "stored", lambda df: sent.append(keep(df)) or sent[-1])
    words = [f"w{k}" for k in range(60)]
    rows = [(f"f{k:03}", n, " ".join(rng.sample(words, 20))) for k in range(200) for n in range(2)]
    rows += [(f"g{k}", n, " ".join([*words[:30], f"x{k}"])) for k in range(3) for n in range(2)]
    df = spark.createDataFrame(rows, "file_path string, line int, text string")
    whole = Y.similar_blocks(df, 2).select("a", "b", "similarity").collect()
    pairs = [x for x in sent if x.columns == ["a", "b"]]
    assert len(whole) == 3 and len(pairs) == 1 and pairs[0].count() < 1000  # nearly all of the 20,503 pairs share a token of a prefix
    monkeypatch.setattr(Y, "ROWS_A_TOKEN", 16)
    monkeypatch.setattr(Y, "ROWS_A_BUCKET", 500)
    assert sorted(Y.similar_blocks(df, 2).select("a", "b", "similarity").collect()) == sorted(whole)


def test_blocks_of_few_signs_are_no_pairs_sent(spark, monkeypatch):
    rng, sent = random.Random(5), []
    keep = Y.stored
    monkeypatch.setattr(Y, "stored", lambda df: sent.append(keep(df)) or sent[-1])
    rows = [(f"f{k:02}", n, " ".join(f"{rng.choice(['the', *(f'w{rng.randrange(10**9)}' for _ in range(9))])} {rng.choice('*&%#') * 3}" for _ in range(40))) for k in range(60) for n in range(2)]
    rows += [("g", n, rows[n][2].replace("the", "a", 1)) for n in range(2)]
    own = ["short", " ".join(f"x{k}" for k in range(30)), "other"]
    rows += [("h", n, x) for n, x in enumerate(own)] + [("i", n, x) for n, x in enumerate(own[1:])]  # blocks of one file that share a line
    df = spark.createDataFrame(rows, "file_path string, line int, text string")
    got = {(r.a_first.file_path, r.b_first.file_path) for r in Y.similar_blocks(df, 2).collect()}
    pairs = [x for x in sent if x.columns == ["a", "b"]]
    assert {tuple(sorted(x)) for x in got} == {("f00", "g"), ("h", "h")} and pairs[0].count() < 200  # of 1711 and more that share three of four tokens


def test_renamed_blocks_are_alike_and_copies_are_one_class(spark):
    df = spark.createDataFrame([(f, n, x) for f, name in (("a", "left"), ("b", "right"), ("c", "left")) for n, x in enumerate([f"let {name} = 1", f"if ({name} > 22) go()", "end"])], "file_path string, line int, text string")
    assert Y.blocks(df, 3, loose=True).count() == 1 and Y.blocks(df, 3).count() == 2
    assert Y.similar_blocks(df, 3, loose=True).collect() == [] and Y.similar_blocks(df, 3, 70).count() == 1


def fold(outcomes, s=0.5):
    for o in outcomes:
        s = s + 0.1 * (1 - s) if o == "success" else min(1.0, s + 0.03) if o == "partial" else max(0.1, s - 0.15) if o == "failure" else s
    return s


def test_rewards_fold_in_order_over_many_pieces(spark):
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else 1 if rng.random() < 0.4 else rng.randrange(9), rng.randrange(500), k, rng.choice(["success", "partial", "failure", "failure", "other", None])) for k in range(4000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "solution_id long, ts long, log_id long, outcome string").repartition(7)
        got = {r.solution_id: r for r in W.reward_state(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len({r[0] for r in rows})
    for key, r in got.items():
        own = [o for k, _, _, o in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2]))]
        assert abs(r.score - fold(own)) < 1e-9 and (r.successes, r.partials, r.failures) == tuple(own.count(o) for o in W.OUTCOMES)
    assert W.reward_state(df.limit(0)).collect() == []


def test_maps_compose():
    rng = np.random.default_rng(0)
    for _ in range(200):
        names = rng.choice([*W.OUTCOMES], rng.integers(1, 30))
        cut = rng.integers(0, len(names) + 1)
        parts = [W.composed(np.array([W.OUTCOMES[n] for n in part]), np.zeros(len(part)))[1] for part in (names[:cut], names[cut:]) if len(part)]
        whole = parts[0] if len(parts) == 1 else W.compose(*parts)
        assert abs(W.applied(whole, 0.5)[0] - fold(names)) < 1e-12


def test_todo_marks(spark):
    rows = spark.createDataFrame([("a", 1, "# TEMP hack later"), ("a", 2, "// TEMPORARY: x"), ("a", 3, "TEMPLATE"), ("a", 4, "FIXME now")], "file_path string, line int, text string")
    dates = rows.select("file_path", "line", F.lit("2020-01-01").cast("timestamp").alias("written"))
    assert sorted(r.line for r in V.todos(rows, dates, F.lit("2024-01-01").cast("timestamp")).collect()) == [1, 2, 4]
