"""Posting search, fuzzy ranking, batch embeddings and migrations."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions.embedding import embed
from fathom.operators import codeindex as C
from fathom.operators import trigrams as T
from fathom.sources import migrate as M
from fathom.sources import schemas
from fathom.sources.store import Store


def test_posting_search_gives_what_the_scan_gives(spark, tmp_path):
    rng = random.Random(2)
    names = ["".join(rng.choices("abAB_é", k=rng.randint(1, 9))) for _ in range(300)] + ["", "a", "ab", "İab"]
    symbols = spark.createDataFrame([(k, k % 5, n, "function", k % 2 == 0, k) for k, n in enumerate(names)], "symbol_id long, file_id long, name string, kind string, exported boolean, line int")
    files = spark.createDataFrame([(k, 1, f"f{k}.ts") for k in range(5)], "file_id long, repo_id long, file_path string")
    T.name_postings(symbols).write.partitionBy("bucket").parquet(f"{tmp_path}/postings")
    postings = spark.read.parquet(f"{tmp_path}/postings")
    for query in ("a", "AB", "aba", "bAbé", "é", "a*b", "zzz", "abab"):
        want, got = (f(query) for f in (lambda q: C.search_symbols(symbols, files, q, 1000).collect(), lambda q: T.search_postings(postings, symbols, files, q, 1000).collect()))
        assert [r.symbol_id for r in got] == [r.symbol_id for r in want], query
    plan = T.search_postings(postings, symbols, files, "aba")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def aligned(path, query):
    low, want = path.lower(), query.lower()
    starts = [T.START if i == 0 or not path[i - 1].isalnum() or (path[i].isupper() and path[i - 1].islower()) else 0 for i in range(len(path))]
    best = [T.MATCH + starts[i] if c == want[0] else None for i, c in enumerate(low)]
    for letter in want[1:]:
        new = [None] * len(low)
        for i, c in enumerate(low):
            ways = [d + (T.RUN if j == i - 1 else 0) - (i - 1 - j) for j, d in enumerate(best[:i]) if d is not None]
            if c == letter and ways:
                new[i] = T.MATCH + starts[i] + max(ways)
        best = new
    return max((b for b in best if b is not None), default=None)


def test_fuzzy_ranking(spark):
    rng = random.Random(5)
    paths = ["src/server/handlers.ts", "src/hooks/serverHook.ts", "shv.ts", "src/sh/v.ts", "src/parser.ts", "docs/Shell-View.md", *("".join(rng.choices("sShHvV/._x", k=rng.randint(3, 25))) for _ in range(60))]
    df = spark.createDataFrame([(p,) for p in paths * 2], "file_path string")
    scores = {p: aligned(p, "shv") for p in set(paths)}
    want = sorted((p for p in scores if scores[p]), key=lambda p: (-scores[p], len(p), p))
    assert [(r.file_path, r.score) for r in T.ranked_files(df, "ShV", 100).collect()] == [(p, scores[p]) for p in want]
    few = spark.createDataFrame([(p,) for p in paths[:6]], "file_path string")
    assert [(r.file_path, r.score) for r in T.ranked_files(few, "shv", 3).collect()] == [("src/sh/v.ts", 75), ("shv.ts", 74), ("docs/Shell-View.md", 72)]
    with pytest.raises(ValueError):
        T.ranked_files(few, "")


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return np.array([[len(t), t.count("a")] for t in texts])

        return model

    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "aa", "old"), (2, "b", None), (3, "aa", None), (4, None, None), (5, "", None)], "id int, text string, embedding string")
    got = embed(rows, load, 2, store, batch=2)
    assert got.columns == ["id", "text", "embedding"] and {r.id: r.embedding and list(r.embedding) for r in got.collect()} == {1: [2.0, 2.0], 2: [1.0, 0.0], 3: [2.0, 2.0], 4: None, 5: [0.0, 0.0]}
    assert calls.value == 3
    more = embed(rows.unionByName(spark.createDataFrame([(6, "new a", None)], rows.schema)), load, 2, store)
    assert more.count() == 6 and calls.value == 4
    with pytest.raises(Exception, match="3 finite numbers"):
        embed(rows.withColumn("text", F.lit("other")), load, 3, store)
    assert store.read("embedding_cache").count() == 4


def tables(store):
    return {n: [(f.name, f.dataType.simpleString()) for f in store.read(n).schema.fields] for n in schemas.TABLES if store.current(n)}


def test_old_stores_become_what_fresh_ones_are(spark, tmp_path):
    clock = lambda: datetime(2024, 1, 2)
    fresh, old = Store(spark, f"{tmp_path}/fresh"), Store(spark, f"{tmp_path}/old")
    assert M.version(fresh) == 0 and M.migrate(fresh, clock) == [schemas.VERSION] and M.migrate(fresh, clock) == []
    old.write("solutions", spark.createDataFrame([("s1", "p", 0.7, "x")], "id string, problem string, score double, gone string"))
    old.write("background_jobs", spark.range(3))
    assert M.version(old) == 1
    chain = M.steps()

    def broken(store):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        M.migrate(old, clock, chain | {7: broken})
    assert M.version(old) == 6
    assert M.migrate(old, clock) == [7, 8, 9] and M.version(old) == schemas.VERSION
    assert tables(old) == tables(fresh) and set(tables(fresh)) == set(schemas.TABLES)
    kept = old.read("solutions").first()
    assert (kept.id, kept.problem, kept.score, kept.prerequisites, kept.failures) == ("s1", "p", 0.7, [], 0) and old.current("background_jobs") is None
    old.append("schema_version", spark.createDataFrame([(99, clock())], "version int, applied_at timestamp"))
    with pytest.raises(ValueError):
        M.migrate(old, clock)
