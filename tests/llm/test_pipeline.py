import os
import random
import struct
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    from fathom.llm.base import written

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    packed = written(corpus_pipeline.packing(spark, docs, FOLDER), "test")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, node string, _slot int, extra string, g long, _all string"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, copies, shared ids and clashing columns; labels; and empty tables."""
    from test_llm_operators import TEXTS

    rng = random.Random(23)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n))
    texts = [t for t in TEXTS if t is None or len(t) < 20_000]
    for k in range(200):
        texts.append(filler(30) + (" you moron, utterly worthless idiot " if k % 4 == 0 else " ") + filler(30))
    texts += [f"{filler(3)} user contact: m{k}@mail.example {filler(3)}" for k in range(12)] + [f"{filler(3)} user contact: AB-{k}77-X {filler(3)}" for k in range(6)]
    texts.append(filler(60_000))
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), "n", 1, "e", k, "a") for k, t in enumerate(texts)]
    rows += [(None, *rows[0][1:]), (None, None, None, None, None, None, None, None, None, None), rows[5], rows[5], (7, "another text of id seven", *rows[7][2:])]
    marks = [(k, 1, int("moron" in (t or ""))) for k, t in enumerate(texts)] + [(0, 1, 1), (None, 1, 1)]
    at = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(rows, AWKWARD).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    empty = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], AWKWARD).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    return str(at), str(empty), [tuple(r) for r in rows]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_empty_tables(spark, awkward):
    docs = spark.read.parquet(f"{awkward[1]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, awkward[1])
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_toxicity_keeps_what_the_scores_keep(spark, awkward):
    from fathom.llm import toxicity

    at, _, rows = awkward
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    automaton = toxicity.compile_terms(model.terms)

    def rejected(text):
        x = toxicity.features_of([text or ""], automaton, model)[0]
        return sum(a * b for a, b in zip(x, model.coefficients, strict=True)) >= 0

    kept = corpus_pipeline.toxicity(spark, docs, at).collect()
    assert plain(kept) == plain(r for r in rows if not rejected(r[1]))
    gone = [r for r in rows if rejected(r[1])]
    assert len(gone) >= 50 and all("moron" in r[1] or "idiot" in r[1] for r in gone)


def test_near_duplicates_against_all_pairs(spark, awkward):
    from test_llm_operators import components_of, union_find

    at, _, rows = awkward
    docs = spark.read.parquet(f"{at}/documents.parquet")
    places = {}
    for i, r in enumerate(rows):
        if r[0] is not None and (r[1] or "").split():
            places.setdefault(r[0], i)
    # a row without an id joins nothing, so groups are made of the other rows
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    again = dict(zip(named, components_of([rows[i][1] for i in named], 5, 80), strict=True))
    group = union_find([(i, named[again[i]]) for i in named] + [(i, places[rows[i][0]]) for i in named if (rows[i][1] or "").split()], len(rows))
    least = {}
    for i in named:
        least[group[i]] = min(least.get(group[i], rows[i][0]), rows[i][0])
    want = [r for i, r in enumerate(rows) if r[0] is None or least[group[i]] == r[0]]
    assert len(want) < len(rows) - 5
    assert plain(corpus_pipeline.near_duplicates(spark, docs, at).collect()) == plain(want)


def test_personal_data_against_the_spans(spark, awkward):
    from test_llm_operators import base_spans, bootstrapped

    at, _, rows = awkward
    distinct = list(dict.fromkeys((r[0], r[1] or "") for r in rows))
    more = dict(zip(distinct, bootstrapped([t for _, t in distinct]), strict=True))
    want = []
    for r in rows:
        marks = sorted([(int(a), int(b), k.upper()) for k, a, b in (x.split(":") for x in base_spans(r[1] or ""))] + [(a, b, k.upper()) for k, a, b in more[r[0], r[1] or ""]])
        text, out, last = r[1] or "", "", 0
        for a, b, k in marks:
            if a >= last:
                out += text[last:a] + f"[{k}]"
            last = max(last, b)
        out += text[last:]
        want.append((r[0], out, *r[2:4], len(out), *r[5:]) if marks else r)
    assert any("[ID]" in (r[1] or "") for r in want) and any("[SECRET]" in (r[1] or "") for r in want)
    assert plain(corpus_pipeline.personal_data(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()) == plain(want)


def test_mixing_and_packing_of_awkward_rows(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, _, rows = awkward
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert plain(corpus_pipeline.mixing(spark, docs, at).collect()) == plain(rows)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*coder.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    pieces = corpus_pipeline.packing(spark, docs, at).collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids))
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [sum(x.length for x in members[:k]) for k in range(len(members))]
        total = sum(r.length for r in members)
        assert total <= 4096 and total & (total - 1) == 0
    unique = {r[0]: x for r, x in zip(rows, ids, strict=True) if sum(o[0] == r[0] for o in rows) == 1}
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, x in unique.items():
        at_token = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at_token and r.doc_tokens == len(x) and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32
            at_token += r.length
        assert at_token == len(x)


def test_run_goes_on_from_finished_stages(spark, awkward, tmp_path, monkeypatch):
    at = awkward[0]
    want = plain(r[:3] for r in corpus_pipeline.run(spark, at).select("doc_id", "start", "length").collect())
    folder = str(tmp_path / "stages")
    calls = []
    counted = [(name, lambda s, docs, d, f=f, name=name: (calls.append(name), f(s, docs, d))[1]) for name, f in corpus_pipeline.STAGES]

    def broken(s, docs, d):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*counted[:2], ("personal_data", broken), *counted[3:]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, at, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    out = corpus_pipeline.run(spark, at, folder)
    assert calls == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert sum(r.length for r in out.collect()) == sum(r[2] for r in want)


def test_near_duplicates_keep_the_least_id(spark):
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(5, text, "x"), (3, text + " tail", "x"), (9, "something else altogether", "y"), (None, text, "z")], "doc_id long, text string, _gone string")
    assert sorted((r.doc_id or -1) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [-1, 3, 9]


def test_redaction_is_in_the_text(spark):
    docs = spark.createDataFrame([(1, "write to a.b@c.org now"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, "").collect()} == {1: "write to [EMAIL] now", 2: None}


def test_packing_follows_the_mixed_order_of_files_read_again(spark):
    from fathom.llm.base import written
    from fathom.llm.mixing import mix

    docs = spark.createDataFrame([(k, f"word {k} " * (400 if k >= 300 else 20), "hot" if k >= 300 else f"s{k % 3}") for k in range(1200)], "doc_id long, text string, source string").repartition(6)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packed = corpus_pipeline.packing(spark, written(corpus_pipeline.mixing(spark, docs, ""), "test"), "").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    slots = {r.doc_id: r.slot for r in mix(docs).collect()}
    parts = {}
    for r in packed:
        parts.setdefault(r.sequence_id >> 32, set()).add(slots[r.doc_id])
    order = sorted(parts)
    assert len(order) > 1 and {r.doc_id for r in packed} == set(slots)
    assert all(max(parts[a]) <= min(parts[b]) for a, b in zip(order, order[1:], strict=False))
