"""Each operator on a small folder of awkward documents, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
import xxhash
from compare import same
from pyspark.sql import functions as F

from fathom.llm import jaccard, licenses, media, mixing, packing, pii, sentences, simhash, suffixes, toxicity
from fathom.llm.graph import components
from fathom.llm.registry import oracle_sql, queries

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(rng, n, base="abcdefgh"):
    return ["".join(rng.choices(base, k=rng.randint(2, 5))) for _ in range(n)]


def make_texts():
    rng = random.Random(7)
    plain = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(40)]
    sent = [" ".join(" ".join(words(rng, 9)).capitalize() + "." for _ in range(12)) for _ in range(6)]
    passage = " ".join(" ".join(words(rng, 14)).capitalize() + "." for _ in range(5))
    near = []
    for k in range(6):
        w = plain[3].split() * 3
        w[5 * k + 7] = "changed"
        near.append(" ".join(w))
    odd = [
        None, "", " ", "a", "É İ K ñandú", "x" * 70_000, "1 " * 3000, "a." * 2000 + "@" + "b." * 2000, plain[0], plain[0], plain[3] + "\n" + plain[3],
        "Foo\n" + passage + "\nbar", "Baz " + plain[5] + "\n" + passage, "This work is licensed under the GNU General Public License, version 3.\nApache  License; CC-BY cc by",
        "mail me.x@y.example.com or 10.0.0.256 or 10.0.0.25, +1 (234) 567-8901, 4111 1111 1111 1111 and 4111111111111112", "token = \"" + "ab12" * 10 + "\" then", "you utter moron, idiot and scum", "he said \"idiot\" once",
    ]
    return plain + sent + near + odd


TEXTS = make_texts()


VECTORS = "vec_id long, embedding array<float>, label int"


def awkward_vectors():
    """Ties, repeated rows, a common label, nulls, components that are not finite, vectors of other lengths, a null id."""
    rng = random.Random(5)
    rows = [(k, [rng.randint(-3, 9) / 16 for _ in range(8)], 1 if k % 3 else rng.randrange(10)) for k in range(0, 400, 2)]
    rows += [rows[3], rows[3], rows[50], rows[50], (None, [0.5] * 8, 1), (None, [0.4] * 8, 2)]
    rows += [(1001, [0.5] * 7 + [None], 1), (1003, [0.5] * 7 + [float("nan")], 1), (1005, [float("inf")] * 8, 1), (1007, None, 1), (1009, [0.5] * 8, None), (1050, None, 2)]
    return rows + [(1100, [0.3] * 5, 1), (1101, [0.9] * 12, 1), (1102, [0.6] * 3, 2), (1150, [], 3), (1103, [], 3), (-50, [0.25] * 8, 1), (-7, [0.2] * 8, 9)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", f"s{k % 5}" if k % 7 else None, 0 if t is None else len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    marks = [(k, 1, int(k % 2)) for k in range(40)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(awkward_vectors(), VECTORS).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def rows_of(spark, name, folder):
    return {r["doc_id"]: r for r in queries()[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_no_rows(spark, name, empty):
    assert queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_gives_the_same(spark, name, folder):
    same(spark, queries()[name], oracle_sql()[name], folder)


def test_licenses(spark, folder):
    got = rows_of(spark, "op1_licenses", folder)
    k = next(i for i, t in enumerate(TEXTS) if t and "GNU" in t)
    assert got[k].base_labels == "apache,cc-by,gpl" and got[k].labels == "apache,cc-by,gpl,gpl-3.0" and got[k].n_base == 4 and got[k].score == 1.0
    assert got[TEXTS.index(None)].n_words == 0 and got[TEXTS.index(None)].first_word is None


def union_find(pairs, n):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, folder, size, percent):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("lang", "node")
    got = {r.doc_id: r for r in jaccard.link(docs, size, percent).collect()}
    sets = [set(x) for x in ([tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else [] for w in ((t or "").encode().lower().split() for t in TEXTS))]
    assert [got[i].component_id for i in range(len(TEXTS))] == components_of(TEXTS, size, percent)
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]


def test_rows_just_below_the_threshold_are_not_multiplied_by_the_square_of_their_group(spark, monkeypatch):
    rng = random.Random(7)
    base, texts = [f"w{k}" for k in range(504)], []
    for k in range(150):
        words = base[:]
        for at in rng.sample(range(504), 7):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    multiplied, links = [], jaccard._Join.links

    def counted(self, pairs, sets):
        multiplied.append(pairs.count())
        return links(self, pairs, sets)

    monkeypatch.setattr(jaccard._Join, "links", counted)
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    assert [got[k] for k in range(150)] == components_of(texts, 5, 80)
    assert sum(multiplied) < 20 * len(texts), multiplied  # of 11175 pairs


def test_pairs_across_are_sent_once_a_bucket_without_refuted_classes():
    import pyarrow as pa

    n, groups = 12, 30
    each = [np.arange(1, 101, dtype=np.uint64) * np.uint64(977)] * n
    rows = {"group": np.repeat(np.arange(groups), n), "first": np.tile(np.arange(n), groups), "a": np.tile(np.arange(n) + 100, groups), "n": np.full(n * groups, 100), "component": np.tile(np.arange(n), groups)}
    sketches = pa.array([jaccard.sketch(x) for x in each] * groups, pa.binary())
    refuted = pa.array(([[{"first": 1, "a": 101}, {"first": 2, "a": 999}], [{"first": 0, "a": 100}]] + [None] * (n - 2)) * groups, pa.list_(pa.struct([("first", pa.int64()), ("a", pa.int64())])))
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"sketch": sketches, "refuted": refuted})
    got = jaccard._across(80, 1 << 16)(table).to_pylist()
    pairs = [(r["lf"], r["rf"]) for r in got]
    assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n) if (i, j) != (0, 1)]  # another class of a refuted row's id stays


def test_a_large_component_does_not_cut_off_the_pairs_of_small_ones():
    import pyarrow as pa

    singles, quota = 30, 4  # each is near both rows of one large component
    first = np.array([x for k in range(singles) for x in (0, 1, 2 + k)])
    group = np.repeat(np.arange(singles), 3)
    rows = {"group": group, "first": first, "a": first + 100, "n": np.full(len(first), 100), "component": np.where(first < 2, 0, first), "bucket": np.full(len(first), 5)}
    sketches = pa.array([jaccard.sketch(np.arange(1, 101, dtype=np.uint64) * np.uint64(977))] * len(first), pa.binary())
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"sketch": sketches, "refuted": pa.nulls(len(first), pa.list_(pa.struct([("first", pa.int64()), ("a", pa.int64())])))})
    got = jaccard._across(80, quota)(table).to_pylist()
    assert sorted((r["lf"], r["rf"]) for r in got) == [(x, 2 + k) for x in (0, 1) for k in range(singles)]
    assert {(r["bucket"], r["joins"]) for r in got} == {(5, False)}  # nothing was held back, so no round need follow
    assert [(r["lf"], r["rf"], r["joins"]) for r in jaccard._across(80, 1)(table).to_pylist()] == [(0, 2 + k, True) for k in range(singles)]


def test_a_round_follows_only_where_a_refuted_pair_had_joined(spark, monkeypatch):
    rng = random.Random(5)
    base, texts = [f"w{k}" for k in range(504)], []
    for k in range(40):
        words = base[:]
        for at in rng.sample(range(504), 7):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    seen, across = [], jaccard._Join.across

    def counted(self, rows, labels, *args):
        out = across(self, rows, labels, *args)
        seen.append((rows.select("bucket").distinct().count(), out[0].where("joins").select("bucket").distinct().count()))
        return out

    monkeypatch.setattr(jaccard._Join, "across", counted)
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    assert [got[k] for k in range(40)] == components_of(texts, 5, 80)
    assert len(seen) < 4 and all(now <= before for (_, before), (now, _) in zip(seen, seen[1:], strict=False)), seen


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from fathom.llm.base import written

    dirs = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(p) for d in dirs for p in Path(d).glob("*/shuffle_*.data")}
    before = files()
    counts = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(map(tuple, counts.collect())) == [(k, 100) for k in range(10)]


def test_products_and_sketch_bounds_against_intersections():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[rng.random(300) < rng.choice([0.9, 0.95, 0.99])], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(30)]
    sets += [np.empty(0, np.uint64), base[:1], base[:2], np.unique(base)]
    sets += [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (700, 3000, 40_000)]
    sets += [np.unique(np.append(x[:-20], np.uint64(7))) for x in sets[-3:]]
    i, j = np.triu_indices(len(sets), 1)
    size = np.array([len(x) for x in sets])
    sketches = jaccard.Sketches(list(map(jaccard.sketch, sets)))
    apart = sketches.apart(i, sketches, j)
    assert all(a <= len(np.setxor1d(sets[x], sets[y])) for a, x, y in zip(apart, i, j, strict=True)) and apart.max() > 1000
    for percent in (50, 80, 90):
        want = []
        for a, b in zip(i, j, strict=True):
            inter = len(np.intersect1d(sets[a], sets[b]))
            want.append(100 * inter >= percent * (size[a] + size[b] - inter))
        assert jaccard.linked_pairs([sets[k] for k in i], [sets[k] for k in j], percent).tolist() == want
        assert (jaccard.may_link(size[i], size[j], apart, percent) >= np.array(want)).all()


def components_of(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return union_find(links, len(sets))


def test_chains_of_near_copies_are_joined(spark, monkeypatch):
    """Neighbours of a chain are alike and its ends are not, so that stars alone do not join it; and many small sets."""
    rng = random.Random(3)
    texts = []
    for length in (30, 12):
        w = words(rng, 120)
        for k in range(length):
            w[(7 * k) % 120] = f"new{length}x{k}"
            texts.append(" ".join(w))
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(80)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, first int")
    monkeypatch.setattr(jaccard, "ROWS_A_BLOCK", 3)
    for size, percent in ((3, 90), (2, 80)):
        got = {r.doc_id: r.component_id for r in jaccard.link(docs, size, percent).collect()}
        assert [got[k] for k in range(len(texts))] == components_of(texts, size, percent)


def test_rows_that_share_an_id_are_linked(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (7, c), (None, a), (8, None), (6, " ")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.link(docs, 3, 90).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (7, 7), (None, None), (8, 8), (6, 6)}
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs, 3, 90).collect()) == ["1", "6", "7", "8", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10 != 9]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(51) if i != 50 or False}


def spans_of(text):
    """The spans of a text by definition: of all runs of sentences that are long enough, those that are shortest at their start or end."""
    parts = [p.split() for p in sentences.sentences(text)]
    n = len(parts)
    good = [(a, b) for a in range(n) for b in range(a + 2, n + 1) if sum(map(len, parts[a:b])) >= 15]
    found = {min(x for x in good if x[0] == a) for a, _ in good} | {max(x for x in good if x[1] == b) for _, b in good if parts[b - 1]}
    if not found and sum(map(bool, parts)) >= 2:
        found = {(0, n)}
    if n and not parts[-1]:
        found = {(a, n if b == n - 1 else b) for a, b in found}
    return {(a, b): " | ".join(" ".join(p) for p in parts[a:b] if p) for a, b in found}


def test_sentences(spark, folder):
    got = rows_of(spark, "op4_sentences", folder)
    first = {}
    for i, t in enumerate(TEXTS):
        assert "".join(sentences.sentences(t or "")) == (t or "")
        for (a, _), s in sorted(spans_of(t or "").items()):
            first.setdefault(s, (i, a))
    for i, t in enumerate(TEXTS):
        parts = sentences.sentences(t or "")
        gone = [any(first[s] != (i, a) and a <= k < b for (a, b), s in spans_of(t or "").items()) for k in range(len(parts))]
        runs = sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))
        kept = "".join(p for p, x in zip(parts, gone, strict=True) if not x)
        assert (got[i].n_sentences, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(parts), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    both = [i for i, t in enumerate(TEXTS) if t and "\nbar" in t or t and t.startswith("Baz")]
    assert got[both[0]].n_removed == 0 and got[both[1]].n_removed >= 4


def test_repeated_runs_of_sentences_go_to_both_ends(spark):
    rng = random.Random(13)

    def sentence(n):
        return " ".join(words(rng, n)) + ". "

    for _ in range(300):  # brute force: every run that qualifies is covered by spans within it
        parts = [sentence(rng.choice([1, 3, 8, 14, 20, 31])) for _ in range(rng.randint(1, 8))]
        found = sentences.spans([p.split() for p in parts])
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if sum(len(p.split()) for p in parts[a:b]) >= 15:
                    assert {k for x, y in found if a <= x and y <= b for k in range(x, y)} == set(range(a, b))
    run, copy, after_long = [sentence(20), sentence(8), sentence(4)], [sentence(12), sentence(9), sentence(2)], [sentence(35), sentence(5)]
    short, single = "Two words. And three more.", sentence(40)
    texts = [["", *run, sentence(9)], [sentence(7), *run, sentence(11)], copy, copy, [*after_long, sentence(8)], [*after_long, sentence(6)], [short], [short], [short + " \n \n"], [sentence(3)], [single], [single], [sentence(6), sentence(5), *run, sentence(3), *run]]
    docs = spark.createDataFrame([(k, "".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.dedup(docs).collect()}
    wanted = {k: "".join(t) for k, t in enumerate(texts)} | {1: texts[1][0] + texts[1][-1], 3: "", 5: texts[5][-1], 7: "", 8: "", 12: texts[12][0] + texts[12][1] + texts[12][5]}
    assert got == wanted  # a single sentence is no run of several, however long


def test_sentences_of_shared_and_null_ids(spark):
    rng = random.Random(14)
    text = "".join(" ".join(words(rng, 12)) + ". " for _ in range(3))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (5, text + "More. "), (7, text)], "doc_id long, text string")
    assert sorted(r.text for r in sentences.dedup(docs).collect()) == sorted([text, "", "", "More. ", ""])


def test_sentence_dedup_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("lang", "d").withColumnRenamed("n_chars", "k")
    out = sentences.dedup(docs)
    assert out.schema == docs.schema and out.count() == len(TEXTS)


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_media_round_trip(spark, folder, codec):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in media.read_payloads(media.store_payloads(docs, codec)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].codec) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), codec)


def expanded(code, law):
    """One sample by the definition of G.711, bit by bit."""
    if law == "mulaw":
        code = ~code & 0xFF
        size = ((2 * (code % 16) + 33) * 2 ** (code // 16 % 8) - 33) * 4
        return -size if code >= 128 else size
    code ^= 0x55
    part, low = code // 16 % 8, code % 16
    size = (2 * low + 1) * 8 if part == 0 else (2 * low + 33) * 2 ** (part + 2)
    return size if code >= 128 else -size


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_stored_pcm_against_one_sample_at_a_time(spark, tmp_path, codec):
    texts = ["hello telephone", None, "é" * 100, "x" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pcm", F.lit(1)).withColumn("rate", F.lit("clash"))
    got = {r.doc_id: r for r in media.store_pcm(docs, str(tmp_path / "pcm"), codec).collect()}
    figures = {r.doc_id: r for r in media.read_payloads(media.store_payloads(docs, codec)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b"\0" * (-len(raw) % 64 if raw else 64)
        plain = media.decode_adpcm(raw).ravel().tolist() if codec == "adpcm" else [expanded(c, codec) for c in raw]
        want = []
        for k in range(2 * len(plain)):
            a, b = plain[k // 2], plain[min(k // 2 + 1, len(plain) - 1)]
            want.append(a if k % 2 == 0 else (8000 * a + 8000 * b) // 16000)
        assert (got[i].rate, got[i].samples, got[i].codec) == (16000, len(want), codec)
        assert np.frombuffer(got[i].pcm, "<i2").tolist() == want
        assert media.parse_wav(got[i].media)[2] == raw
        peak, square, turns = max(map(abs, want)), sum(x * x for x in want) // len(want), sum((a < 0) != (b < 0) for a, b in zip(want, want[1:], strict=False))
        assert figures[i].feature == f"16000:{len(want)}:{peak}:{square}:{turns}"
        assert (figures[i].pcm_sha256, figures[i].media_sha256) == (hashlib.sha256(got[i].pcm).hexdigest(), hashlib.sha256(got[i].media).hexdigest())


def test_damaged_media_give_nulls(spark, monkeypatch):
    good = media.wav("mulaw", b"a" * 64)
    rows = [(1, 1, bytearray(good)), (2, 1, None), (3, 1, bytearray(good[:-1])), (4, 1, bytearray(b"junk"))]
    got = {r.doc_id: r for r in media.read_payloads(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].payload_bytes == 64 and all(got[k].feature is None and got[k].payload_sha256 is None and got[k].pcm_samples is None for k in (2, 3, 4))
    sound = np.random.default_rng(3).integers(-32768, 32768, 5000).astype(np.int16)
    whole = media.describe(sound, 8000), media.resample(sound, 8000, 16000).tolist(), media.decode_adpcm(sound.tobytes()[:6400]).tolist()
    monkeypatch.setattr(media, "SLICE", 300)
    assert whole == (media.describe(sound, 8000), media.resample(sound, 8000, 16000).tolist(), media.decode_adpcm(sound.tobytes()[:6400]).tolist())


def test_telephony_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def test_adpcm_against_one_sample_at_a_time():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 64 * 20, dtype=np.uint8).tobytes()
    out = media.decode_adpcm(data)
    for b in range(20):
        block = data[64 * b : 64 * b + 64]
        sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        want = [sample]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample + (-change if code & 8 else change)))
                index = max(0, min(88, index + (2 * (code & 3) + 2 if code & 4 else -1)))
                want.append(sample)
        assert out[b].tolist() == want
    tone = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = media.decode_adpcm(media.encode_adpcm(tone)).ravel()[:2000]
    assert np.abs(back.astype(int) - tone)[200:].mean() < 300
    assert media.parse_wav(b"junk") is None and len(media.resample(tone, 8000, 16000)) == 4000


def luhn(digits):
    doubled = [2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def bootstrapped(texts, confidence=0.4, support=3):
    """The method's spans of each text, one string at a time: (kind, start, end)."""
    around = []
    for t in texts:
        own, base = [], [(int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(t))]
        found = [(a, b, True) for a, b in base] + [(m.start(), m.end(), False) for m in re.finditer(r"(?<!\S)(?=\S{5})(?=\S*?[0-9])\S+", t)]
        for a, b, seed in found:
            core = regex.sub(r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "", t[a:b])
            if len(core) < 5:
                continue
            at = a + t[a:b].index(core)
            left = t[max(0, a - 48) : a]
            left = re.sub(r"^\S*", "", left) if len(left) == 48 else left
            left = re.sub("[0-9]+", "#", left.lower()).split()
            # what follows a string ends where the next one of its kind begins
            stops = [x for x, _, s in found if x >= b and s == seed and (not seed or base_kind(t, x, base) == base_kind(t, a, base))]
            after = re.match(r"\s*(\S*[^\W\d_]\S*)\s", t[b : min([b + 48, *stops])].lower())
            patterns = {" ".join(left[-2:]) + " _" if len(left) > 1 else None, left[-1] + " _" if left else None, f"{left[-1]} _ {re.sub('[0-9]+', '#', after[1])}" if left and after else None}
            patterns = {p for p in patterns if p and regex.search(r"\p{L}", p)}
            secret = not seed and re.fullmatch("[0-9a-fA-F]{32,}", core) is not None
            own.append((at, at + len(core), core, patterns, seed or secret, secret))
        around.append((own, base))
    plain = [re.sub("[0-9]+", "#", t.lower()).split() for t in texts]
    total, near = Counter(w for ws in plain for w in ws), Counter(w for own, _ in around for _, _, _, patterns, _, _ in own for w in {w for p in patterns for w in p.split()} - {"_"})
    telling = {w for w in near if near[w] >= 0.05 * total[w]}
    graph, seeds = {}, {core for own, _ in around for _, _, core, _, seed, _ in own if seed}
    for own, _ in around:
        for _, _, core, patterns, _, _ in own:
            for p in patterns:
                if telling & set(p.split()):
                    graph.setdefault(p, set()).add(core)
    trusted, accepted = seeds, set()
    while True:
        now = {p for p, v in graph.items() if len(v & trusted) >= support and round(len(v & trusted) / len(v) * (1 - 1 / (1 + len(v))), 9) >= confidence}
        done, accepted = len(now) == len(accepted), now
        if done:
            break
        trusted = seeds.union(*(graph[p] for p in accepted))
    out = []
    for own, base in around:
        hits = {("secret", a, b) for a, b, _, _, _, secret in own if secret} | {("id", a, b) for a, b, _, patterns, _, secret in own if not secret and patterns & accepted}
        out.append({(k, a, b) for k, a, b in hits if not any(x < b and a < y for x, y in base)})
    return out


def base_kind(text, start, base):
    return next((k for k in ("email", "ip", "card", "phone") for x in base_spans(text) if x.startswith(f"{k}:{start}:")), None)


def test_pii(spark, folder):
    got = rows_of(spark, "op6_pii", folder)
    for i, (t, more) in enumerate(zip(TEXTS, bootstrapped([t or "" for t in TEXTS]), strict=True)):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        listed = [f"{k}:{a}:{b}" for kind in ("secret", "id") for k, a, b in sorted(more) if k == kind]
        assert got[i].spans == ",".join(want + listed), t[:80]
        assert got[i].n_secret == sum(k == "secret" for k, _, _ in more)


def make_identifiers():
    """Texts in which mail addresses stand behind one phrase, account numbers behind it and another, badge numbers behind that
    and a third; and numbers that are no identifiers."""
    rng = random.Random(17)
    name = lambda k: "".join(rng.choices("ABCDEFGHJK", k=2)) + f"-{rng.randint(1000, 9999)}-{k}"
    filler = lambda: " ".join(words(rng, rng.randint(1, 6)))
    accounts, badges, out = [name(k) for k in range(40)], [name(100 + k) for k in range(40)], []
    for k in range(60):
        out.append((f"{filler()} user contact: m{k}@mail.example {filler()}", []))
        out.append((f"{filler()} built in {1000 + rng.randint(0, 9999)} {filler()}", []))
    for k, x in enumerate(accounts):
        out.append((f"{filler()} user contact: {x} {filler()}" if k < 25 else f"{filler()} account holder {x} {filler()}", [x]))
        if k < 25:
            out.append((f"{filler()} account holder {x} {filler()}", [x]))
    for k, x in enumerate(badges):
        out.append((f"{filler()} badge id {x} {filler()}", [x]))
        if k < 18:
            out.append((f"{filler()} account holder {x}, {filler()}", [x]))
    return out


def test_pii_bootstrapping_finds_unseen_identifiers(spark):
    cases = make_identifiers()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: {t for t in (cases[r.doc_id][0][e.start : e.end] for e in r.extra)} for r in pii.with_extra(pii.found_in(docs), docs).collect()}
    planted = [(k, x) for k, (_, xs) in enumerate(cases) for x in xs]
    assert sum(x in got[k] for k, x in planted) >= 0.9 * len(planted)  # recall, over three steps of bootstrapping
    assert not any(got[k] for k, (_, xs) in enumerate(cases) if not xs)
    want = bootstrapped([t for t, _ in cases])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in enumerate(want)}


def test_words_that_stand_anywhere_tell_nothing(spark):
    """Cards and numbers that are none between the same function words; and account numbers behind a word that tells them."""
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choices(["in", "the", "of", "and", *words(rng, 4)], k=300))
    cards = [f"{filler()} in 4111 1111 1111 1111 the {filler()}" for _ in range(3)] + [f"{filler()} in {c} the {filler()}" for c in ("4111111111111111", "5500005555555559", "4012888888881881", "340000000000009")]
    none = [f"{filler()} in {c} the {filler()}" for c in ("4111111111111112", "5500005555555558", "4012888888881882")]
    known = [f"{filler()} cardno {c} and {filler()}" for c in ("4111111111111111", "5500005555555559", "4012888888881881")]
    docs = spark.createDataFrame(list(enumerate([*cards, *none, *known, f"{filler()} cardno 99123-X and {filler()}"])), "doc_id long, text string")
    got = {r.doc_id: [e.kind for e in r.extra] for r in pii.with_extra(pii.found_in(docs), docs).collect()}
    assert {k: v for k, v in got.items() if v} == {13: ["id"]}


def test_pii_redacts_secrets_and_discovered_identifiers(spark):
    secret = "0a" * 20
    seeds = [(k, f"text {k} user contact: a{k}@b.example and more") for k in range(20)]
    unseen = [(100, "here user contact: ZX-9981-Q ok"), (101, "no contact here 12345"), (102, f'token = "{secret}" and 1.2.3.4'), (103, None)]
    docs = spark.createDataFrame(seeds + unseen, "doc_id long, text string").withColumn("extra", F.lit("clash")).withColumn("h", F.lit(1))
    got = pii.redact(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert [texts[k] for k in (0, 100, 101, 102, 103)] == ["text 0 user contact: [EMAIL] and more", "here user contact: [ID] ok", "no contact here 12345", 'token = "[SECRET]" and [IP]', None]


def without_repeats(texts):
    """Brute force, by ids in order: bytes, removed bytes, runs and digest of each text."""
    raws, first, out = [(t or "").encode() for t in texts], {}, []
    for i, raw in enumerate(raws):
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, raw in enumerate(raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        gone = gone[: len(raw)]
        kept = bytes(c for c, x in zip(raw, gone, strict=True) if not x)
        runs = sum(bool(x) and not (j and gone[j - 1]) for j, x in enumerate(gone))
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes(spark, folder):
    got = rows_of(spark, "op7_suffixes", folder)
    for i, want in enumerate(without_repeats(TEXTS)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_suffixes_leave_no_records_behind(spark):
    from pathlib import Path

    kept = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("fathom-*") if p.name.split("-")[1] in ("wanted", "records", "settled")}
    before = kept()
    docs = spark.createDataFrame([(k, "x%d " % k + "a passage that comes in all of these texts, and is long enough to go " * 3) for k in range(20)], "doc long, text string")
    _, runs = suffixes.repeated_starts(docs)
    assert runs.count() == 19 and kept() == before


def test_suffixes_with_hot_leads_across_buckets(spark):
    """A passage of 60 bytes in most documents, each time in other surroundings: its leads are cut and compared across buckets."""
    rng = random.Random(21)
    passage = "".join(rng.choices("abcdef ", k=60))
    texts = ["".join(rng.choices("ghijkl ", k=rng.randint(0, 90))) + passage[rng.randint(0, 8) :] + "".join(rng.choices("mnopqr ", k=rng.randint(0, 90))) for _ in range(150)]
    texts[20:24] = [texts[3]] * 3 + ["é" * 26 + passage]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, text string").repartition(5)
    _, runs = suffixes.repeated_starts(docs, chunk=7, range_bytes=1000)
    lost = {r.doc: r.lost for r in runs.collect()}
    copies = {20, 21, 22}
    for i, (n, gone, _, _) in enumerate(without_repeats(texts)):
        if i not in copies:
            assert int(suffixes.lost_bytes(n, lost.get(i), 50).sum()) == gone, i


def test_anchors_do_not_depend_on_the_pieces():
    rng = random.Random(8)
    raws = ["".join(rng.choices("ab", k=n)).encode() for n in (3000, 49, 50, 700)]

    def starts(size):
        out = {}
        for group in suffixes.pieces(raws, 50, size):
            for row, at, first, last, h in zip(*(x.tolist() for x in suffixes.anchors(group)), strict=True):
                out |= {(row, p): (at, h) for p in range(first, last + 1)}
        return out

    whole = starts(1 << 20)
    assert set(whole) == {(r, p) for r, raw in enumerate(raws) for p in range(len(raw) - 49)}
    assert starts(64) == starts(333) == whole


def test_groups_of_equals():
    words_ = np.array([[1, 2], [1, 3], [1, 2], [5, 5], [1, 3]], np.uint64)
    g = suffixes.groups_of_equals(words_)
    assert g[0] == g[2] >= 0 and g[1] == g[4] >= 0 and g[0] != g[1] and g[3] == -1


def test_automaton_accepts_what_is_near():
    terms = [("moron", True), ("disgusting", True), ("lowei", False), ("scum", True)]
    auto = toxicity.compile_terms(terms)

    def run(word):
        state = 1
        for c in word:
            state = auto.moves[state, ord(c) - 97 if "a" <= c <= "z" else 26]
        return (int(auto.term[state]), int(auto.edits[state])) if auto.term[state] >= 0 else None

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        term = rng.choice(terms)[0]
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choices("abmorn1", k=rng.randint(0, 1))
        w = "".join(w)
        near = [distance(w, t) for t, whole in terms if whole and distance(w, t) <= toxicity.edits_for(t, whole)] + [0] * w.startswith("lowei")
        assert (run(w) or (0, None))[1] == (min(near) if near else None), w


def test_lexicon_with_too_many_states_loses_edits():
    terms = [("disgusting", True), ("moron", True), ("scum", True)]
    auto = toxicity.compile_terms(terms, most_states=60)
    assert len(auto.moves) <= 60
    assert [(w, e) for _, _, w, e, _ in toxicity.hits_of(["disgusting moron scum disgustin"], auto)] == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0)], [(1, 1), (2, 0)], [(None, 1), (2, None)]])
def test_without_labels_of_both_kinds_all_documents_stay(spark, marks):
    docs = spark.createDataFrame([(1, "you utter moron", 1), (2, None, 2), (3, "clean words", 3), (None, "", 4)], "doc_id long, text string, score long")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4


def test_toxicity_learns_and_uses_no_labels(spark, tmp_path):
    rng = random.Random(11)
    docs, marks = [], []
    for k in range(600):
        w = words(rng, 40)
        bad = k % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(40)] = rng.choice(["moron", "worthless", "idiot"])
        docs.append((k, " ".join(w), "en", "s", 1))
        marks.append((k, 1, int(bad)))
    docs += [(1000, "you are a wortless fool and an idiott", "en", "s", 1), (1001, None, "en", "s", 1)]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    got = rows_of(spark, "op8_toxicity", at)
    held = [k for k, _, _ in marks if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held)
    assert sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.97 * len(held)
    assert got[1000].score > 0.5 > got[1001].score


def test_toxicity_learns_words_with_letters_beyond_ascii(spark):
    rng = random.Random(12)
    bad = ["véreux", "идиот", "dégoûtant"]
    docs, marks = [], []
    for k in range(600):
        w = words(rng, 40, "abcdeéèо")
        for _ in range(3 * (k % 4 == 0)):
            w[rng.randrange(40)] = rng.choice(bad)
        docs.append((k, " ".join(w)))
        marks.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {w for w, _ in model.terms} == set(bad)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.97 * len(held)
    auto = toxicity.compile_terms(model.terms)
    texts = ["«Идиот…» VÉREUX—véreus 𝐀é", "vreux est dégoutant"]
    found = [(row, model.terms[term][0], edits) for row, _, term, edits, _ in toxicity.hits_of(texts, auto)]
    assert found == [(0, "идиот", 0), (0, "véreux", 0), (0, "véreux", 1), (1, "véreux", 1), (1, "dégoûtant", 1)]


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    rows = queries()["op9_packing"](spark, folder).collect()
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_step_groups_are_balanced_and_tiers_need_no_padding():
    rng = random.Random(31)
    packer = packing.Packer(4096, (512, 1024, 2048, 4096), 0, 8, 4)
    want = {}
    for k in range(600):
        n = rng.choice([1, 2, 40, 300, 700, 1500, 3000, 4096, 9000])
        want[k] = np.full(n, k, "<u4")
        packer.add(k, want[k].tobytes())
    packer.finish()
    rows = packer.rows
    groups, sequences, pieces = {}, {}, {}
    for doc, start, n, crc, total, seq, offset, tier, group in rows:
        sequences.setdefault(seq, []).append((offset, n, tier, group))
        pieces.setdefault(doc, []).append((start, n))
        assert total == len(want[doc]) and crc == zlib.crc32(np.full(n, doc, "<u4").tobytes())
    for members in sequences.values():
        size = sum(n for _, n, _, _ in members)
        assert size & (size - 1) == 0 and size <= members[0][2] and len({(t, g) for _, _, t, g in members}) == 1
        groups[members[0][3]] = groups.get(members[0][3], 0) + size
    assert sum(size != 4 * 4096 for size in groups.values()) <= 4 and max(groups.values()) == 4 * 4096
    for doc, found in pieces.items():
        assert sum(n for _, n in found) == len(want[doc]) and [s for s, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))]


def test_pieces_of_equal_hashes_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, own = Tokenizer.from_file(path), packing.Encoder(path)
    monkeypatch.setattr(own, "_hash", lambda a, starts, ends: (ends - starts).astype(np.uint64))
    text = "several words of equal length, other words too"
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, own = Tokenizer.from_file(path), packing.Encoder(path)
    texts = [t or "" for t in TEXTS] + ["it's DON'T we'll 's", "<|endoftext|> <|X|>", "ΣΑΣ ΟΔΟΣ", "a1b22 c-d --e__f 3.14!!", "é ñ ½ ² ª º × ÷", "　x y z", "日本語 テスト", "🙂🙂 ok", "À́b"]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids, t[:60]


def plain_fingerprint(text):
    found = re.findall("[a-z0-9]+", text.lower())
    pairs = list(zip(found, found[1:], strict=False)) or [(w, None) for w in found]
    hashes = []
    for a, b in pairs:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        hashes.append(h if b is None else xxhash.xxh64_intdigest(b.encode(), h))
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_of_any_ids(spark, tmp_path):
    ids = [2**63 - 1, -(2**63), 0, 7, 7, 7, None, None, 40]
    texts = ["one two three four", "five six", "seven", "eight nine", "ten eleven twelve", "eight nine", None, "thirteen", "one two three four"]
    at = str(tmp_path)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("n", F.lit(1))
    docs.write.parquet(f"{at}/documents.parquet")
    got = queries()["op10_simhash"](spark, at).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((False, i, len(t or "")) for i, t in zip(ids, texts, strict=True) if i is not None)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert len(by[7, 10]) == 2 and by[7, 10][0] == by[7, 10][1]
    assert by[2**63 - 1, 18][0].edited_sha256 == hashlib.sha256(b"one two threone tw").hexdigest()
    assert by[40, 18][0].n_near == 2 and by[0, 5][0].n_near == 1 and by[7, 10][0].n_near is None
    last = {r.n_chars: r.edited_sha256 for r in got if r.doc_id is None}
    assert last[8] in {hashlib.sha256(x).hexdigest() for x in (b"thirteon", b"thirte")}


def test_simhash(spark, folder):
    got = rows_of(spark, "op10_simhash", folder)
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, i in enumerate(order):
        t, follower = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + follower[:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        j = order[(k + 1) % len(order)]
        apart = bin(int(got[i].fingerprint, 16) ^ int(got[j].fingerprint, 16)).count("1")
        assert got[i].near_next == pytest.approx(1 - apart / 64)
        if (t + edited).isascii():
            assert int(got[i].fingerprint, 16) == plain_fingerprint(t) and int(got[i].edited_fingerprint, 16) == plain_fingerprint(edited)
            apart = bin(plain_fingerprint(t) ^ plain_fingerprint(edited)).count("1")
            assert got[i].near_edited == pytest.approx(1 - apart / 64)
        within = sum(bin(int(got[i].fingerprint, 16) ^ int(r.fingerprint, 16)).count("1") <= 3 for r in got.values())
        assert got[i].n_near == (within if i % 20 == 0 else None)
    same_texts = [i for i, t in enumerate(TEXTS) if t == TEXTS[0]]
    assert len(same_texts) == 3 and len({got[i].fingerprint for i in same_texts}) == 1


def test_hamming_neighbours(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.query_fp, r.fp, r.distance) for r in simhash.neighbours(df, df.limit(40), 3).collect()}
    asked = {r.fp for r in df.limit(40).collect()}
    want = {(a, b, d) for a in asked for b in set(signed) if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3}
    assert got == want


def lags_stay_below_one(slots, weights):
    """``slots``: source by slot. In each phase, counts stay less than one from the exact targets of the sources with blocks left."""
    left = {s: slots.count(s) for s in weights}
    start = 0
    while start < len(slots):
        active = {s for s, n in left.items() if n}
        total, count = sum(weights[s] for s in active), dict.fromkeys(active, 0)
        for t in range(start, len(slots)):
            count[slots[t]] += 1
            for s in active:
                assert abs(count[s] - Fraction(weights[s], total) * (t + 1 - start)) < 1
            left[slots[t]] -= 1
            if not left[slots[t]]:
                break
        start = t + 1


@pytest.mark.parametrize("weights", [{"a": Fraction(1, 3), "b": Fraction(2, 3)}, {"a": 0.7, "b": 0.0001, "c": 0.2999}, {"a": 5, "b": 3, None: 2}, None, {"a": 0.5, "c": 0.5}])
def test_schedule_stays_within_a_block(weights):
    sizes = {"a": 400, "b": 170, "c": 90, None: 3}
    whole_shares = mixing.shares(sizes, weights)
    made = mixing.schedule(whole_shares, sizes)
    slots = {t: s for s, v in made.items() for t in v}
    live = {s: w for s, w in whole_shares.items() if w}
    assert sorted(slots) == list(range(sum(sizes[s] for s in live)))
    assert all(len(made[s]) == (sizes[s] if s in live else 0) and made[s] == sorted(made[s]) for s in sizes)
    lags_stay_below_one([slots[t] for t in range(len(slots))], live)


def test_shares():
    assert mixing.shares({"a": 1, "b": 1}, {"a": 0.75, "b": 0.25}) == {"a": 3, "b": 1}
    assert mixing.shares({"a": 1, "b": 9, "c": 7}, {"a": Fraction(1, 2), "x": 9}) == {"a": 2, "b": 1, "c": 1}
    assert mixing.shares({"a": 1, "b": 1}, {"a": 1, "b": 0}) == {"a": 1, "b": 0}
    assert mixing.shares({}, None) == {}
    with pytest.raises(ValueError):
        mixing.shares({"a": 1}, {"a": -1})


def test_mixing_keeps_all_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("lang", "slot").withColumnRenamed("n_chars", "block")
    out = mixing.mixed(docs, block=2, range_rows=7)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(len(TEXTS)))
    for most in (1 << 18, 10):
        rows = mixing.mix(docs, block=2, range_rows=7, most_slots=most).collect()
        size = max(2, -(-len(TEXTS) // most))
        assert len({(r.slot, r.place) for r in rows}) == len(rows) == len(TEXTS)
        sizes = {}
        for s in {r.source for r in rows}:
            own = sorted((r.block, r.place) for r in rows if r.source == s)
            assert own == [(k // size, k % size) for k in range(len(own))]
            sizes[s] = len(own)
        by_slot = {r.slot: r.source for r in rows}
        assert sorted(by_slot) == list(range(len(by_slot)))
        lags_stay_below_one([by_slot[t] for t in range(len(by_slot))], mixing.shares(sizes, None))
    order = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs, block=2).collect()}
    got = [r.doc_id for r in mixing.mixed(docs, block=2).collect()]
    assert got == sorted(got, key=order.__getitem__)


def test_mixing_of_repeated_rows_null_ids_and_weight_zero(spark):
    rows = [(1, "a", "t")] * 7 + [(None, "a", None)] * 5 + [(None, None, "u")] * 3 + [(4, "b", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _all string")
    got = mixing.mix(docs, {"a": 1, "b": 0}, block=3).collect()
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, ((a, b) for a, b, _ in rows)))
    assert {r.slot for r in got if r.source == "b"} == {None} and len({(r.slot, r.place) for r in got if r.source == "a"}) == 12
    out = mixing.mixed(docs, {"a": 1, "b": 0}, block=3)
    assert out.columns == docs.columns and out.collect()[-1].source in ("b", None) and out.count() == len(rows)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few awkward texts, one of them very long, without and with further columns whose names operators use themselves."""
    rng = random.Random(41)
    long = "\n".join(" ".join(words(rng, 40)) + ". " for _ in range(3000)) + " 12345 a1b2c " * 2000
    texts = [None, "", "x", *TEXTS[:4], TEXTS[-1], TEXTS[-2], TEXTS[-3], "MIT License", long, "once more: " + long[:5000], TEXTS[0], TEXTS[0]]
    plain, more = (tmp_path_factory.mktemp(n) for n in ("plain", "more"))
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    marks = [(k, k % 2) for k in range(len(texts))]
    names = ["h", "g", "doc", "keys", "fp", "n", "part", "label", "a", "b", "first", "component", "node", "_all", "_id", "_g", "_slot", "_block", "_copies", "slot", "block", "place", "words", "low", "media", "pcm", "extra", "strings", "email", "lang", "n_chars", "next", "edited", "copies", "text_", "doc_id_"]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for at, df in ((plain, base), (more, base.select("*", *[F.lit("clash").alias(n) for n in names]))):
        df.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(plain), str(more), len(texts)


@pytest.mark.parametrize("name", sorted(set(queries()) - {"op13_negatives"}))
def test_further_columns_and_very_long_texts(spark, small, name):
    plain, more = (sorted(map(str, queries()[name](spark, at).collect())) for at in small[:2])
    assert plain == more and len(plain) >= small[2]


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "same text here " * 9, "en", "s", 1)] * 3 + [(None, "same text here " * 9, "en", None, 1), (None, None, None, None, None), (2, "other words entirely", "en", "s", 1)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    for name, q in queries().items():
        if name == "op13_negatives":
            continue
        got = q(spark, at).collect()
        assert len(got) >= 6, name
        assert {r.doc_id for r in got} == {1, 2, None}, name


def test_license_blocks_against_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(25)]
    templates = []
    for k in range(8):
        own = rng.sample(vocabulary, rng.randint(3, 8))
        templates.append((f"t{k}", rng.choice([" ", ";"]).join(own[: rng.randint(1, 2)]), " ".join(own)))
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(rng.choices(vocabulary, k=20) + t[2].split() + rng.choices(vocabulary, k=9)) for t in templates for _ in range(4)]
    some = 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("label", F.lit("clash"))
    got = {r.doc_id: r.labels for r in licenses.scan(docs, templates, 0.7, span=8).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"w\d+", t)
        blocks, want = [ws[k : k + 16] for k in range(0, max(1, len(ws) - 8), 8)] if ws else [], set()
        for label, telling, x in templates:
            own, n = set(x.split()), len(x.split())
            for w in (b[k : k + 2 * n] for b in blocks for k in range(0, max(1, -(-len(b) // n) * n - n), n)):
                if len(own & set(w)) >= 0.7 * n - 1e-9 and all(f" {p} " in f" {' '.join(w)} " for p in telling.split(";")):
                    want.add(label)
        assert got[i] == ",".join(sorted(want)), t
        some += len(want)
    assert some > 20


def test_templates_longer_than_the_span_are_refused():
    for telling, text in (("mit", "mit " * 9), ("", "mit"), ("x", "mit")):
        with pytest.raises(ValueError):
            licenses.prepared([("t", telling, text)], 8)


def test_license_notices_in_the_wild(spark):
    rng = random.Random(10)
    filler = " ".join(words(rng, 150))
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction"
    cases = [
        (gpl, "gpl,gpl-3.0"), (filler + "\n" + mit + "\n" + filler, "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
        ("Released under the Apache License.", "apache"), ("Released under the BSD License.", ""), ("Released under the MIT License.", "mit"), ("licensed under the GNU General Public License", "gpl"), (filler, ""),
        ("she was released under the license of mit hospital", ""), ("he studied at MIT and got the driver license under the new rules released in May", ""),
        ("This work is licensed under the GNU General Public License, version 2. " + filler[:100] + " In 3 of the cases", "gpl"), ("This work, licensed under the GNU General Public License (version 3)", "gpl,gpl-3.0"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == [want for _, want in cases]


def test_links_of_licenses_need_no_telling_phrase(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    texts = [bsd, bsd.replace("Redistribution", "Copying"), "released under the license of a town", "one two " * 90 + bsd.replace("binary", "object"), None, "of the and"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_links, r.labels) for r in got] == [(1, "bsd"), (1, ""), (1, ""), (1, ""), (0, ""), (0, "")]


def test_the_join_leaves_few_tables(spark):
    import glob

    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{place}/fathom-*"))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60)) + f" x{k % 3}") for k in range(30)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.link(docs, 3, 90).collect()} == {0}
    left = {x.split("/")[-1].rsplit("-", 1)[0] for x in set(glob.glob(f"{place}/fathom-*")) - before}
    assert not left & {"fathom-shingles", "fathom-classes", "fathom-prefixes", "fathom-stars", "fathom-star-pairs", "fathom-pairs-across", "fathom-large-columns", "fathom-edges", "fathom-sets"}
