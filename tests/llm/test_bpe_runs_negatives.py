"""BPE by its automaton against the tokenizers library, runs and hard negatives against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import automaton, negatives, periods
from fathom.llm.registry import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  a\tb", "don't we'll I'VE 'tis", "x" * 5000, " " * 700, "aaaa" * 333, "naïve 中文 \U0001f600‍\U0001f600 ﬁ ½ Ⅷ", "<|endoftext|>", "a <|endoftext|> <|endoftext|>b", "<|endoftext", "=՘=a՘ ՘՘",
    "\x00\x1c\x85　\xa0 z", "\U0001e6c0" * 3 + " word", "word word word\r\nword  word ", "1234567 12.5e-7 a1b2",
]


@pytest.fixture(scope="module")
def bpe():
    return automaton.Automaton.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(11)
    out = [t or "" for t in ODD]
    out += ["".join(rng.choices("ab cdetheinaaaa  \n\t'sétx1<|>", k=rng.randint(0, 60))) for _ in range(800)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return out + ["".join(rng.choices("a-=_ *", k=200)) for _ in range(100)]


def test_ids_and_texts_are_the_librarys(bpe, library):
    every = texts()
    for text, ids in zip(every, bpe.encode_all(every), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_one_word_and_many_words_take_the_same_path(bpe):
    rng = random.Random(2)
    words = [bytes(rng.choices(range(256), k=rng.randint(1, 9))) for _ in range(500)] + ["".join(rng.choices("etaoin shrdlu", k=rng.randint(1, 40))).encode() for _ in range(500)] + [b"x" * 600]
    assert bpe.many_ids(words) == [np.array(bpe.word_ids(w), "<u4").tobytes() for w in words]
    assert bpe.many_ids([]) == []


def merged(word, ranks):
    """Byte-pair merging as it is defined: the lowest-ranked pair, the leftmost of equals, again and again."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automata_of_any_merges_accept_what_merging_gives(seed):
    """Merges as training could make them: each of two tokens that words of two letters have side by side."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("ab", weights=[3, 1], k=rng.randint(1, 24))).encode() for _ in range(60)]
    ranks = {}
    for _ in range(25):
        pairs = [p for w in words for parts in [merged(w, ranks)] for p in zip(parts, parts[1:], strict=False)]
        if not pairs:
            break
        pair = rng.choice(pairs)
        if pair[0] + pair[1] not in {a + b for a, b in ranks}:
            ranks[pair] = len(ranks)
    labels = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(ranks)}
    built = automaton.Automaton(labels, list(ranks))
    for w in words + ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(200)]:
        want = [labels[p] for p in merged(w, ranks)]
        assert built.word_ids(w) == want and np.frombuffer(built.many_ids([w])[0], "<u4").tolist() == want


def test_merges_that_never_meet_add_nothing():
    labels = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    built = automaton.Automaton(labels, [(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")])
    assert built.born[258] < 0 and built.word_ids(b"abc") == [256, ord("c")]


def test_words_held_are_bounded(bpe, monkeypatch):
    monkeypatch.setattr(automaton, "CHARACTERS_HELD", 50)
    first = [bpe.encode(t) for t in ("one two three four five six seven eight nine ten", "other words", "one two")]
    assert first == [bpe.encode(t) for t in ("one two three four five six seven eight nine ten", "other words", "one two")] and bpe.held < 120


def test_models_that_ask_for_more_are_refused():
    with pytest.raises(ValueError):
        automaton.Automaton.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query(spark, tmp_path, library):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(None, "no id", "x"), (3, ODD[3], "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries()["op11_bpe"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encoded_and_decoded_columns(spark, bpe):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = automaton.decoded(automaton.encoded(docs, bpe), bpe).collect()
    assert [r.decoded for r in sorted(rows)] == [t or "" for t in ODD] and rows[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in out.items())


@pytest.mark.parametrize("block", [1, 4, 1 << 12])
def test_runs_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(700):
        w = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            if len(w) > 8:
                a = rng.randrange(len(w))
                p, e = rng.randint(1, max(1, (len(w) - a) // 3)), rng.randint(a, len(w))
                for i in range(a, e):
                    w[i] = w[a + (i - a) % p]
        want = brute_runs(w)
        assert periods.runs_of(w) == want
        texts = [[b"%d" % x for x in v] for v in ([0, 0, 0], w, [], w)]
        assert periods.runs_of_all(texts) == [[], want, [], want]


def test_a_long_run_and_a_run_of_long_periods():
    assert periods.runs_of([1] * 5000) == [(0, 5000, 1)]
    assert periods.runs_of([*range(5003)] * 4 + [1]) == [(0, 20012, 5003)]
    assert periods.runs_of([*range(5003)] * 3 + [*range(5002)]) == []
    assert periods.runs_of(([1] * 7 + [2]) * 40) == sorted([(8 * k, 7, 1) for k in range(40)] + [(0, 320, 8)])
    with pytest.raises(ValueError):
        periods.runs_of([1, 1], least_repeats=3)


def test_periods_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t", "a " * 9, "one two " * 5 + "three", "x y " * 8, *(" ".join(rng.choices("abc", k=rng.randint(1, 150))) for _ in range(90)), "say it again and again\n" * 70]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "a " * 9, "x"), (4, texts[4], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t, _ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((k, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    assert sum(r[1] for r in want) > 20
    assert sorted(map(tuple, queries()["op12_periods"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_runs_and_collapsed_texts_as_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 4 + "c", 1), (2, "plain  text", 2), (None, None, 3)], "doc_id long, text string, length int")
    assert [tuple(r) for r in periods.find_runs(docs).collect()] == [(1, 0, 8, 2)]
    assert {r.length: r.text for r in periods.collapse(docs).collect()} == {1: "a b c", 2: "plain  text", 3: None}


def brute_negatives(rows):
    used = []
    for k, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        used.append((k, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if k is not None and k % 7 == 0 else label))
    late = 1 << 63
    out = []
    for k, v, label in {(k, tuple(v), c) for k, v, c in used if k is not None and k % 50 == 0}:
        others = sorted(((-sum(x * y for x, y in zip(v, u, strict=False)), late if j is None else j, c == label) for j, u, c in used if j != k))
        for s, j, _ in [o for o in others if o[2]][:5]:
            hits = [o for o in others if not o[2] and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(k, None if j == late else j, n, None if i == late else i, -s, -t) for n, (t, i, _) in enumerate(hits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [16 << 20, 300])
def test_negatives_against_brute_force(spark, monkeypatch, chunk):
    from test_llm_operators import VECTORS, awkward_vectors

    rows = awkward_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).withColumn("score", F.lit("clash"))
    monkeypatch.setattr(negatives, "BLOCK", 7)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0, chunk_bytes=chunk).collect()), key=str)
    want = brute_negatives(rows)
    assert got == want and len(want) > 30 and any(r[3] is None or r[1] is None for r in want)


def test_scores_beyond_floats_are_exact():
    a, b = np.array([[float(1 << 40), 1.0]]), np.array([[float(1 << 20), 1.0], [float(1 << 21), -1.0]])
    assert negatives.scores(a, b).tolist() == [[(1 << 60) + 1, (1 << 61) - 1]]
    with pytest.raises(OverflowError):
        negatives.scores(a, a)
