"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

``fit`` learns from labelled documents: stems whose words mark toxic documents become the lexicon; the
Levenshtein automata of its terms, intersected with the trie they form, are compiled to one deterministic
table; and a logistic model weighs hits by their context. Words are runs of letters and marks of any script, in
both; the table has a symbol for each letter of the terms. ``score`` runs it over all words of a batch at once. A hit
between quotation marks or next to a reporting word counts as quoted; hits in one
window of words add up, as abuse clusters and quotations do not.

The fit reads a bounded sample of labelled rows (``fit_rows``, the rows whose id hashes lowest), and what it
brings to the driver is bounded by ``fit_rows`` and ``most_terms``. Scoring is a map over all rows without a
shuffle.

Edge cases: a null or empty text scores as a text without hits; ids, languages, sources and labels are no
inputs of a score; without labels of both kinds nothing can be learnt, so all scores are 0 and no document is
rejected; labels of one document that differ count as toxic; an empty table gives no rows; further columns
are ignored. A lexicon whose automata would have too many states loses the edits of its longest terms first.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, table, text_of, written

FIT_ROWS = 20_000
MOST_TERMS = 96
QUOTES = str.maketrans(dict.fromkeys("“”„«»", '"'))
REPORTING = [b"said", b"says", b"quote", b"quoted", b"quotes", b"wrote", b"writes", b"called", b"calls", b"word", b"term", b"reported"]
FOLLOWING = 26  # the symbol of any character that is neither a to z nor a letter of a term
NO_WORD = r"[^\p{L}\p{M}]+"
NEAR = 24  # bytes next to a hit that are searched for a reporting word
WINDOW = 200  # bytes of the window in which hits add up
BATCH = 2 << 20  # bytes of text that are scored at once


@dataclass
class Automaton:
    """The union of the terms' Levenshtein automata, as a table of states and symbols; 0 is dead, 1 the start."""

    moves: np.ndarray
    term: np.ndarray  # of each state: the accepted term or -1
    edits: np.ndarray
    letters: dict[int, int]  # symbols, from 27 on, of the terms' letters that are not a to z


def edits_for(term: str, whole: bool) -> int:
    """Edits within which a misspelling counts: none for short terms, fewer for stems, whose ends are open."""
    n = len(term)
    return (n >= 5) + (n >= 9) if whole else int(n >= 8)


def symbols_of(terms: list[tuple[str, bool]]) -> dict[str, int]:
    """The symbols of the terms' letters: 0 to 25 are a to z, those from 27 on the others."""
    others = sorted({c for term, _ in terms for c in term} - set("abcdefghijklmnopqrstuvwxyz"))
    return {chr(97 + k): k for k in range(26)} | {c: k for k, c in enumerate(others, FOLLOWING + 1)}


def compile_terms(terms: list[tuple[str, bool]], most_states: int = 60_000) -> Automaton:
    """The table for ``terms`` (letters, whole word or open stem). While it has too many states, the longest half of
    the terms that still have edits loses them; without edits it has a state for each letter at most."""
    edits = [edits_for(*t) for t in terms]
    while True:
        made = _compiled(terms, edits, most_states)
        if made is not None:
            return made
        having = sorted((k for k, e in enumerate(edits) if e), key=lambda k: (-len(terms[k][0]), terms[k][0]))
        if not having:
            return _compiled(terms, edits, 1 << 62)
        for k in having[: -(-len(having) // 2)]:
            edits[k] = 0


def _compiled(terms: list[tuple[str, bool]], allowed: list[int], most_states: int) -> Automaton | None:
    """Subset construction over (trie node, edits); none if there are too many states."""
    symbols = symbols_of(terms)
    count = len(symbols) + 1
    children: list[dict[int, int]] = [{}]
    ends: dict[int, tuple[int, int, bool]] = {}
    room = [0]
    for k, (term, whole) in enumerate(terms):
        node = 0
        most = allowed[k]
        room[0] = max(room[0], most)
        for c in term:
            if (following := children[node].get(symbols[c])) is None:
                children.append({})
                room.append(0)
                following = children[node][symbols[c]] = len(children) - 1
            node = following
            room[node] = max(room[node], most)
        ends.setdefault(node, (k, most, whole))

    def closed(found: dict[int, int]) -> frozenset:
        queue = deque(found)
        while queue:
            node = queue.popleft()
            e = found[node] + 1
            for child in children[node].values():
                if e <= room[child] and found.get(child, 99) > e:
                    found[child] = e
                    queue.append(child)
        return frozenset(found.items())

    def after(state: frozenset, c: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, e in state:
            end = ends.get(node)
            if end and not end[2] and e <= end[1] and out.get(node, 99) > e:
                out[node] = e  # an open stem takes any ending
            for letter, child in children[node].items():
                cost = e + (letter != c)
                if cost <= room[child] and out.get(child, 99) > cost:
                    out[child] = cost
            if e + 1 <= room[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
        return out

    start = closed({0: 0})
    numbers = {frozenset(): 0, start: 1}
    order: list[frozenset] = [frozenset(), start]
    moves = [[0] * count]
    at = 1
    while at < len(order):
        row = []
        for c in range(count):
            state = closed(after(order[at], c))
            if state not in numbers:
                numbers[state] = len(order)
                order.append(state)
                if len(order) > most_states:
                    return None
            row.append(numbers[state])
        moves.append(row)
        at += 1
    term, edits = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int32)
    for k, state in enumerate(order):
        hits = [(e, ends[n][0]) for n, e in state if n in ends and e <= ends[n][1]]
        if hits:
            edits[k], term[k] = min(hits)
    return Automaton(np.array(moves, np.int32), term, edits, {ord(c): k for c, k in symbols.items() if k > FOLLOWING})


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # of a term and its edits
    coefficients: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


@functools.cache
def _word_characters() -> np.ndarray:
    """Of each code point: whether it is a letter or mark, as ``NO_WORD`` has it."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def wide_characters(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and code points of the characters of more than one byte in UTF-8."""
    at = np.flatnonzero(a >= 0xC0)
    lead = a[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | a[at[more] + k] & 0x3F
    return at, size, code


def hits_of(texts: list[str], automaton: Automaton) -> list[tuple[int, int, int, int, int]]:
    """(text, byte position, term, edits, quoted) of all words that the automaton accepts."""
    lows = [(t.translate(QUOTES) if not t.isascii() else t).lower().encode() for t in texts]
    joined = b" ".join(lows) + b"  "
    a = np.frombuffer(joined, np.uint8)
    letter = (a >= 97) & (a <= 122)
    symbol = np.where(letter, a - 97, FOLLOWING).astype(np.int64)
    wide, size, code = wide_characters(a)
    solid_wide = _word_characters()[code]
    for k in range(4):
        letter[wide[solid_wide & (size > k)] + k] = True
    for c, s in automaton.letters.items():
        symbol[wide[code == c]] = s
    sign = np.isin(a, np.frombuffer(b"013457@$!*_-", np.uint8))  # within a word they stand for letters
    inner = np.zeros(len(a), bool)
    inner[1:-1] = sign[1:-1] & letter[:-2] & letter[2:]
    solid = letter | inner
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    starts = starts[: len(ends)]
    skip = (a & 0xC0) == 0x80  # the later bytes of a character
    state = np.ones(len(starts), np.int64)
    live = np.arange(len(starts))
    at = starts.copy()
    flat, count = automaton.moves.ravel(), automaton.moves.shape[1]
    accepted: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        over = at >= ends[live]
        if over.any():
            good = over & (automaton.term[state] >= 0)
            accepted.append((live[good], state[good]))
            keep = ~over
            live, at, state = live[keep], at[keep], state[keep]
            if not len(live):
                break
        state = np.where(skip[at], state, flat[state * count + symbol[at]])
        at = at + 1
        keep = state != 0
        live, at, state = live[keep], at[keep], state[keep]
    if not accepted:
        return []
    word, state = np.concatenate([x[0] for x in accepted]), np.concatenate([x[1] for x in accepted])
    order = np.argsort(word)
    word, state = word[order], state[order]
    bounds = np.cumsum([len(x) + 1 for x in lows])
    row = np.searchsorted(bounds, starts[word], side="right")
    begin = np.append(0, bounds)
    out = []
    for r, s, e, t, d in zip(row.tolist(), starts[word].tolist(), ends[word].tolist(), automaton.term[state].tolist(), automaton.edits[state].tolist(), strict=True):
        lo, hi = begin[r], begin[r + 1] - 1
        line = joined.rfind(b"\n", lo, s) + 1 or lo
        stop = joined.find(b"\n", e, hi)
        stop = hi if stop < 0 else stop
        quoted = joined.count(b'"', line, s) % 2 == 1 and joined.find(b'"', e, stop) >= 0
        if not quoted:
            near = joined[max(lo, s - NEAR) : s].split()
            quoted = any(w in near for w in REPORTING)
        out.append((r, s - lo, t, d, int(quoted)))
    return out


def features_of(texts: list[str], automaton: Automaton, model: Model) -> np.ndarray:
    """Rows of 1, direct and quoted weight of all hits, and the most direct weight in one window (logarithms)."""
    out = np.zeros((len(texts), 4))
    out[:, 0] = 1
    windows: dict[int, list[tuple[int, float]]] = {}
    if model.terms:
        for row, at, term, edits, quoted in hits_of(texts, automaton):
            weight = model.weights.get((term, edits), 0.0)
            out[row, 2 if quoted else 1] += weight
            if not quoted:
                windows.setdefault(row, []).append((at, weight))
    for row, hits in windows.items():
        first = held = 0
        for at, weight in hits:
            held += weight
            while hits[first][0] < at - WINDOW:
                held -= hits[first][1]
                first += 1
            out[row, 3] = max(out[row, 3], held)
    out[:, 1:] = np.log1p(np.maximum(out[:, 1:], 0))
    return out


def held_out(id_column: str = "doc_id"):
    """Rows that no fit may read: those whose id's CRC is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def choose_terms(rows: list[tuple[str, int, int, int]], most: int) -> list[tuple[str, bool]]:
    """Stems from (prefix, toxic words, clean words, toxic words equal to it): the shortest that mark toxic
    documents, each drawn out while it keeps nearly all its words; whole words where most words equal the stem."""
    found = {p: (t, c, e) for p, t, c, e in rows}
    good = sorted(found, key=lambda p: (len(p), p))
    roots: list[str] = []
    for p in good:
        if not any(p.startswith(r) for r in roots):
            roots.append(p)
    terms = []
    for root in roots:
        stem = root
        while longer := [p for p in found if len(p) == len(stem) + 1 and p.startswith(stem) and found[p][0] >= 0.95 * found[root][0]]:
            stem = longer[0]
        t, c, equal = found[stem]
        terms.append((t, stem, equal >= 0.8 * t))
    terms.sort(key=lambda x: (-x[0], x[1]))
    return [(stem, whole) for _, stem, whole in terms[:most]]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_terms: int = MOST_TERMS) -> Model:
    """A model from at most ``fit_rows`` labelled documents that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(fit_rows)
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow())  # fit_rows rows at most: two integers each
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id"), "labelled")
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), NO_WORD))).alias("word")).where(F.length("word") >= 4)
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    sizes = chosen.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = int(sizes[0] or 0), int(sizes[1] or 0)
    model = Model()
    if not toxic or not clean:
        model.coefficients[0] = -30.0  # a score of 0
        return model
    share = toxic / (toxic + clean)
    model.coefficients[0] = math.log(share / (1 - share))
    prefixes = counts.select("word", "t", "c", F.explode(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(12)))).alias("n")).groupBy(F.expr("substring(word, 1, n)").alias("p")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.when(F.length("word") == F.col("n"), F.col("t")).otherwise(0)).alias("e"))
    least = max(4.0, 0.012 * toxic)
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 2) / F.lit(clean + 1.0))
    rows = prefixes.where((F.col("t") >= least) & (odds >= 3.5)).orderBy((odds * F.col("t")).desc(), "p").limit(16 * most_terms).collect()
    model.terms = choose_terms([(r.p, r.t, r.c, r.e) for r in rows], most_terms)
    if not model.terms:
        model.coefficients[0] = min(model.coefficients[0], -1e-6)  # nothing tells the kinds apart, so nothing is rejected
        return model
    automaton = compile_terms(model.terms)

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = batch.column(1).to_pylist()
        seen = {(row, term, edits) for row, _, term, edits, _ in hits_of(batch.column(0).to_pylist(), automaton)}
        out = [(term, edits, marks[row]) for row, term, edits in seen]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["term", "edits", "toxic"])

    tallies = {}
    for r in map_batches(sample.select("text", F.col("toxic").cast("long")), tally, "term long, edits long, toxic long", size=BATCH).groupBy("term", "edits").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect():
        tallies[r.term, r.edits] = max(0.0, math.log((r.t + 0.5) / (toxic + 1)) - math.log((r.n - r.t + 0.5) / (clean + 1))) / 8
    for k in range(len(model.terms)):
        plain = tallies.get((k, 0), 0.5)
        for e in range(3):
            model.weights[k, e] = tallies.get((k, e), plain * (1 - 0.3 * e))  # a misspelling not met counts a little less

    def feature_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of(batch.column(0).to_pylist(), automaton, model)
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(1, 4))], ["y", "a", "b", "c"])

    pairs = map_batches(sample.select("text", F.col("toxic").cast("double").alias("y")), feature_rows, "y double, a double, b double, c double", size=BATCH).groupBy("y", "a", "b", "c").agg(F.count("*").alias("n")).toArrow().sort_by([(k, "ascending") for k in "yabc"])
    data = np.array([pairs.column(k).to_numpy() for k in ("y", "a", "b", "c", "n")], float).T
    model.coefficients = logistic(np.column_stack([np.ones(len(data)), data[:, 1:4]]), data[:, 0], data[:, 4]).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's method, with a small penalty on all but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    automaton = compile_terms(model.terms)
    w = np.array(model.coefficients)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of(batch.column(1).to_pylist(), automaton, model)
        p = np.round(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 9)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")), run, "doc_id long, score double, predicted int", size=BATCH)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject. The decision is made in one pass, without a join."""
    automaton = compile_terms(model.terms)
    w = np.array(model.coefficients)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features_of([t or "" for t in batch.column(at).to_pylist()], automaton, model)
        return batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) < 0.5))

    return map_batches(docs, run, docs.schema, size=BATCH)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
