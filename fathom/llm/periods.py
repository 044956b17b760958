"""Runs of repeated word patterns by block matching.

A run is a stretch of words whose smallest period q fits into it at least ``least_repeats`` times, of at least
``least_words`` words, that no neighbouring word extends. For each power of two L, the blocks of L words that begin at
multiples of L are keys, sequences of word numbers, of a pyahocorasick automaton, and the document is searched for them.
A run of a period from L up to 2 L - 1 holds a whole block and its copy one period on, so every block that occurs again
at such a distance seeds an extension, word by word exact, to both sides. Longer periods are found at larger scales, and
where a scale finds a stretch that a smaller period has made a run already, it is the same run. Blocks longer than
``BLOCK`` words are cut to that many, which only makes more seeds; all of them are extended exactly.

Before the search a text is cut down to where runs can be: each of a run's sequences of four words recurs within it, so
stretches without recurring sequences (told by 64-bit hashes, where equal ones only keep more) are left out.

A text is one row and is worked on in its task, in memory linear in its length; rows are read in Arrow batches and
nothing is shuffled, so a task lost with its executor is simply run again.

Edge cases: a null or empty text has no words and no runs; a null id is changed by no test pattern; repeated rows give
equal rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, table, text_of
from fathom.llm.hashing import ODD, mix

LEAST_WORDS, LEAST_REPEATS, BLOCK, GRAM = 6, 4, 1 << 12, 4


def extended(w: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The stretch around ``at`` where each word equals the one ``distance`` on: its start, and the end of the last copy."""
    total, step, low = len(w) - distance, 64, at
    while low > 0:
        a = max(0, low - step)
        other = np.flatnonzero(w[a:low] != w[a + distance : low + distance])
        if len(other):
            low = a + int(other[-1]) + 1
            break
        low, step = a, step * 2
    step, high = 64, at
    while high < total:
        b = min(total, high + step)
        other = np.flatnonzero(w[high:b] != w[high + distance : b + distance])
        if len(other):
            high += int(other[0])
            break
        high, step = b, step * 2
    return low, high + distance


def runs_of(numbers: Sequence[int], least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers, by start and then period.

    ``least_repeats`` is 4 or more: fewer copies need not hold a whole aligned block twice.
    """
    if least_repeats < 4:
        raise ValueError("least_repeats must be 4 or more")
    w = np.asarray(numbers, np.int64)
    word = tuple(w.tolist())
    found: dict[tuple[int, int], int] = {}
    within: list[tuple[int, int]] = [(0, 1)] * len(word)  # for each word the end and the period of the last run found around it
    scale = 1
    while scale * least_repeats <= len(word):
        size = min(scale, BLOCK)
        names: dict[tuple, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        blocks = []
        for p in range(0, len(word) - size + 1, scale):
            key = word[p : p + size]
            name = names.setdefault(key, len(names))
            if name == len(names) - 1:
                automaton.add_word(key, name)
            blocks.append(name)
        automaton.make_automaton()
        done: dict[int, int] = {}  # by distance, the end of the last stretch
        for end, name in automaton.iter(word):
            x = end - size + 1
            p = (x - scale) // scale * scale
            if p < 0 or blocks[p // scale] != name or p + size <= done.get(x - p, 0) - (x - p):
                continue
            if x + size <= within[p][0] and (x - p) % within[p][1] == 0:
                continue  # copies within a run, a whole number of its periods apart
            low, high = extended(w, p, x - p)
            done[x - p] = high
            if high - low >= max(least_words, least_repeats * (x - p)):
                if found.setdefault((low, high), x - p) == x - p:
                    within[low:high] = [(high, x - p)] * (high - low)
        scale *= 2
    return sorted((low, high - low, period) for (low, high), period in found.items())


def recurring(hashes: np.ndarray, owners: np.ndarray, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(owner, first word, word after the last) of the stretches of words that runs can lie in.

    ``hashes`` are those of the words of many documents, one after another, and ``owners`` their ascending document numbers.
    """
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return []
    h = hashes[:n] ^ mix(owners[:n].astype(np.uint64) + np.uint64(1))
    for k in range(1, GRAM):
        h = h * ODD + hashes[k : k + n]
    whole = owners[:n] == owners[GRAM - 1 :]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    live = np.zeros(n + 2, bool)
    live[1 + order[1:][same]] = live[1 + order[:-1][same]] = True
    live[1:-1] &= whole
    owner = np.concatenate([[-1], owners[:n], [-1]])
    edge = live[1:] & (~live[:-1] | (owner[1:] != owner[:-1]))
    last = live[:-1] & (~live[1:] | (owner[1:] != owner[:-1]))
    first, after = np.flatnonzero(edge), np.flatnonzero(last)
    keep = after - first + GRAM - 1 >= least_words
    return list(zip(owners[first[keep]].tolist(), first[keep].tolist(), (after[keep] + GRAM - 1).tolist(), strict=True))


def runs_of_all(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    counts = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(counts) - counts
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(counts.sum())).astype(np.uint64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for owner, a, b in recurring(mix(hashes), np.repeat(np.arange(len(texts)), counts), least_words):
        a, b = a - int(begin[owner]), b - int(begin[owner])
        names: dict[bytes, int] = {}
        numbers = [names.setdefault(w, len(names)) for w in texts[owner][a:b]]
        out[owner] += [(a + start, length, period) for start, length, period in runs_of(numbers, least_words, least_repeats)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(words, (np.cumsum(gone[:-1]) > 0).tolist(), strict=True) if not x]


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """doc_id, start, length, period: a row for each run in the words between ASCII white space of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = runs_of_all([t.encode().split() for t in batch.column(1).to_pylist()], least_words, least_repeats)
        rows = np.array([(k, *r) for k, runs in enumerate(found) for r in runs], np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[:, 0])), *(pa.array(rows[:, k]) for k in (1, 2, 3))], ["doc_id", "start", "length", "period"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, start long, length long, period long", size=1 << 20)


def collapse(docs: DataFrame, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """``docs`` with each run cut to its first period; texts without runs stay as they are, the others get single spaces."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        words = [(t or "").encode().split() for t in texts]
        found = runs_of_all(words, least_words, least_repeats)
        texts = [b" ".join(collapsed(w, r)).decode() if r else t for t, w, r in zip(texts, words, found, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, run, docs.schema, size=1 << 20)


def with_pattern(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query looks at: of a tenth of the ids, the words from one on are a pattern that repeats."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    pattern = words[a : a + p]
    return words[:a] + (pattern * (-(-(n - a) // len(pattern))))[: n - a]


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, the one of the greatest exponent, digests of all runs and of the text without repeats."""
    best = ("start", "length", "period", "exponent_milli")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        words = [with_pattern(i, t.encode().split()) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
        counts, tops, digests, kept = [], [], [], []
        for own, runs in zip(words, runs_of_all(words), strict=True):
            counts.append(len(runs))
            top = None
            for start, length, period in runs:
                if top is None or length * top[2] > top[1] * period:
                    top = (start, length, period, 1000 * length // period)
            tops.append(top or (None,) * 4)
            digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
            kept.append(hashlib.sha256(b" ".join(collapsed(own, runs))).hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array([t[k] for t in tops], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", *best, "runs_sha256", "collapsed_sha256"])

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, n_runs long, " + ", ".join(f"{x} long" for x in best) + ", runs_sha256 string, collapsed_sha256 string", size=1 << 20)
