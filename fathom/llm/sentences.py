"""Substring dedup by sliding sentence spans.

A text is cut into sentences at ends of lines and after full stops, question and exclamation marks. At every
sentence one span starts and one ends: the shortest run of at least ``least_sentences`` sentences with at least
``least_words`` words, so that every repeated run of so many sentences and words is covered to both ends. (Shorter runs
agree by chance in unrelated texts.) A document of several sentences but fewer words is one span. Spans are hashed to
128 bits, over the hashes of their sentences with white space squeezed, and joined over all documents; the first span
of a group is the one in the document with the lowest id, and there at the lowest place. Sentences that any other span
of the group covers are removed.

Texts are read once for their spans, which are written as rows of numbers. A span that repeats within its own document
is settled there and sent once; so each document counts once, counts are aggregated before they are shuffled, and the
join back is of two written tables, which adaptive execution splits where a span is very common. No group is ever
collected.

Edge cases: a null or empty text has no sentences and is kept; rows that share an id count as one document, so a span
at which only they agree stays; null ids come before others; an empty table gives no rows; further columns are ignored,
or kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, table, text_of, whole, written

SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)\s*|[.!?]+|\n+|$)")
LEAST_SENTENCES, LEAST_WORDS = 2, 15
NO_ID = -(1 << 63)


def sentences(text: str) -> list[str]:
    """Pieces that joined give the text; each ends after the marks or line ends that end a sentence."""
    out, begun = [], ""
    for piece in SENTENCE.findall(text):
        if not piece:
            continue
        begun += piece
        if begun.strip() and (piece[-1].isspace() or piece[-1] in ".!?"):
            if piece[-1].isspace():
                out.append(begun)
                begun = ""
    if begun:
        out.append(begun)
    return out


def spans(words: list[list[str]], least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(first sentence, sentence after the last) of the spans that start or end at each sentence, in order; ``words`` by sentence."""
    found, end, held = set(), 0, 0
    for i, own in enumerate(words):
        while end < len(words) and (held < least_words or end - i < least_sentences):
            held += len(words[end])
            end += 1
        if held >= least_words and end - i >= least_sentences:
            found.add((i, end))
        held -= len(own)
    begin, held = 0, 0
    for i, own in enumerate(words):
        held += len(own)
        while i - begin >= least_sentences and held - len(words[begin]) >= least_words:
            held -= len(words[begin])
            begin += 1
        if own and i + 1 - begin >= least_sentences and held >= least_words:
            found.add((begin, i + 1))
    if not found and sum(map(bool, words)) >= least_sentences:
        found.add((0, len(words)))
    if words and not words[-1]:  # white space after the last sentence belongs to it
        found = {(i, len(words) if stop == len(words) - 1 else stop) for i, stop in found}
    return sorted(found)


def hashed_spans(text: str, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit hash) of a text's spans."""
    words = [p.split() for p in sentences(text)]
    own = [hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() if w else b"" for w in words]
    return [(i, stop, hashlib.blake2b(b"".join(own[i:stop]), digest_size=16).digest()) for i, stop in spans(words, least_sentences, least_words)]


def removed(parts: list[str], places: list[int]) -> list[bool]:
    """Which sentences the spans at ``places`` cover."""
    gone = [False] * len(parts)
    for place in places:
        i, stop = place >> 32, place & 0xFFFFFFFF
        gone[i:stop] = [True] * (stop - i)
    return gone


SPAN = "doc long, g long, a long, b long, i long, again boolean"


def repeated_spans(rows: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """doc, g, places: the spans, as start times 2**32 plus end, that are not the first of their group. ``rows`` has doc, g, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, keys, hashes, places, again = [], [], [], [], []
        for doc, g, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen = set()
            for i, stop, h in hashed_spans(text, least_sentences, least_words):
                docs.append(doc)
                keys.append(g)
                hashes.append(h)
                places.append(i << 32 | stop)
                again.append(h in seen)
                seen.add(h)
        two = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        columns = [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(places, pa.int64()), pa.array(again, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SPAN.split(", ")])

    found = written(map_batches(rows.select("doc", "g", "text"), run, SPAN, size=2 << 20), "spans")
    once = found.where(~F.col("again"))
    counts = once.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where(F.col("least") < F.col("most"))
    firsts = written(counts.select("a", "b", "least"), "span-firsts")
    later = once.join(firsts.hint("merge"), ["a", "b"]).where(F.col("doc") > F.col("least")).select("doc", "g", "i")
    every = later.unionByName(found.where("again").select("doc", "g", "i"))
    return every.groupBy(F.col("doc").alias("_d"), F.col("g").alias("_k")).agg(F.array_sort(F.collect_set("i")).alias("places"))


def marked(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` and one more column: the places of each row's spans that go, null where nothing repeats."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(whole(docs), doc.alias("_id"), F.xxhash64(text_of()).alias("_g"))
    later = written(repeated_spans(docs.select(doc.alias("doc"), F.xxhash64(text_of()).alias("g"), text_of().alias("text")), least_sentences, least_words), "span-places")
    joined = rows.join(later.hint("merge"), (F.col("_id") == F.col("_d")) & (F.col("_g") == F.col("_k")), "left")
    name = "_places"
    while name in docs.columns:
        name += "_"
    return joined.select("_all.*", F.col("places").alias(name))


def dedup(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated sentences gone from the text; all columns stay."""
    rows = marked(docs, least_sentences, least_words)
    names = docs.columns
    at, last = names.index("text"), len(names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, places in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
            if places:
                parts = sentences(text)
                gone = removed(parts, places)
                text = "".join(p for p, x in zip(parts, gone, strict=True) if not x)
            texts.append(text)
        columns = list(batch.columns)[:last]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(rows, run, docs.schema)


def op4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: sentences, those removed, maximal removed runs, and a digest of the kept text."""
    rows = marked(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone_counts, runs, digests = [], [], [], []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = sentences(text)
            gone = removed(parts, places or [])
            counts.append(len(parts))
            gone_counts.append(sum(gone))
            runs.append(sum(x and not y for x, y in zip(gone, [False, *gone], strict=False)))
            digests.append(hashlib.sha256("".join(p for p, x in zip(parts, gone, strict=True) if not x).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, gone_counts, runs)), pa.array(digests)], ["doc_id", "n_sentences", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(rows, run, "doc_id long, n_sentences long, n_removed long, n_spans long, kept_sha256 string")
