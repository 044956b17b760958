"""Suffix-array dedup of byte strings that repeat across documents.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller id. A suffix matters
by its first ``width`` bytes alone. Suffixes are not all sorted: each string of ``width`` bytes has one anchor, the
place of its least 20-byte hash, which equal strings share at equal offsets. So

1. anchors are hashed and dealt to hash ranges, whose number follows from the bytes of all texts, so that a range stays
   small; those of one document alone drop out. Of an anchor that several texts of one flush hold, only the least and
   the greatest text are sent, as the others are known to repeat;
2. the suffixes that start around the remaining anchors become records, which sampled splitters range-partition by
   their leading 20 bytes at the anchor, and then by a hash of the document, so that a very common lead is split too;
3. every bucket is sorted (by Spark, which spills) and read as a stream of leads. Equal records count once; where a lead
   has several, they unfold to suffixes of ``width`` bytes, which are sorted by multikey quicksort, eight bytes a step,
   going on with ties only. In each group of equals all but the smallest document lose the string;
4. leads that reach a bucket's boundary, or that are cut for their length, are compared across the buckets: of each
   bucket's least owner of such a string, the string itself is joined with those of the other buckets.

Equal texts are one from the start (named by a 64-bit and a 128-bit hash together): all but the smallest id of them lose
everything, and their texts are not moved. Everything else is compared by its bytes.

Edge cases: a null text is empty; texts shorter than ``width`` lose nothing; rows equal in id and text get equal
results, and rows that share an id do not count against each other; null ids come before all others; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, map_texts, partitions, remove, table, text_of, written, written_at
from fathom.llm.hashing import TOP, blobs_of, from_blobs, held_pairs, window_hashes

WIDTH = 50
LEAD = 20
NO_ID = -(1 << 63)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, reach = v, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


PIECE = 1 << 19
Piece = tuple[int, int, bytes]


def pieces(texts: Iterable[bytes], width: int = WIDTH, size: int = PIECE) -> Iterator[list[Piece]]:
    """(text, place, bytes) of pieces of the texts, in groups of at most about ``size`` bytes; every string of ``width``
    bytes is whole in one piece, so that a text of any length is worked on in bounded memory."""
    held, total = [], 0
    for row, raw in enumerate(texts):
        for base in range(0, len(raw) - width + 1, size):
            piece = raw[base : base + size + width - 1]
            if held and total + len(piece) > size:
                yield held
                held, total = [], 0
            held.append((row, base, piece))
            total += len(piece)
    if held:
        yield held


def anchors(group: list[Piece], width: int = WIDTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """For the strings of ``width`` bytes of each piece: text, anchor, first and last start that have it, anchor's hash."""
    a = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    sizes = np.array([len(p[2]) for p in group], np.int64)
    stops = np.cumsum(sizes)
    h = window_hashes(a, lead)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(ranked, width - lead + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    piece = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
    inside = start + width <= stops[piece]
    anchor, start, piece = anchor[inside], start[inside], piece[inside]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:], len(anchor)) - 1
    own = piece[first]
    shift = np.array([p[1] for p in group], np.int64)[own] - (stops - sizes)[own]
    at = anchor[first]
    return np.array([p[0] for p in group], np.int64)[own], at + shift, start[first] + shift, start[last] + shift, h[at]


def groups_of_equals(words: np.ndarray) -> np.ndarray:
    """A number for each row of eight-byte words, the same for equal rows and -1 for rows without an equal.

    Multikey quicksort, a word at a time: rows are ordered within their group by the next word, and only ties go on.
    """
    group = np.zeros(len(words), np.int64)
    live = np.arange(len(words))
    for k in range(words.shape[1]):
        order = np.lexsort((words[live, k], group[live]))
        live = live[order]
        key, own = words[live, k], group[live]
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        number = np.cumsum(new) - 1
        group[live] = number
        live = live[np.bincount(number)[number] > 1]
        if not len(live):
            break
    out = np.full(len(words), -1, np.int64)
    out[live] = group[live]
    return out


def _dealt(width: int, buckets: int, flush: int = 1 << 19):
    """Anchors of the distinct texts of a partition, a blob for each hash range and flush. Numbers from ``buckets`` on are
    groups of one blob, of pairs that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spare = buckets + (TaskContext.get().partitionId() << 32)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                distinct = dict(zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
                names = np.array(list(distinct), np.int64)
                for group in pieces((t.as_py().encode() for t in distinct.values()), width):
                    text, _, _, _, h = anchors(group, width)
                    yield h & TOP, names[text]

        for n, (keys, owners) in enumerate(held_pairs(found(), flush)):
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            inner = np.ones(len(keys), bool)
            inner[begin] = inner[np.append(begin[1:], len(keys)) - 1] = False
            yield blobs_of(keys[~inner], owners[~inner], buckets)
            if inner.any():
                rest = blobs_of(keys[inner], owners[inner], 1)
                yield rest.set_column(0, "bucket", pa.array([spare + n] * rest.num_rows, pa.int64()))

    return run


def _repeated(buckets: int):
    def run(key: tuple, blobs: pa.Table) -> pa.Table:
        """Owner and key of the keys that more than one owner has."""
        keys, owners = from_blobs(x.as_py() for x in blobs.column("blob"))
        if key[0].as_py() < buckets and len(keys):
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            several = np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin)
            keep = np.repeat(several, np.diff(np.append(begin, len(keys))))
            keys, owners = keys[keep], owners[keep]
        return pa.table({"g": pa.array(owners, pa.int64()), "key": pa.array(keys.view(np.int64), pa.int64())})

    return run


RECORD = "doc long, g long, context binary, ahead int, at int, lost_to int"


def _records(width: int):
    """Records of rows of doc, g, text and keys; ``at`` is the first start. Rows that are equal within a batch count once,
    and of records that are equal within a group only the least document keeps its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(d, g): i for i, (d, g) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))}
            chosen = list(rows.values())
            docs, gs = (np.array([x[k] for x in rows], np.int64) for k in (0, 1))
            known = {}
            for group in pieces((batch.column(2)[i].as_py().encode() for i in chosen), width):
                text, anchor, first, last, h = anchors(group, width)
                bounds = np.searchsorted(text, np.arange(len(chosen) + 1))
                hits, contexts = [], []
                for row, base, raw in group:  # a text has one piece in a group
                    if row not in known:
                        known = {row: batch.column(3)[chosen[row]].values.to_numpy().view(np.uint64)}
                    lo, hi = bounds[row], bounds[row + 1]
                    found = lo + np.flatnonzero(np.isin(h[lo:hi] & TOP, known[row]))
                    hits.append(found)
                    contexts += [raw[p:q] for p, q in zip((first[found] - base).tolist(), (last[found] - base + width).tolist(), strict=True)]
                hit = np.concatenate(hits)
                own = docs[text[hit]]
                least: dict[bytes, int] = {}
                for c, d in zip(contexts, own.tolist(), strict=True):
                    if least.get(c, d) >= d:
                        least[c] = d
                kept = [c if d == least[c] else None for c, d in zip(contexts, own.tolist(), strict=True)]
                size = np.array([len(c) for c in contexts], np.int64)
                lost = [a if c is None else None for a, c in zip((first[hit] + size - width).tolist(), kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(gs[text[hit]]), pa.array(kept, pa.binary()), pa.array((anchor - first)[hit].astype(np.int32)), pa.array(first[hit].astype(np.int32)), pa.array(lost, pa.int32())],
                    [x.split()[0] for x in RECORD.split(", ")],
                )

    return run


def settle(docs: np.ndarray, contexts: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(record, from, to): the starts within each record's context whose string a smaller document has."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    counts = sizes - width + 1
    a = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    ends = np.cumsum(counts)
    record = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    at = (np.cumsum(sizes) - sizes)[record] + offset
    steps = -(-width // 8)
    words = np.empty((len(at), steps), np.uint64)
    eight = np.zeros(len(a) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | a[k : len(a) - 7 + k].astype(np.uint64)
    for k in range(steps):
        words[:, k] = eight[at + min(8 * k, width - 8)]  # the last word may overlap the one before
    group = groups_of_equals(words)
    tied = np.flatnonzero(group >= 0)
    if not len(tied):
        return []
    order = tied[np.argsort(group[tied], kind="stable")]
    begin = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    owner = docs[record[order]]
    least = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(order))))
    lost = np.sort(order[owner > least])
    if not len(lost):
        return []
    first = np.flatnonzero(np.append(True, (np.diff(lost) != 1) | (record[lost][1:] != record[lost][:-1])))
    last = np.append(first[1:], len(lost)) - 1
    return list(zip(record[lost[first]].tolist(), offset[lost[first]].tolist(), offset[lost[last]].tolist(), strict=True))


LOST = "doc long, g long, lo int, hi int, string binary"
CHUNK = 10_000


def _compared(rows: pa.Table, opened: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """What the sorted records ``rows`` lose, and the strings that must be compared with other buckets.

    ``opened`` says whose lead may have records elsewhere.
    """
    docs, gs, at = (rows.column(n).to_numpy() for n in ("doc", "g", "at"))
    context, lead = rows.column("context").combine_chunks(), rows.column("lead").combine_chunks()
    other = lambda x: np.append(True, pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False))
    new_lead = other(lead)
    new = new_lead | other(context)
    number, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    least = docs[begin]  # rows are in order of lead, context and document
    size = pc.binary_length(context).to_numpy()
    gone = np.flatnonzero(docs > least[number])
    parts = [(docs[gone], gs[gone], at[gone], at[gone] + size[gone] - width, None)]
    lead_of = np.cumsum(new_lead)[begin]
    several = np.bincount(lead_of)[lead_of] > 1
    chosen = np.flatnonzero(several | opened[begin])
    ends = np.append(begin[1:], len(docs))
    unlost = {}
    if len(chosen):
        raws = [context[i].as_py() for i in begin[chosen].tolist()]
        found = settle(least[chosen], raws, width)
        for k, lo, hi in found:
            i = int(chosen[k])
            own = np.arange(begin[i], ends[i])
            own = own[docs[own] == least[i]]
            parts.append((docs[own], gs[own], at[own] + lo, at[own] + hi, None))
            unlost.setdefault(k, []).append((lo, hi))
        strings: list[tuple] = []
        for k in np.flatnonzero(opened[begin[chosen]]).tolist():
            i, raw = int(chosen[k]), raws[k]
            keep = np.ones(len(raw) - width + 1, bool)
            for lo, hi in unlost.get(k, []):
                keep[lo : hi + 1] = False
            for row in range(begin[i], ends[i]):
                if docs[row] == least[i]:
                    strings += [(docs[row], gs[row], at[row] + x, raw[x : x + width]) for x in np.flatnonzero(keep).tolist()]
        if strings:
            d, g, p, raw = zip(*strings, strict=True)
            parts.append((np.array(d), np.array(g), np.array(p), np.array(p), list(raw)))
    for d, g, lo, hi, raw in parts:
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(g, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(raw or [None] * len(d), pa.binary())], [x.split()[0] for x in LOST.split(", ")])


def _settled(width: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's records in order, a chunk of whole leads at a time; a lead longer than a chunk is cut and stays open."""
        held: list[pa.RecordBatch] = []
        count, open_lead, begun = 0, None, False

        def work(rows: pa.Table, last_open: bool):
            nonlocal open_lead, begun
            lead = rows.column("lead")
            if not begun:
                open_lead, begun = lead[0], True
            mask = pc.equal(lead, open_lead).to_numpy()
            if last_open:
                open_lead = lead[-1]
                mask = mask | pc.equal(lead, open_lead).to_numpy()
            yield from _compared(rows, mask, width)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < chunk:
                continue
            rows = pa.Table.from_batches(held)
            lead = rows.column("lead").combine_chunks()
            cut = int(np.count_nonzero(pc.not_equal(lead, lead[-1]).to_numpy(zero_copy_only=False)))  # leads are in order
            if cut:
                yield from work(rows.slice(0, cut), False)
                rows = rows.slice(cut)
            if rows.num_rows >= chunk:
                yield from work(rows, True)
                rows = rows.slice(rows.num_rows)
            held, count = rows.to_batches(), rows.num_rows
        if count:
            yield from work(pa.Table.from_batches(held), True)

    return run


def repeated_starts(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK, range_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows of doc, g, m, n_bytes, sha, first (the least id with that text), and the runs of starts that go: doc, g, lost.

    ``docs`` has doc (no nulls) and text. ``range_bytes`` is the amount of text whose anchors make up one hash range.
    """
    rows = docs.select("doc", F.xxhash64("text").alias("g"), "text")
    raw = F.col("text").cast("binary")
    facts = written(rows.select("doc", "g", F.unhex(F.md5(raw)).alias("m"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha")), "texts")
    firsts = written(facts.groupBy("g", "m").agg(F.min("doc").alias("first")), "firsts")
    buckets = max(8, -(-(facts.agg(F.sum("n_bytes")).first()[0] or 0) // range_bytes))
    texts = rows.where(F.octet_length("text") >= width)
    keys = map_texts(texts.select("g", "text"), _dealt(width, buckets), "bucket long, blob binary").groupBy("bucket").applyInArrow(_repeated(buckets), "g long, key long")
    # written before the texts are sent, so that the anchors' blobs are gone by then
    wanted, wanted_path = written_at(keys.groupBy("g").agg(F.collect_list("key").alias("keys")).join(firsts.hint("merge"), "g").select(F.col("first").alias("doc"), "g", "keys"), "wanted")
    asked = texts.join(wanted.hint("merge"), ["doc", "g"]).select("doc", "g", "text", "keys")
    records, records_path = written_at(map_texts(asked, _records(width), RECORD), "records")
    remove(docs.sparkSession, wanted_path)
    lead = F.substring("context", F.col("ahead") + 1, F.lit(LEAD))
    sent = records.where(F.col("context").isNotNull()).select("doc", "g", "context", "ahead", "at").repartitionByRange(max(partitions(docs.sparkSession), buckets // 16), lead, F.xxhash64("doc", "at"))
    ordered = sent.select("doc", "g", "context", "at", lead.alias("lead")).sortWithinPartitions("lead", "context", "doc")
    settled, settled_path = written_at(ordered.mapInArrow(_settled(width, chunk), LOST), "settled")
    here = records.where(F.col("context").isNull()).select("doc", "g", F.col("at").alias("lo"), F.col("lost_to").alias("hi"))
    across = settled.where(F.col("string").isNotNull())
    least = across.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where(F.col("least") < F.col("most")).select("string", "least")
    beyond = across.join(least.hint("merge"), "string").where(F.col("doc") > F.col("least")).select("doc", "g", "lo", "hi")
    lost = settled.where(F.col("string").isNull()).select("doc", "g", "lo", "hi").unionByName(here).unionByName(beyond)
    runs = written(lost.groupBy("doc", "g").agg(F.collect_list(F.struct("lo", "hi")).alias("lost")), "lost")
    for path in (records_path, settled_path):
        remove(docs.sparkSession, path)
    return facts.join(firsts.hint("merge"), ["g", "m"]), runs


def lost_bytes(size: int, lost: list[dict] | None, width: int) -> np.ndarray:
    """Which of a text's bytes go."""
    change = np.zeros(size + 1, np.int32)
    for run in lost or []:
        change[run["lo"]] += 1
        change[run["hi"] + width] -= 1
    return np.cumsum(change[:-1]) > 0


def op7_suffixes(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"))
    known, runs = repeated_starts(docs, width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone_sizes, spans, digests = [], [], []
        for text, lost in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = text.as_py().encode()
            mask = lost_bytes(len(raw), lost, width)
            gone_sizes.append(int(mask.sum()))
            spans.append(int((np.diff(mask.astype(np.int8), prepend=np.int8(0)) == 1).sum()))
            digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask]).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone_sizes, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc", "g", "gone", "spans", "kept"])

    touched = docs.select("doc", F.xxhash64("text").alias("g"), "text").join(runs.hint("merge"), ["doc", "g"]).select("doc", "g", "text", "lost")
    changed = map_batches(touched, run, "doc long, g long, gone long, spans long, kept string", size=1 << 20).dropDuplicates(["doc", "g"])
    whole = (F.col("doc") != F.col("first")) & (F.col("n_bytes") >= width)  # a copy of an earlier document
    zero, nothing = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    return known.join(changed.hint("merge"), ["doc", "g"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, place, substr(h, 2 * place + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS place FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 0 ELSE 1 END AS begins FROM strings JOIN firsts USING (s) WHERE doc_id > first),
runs AS (SELECT doc_id, min(place) AS lo, max(place) + 50 AS hi FROM (SELECT doc_id, place, sum(begins) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM lost) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b, hi FROM runs),
kept AS (SELECT doc_id, sum(hi - b) AS gone, count(*) AS runs, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) || substr(any_value(h), 2 * max(hi) + 1) AS left_over FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
