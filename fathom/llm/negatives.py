"""Hard negatives for embeddings by blocked matrix products.

Anchors are read in chunks of a bounded number of bytes. Each chunk is broadcast, and the candidates' Arrow batches meet it
block by block as float64 products, which are exact while sums stay below 2**53; batches whose largest components could
pass that bound are multiplied as Python's integers, and a score beyond 64 bits is an error. Two passes read all
candidates: the first keeps for each anchor and task the best rows of its label, which Spark merges to the first five; the
second keeps for each anchor and positive the best rows of other labels whose score lies in the positive's window, merged
to the first three. What a task holds is bounded by the chunk, whatever its number of candidates, and no label is ever
grouped, so a common label makes no task larger.

The anchors' number follows the input: their chunks pass the driver one at a time, as every broadcast does, and the
results of each are written to the shared folder.

Edge cases: rows with a null label, a null vector or a component that is null or not finite take no part; an anchor's
other rows are those of another id (a null id is another one, and comes after all in ties); repeated rows are rows of
their own, but an anchor that is repeated exactly is one; of vectors of different lengths, the components that both have
count; an empty table, or one without anchors, gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, map_texts, remove, remove_later, shared_dir, store_at, table, written_at

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
CHUNK_BYTES, BLOCK = 16 << 20, 1024
EXACT, LAST = 1 << 53, (1 << 63) - 1
READY = "vec_id long, label int, q binary"
FOUND = "anchor long, slot int, score long, id long"


class Vectors(NamedTuple):
    ids: np.ndarray  # a null id is LAST, with ``named`` false
    named: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # float64, a row each

    def part(self, rows) -> Vectors:
        return Vectors(*(x[rows] for x in self))


def ready(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, and the whole numbers floor(scale * component) as float64 bytes, of the rows that take part. ``rows`` has vec_id, embedding, label."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        values = lists.flatten()
        x = np.floor(scale * values.cast(pa.float64()).to_numpy(zero_copy_only=False))
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        bad = np.append(0, np.cumsum(~np.isfinite(x)))
        ends = np.cumsum(sizes)
        good = bad[ends] == bad[ends - sizes]
        raw = [x[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], ["vec_id", "label", "q"])
        return out.filter(pa.array(good))

    used = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return map_batches(used.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("int")), run, READY)


def vectors(batch: pa.RecordBatch, width: int | None = None) -> Vectors:
    """The rows of ``ready``; shorter ones get components 0, longer ones are cut to ``width`` (the longest, if None)."""
    raw = batch.column(2).to_pylist()
    sizes = np.array([len(r) // 8 for r in raw], np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    rows = np.zeros((len(raw), width))
    if len(raw) and sizes.min() == sizes.max() >= width:
        rows[:] = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)[:, :width]
    else:
        for row, r in zip(rows, raw, strict=True):
            row[: len(r) // 8] = np.frombuffer(r, np.float64)[:width]
    ids = batch.column(0)
    return Vectors(ids.fill_null(LAST).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), rows)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, as 64-bit integers; OverflowError beyond."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [[[int(x) for x in row] for row in m.tolist()] for m in (a, b)]
    return np.array([[sum(x * y for x, y in zip(r, s, strict=True)) for s in exact[1]] for r in exact[0]], object).astype(np.int64)


class Best:
    """The best ``k`` (score, id) of each group: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int, least: np.ndarray | None = None) -> None:
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min) if least is None else least.copy()  # what a score must reach
        self.rows = [np.empty(0, np.int64)] * 3

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        g, s, i = (np.concatenate(x) for x in zip(self.rows, (group, score, ids), strict=True))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[g[full]] = s[full]
        self.rows = [x[keep] for x in (g, s, i)]


def best_positives(anchors: Vectors, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each anchor its best ``k`` of the batches' other rows with its label."""
    best = Best(len(anchors.ids), k)
    for own, other, score, first in products(anchors, batches):
        hit = (score >= best.least[first : first + len(own.ids), None]) & (own.labels[:, None] == other.labels) & ((own.ids[:, None] != other.ids) | ~other.named)
        at, to = np.nonzero(hit)
        best.add(first + at, score[at, to], np.where(other.named, other.ids, LAST)[to])
    g, s, i = best.rows
    yield found(g, np.zeros(len(g), np.int32), s, i)


def best_negatives(anchors: Vectors, owner: np.ndarray, low: np.ndarray, high: np.ndarray, slot: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each window (its anchor, lowest and highest score) the best ``k`` of the batches' rows with another label. ``owner`` ascends."""
    best = Best(len(owner), k, low)
    for own, other, score, first in products(anchors, batches):
        differs = own.labels[:, None] != other.labels
        begin, end = np.searchsorted(owner, [first, first + len(own.ids)])
        for part in np.array_split(np.arange(begin, end), max(1, -(-(end - begin) // BLOCK))):
            row = owner[part] - first
            at, to = np.nonzero((score[row] >= best.least[part, None]) & (score[row] <= high[part, None]) & differs[row])
            best.add(part[at], score[row[at], to], np.where(other.named, other.ids, LAST)[to])
    g, s, i = best.rows
    yield found(owner[g], slot[g], s, i)


def products(anchors: Vectors, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Vectors, Vectors, np.ndarray, int]]:
    """(block of anchors, block of candidates, their scores, number of the first anchor), for all blocks."""
    width = anchors.rows.shape[1]
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            other = vectors(batch.slice(begin, BLOCK), width)
            for first in range(0, len(anchors.ids), BLOCK):
                own = anchors.part(slice(first, first + BLOCK))
                yield own, other, scores(own.rows, other.rows), first


def found(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ids = pa.array(ids, pa.int64(), mask=ids == LAST)
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), ids], ["anchor", "slot", "score", "id"])


def first_of(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot, with ``rank`` from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chunks(anchors: DataFrame, size: int = CHUNK_BYTES) -> Iterator[Vectors]:
    """The anchors, about ``size`` bytes at a time."""
    held, used = [], 0
    for row in anchors.select("vec_id", "label", "q").toLocalIterator():
        if held and used + len(row.q) > size:
            yield _packed(held)
            held, used = [], 0
        held.append(row)
        used += len(row.q) + 32
    if held:
        yield _packed(held)


def _packed(held: list) -> Vectors:
    columns = [pa.array([r[k] for r in held], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))]
    return vectors(pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "q"]))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, scale: int = SCALE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding, label; ``is_anchor`` is a condition over vec_id and label. A negative's score lies from
    ``low`` to ``high`` percent of its positive's.
    """
    spark = rows.sparkSession
    every = ready(rows, scale)
    anchors, place = written_at(every.where(is_anchor & F.col("vec_id").isNotNull()).distinct(), "anchors")
    out = f"{shared_dir(spark)}/fathom-negatives-{place.rsplit('-', 1)[1]}"
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts = 0
    for parts, chunk in enumerate(chunks(anchors, chunk_bytes), 1):
        store_at(_of_chunk(spark, every, chunk, positives, negatives, low, high), f"{out}/part={parts}")
    remove(spark, place)
    if not parts:
        return empty
    remove_later(spark, out)
    return spark.read.schema(empty.schema).parquet(*(f"{out}/part={k}" for k in range(1, parts + 1)))


def _of_chunk(spark: SparkSession, every: DataFrame, chunk: Vectors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(chunk)
    best = first_of(map_texts(every, lambda batches: best_positives(shared.value, batches, positives), FOUND, size=8 << 20), positives)
    known = best.orderBy("anchor", "rank").toArrow()  # at most ``positives`` rows for each anchor of the chunk
    owner, score, slot = (known.column(c).to_numpy() for c in ("anchor", "score", "rank"))
    windows = spark.sparkContext.broadcast((owner, -(-score * low // 100), score * high // 100, slot.astype(np.int32)))
    ids = chunk.ids[owner] if len(owner) else owner
    pairs = pa.table({"anchor": known.column("anchor"), "slot": known.column("rank"), "anchor_id": pa.array(ids, pa.int64()), "positive_id": known.column("id"), "positive_score": known.column("score")})
    hits = first_of(map_texts(every, lambda batches: best_negatives(shared.value, *windows.value, batches, negatives), FOUND, size=8 << 20), negatives)
    joined = hits.join(F.broadcast(spark.createDataFrame(pairs)), ["anchor", "slot"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor and positive: its first three hard negatives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH used AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT DISTINCT ON (vec_id, label, q) * FROM used WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, c.r AS c, CAST(coalesce(list_sum(list_transform(list_zip(a.q, c.q, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM anchors a JOIN used c ON c.vec_id IS DISTINCT FROM a.vec_id
), positives AS (
  SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.c ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.r = p.r AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
