"""Scores of solutions folded from their usage logs by maps that compose.

Each outcome maps a score s to max(lo, min(hi, a * s + b)), and two such maps in a row are one again. So a log can be cut
anywhere: pieces are folded to a map each, where they lie, and maps are composed in the log's order. A solution with a
large share of the log is cut into ranges like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructType

FREE = (1.0, 0.0, -np.inf, np.inf)
# What an outcome does to a score, as (a, b, lo, hi).
OUTCOMES = {"success": (0.9, 0.1, -np.inf, np.inf), "partial": (1.0, 0.03, -np.inf, 1.0), "failure": (1.0, -0.15, 0.1, np.inf)}
COUNTS = {"successes": "success", "partials": "partial", "failures": "failure"}


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The maps (rows of a, b, lo, hi) that do ``first`` and ``then``."""
    a, b = then[:, 0] * first[:, 0], then[:, 0] * first[:, 1] + then[:, 1]
    lo, hi = (np.clip(then[:, 0] * first[:, k] + then[:, 1], then[:, 2], then[:, 3]) for k in (2, 3))
    return np.stack([a, b, lo, hi], 1)


def composed(maps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of the runs of equal keys, the composition of each run), by halving."""
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    starts = begins
    while len(maps) > len(starts):
        place = np.arange(len(maps)) - np.repeat(starts, np.diff(np.append(starts, len(maps))))
        odd = place % 2 == 1
        at = np.flatnonzero(odd)
        maps = maps.copy()
        maps[at - 1] = compose(maps[at - 1], maps[at])
        starts = starts - np.cumsum(odd)[starts]  # odd places before each run
        maps = maps[~odd]
    return begins, maps


def applied(maps: np.ndarray, start: float) -> np.ndarray:
    return np.clip(maps[:, 0] * start + maps[:, 1], maps[:, 2], maps[:, 3])


def reward_state(log: DataFrame, start: float = 0.5) -> DataFrame:
    """Score and counters of each solution from its usage log (solution_id, ts, log_id, outcome), folded in order.

    Unknown outcomes change nothing; equal times follow the log's ids and then the outcomes' names.
    """
    key = log.schema["solution_id"]
    numbers = ["a", "b", "lo", "hi"]
    pieces_kind = StructType([log.schema["solution_id"], log.schema["ts"], log.schema["log_id"]])
    for c in numbers:
        pieces_kind = pieces_kind.add(c, DoubleType())
    done_kind = StructType([key]).add("score", DoubleType())
    for c in COUNTS:
        pieces_kind, done_kind = pieces_kind.add(c, LongType()), done_kind.add(c, LongType())

    def codes(column: pa.Array) -> np.ndarray:
        return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes = batch.column(3)
            maps = np.tile(np.array(FREE), (batch.num_rows, 1))
            hits = {name: pc.fill_null(pc.equal(outcomes, name), False).to_numpy(zero_copy_only=False) for name in OUTCOMES}
            for name, hit in hits.items():
                maps[hit] = OUTCOMES[name]
            first, maps = composed(maps, codes(batch.column(0)))
            totals = [np.add.reduceat(hits[COUNTS[c]].astype(np.int64), first) if len(first) else first for c in COUNTS]
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *map(pa.array, maps.T), *map(pa.array, totals)], pieces_kind.names)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last solution so far, as one piece
        for batch in batches:
            if not batch.num_rows:
                continue
            every = batch if held is None else pa.concat_batches([held, batch])
            first, maps = composed(np.stack([every.column(c).to_numpy() for c in numbers], 1), codes(every.column(0)))
            totals = [np.add.reduceat(every.column(c).to_numpy(), first) for c in COUNTS]
            at = pa.array(first)
            merged = pa.RecordBatch.from_arrays([*(every.column(k).take(at) for k in range(3)), *map(pa.array, maps.T), *map(pa.array, totals)], schema=every.schema)
            held = merged.slice(len(first) - 1)
            yield finished(merged.slice(0, len(first) - 1))
        if held is not None:
            yield finished(held)

    def finished(rows: pa.RecordBatch) -> pa.RecordBatch:
        score = applied(np.stack([rows.column(c).to_numpy() for c in numbers], 1), start)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), *(rows.column(c) for c in COUNTS)], done_kind.names)

    order = ["solution_id", "ts", "log_id"]
    cut = log.select(*order, "outcome").repartitionByRange(*order, "outcome").sortWithinPartitions(*order, "outcome").mapInArrow(pieces, pieces_kind)
    return cut.repartition("solution_id").sortWithinPartitions(*order).mapInArrow(scores, done_kind)
