"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of ``block`` rows in an order of hashed ids. The j-th block of a source of weight w is
released at slot floor(j / w) and due by ceil((j + 1) / w); the earliest deadline first, one block a slot, meets every
deadline, so that at any slot every source is less than one block from its target. Weights are whole numbers over their
sum, never rounded, and the schedule is made for all blocks, so the deviation stays below one block however long it is.
When a source has no block left, the others keep their proportions and their targets count from that slot on; so no
slot is empty, and no row is dropped or repeated.

The schedule is made on the driver for at most about ``most_slots`` blocks: with more rows the blocks grow instead, so
driver and broadcast see at most that many rows of three numbers, and a row a source. Ranks within a source are counted
in two levels, by hash ranges of about ``range_rows`` rows, so that no task sees all rows of a large source.

Edge cases: a null source is a source of its own; null ids are spread by a hash of the whole row; repeated rows follow
each other; weights of unknown sources are ignored, sources without a weight share what is left; a source of weight 0
has no slot (null) and comes last; an empty table gives no rows; the columns of the input stay.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import isqrt, lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.base import table, whole

BLOCK = 16
MOST_SLOTS = 1 << 18
RANGE_ROWS = 1 << 12


def shares(sizes: dict, weights: dict | None) -> dict:
    """A whole number for each source, in proportion to its weight: as given, or the square root of its size."""
    order = sorted(sizes, key=lambda s: (s is not None, str(s)))
    if not weights:
        return {s: max(1, isqrt(sizes[s] << 40)) for s in order}
    wanted = {s: Fraction(weights.get(s, 0)) for s in order}
    if min(wanted.values(), default=0) < 0:
        raise ValueError("weights must not be negative")
    missing = [s for s in order if s not in weights]
    for s in missing:
        wanted[s] = max(Fraction(0), 1 - sum(Fraction(weights[x]) for x in order if x in weights)) / len(missing)
    scale = lcm(*(w.denominator for w in wanted.values())) if wanted else 1
    return {s: int(w * scale) for s, w in wanted.items()}


def schedule(weights: dict, blocks: dict) -> dict:
    """The slots of each source's blocks, by earliest deadline among the released ones.

    A phase lasts until a source of it has no block left; in it the j-th block of a source of weight w / total is
    released at floor(j * total / w) and due by ceil((j + 1) * total / w).
    """
    made: dict = {s: [] for s in weights}
    left = {s: blocks[s] for s, w in weights.items() if w > 0 and blocks[s] > 0}
    start = 0
    while left:
        order = list(left)
        total = sum(weights[s] for s in order)
        waiting: list[tuple[int, int]] = []
        ready = [(-(-total // weights[s]), k) for k, s in enumerate(order)]
        heapq.heapify(ready)
        done = [0] * len(order)
        t, over = 0, False
        while not over:
            while waiting and waiting[0][0] <= t:
                k = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[k] + 1) * total // weights[order[k]]), k))
            _, k = heapq.heappop(ready)
            s = order[k]
            made[s].append(start + t)
            done[k] += 1
            t += 1
            over = done[k] == left[s]
            heapq.heappush(waiting, (done[k] * total // weights[s], k))
        start += t
        left = {s: left[s] - done[k] for k, s in enumerate(order) if left[s] > done[k]}
    return made


def _placed(docs: DataFrame, weights: dict | None, block: int, most_slots: int, range_rows: int, seed: str) -> DataFrame:
    """The rows of ``docs`` (as _all) with the columns _block, _slot and _place. A column _copies says how often a row stands there."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "_copies"]
    copies = F.col("_copies") if "_copies" in docs.columns else F.lit(1).cast("long")
    row = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns])
    order = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))), row)
    keyed = docs.select(whole(docs.select(*[f"`{c}`" for c in columns])), F.col("source").cast("string").alias("_source"), copies.alias("_copies"), order.alias("_order"), row.alias("_row"))
    sizes = {r["_source"]: r["n"] for r in keyed.groupBy("_source").agg(F.sum("_copies").alias("n")).collect()}
    rows = sum(sizes.values())
    block = max(block, -(-rows // most_slots))
    made = schedule(shares(sizes, weights), {s: -(-n // block) for s, n in sizes.items()})
    ranges = max(1, -(-rows // range_rows))
    part = F.pmod(F.xxhash64(F.lit("range"), "_order"), F.lit(ranges)).cast("long")
    keyed = keyed.withColumn("_part", part)
    counts = keyed.groupBy("_source", "_part").agg(F.sum("_copies").alias("n"))
    before = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), (F.sum("n").over(Window.partitionBy("_source").orderBy("_part")) - F.col("n")).alias("_before"))
    running = F.sum("_copies").over(Window.partitionBy("_source", "_part").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = keyed.withColumn("_rank", running - F.col("_copies"))
    joined = ranked.join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).withColumn("_at", F.col("_before") + F.col("_rank"))
    if "_copies" in docs.columns:
        joined = joined.withColumn("_at", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_copies") - 1)))
    joined = joined.withColumn("_block", F.expr(f"_at div {block}L")).withColumn("_place", (F.col("_at") % block).cast("int"))
    plan = spark.createDataFrame([(s, j, t) for s, at in made.items() for j, t in enumerate(at)], "_t string, _j long, _slot long")
    # one row a slot: at most most_slots and a row a source
    joined = joined.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_t")) & (F.col("_block") == F.col("_j")), "left")
    return joined.select("_all", "_block", "_slot", "_place")


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, most_slots: int = MOST_SLOTS, range_rows: int = RANGE_ROWS, seed: str = "mix") -> DataFrame:
    """doc_id, source, block (of the source), slot and place (in the block) of every row; (slot, place) is the mixed order."""
    rows = docs.select("doc_id", "source").groupBy("doc_id", "source").agg(F.count("*").alias("_copies"))
    return _placed(rows, weights, block, most_slots, range_rows, seed).select("_all.*", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, most_slots: int = MOST_SLOTS, range_rows: int = RANGE_ROWS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` in their mixed order, as a range-partitioned sort; written out, the files keep it."""
    return _placed(docs, weights, block, most_slots, range_rows, seed).orderBy(F.col("_slot").asc_nulls_last(), F.col("_block"), "_place").select("_all.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
