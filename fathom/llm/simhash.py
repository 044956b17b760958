"""SimHash document fingerprints and exact Hamming-radius search, in DataFrame functions alone.

A document's terms are its pairs of neighbouring words, each as often as it occurs (its weight); a text of one
word has that word. Each term's 64-bit hash votes for or against every bit, and the sign of the sum is the
fingerprint's bit. Votes are counted in 32 sums, each of two bits at once: bit b and bit b + 32 of a hash are
added in the halves of one long.

``neighbours`` finds all fingerprints within a Hamming radius of a query set: bits are cut into blocks; whichever
``radius`` blocks differ, the others agree, so for each choice of blocks that agree there is a table keyed by
them, and every match is met in at least one. Equal fingerprints meet once, with their count.

``successors`` pairs every document with the next one in descending order of ids, on narrow rows alone: they are
range-partitioned, each range is a window of its own, and a range's last row is joined to the first row of the
range that follows (one row a range). ``edited`` then shuffles the texts once: they are asked for the heads that
their predecessors need, and joined to the heads of their successors.

Edge cases: a null or empty text has the fingerprint 0; null ids come after all others; equal ids are ordered by
a hash of the text; rows equal in id and text stand at one place and get equal results; a lone document is its
own successor; ids may be any long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.base import partitions, table, text_of, written

BITS = 64
PAIR = (1 << 32) + 1
KEYS = ["doc_id", "h"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pairs_of(words: Column) -> Column:
    """Pairs of neighbouring words, or the only word with a null."""
    last = F.greatest(F.size(words) - 1, F.lit(1))
    return F.arrays_zip(F.slice(words, 1, last).alias("a"), F.slice(words, 2, last).alias("b"))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and fp of every row; rows with equal keys must have equal texts. Votes are summed before they are shuffled."""
    hashed = rows.select(*keys, words_of(F.col(text)).alias("words")).select(*keys, F.explode_outer(pairs_of(F.col("words"))).alias("term")).select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h_"))
    sums = [F.sum(F.shiftrightunsigned("h_", i).bitwiseAND(F.lit(PAIR))).alias(f"s{i}") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count("h_").alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        s = F.col(f"s{i}")
        fp = fp.bitwiseOR(F.when(2 * s.bitwiseAND(F.lit((1 << 32) - 1)) > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        high = 1 << (i + 32)
        fp = fp.bitwiseOR(F.when(2 * F.shiftrightunsigned(s, 32) > F.col("n"), F.lit(high - (1 << 64) if i == 31 else high)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, fp.alias("fp"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right``, which has the same two key columns; a null id meets a null id."""
    keys = keys or KEYS
    other = right.select(F.col(keys[0]).alias("k0_"), F.col(keys[1]).alias("k1_"), *[c for c in right.columns if c not in keys]).hint("merge")
    return left.join(other, F.col(keys[0]).eqNullSafe(F.col("k0_")) & (F.col(keys[1]) == F.col("k1_")), how).drop("k0_", "k1_")


def successors(rows: DataFrame) -> DataFrame:
    """doc_id, h, next_id, next_h of the distinct (doc_id, h) of ``rows``, in descending order of ids, the first after the last.

    The range's number is written with each row, so that it holds whichever executor is lost.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    ranged = rows.select(*KEYS).distinct().repartitionByRange(partitions(rows.sparkSession), *order)
    placed = written(ranged.select(*KEYS, F.spark_partition_id().alias("part")), "places")
    own = Window.partitionBy("part").orderBy(*order)
    ranked = placed.select("part", *KEYS, F.lead(F.struct(*KEYS)).over(own).alias("after"), F.row_number().over(own).alias("place"))
    heads = ranked.where(F.col("place") == 1).select("part", F.struct(*KEYS).alias("head"))
    by_part = Window.orderBy("part")  # a row for each range, however many rows there are
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(by_part), F.first("head").over(every)).alias("head"))
    found = ranked.join(following, F.col("part") == F.col("p")).withColumn("next", F.coalesce("after", "head"))
    return found.select(*KEYS, F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def edited(rows: DataFrame, following: DataFrame) -> DataFrame:
    """doc_id, h, edited of ``rows`` (doc_id, h, text): the last floor(n / 3) of a text's n code points are replaced by the
    first as many of the next document's. ``following`` is what ``successors`` gives, with the column n.
    """
    asked = following.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n") / 3).cast("int").alias("third"))
    given = keyed_join(rows, asked).select(F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), "third", F.substring("text", F.lit(1), F.col("third")).alias("head"))
    heads = given.groupBy(*KEYS).agg(F.any_value("third").alias("third"), F.any_value("head").alias("head"))
    both = keyed_join(rows, heads)
    return both.select(*KEYS, F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("third")), "head").alias("edited"))


def neighbours(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All fingerprints within ``radius`` of the queries': query_fp, fp, distance, n (rows with that fingerprint).

    ``fps`` and ``queries`` have a column fp; a column n of ``fps`` says how many rows a row stands for. A pair is met in the first table whose blocks agree, and only there.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be less than the number of blocks")
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[k] for k in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    listed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(tables)])

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(listed).alias("x")).select("*", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("k")).drop("x")

    every = keyed(fps.groupBy("fp").agg((F.sum("n") if "n" in fps.columns else F.count("*")).alias("n"))).select(F.col("fp").alias("other"), "n", "t", "k")
    asked = keyed(queries.select("fp").distinct())
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    near = asked.join(every.hint("merge"), (asked.t == every.t) & (asked.k == every.k) & (F.bit_count(apart) <= radius))
    # the first table in which a pair agrees: the blocks that agree, and of them the first ``blocks - radius``
    agree = F.lit(None)
    for t, m in reversed(list(enumerate(tables))):
        agree = F.when(apart.bitwiseAND(F.lit(m)) == 0, t).otherwise(agree)
    return near.where(agree == asked.t).select(F.col("fp").alias("query_fp"), F.col("other").alias("fp"), F.bit_count(apart).alias("distance"), "n")


def op10_simhash(spark: SparkSession, sf_dir: str, radius: int = 3) -> DataFrame:
    """Fingerprints of all texts and their edited texts; ``n_near`` is, for the queries (ids divisible by 20), the number
    of documents within ``radius`` of the fingerprint, the row itself included, and null for all other rows.
    """
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    facts = written(rows.select(*KEYS, F.char_length("text").cast("long").alias("n")).groupBy(*KEYS, "n").agg(F.count("*").alias("copies")), "simhash-facts")
    prints = written(fingerprints(rows, KEYS, "text"), "simhash-prints")
    following = written(keyed_join(facts, successors(facts)), "simhash-order")
    new = edited(rows, following)
    digests = new.select(*KEYS, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited")
    changed = fingerprints(digests, [*KEYS, "edited_sha256"], "edited").withColumnRenamed("fp", "edited_fp")
    own = keyed_join(keyed_join(following, prints), changed)
    after = keyed_join(own, prints.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp")), ["next_id", "next_h"])
    every = written(after, "simhash-all")
    asked = every.where(F.col("doc_id") % 20 == 0).select(*KEYS, "fp")
    near = neighbours(every.select("fp", F.col("copies").alias("n")), asked, radius).groupBy("query_fp").agg(F.sum("n").alias("n_near"))
    counted = asked.join(near, F.col("fp") == F.col("query_fp")).select(*KEYS, "n_near")
    done = keyed_join(every, counted, how="left")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
