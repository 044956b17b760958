"""N-gram Jaccard join: which documents' shingle sets are alike, by a blocked sparse matrix product.

The matrix of documents by shingles is cut into column blocks, ranges of shingle hashes. A set of n shingles shares at
least ceil(t * n) with any set that meets the threshold t. With columns in one global order, rarest first, two such sets
therefore meet in the first n - ceil(t * n) + 1 columns of both. That is the size-derived bound: pairs that meet in no
such column are discarded before anything is multiplied, and columns that one row alone has cannot join a pair at all.

Any order that is the same everywhere gives exact results. Here a share of the columns, chosen by hash and well
above 1 - t, comes first, by the number of rows that hold them, which is counted over all documents; the other
columns follow by hash. So a document whose counted columns are mostly its own drops out, whatever passages it shares.

What meets is multiplied in two steps, never as all pairs of a group of like documents:

1. in every column of the prefixes the least row meets each other row (a star). A sketch of each row, the parities of
   its counts in about as many bins as it has members, bounds the difference of two sets from below; pairs beyond what
   their sizes allow are discarded. For the rest, overlaps are accumulated over column blocks, and a pair is dropped as soon as the columns
   left cannot lift it to its bound;
2. links make components. Only columns that still hold rows of several components are left; there all pairs of rows of
   different components that are near in size meet in blocks and pass the sketch bound. Of what it leaves, a bucket of
   columns sends on a forest, the pairs that connect its components, so rows sent grow with the rows and not with pairs.
   The product follows; a bucket where it refutes a pair that had joined two components may have held back others, so the
   step is repeated there, without the refuted pairs and with 128 times as many pairs for each component, until it refutes
   none that joined. Then no pair is left that could link two components. Rows of refuted pairs
   get sketches of more bins first, so that of a group of rows that are almost alike only pairs at the threshold are
   multiplied and remembered, and not the square of the group.

Copies are one row from the start, named by a 128-bit hash of the set. Nothing is collected: components are found by
joins of written tables, which adaptive execution can split at common rows.

Edge cases: a null text is empty; documents without words have the size 0 and stay alone; rows that share an id are
one node and so linked; a null id has no component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.base import map_batches, remove, table, text_of, whole, written, written_at
from fathom.llm.graph import components
from fathom.llm.hashing import TOP, bucket_count, deal, from_blobs, shingle_sets

ROWS_A_BLOCK = 1024
COLUMN_BLOCKS = 8
ROWS_A_BUCKET = 20_000
PAIRS_AT_ONCE = 1 << 16
LEAST_BINS, MOST_BINS = 512, 1 << 14
FINER, MOST_FINE_BINS = 8, 1 << 16  # sketches of rows of refuted pairs: bins a member, and at most
WORDS_AT_ONCE = 1 << 19  # of sketches that are compared
COUNTED_SHARE = 0.4
COUNTED = np.uint64(int(COUNTED_SHARE * 2**64) & ~0xFFFF)  # hashes below it are of the columns that are counted and come first


def class_key(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set, as two signed longs."""
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    """Columns of a row of n in which it must meet any row that is alike."""
    return n + percent * n // -100 + 1 if n else 0


def sketch(found: np.ndarray, finer: int = 1, most: int = MOST_BINS) -> bytes:
    """The parities of the set's counts in bins: two sketches differ in no more bits than the sets in members.

    The number of bins is the least power of two that is not below the set's size (``finer`` times), within limits; halves that are put
    together by exclusive or are the sketch in half as many bins.
    """
    bins = min(most, max(LEAST_BINS, 1 << max(0, finer * len(found) - 1).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of eight-byte words) in ``width`` words."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


class Sketches:
    """Sketches of many rows, which are compared in the bins that both rows of a pair have."""

    def __init__(self, column: list[bytes]):
        self.width = np.array([len(x) // 8 for x in column], np.int64)
        self.words = [np.frombuffer(x, "<u8") for x in column]
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _in(self, width: int, rows: np.ndarray) -> np.ndarray:
        """The sketches of rows of at least that width, folded to it; no others are held in that width."""
        if width not in self.at:
            wide = np.flatnonzero(self.width >= width)
            out = np.empty((len(wide), width), np.uint64)
            for place, k in enumerate(wide.tolist()):
                out[place] = folded(self.words[k], width)
            self.at[width] = wide, out
        wide, out = self.at[width]
        return out[np.searchsorted(wide, rows)]

    def apart(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """In how many bits the rows i differ from the rows j of ``other``."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.width[i], other.width[j])
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            step = max(1, WORDS_AT_ONCE // w)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                out[part] = np.bitwise_count(self._in(w, i[part]) ^ other._in(w, j[part])).sum(1, dtype=np.int64)
        return out


def least_overlap(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that links sets of the sizes m and n."""
    return -(-percent * (m + n) // (100 + percent))


def may_link(m: np.ndarray, n: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes m and n, and sketches that differ in ``apart`` bits, leave room for a link."""
    need = least_overlap(m, n, percent)
    return (np.minimum(m, n) >= need) & (apart <= m + n - 2 * need)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sorted sets meet the threshold. Overlaps are accumulated over column blocks, for the pairs that can
    still reach their bound with the columns that are left."""
    m, n = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    need = least_overlap(m, n, percent)
    overlap = np.zeros(len(left), np.int64)
    live = np.flatnonzero(np.minimum(m, n) >= need)
    edges = np.array([(k << 64) // COLUMN_BLOCKS for k in range(1, COLUMN_BLOCKS)], np.uint64)
    at_left, at_right = ({int(k): [0, *np.searchsorted(side[k], edges).tolist(), len(side[k])] for k in live} for side in (left, right))
    for block in range(COLUMN_BLOCKS):
        keep = []
        for k in live.tolist():
            a, b = at_left[k], at_right[k]
            own, other = left[k][a[block] : a[block + 1]], right[k][b[block] : b[block + 1]]
            if len(own) and len(other):
                overlap[k] += np.count_nonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own)
            if overlap[k] + min(a[-1] - a[block + 1], b[-1] - b[block + 1]) >= need[k]:
                keep.append(k)
        live = np.array(keep, np.int64)
    out = np.zeros(len(left), bool)
    out[live] = True
    return out


def _sorted_pairs(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of key and owner of a bucket, in order."""
    keys, owners = from_blobs(x.as_py() for x in blobs.column("blob"))
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    if len(keys):
        once = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))  # an owner can come in several batches
        keys, owners = keys[once], owners[once]
    return keys, owners


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each group of equal keys."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(keys)))


def _shared(blobs: pa.Table) -> pa.Table:
    """owner, key, holders of the keys of a bucket that more than one owner has."""
    keys, owners = _sorted_pairs(blobs)
    _, size = _groups(keys)
    holders = np.repeat(size, size)
    keep = holders > 1
    return pa.table({"owner": pa.array(owners[keep], pa.int64()), "key": pa.array(keys[keep].view(np.int64), pa.int64()), "holders": pa.array(holders[keep], pa.int64())})


def _stars(blobs: pa.Table) -> pa.Table:
    """Distinct pairs of the least owner of a key and each other one."""
    keys, owners = _sorted_pairs(blobs)
    begin, size = _groups(keys)
    least = np.repeat(owners[begin], size)
    pairs = np.unique(np.stack([least, owners], 1)[least != owners], axis=0)
    return pa.table({"l": pa.array(pairs[:, 0], pa.int64()), "r": pa.array(pairs[:, 1], pa.int64())})


def _across(percent: int, quota: int):
    """A function of a bucket's rows, which are those of one bucket or, without that column, of no numbered one."""

    def run(rows: pa.Table) -> pa.Table:
        """A forest of the pairs that may link rows of different components, over all groups of a bucket."""
        # in order of nodes, so that buckets send on the same pairs where they can
        order = np.lexsort((rows.column("first").to_numpy(), rows.column("group").to_numpy()))
        group, node, name, n, part = (rows.column(c).to_numpy()[order] for c in ("group", "first", "a", "n", "component"))
        raw = rows.column("sketch").to_pylist()
        sketches = Sketches([raw[k] for k in order.tolist()])
        refuted = rows.column("refuted")
        barred: dict[tuple[int, int], list[np.ndarray]] = {}  # by class, as a class's rows have the same ones
        for k in np.flatnonzero(refuted.is_valid().to_numpy()[order]).tolist():
            if (own := (int(node[k]), int(name[k]))) not in barred:
                others = refuted[int(order[k])].values
                barred[own] = [others.field(c).to_numpy() for c in ("first", "a")]
        begin, size = _groups(group)
        _, label = np.unique(part, return_inverse=True)
        found: dict[tuple[int, ...], tuple[int, int, bool]] = {}  # by classes, as two may meet in many groups
        sent: dict[int, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def is_barred(x: int, y: int) -> bool:
            bar = barred.get((int(node[x]), int(name[x])))
            return bar is not None and bool(((bar[0] == node[y]) & (bar[1] == name[y])).any())

        def test() -> None:
            if not held:
                return
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            need = least_overlap(n[i], n[j], percent)
            near = np.minimum(n[i], n[j]) >= need
            i, j = i[near], j[near]
            good = may_link(n[i], n[j], sketches.apart(i, sketches, j), percent)
            for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                if node[x] > node[y]:
                    x, y = y, x
                pair = int(node[x]), int(name[x]), int(node[y]), int(name[y])
                if label[x] != label[y] and pair not in found and not is_barred(x, y):
                    p, q = int(label[x]), int(label[y])
                    sent[p], sent[q] = sent.get(p, 0) + 1, sent.get(q, 0) + 1
                    if joins := min(sent[p], sent[q]) >= quota:  # so pairs are at most quota times the components
                        label[label == q] = p
                        sent[p] = max(sent[p], sent[q])
                    found[pair] = x, y, joins

        count = 0
        for at, m in zip(begin.tolist(), size.tolist(), strict=True):
            for k in range(at, at + m - 1):
                j = k + 1 + np.flatnonzero(label[k + 1 : at + m] != label[k])
                if len(j):
                    held.append((np.full(len(j), k), j))
                    count += len(j)
                if count >= PAIRS_AT_ONCE:
                    test()
                    count = 0
        test()
        i, j, joins = np.array(list(found.values()), np.int64).reshape(-1, 3).T
        bucket = rows.column("bucket")[0].as_py() if "bucket" in rows.column_names else None
        return pa.table({"lf": pa.array(node[i]), "la": pa.array(name[i]), "rf": pa.array(node[j]), "ra": pa.array(name[j]), "bucket": pa.array([bucket] * len(i), pa.int64()), "joins": pa.array(joins > 0)})

    return run


PAIR = "lf long, la long, rf long, ra long"
MORE_PAIRS = 128  # for each component, with each round


class _Join:
    """One join: its rows, classes and prefixes, as written tables."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_column: str, text_column: str):
        self.words, self.percent = words, percent
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
        self.rows, self.known = rows, rows.where(F.col("doc_id").isNotNull())
        self.paths: list[str] = []  # tables that go once the rows have their classes
        self.facts = self._held(map_batches(rows, self._describe(), "doc_id long, n_shingles long, a long, b long, sampled long, more array<long>, sketch binary", size=1 << 20), "shingles")
        counted = self.facts.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        own = ("n_shingles", "sampled", "more", "sketch")
        firsts = counted.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.min_by(F.struct(*own), "doc_id").alias("x"))
        self.classes = self._held(firsts.select("a", "b", "first", F.col("x.n_shingles").alias("n"), "x.sampled", "x.more", "x.sketch"), "classes")

    def _held(self, df: DataFrame, label: str) -> DataFrame:
        out, path = written_at(df, label)
        self.paths.append(path)
        return out

    def _done(self, *paths: str) -> None:
        for path in paths:
            remove(self.known.sparkSession, path)

    def _describe(self):
        words, percent = self.words, self.percent

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            below = [int(np.searchsorted(x, COUNTED)) for x in sets]  # sets are sorted
            sampled = [len(np.unique(x[:s] & TOP)) for x, s in zip(sets, below, strict=True)]
            more = [(x[s : prefix_size(len(x), percent)] & TOP).view(np.int64) for x, s in zip(sets, below, strict=True)]
            names = [class_key(x) for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(sampled, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array([sketch(x) for x in sets], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "a", "b", "sampled", "more", "sketch"])

        return run

    def prefixes(self) -> DataFrame:
        """a, first, keys: the columns of each class's prefix that other classes hold too, as far as they are counted."""
        words, percent = self.words, self.percent

        def counted_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = {class_key(x)[0]: x[: np.searchsorted(x, COUNTED)] & TOP for x in shingle_sets(batch.column(0).to_pylist(), words)}
            names = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
            return np.concatenate(list(found.values()) or [np.empty(0, np.uint64)]), names

        shared = deal(self.known.select("text"), counted_keys, self._buckets()).groupBy("bucket").applyInArrow(_shared, "owner long, key long, holders long")
        listed = shared.groupBy(F.col("owner").alias("a")).agg(F.array_sort(F.collect_list(F.struct("holders", "key"))).alias("shared"))
        same = F.count("*").over(Window.partitionBy("a"))  # classes that agree in half of their names share a list, so take all of it
        joined = self.classes.select("*", same.alias("same")).join(listed, "a", "left")
        own = F.col("sampled") - F.coalesce(F.size("shared"), F.lit(0))  # columns that no other row has
        prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        left = F.when(F.col("same") > 1, F.size("shared")).otherwise(F.greatest(F.lit(0).cast("long"), prefix - own).cast("int"))
        met = F.transform(F.slice(F.coalesce("shared", F.array().cast("array<struct<holders:bigint,key:bigint>>")), F.lit(1), F.coalesce(left, F.lit(0))), lambda x: x["key"])
        return self._held(joined.select("a", "first", F.concat(met, "more").alias("keys")).where(F.size("keys") > 0), "prefixes")

    def _buckets(self) -> int:
        """Hash ranges of about a million pairs, from the counted sizes of all rows."""
        pairs = self.facts.agg(F.sum("n_shingles")).first()[0] or 0
        return max(math.ceil(COUNTED_SHARE * pairs / (1 << 20)), 8 * bucket_count(self.facts))

    def dealt(self, keyed: DataFrame) -> DataFrame:
        """Blobs of ``keyed`` (an owner and its keys)."""

        def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = batch.column(1)
            return found.flatten().to_numpy().view(np.uint64), np.repeat(batch.column(0).to_numpy(), np.diff(found.offsets.to_numpy()))

        return deal(keyed, keys_of, 8 * bucket_count(keyed)).groupBy("bucket")

    def sets_of(self, prefixes: DataFrame) -> tuple[DataFrame, str]:
        """first, a, shingles of the rows that share a column, the only sets that can be needed; and the table's path."""
        words = self.words
        wanted = self.known.join(prefixes.select("first", "a").distinct().hint("merge"), F.col("doc_id") == F.col("first")).select("first", "a", "text")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            good = [class_key(s)[0] == a for s, a in zip(sets, batch.column(1).to_pylist(), strict=True)]  # another row may share the id
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["first", "a", "shingles"])
            return out.filter(pa.array(good, pa.bool_()))

        return written_at(map_batches(wanted, run, "first long, a long, shingles binary", size=1 << 20).dropDuplicates(["first", "a"]), "sets")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b of the pairs (PAIR) that link."""
        percent = self.percent
        left = sets.select(F.col("first").alias("lf"), F.col("a").alias("la"), F.col("shingles").alias("ls"))
        right = sets.select(F.col("first").alias("rf"), F.col("a").alias("ra"), F.col("shingles").alias("rs"))
        both = pairs.join(left.hint("merge"), ["lf", "la"]).join(right.hint("merge"), ["rf", "ra"]).select("lf", "rf", "ls", "rs")

        def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
            sides = [[np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (2, 3)]
            good = pa.array(linked_pairs(*sides, percent), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

        return written(map_batches(both, verify, "a long, b long", size=1 << 20), "links")

    def stars(self, prefixes: DataFrame) -> tuple[DataFrame, str]:
        """Pairs (PAIR) of the least and each other row of a column that sizes and sketches leave; and the table's path."""
        percent = self.percent
        edges = self.dealt(prefixes.select("a", "keys")).applyInArrow(_stars, "l long, r long").distinct()
        side = lambda k: self.classes.select(F.col("a").alias(k), F.col("first").alias(k + "f"), F.col("n").alias(k + "n"), F.col("sketch").alias(k + "s")).hint("merge")
        edges, path = written_at(edges, "stars")
        both = edges.join(side("l"), "l").join(side("r"), "r").select("lf", F.col("l").alias("la"), "rf", F.col("r").alias("ra"), "ln", "rn", "ls", "rs").where("lf <> rf")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            m, n = (batch.column(k).to_numpy() for k in (4, 5))
            left, right = (Sketches(batch.column(k).to_pylist()) for k in (6, 7))
            own = np.arange(len(m))
            good = may_link(m, n, left.apart(own, right, own), percent)
            return batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

        out = written_at(map_batches(both, run, PAIR, size=1 << 20), "star-pairs")
        self._done(path)
        return out

    def mixed(self, prefixes: DataFrame, labels: DataFrame) -> DataFrame:
        """a, first, n, sketch, group, bucket of the rows of columns that hold rows of several components."""
        percent = self.percent
        placed = prefixes.join(labels.select(F.col("node").alias("first"), "component").hint("merge"), "first", "left").select("a", "first", F.coalesce("component", "first").alias("component"), "keys")
        placed, path = written_at(placed, "placed")
        mixed, path_2 = written_at(self.dealt(placed.select("component", "keys")).applyInArrow(_shared, "owner long, key long, holders long").select(F.col("owner").alias("component"), "key"), "mixed-columns")
        # columns are compared by the bits that blobs keep, as there
        met = placed.select("a", "first", "component", F.explode("keys").alias("key")).join(mixed.hint("merge"), ["component", "key"]).select("a", "first", "key")
        rows, path_3 = written_at(met.join(self.classes.select("a", "first", "n", "sketch").hint("merge"), ["a", "first"]), "mixed-rows")
        self._done(path, path_2)
        big, path_4 = written_at(rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > ROWS_A_BLOCK), "large-columns")
        rows = rows.join(big.hint("merge"), "key", "left")
        # in a large column, rows near in size share a band; then bands are cut into blocks that meet two by two
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
        rows = rows.withColumn("band", F.explode(F.when(F.col("members").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(band, band + 1))))
        blocks = F.ceil(F.coalesce("members", F.lit(1)) / ROWS_A_BLOCK).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("first"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        group = F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other"))
        buckets = max(2 * bucket_count(rows), -(-(prefixes.agg(F.sum(F.size("keys"))).first()[0] or 0) // ROWS_A_BUCKET))
        self.paths += [path_3, path_4]
        return rows.select("a", "first", "n", "sketch", group.alias("group")).withColumn("bucket", F.pmod("group", F.lit(buckets)))

    def across(self, rows: DataFrame, labels: DataFrame, quota: int = 1, refuted: DataFrame | None = None, fine: DataFrame | None = None) -> tuple[DataFrame, str]:
        """Pairs (PAIR) that connect the components of ``rows`` that share a column and that sizes and sketches leave, without
        those of ``refuted`` (PAIR): a forest, with up to ``quota`` pairs of a bucket for each component before it is joined to another;
        their bucket, and whether they joined; and the table's path. ``fine`` has finer sketches of some rows."""
        rows = rows.join(labels.select(F.col("node").alias("first"), "component").hint("merge"), "first", "left").withColumn("component", F.coalesce("component", "first"))
        if fine is not None:
            rows = rows.join(fine.hint("merge"), ["first", "a"], "left").withColumn("sketch", F.coalesce("fine", "sketch")).drop("fine")
        if refuted is None:
            rows = rows.withColumn("refuted", F.lit(None).cast("array<struct<first:long,a:long>>"))
        else:
            end = lambda k: F.struct(F.col(k + "f").alias("first"), F.col(k + "a").alias("a"))
            both = refuted.select(F.explode(F.array(F.struct(end("l").alias("own"), end("r").alias("other")), F.struct(end("r").alias("own"), end("l").alias("other")))).alias("x")).select("x.own.first", "x.own.a", "x.other")
            rows = rows.join(both.groupBy("first", "a").agg(F.collect_set("other").alias("refuted")).hint("merge"), ["first", "a"], "left")
        dealt = rows.select("a", "first", "component", "n", "sketch", "refuted", "group", "bucket")
        return written_at(dealt.groupBy("bucket").applyInArrow(_across(self.percent, quota), PAIR + ", bucket long, joins boolean"), "pairs-across")

    def finer(self, refuted: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """first, a, fine: finer sketches of the rows of the pairs ``refuted``; the pairs that even those leave; and the sketches' path."""
        percent = self.percent
        wanted = refuted.select("lf", "la").unionAll(refuted.select("rf", "ra")).toDF("first", "a").distinct()

        def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            made = pa.array([sketch(x, FINER, MOST_FINE_BINS) for x in found], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, pa.array([len(x) for x in found], pa.int64())], ["first", "a", "fine", "n"])

        fine, path = written_at(map_batches(sets.join(wanted.hint("merge"), ["first", "a"]).select("first", "a", "shingles"), describe, "first long, a long, fine binary, n long", size=1 << 20), "fine-sketches")
        side = lambda k: fine.select(F.col("first").alias(k + "f"), F.col("a").alias(k + "a"), F.col("n").alias(k + "n"), F.col("fine").alias(k + "s")).hint("merge")
        both = refuted.join(side("l"), ["lf", "la"]).join(side("r"), ["rf", "ra"]).select("lf", "la", "rf", "ra", "ln", "rn", "ls", "rs")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            m, n = (batch.column(k).to_numpy() for k in (4, 5))
            left, right = (Sketches(batch.column(k).to_pylist()) for k in (6, 7))
            own = np.arange(len(m))
            return batch.select([0, 1, 2, 3]).filter(pa.array(may_link(m, n, left.apart(own, right, own), percent), pa.bool_()))

        return fine.select("first", "a", "fine"), written(map_batches(both, run, PAIR, size=1 << 20), "close"), path

    def joined(self, prefixes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Links that make the components: of stars, and of pairs across components until none is left that might link; and
        the labels of the components, where they are known by then."""
        sets, path = self.sets_of(prefixes)
        pairs, pairs_path = self.stars(prefixes)
        links, refuted, quota = self.links(pairs, sets), None, 1
        fine = close = fine_path = None
        self._done(pairs_path)
        labels = components(links)
        rows = self.mixed(prefixes, labels)
        while True:
            pairs, pairs_path = self.across(rows, labels, quota, close, fine)
            quota *= MORE_PAIRS
            more = self.links(pairs.select("lf", "la", "rf", "ra").distinct(), sets)
            links = links.unionByName(more)
            wrong = written(pairs.join(more.select(F.col("a").alias("lf"), F.col("b").alias("rf")).hint("merge"), ["lf", "rf"], "left_anti"), "refuted")
            self._done(pairs_path)
            new = not more.isEmpty()
            # what a bucket held back was of components that its pairs had joined; where those are links, nothing is open
            if wrong.where("joins").isEmpty():
                self._done(path, *([fine_path] if fine_path else []))
                return links, None if new else labels
            rows = rows.join(wrong.where("joins").select("bucket").distinct().hint("merge"), "bucket", "left_semi")
            wrong = wrong.select("lf", "la", "rf", "ra").distinct()
            refuted = wrong if refuted is None else refuted.unionByName(wrong)
            if fine_path:
                self._done(fine_path)
            fine, close, fine_path = self.finer(refuted, sets)
            if new:
                labels = components(links)

    def shared_ids(self, of_row: DataFrame) -> DataFrame:
        """Links of the classes of rows that share an id; ``of_row`` has doc_id and first."""
        some = of_row.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("most")).where(F.col("a") < F.col("most")).select("doc_id", "a")
        return of_row.join(some.hint("merge"), "doc_id").select("a", F.col("first").alias("b")).distinct()

    def result(self) -> DataFrame:
        prefixes = self.prefixes()
        links, labels = self.joined(prefixes)
        near = self.facts.select("doc_id", "n_shingles", "a", "b").join(self.classes.select("a", "b", "first").hint("merge"), ["a", "b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first"))
        of_row = written(near, "rows")
        self._done(*self.paths)
        same_id = self.shared_ids(of_row.where("doc_id IS NOT NULL AND first IS NOT NULL"))
        groups = labels if labels is not None and same_id.isEmpty() else components(links.unionByName(same_id))
        joined = of_row.join(groups.select(F.col("node").alias("first"), "component").hint("merge"), "first", "left")
        return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("component_id"))


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module. Links: 100 * intersection >= percent * union."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    return _Join(docs, words, percent, id_column, text_column).result()


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their group, all columns; rows without an id stay."""
    gone = written(link(docs, words, percent).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id")).join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti")
    return kept.select("_all.*")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), words=3, percent=90)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS shingle FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""
