"""Blocks of lines that are nearly equal: a prefix-filter join of runs of tokens, verified by edit similarity.

A block is a run of ``length`` non-blank lines, a token a word or a sign. Blocks of equal tokens are one class, and only the
first block of a class is compared, so copies are never paired. A run of q tokens is a gram. An edit destroys at most q grams,
so of two blocks of at most M tokens that differ by d edits, M - q + 1 - q * d grams stay in their order (q is chosen such that
this is one or more for all d below 100 - ``percent`` of M). In one order of all grams, rare ones first, the two thus share a
gram of their first ones (``_prefix``), at places that differ by no more edits than are allowed before and behind it.
The order is by the number of a gram's tokens, or by its own if it is more than they let expect, then by hash.

A file's grams are sent once, for all its blocks, to the bucket of their hash, with the sizes of its lines; rows that are sent
grow with the text and not with the pairs. What meets in a bucket gives pairs of blocks, of which lengths and places leave few;
only these are joined with their texts and verified, by the shared tokens and then by the number of edits. A gram of very many
places is cut into parts that meet two by two.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 20  # bits of the tables that count tokens and grams
GRAM = 4  # tokens, at most
ROWS_A_TOKEN = 1 << 14  # a gram of more places is split
ROWS_A_BUCKET = 1 << 22  # tokens
TOKENS_AT_ONCE = 1 << 19
PAIRS_AT_ONCE = 1 << 20
PLACES_AT_ONCE = 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the checkpoint folder, until the driver ends; the shuffle files behind it go at once."""
    spark = df.sparkSession
    path, was = f"{spark.sparkContext.getCheckpointDir()}/similar-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _dense(lines: DataFrame, loose: bool) -> DataFrame:
    """file_path, line, body (the tokens): the lines that have any."""
    text = F.regexp_replace("text", r"[A-Za-z_$][\w$]*", "v") if loose else F.col("text")
    text = F.regexp_replace(text, "[0-9]+", "0") if loose else text
    return lines.where(F.col("text").rlike(r"\S")).select("file_path", "line", F.array_join(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_$]+|[^\s\p{L}\p{N}_$])"), F.lit(1)), "\n").alias("body"))


def blocks(lines: DataFrame, length: int = 5, loose: bool = False) -> DataFrame:
    """digest, tokens, lo, hi, first (file_path, line): a row for each class. ``lines`` has file_path, line, text.

    With ``loose``, all names are alike and so are all numbers.
    """
    run = F.collect_list("body").over(Window.partitionBy("file_path").orderBy("line").rowsBetween(0, length - 1))
    whole = _dense(lines, loose).withColumn("run", run).where(F.size("run") == length).select(F.array_join("run", "\n").alias("body"), "file_path", "line")
    named = whole.withColumn("digest", F.sha2("body", 256))
    place = F.min(F.struct("file_path", "line")).alias("first")
    classes = named.groupBy("digest").agg(F.first("body").alias("body"), F.min("file_path").alias("lo"), F.max("file_path").alias("hi"), place)
    return classes.select("digest", F.split("body", "\n").alias("tokens"), "lo", "hi", "first")


def files_of(lines: DataFrame, length: int, loose: bool) -> DataFrame:
    """f (a number), file_path, lines, bodies: the files of ``length`` lines with tokens or more, a row each."""
    at = F.sort_array(F.collect_list(F.struct("line", "body")))
    whole = _dense(lines, loose).groupBy("file_path").agg(at.alias("at")).where(F.size("at") >= length)
    return stored(whole.select(F.monotonically_increasing_id().alias("f"), "file_path", F.col("at.line").alias("lines"), F.col("at.body").alias("bodies")))


def _hashed(files: DataFrame, *more: str) -> DataFrame:
    """f, sizes (tokens of each line), hashes (of each token) and ``more``."""
    sizes = F.transform("bodies", lambda x: F.size(F.split(x, "\n")))
    return files.select("f", sizes.alias("sizes"), F.transform(F.split(F.array_join("bodies", "\n"), "\n"), lambda x: F.xxhash64(x)).alias("hashes"), *more)


def firsts(files: DataFrame, length: int) -> DataFrame:
    """f, own: the blocks of a file that are the first of their class, each as twice its number, and one more if several files have it."""
    body = lambda k: F.sha2(F.array_join(F.slice("bodies", k + 1, length), "\n"), 256)
    names = F.transform(F.sequence(F.lit(0), F.size("bodies") - length), lambda k: F.unhex(F.substring(body(k), 1, 32)))  # 128 bits name a class
    each = files.select("f", "file_path", "lines", F.posexplode(names).alias("k", "id"))
    place = F.min(F.struct("file_path", F.get("lines", F.col("k")).alias("line"), "f", "k"))
    first = each.groupBy("id").agg(place.alias("first"), (F.min("f") != F.max("f")).cast("int").alias("several"))
    return first.groupBy(F.col("first.f").alias("f")).agg(F.collect_list(F.col("first.k") * 2 + F.col("several")).alias("own"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * ODD
    return x ^ (x >> np.uint64(31))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOTS)).astype(np.int64)


def _grams(tokens: np.ndarray, q: int) -> np.ndarray:
    """The hash of the gram that begins at each token; the last q - 1 have none."""
    out = tokens[: max(0, len(tokens) - q + 1)]
    for k in range(1, q):
        out = _mixed(out * ODD + tokens[k : len(out) + k])
    return out


def _pieces(batch: pa.RecordBatch):
    """Files of about TOKENS_AT_ONCE tokens: the first of them, sizes of lines, lines of each, tokens."""
    sizes, hashes = batch.column(1), batch.column(2)
    ends = hashes.offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < len(hashes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TOKENS_AT_ONCE, "right")) - 1)
        part = sizes.slice(lo, hi - lo)
        yield lo, part.flatten().to_numpy().astype(np.int64), np.diff(part.offsets.to_numpy()), _mixed(hashes.slice(lo, hi - lo).flatten().to_numpy().view(np.uint64))
        lo = hi


def token_counts(hashed: DataFrame, sizes: list[int]) -> tuple[np.ndarray, int]:
    """How many tokens and how many grams the slots have, those of a 65,536th of a task's tokens or more, and the number of all
    tokens: tables of a fixed size. They only order the grams."""

    def run(batches):
        held, total = np.zeros(2 << SLOTS, np.int64), 0
        for batch in batches:
            for _, _, _, tokens in _pieces(batch):
                total += len(tokens)
                for k, x in ((0, tokens), *((1, _grams(tokens, q)) for q in sizes)):
                    held[k << SLOTS : (k + 1) << SLOTS] += np.bincount(_slot(x), minlength=1 << SLOTS)
        often = np.flatnonzero(held > max(1, total >> 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, often)), pa.array(np.append(total, held[often]))], ["slot", "held"])

    out = np.zeros(2 << SLOTS, np.int64)
    found = hashed.mapInArrow(run, "slot long, held long").groupBy("slot").agg(F.sum("held").alias("held")).toArrow()
    slot, held = found.column("slot").to_numpy(), found.column("held").to_numpy()
    out[slot[slot >= 0]] = held[slot >= 0]
    return out, int(held[slot < 0].sum())


def _room(most: np.ndarray, percent: int) -> np.ndarray:
    """The most edits of a pair whose longer block has ``most`` tokens, so that more than ``percent`` stay."""
    return np.maximum(-(-(100 - percent) * most // 100) - 1, 0)


def _grades(percent: int) -> list[tuple[int, int, float]]:
    """q, lo, hi: the tokens of a gram for pairs whose longer block has lo tokens or more and less than hi, such that q * (d + 1)
    tokens are no more than it has: so a gram stays whatever d edits do."""
    out, hi = [], float("inf")
    for q in range(GRAM, 0, -1):
        if q == 1 or q * (100 - percent) < 100:
            most = np.arange(1, 2 if q == 1 else 100 * q // (100 - q * (100 - percent)) + 2)
            room = _room(most, percent)
            lo = int(most[(room > 0) & (most < q * (room + 1))].max(initial=-1)) + 1
            if lo < hi:
                out.append((q, lo, hi))
                hi = lo
    return out


def _shared(most: np.ndarray, percent: int, q: int) -> np.ndarray:
    """How many grams the prefixes of a pair share at least: half of those that stay, as the most common ones are not sent."""
    return np.maximum((most - q + 1 - q * _room(most, percent)) // 2, 1)


def _prefix(n: np.ndarray, percent: int, q: int, lo: int, hi: float) -> np.ndarray:
    """How many of the first grams of a block of n tokens hold ``_shared`` that it has in common with any block with which it may pair."""
    out = np.zeros(len(n), np.int64)
    for more in range(100 // max(1, 100 - percent) + 2):
        room = _room(n + more, percent)
        out = np.where((room >= max(1, more)) & (n + more >= lo) & (n + more < hi), np.maximum(out, q * room - more + _shared(n + more, percent, q)), out)
    return np.minimum(out, np.maximum(n - q + 1, 0))


def _dealt(hashed: DataFrame, length: int, percent: int, grades: list[tuple[int, int, float]], counts: np.ndarray, total: int, buckets: int) -> DataFrame:
    """A row for each bucket and file: four times the tokens of each line, and 1 or 2 more if a class begins there that one file has
    or several; gram and place of each of the file's grams in the bucket. ``hashed`` has a column own."""
    spark = hashed.sparkSession
    at_most, at_once, held = ROWS_A_TOKEN, np.float32(np.log2(max(total, 1))), spark.sparkContext.broadcast((counts, np.log2(np.maximum(counts, 1)).astype(np.float32)))

    def first_grams(tokens, grams, begin, n, q, lo, hi):
        """Whether the gram at each token is among the first of a block."""
        often = held.value[1]
        alone = often[_slot(tokens)]
        score = sum(alone[k : len(grams) + k] for k in range(q)) - (q - 1) * at_once
        score = np.rint(4 * np.maximum(score, often[(1 << SLOTS) + _slot(grams)]))
        order = np.lexsort((grams, score))
        rank = np.empty(len(grams), np.int64)
        rank[order] = np.cumsum(np.append(0, grams[order][1:] != grams[order][:-1]))
        wanted = _prefix(n, percent, q, lo, hi)
        begin, n, wanted = begin[wanted > 0], n[wanted > 0] - q + 1, wanted[wanted > 0]
        block, base = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        place = np.arange(len(block)) + np.repeat(begin - base, n)
        code = block * (len(grams) + 1) + rank[place]
        last = np.sort(code)[base + wanted - 1] if len(n) else base
        out = np.zeros(len(grams), bool)
        out[place[code <= last[block]]] = True  # all places of the last gram
        return out

    def spread(key: np.ndarray, many: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of split grams: one for each part with the file's own; and whose they are."""
        who, k = np.repeat(np.arange(len(key)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        mine = own[who] % many[who]
        return who, _mixed(key[who] + _mixed((np.minimum(mine, k) * (1 << 32) + np.maximum(mine, k)).astype(np.uint64) * ODD))

    def run(batches):
        width = np.uint64(-(-(1 << 64) // buckets))
        for batch in batches:
            for lo, sizes, lines, tokens in _pieces(batch):
                own = batch.column(3).slice(lo, len(lines))
                whose, own = np.repeat(np.arange(len(lines)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()
                start, line = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(lines))
                at, table = line[whose] + own // 2, sizes * 4
                table[at] += 1 + own % 2
                place, key = np.empty(0, np.int64), np.empty(0, np.uint64)
                for grade in grades:
                    grams = _grams(tokens, grade[0])
                    own = np.flatnonzero(first_grams(tokens, grams, start[at], start[at + length] - start[at], *grade))
                    place, key = np.append(place, own), np.append(key, grams[own])
                row = np.searchsorted(start[line], place, "right") - 1
                f = batch.column(0).slice(lo, len(lines)).to_numpy()
                many = -(-held.value[0][(1 << SLOTS) + _slot(key)] // at_most)
                hot = np.flatnonzero(many > 1)
                who, more = spread(key[hot], many[hot], f[row[hot]])
                cool, who = np.flatnonzero(many <= 1), hot[who]
                row, place, key = np.append(row[cool], row[who]), np.append(place[cool], place[who]), np.append(key[cool], more)
                bucket = (key // width).astype(np.int64) if buckets > 1 else np.zeros(len(key), np.int64)
                order = np.lexsort((place, bucket, row))
                row, key, bucket, place = row[order], key[order], bucket[order], place[order] - start[line][row[order]]
                begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))) if len(row) else np.empty(0, np.int64)
                ends = pa.array(np.append(begin, len(row)), pa.int32())
                tables = pa.ListArray.from_arrays(pa.array(line, pa.int32()), pa.array(table, pa.int32())).take(pa.array(row[begin]))
                keys = pa.ListArray.from_arrays(ends, pa.array(key.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(f[row[begin]]), tables, keys, pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))], ["bucket", "f", "lines", "keys", "places"])

    return hashed.mapInArrow(run, "bucket long, f long, lines array<int>, keys array<int>, places array<int>")


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, hits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(pair)
    pair, hits = pair[order], hits[order]
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    return pair[begin], np.add.reduceat(hits, begin) if len(pair) else hits


def _near(length: int, percent: int, grades: list[tuple[int, int, float]], buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """The pairs of blocks that meet in a bucket, at near places, as often as a pair must in one of them; and what they lack in all."""
        rows = rows.combine_chunks()
        f, lists, keys, places = rows.column("f").to_numpy(), *(rows.column(x).combine_chunks() for x in ("lines", "keys", "places"))
        table, every = lists.flatten().to_numpy().astype(np.int64), keys.flatten().to_numpy().view(np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(f)), np.diff(lists.offsets.to_numpy()))  # the row of each line
        begin = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        start = np.append(0, np.cumsum(table >> 2))  # lines as one text
        n = start[np.minimum(np.arange(len(table)) + length, len(table))] - start[:-1]
        most = np.arange(int(n.max(initial=0)) + 1)
        kind, room, least = table & 3, _room(most, percent), np.ones(len(most), np.int64)
        for q, lo, hi in grades:
            least = np.where((most >= lo) & (most < hi), _shared(most, percent, q), least)
        place = places.flatten().to_numpy() + np.repeat(start[begin[:-1]], np.diff(keys.offsets.to_numpy()))
        found, slices = [(np.empty(0, np.int64), np.empty(0, np.int64))], -(-len(every) // PLACES_AT_ONCE)
        for k in range(slices):
            own = np.flatnonzero(every % slices == k)
            key, at = every[own], place[own]
            line = np.searchsorted(start, at, "right") - 1
            parts = [line - x for x in range(length)]  # the blocks that may hold the gram
            good = [np.flatnonzero((x >= begin[of[line]]) & (kind[x] > 0)) for x in parts]
            block = np.concatenate([x[k] for x, k in zip(parts, good, strict=True)])
            good = np.concatenate(good)
            before = at[good] - start[block]
            code = (key[good] << 31) + before
            order = np.argsort(code)
            code, block, before = code[order], block[order], before[order]
            behind = n[block] - before
            many = np.searchsorted(code, code + np.minimum(_room(100 * n[block] // max(percent, 1), percent), (1 << 31) - 1 - before), "right") - np.arange(len(code)) - 1
            upto, lo = np.cumsum(many), 0
            while lo < len(code):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
                size = many[lo:hi]
                i = np.repeat(np.arange(lo, hi), size)
                j = np.arange(len(i)) + np.repeat(np.arange(lo, hi) + 1 - np.cumsum(size) + size, size)
                b, rest = before[j] - before[i], behind[j] - behind[i]
                near = np.flatnonzero(b + np.abs(rest) <= room[n[block[i]] + np.maximum(b + rest, 0)])
                a, b = block[i[near]], block[j[near]]
                own = (a != b) & ((of[a] != of[b]) | (kind[a] + kind[b] > 2))
                met = np.minimum(a, b)[own] * len(table) + np.maximum(a, b)[own]
                if len(table) ** 2 * (hi - lo) < 1 << 63:  # a gram meets one of the other block's at most
                    met = np.sort(met * (hi - lo) + i[near[own]] - lo)
                    met = met[np.append(True, met[1:] != met[:-1])[: len(met)]] // (hi - lo)
                found.append(_summed([(met, np.ones(len(met), np.int64))]))
                lo = hi
                if len(found) > 20:
                    found = [_summed(found)]
        pair, hits = _summed(found)
        a, b = pair // max(len(table), 1), pair % max(len(table), 1)
        need = least[np.maximum(n[a], n[b])]
        spare = -(-need // buckets) - 1  # so many may be in each bucket that does not send the pair
        enough = hits > spare
        a, b, gain, need = a[enough], b[enough], (hits - spare)[enough], (need - buckets * spare)[enough]
        swap = f[of[a]] > f[of[b]]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        place = lambda x: pa.StructArray.from_arrays([pa.array(f[of[x]]), pa.array(x - begin[of[x]], pa.int32())], ["f", "k"])
        return pa.table({"a": place(a), "b": place(b), "gain": pa.array(gain), "need": pa.array(need)})

    return run


def near_blocks(files: DataFrame, length: int, percent: int) -> DataFrame:
    """a, b (f, and the number of the block in its file): what is left to verify, among the first blocks of all classes."""
    grades = _grades(percent)
    counts, total = token_counts(_hashed(files), [q for q, _, _ in grades])
    buckets = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_A_BUCKET))
    owned = files.select("f", "bodies").join(firsts(files, length), "f")
    dealt = _dealt(_hashed(owned, "own"), length, percent, grades, counts, total, buckets)
    place = "struct<f: bigint, k: int>"
    met = dealt.groupBy("bucket").applyInArrow(_near(length, percent, grades, buckets), f"a {place}, b {place}, gain long, need long")
    return stored(met.groupBy("a", "b").agg(F.sum("gain").alias("gain"), F.max("need").alias("need")).where("gain >= need").select("a", "b"))


def edits(x: list[str], y: list[str]) -> int:
    """Levenshtein's distance of two lists of tokens, a column of the table at a time as the bits of a number."""
    lo, end = 0, min(len(x), len(y))
    while lo < end and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if not x or not y:
        return max(len(x), len(y))
    at: dict[str, int] = {}
    for k, token in enumerate(x):
        at[token] = at.get(token, 0) | 1 << k
    full, top, out = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down = full, 0
    for token in y:
        same = at.get(token, 0)
        flat = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(flat | up)), flat & up
        out += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(flat | more)) & full, more & flat & full
    return out


def _scored(percent: int):
    def run(batches):
        for batch in batches:
            keep, found = [], []
            for k, (x, y) in enumerate(zip(*(batch.column(f"{c}_body").to_pylist() for c in "ab"), strict=True)):
                x, y = x.split("\n"), y.split("\n")
                most = max(len(x), len(y))
                if sum((Counter(x) & Counter(y)).values()) * 100 > percent * most and (same := 100 * (most - edits(x, y))) > percent * most:
                    keep.append(k)
                    found.append(same // most)
            left = batch.select([c for c in batch.schema.names if not c.endswith("_body")]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(found, pa.int32())], [*left.schema.names, "similarity"])

    return run


def similar_blocks(lines: DataFrame, length: int = 5, percent: int = 80, loose: bool = False) -> DataFrame:
    """a, b (digests), similarity (whole percent), a_first, b_first: the pairs of classes of more than ``percent`` similarity
    whose copies are in several files. Members of classes are in ``blocks``."""
    files = files_of(lines, length, loose)
    met = near_blocks(files, length, percent)
    needed = met.select(F.explode(F.array("a", "b")).alias("x")).groupBy(F.col("x.f").alias("f")).agg(F.collect_set("x.k").alias("ks"))
    each = files.join(needed, "f").select("f", "file_path", "lines", "bodies", F.explode("ks").alias("k"))
    first = F.struct("file_path", F.get("lines", F.col("k")).alias("line"))
    texts = stored(each.select(F.struct("f", "k").alias("x"), F.array_join(F.slice("bodies", F.col("k") + 1, length), "\n").alias("body"), first.alias("first")).withColumn("digest", F.sha2("body", 256)))
    side = lambda x: texts.select(F.col("x").alias(f"{x}_x"), F.col("digest").alias(x), F.col("first").alias(f"{x}_first"), F.col("body").alias(f"{x}_body")).hint("merge")
    both = met.withColumnsRenamed({"a": "a_x", "b": "b_x"}).join(side("a"), "a_x").join(side("b"), "b_x").drop("a_x", "b_x")
    schema = both.drop("a_body", "b_body").schema.add("similarity", "integer")
    swap = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
    return both.mapInArrow(_scored(percent), schema).select(swap("a", "b"), swap("b", "a"), "similarity", swap("a_first", "b_first"), swap("b_first", "a_first"))
