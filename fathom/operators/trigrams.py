"""Symbol search over a posting table of three letters, instead of a scan of all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scalar import ascii_fold
from fathom.operators.codeindex import search_symbols

END = "\x00"
BUCKETS = 64


def grams(name: Column) -> Column:
    """The distinct runs of three letters of a folded name; two ends follow it, so that every letter begins one."""
    text = F.concat(ascii_fold(name), F.lit(END * 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substr(gram, F.lit(1), F.lit(1))), F.lit(BUCKETS)).cast("int")


def name_postings(symbols: DataFrame) -> DataFrame:
    """bucket, gram, name: a row for each distinct name and gram. Written partitioned by bucket, a search reads those of its grams' first letters."""
    names = symbols.select("name").where(F.char_length("name") > 0).distinct()
    return names.select(F.explode(grams(F.col("name"))).alias("gram"), "name").select(bucket(F.col("gram")).alias("bucket"), "gram", "name")


def search_postings(postings: DataFrame, symbols: DataFrame, files: DataFrame, query: str, limit: int = 30, kind: str | None = None, repo_id=None) -> DataFrame:
    """As ``codeindex.search_symbols``, over the names that have all grams of the query; these are verified there.

    A query of one or two letters meets the grams that begin with it. Wildcards and the empty query need the scan.
    """
    if not query or any(c in query for c in "*?%_\\"):
        return search_symbols(symbols, files, query, limit, kind, repo_id)
    low = query.translate({k: k + 32 for k in range(65, 91)})
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    firsts = sorted({g[0] for g in wanted or [low]})
    own = postings.where(F.col("bucket").isin([r[0] for r in postings.sparkSession.createDataFrame([(x,) for x in firsts], "x string").select(bucket(F.col("x"))).collect()]))
    if wanted:
        met = own.where(F.col("gram").isin(wanted)).groupBy("name").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("name")
    else:
        met = own.where(F.col("gram").startswith(low)).select("name").distinct()
    return search_symbols(symbols.join(met, "name", "left_semi"), files, query, limit, kind, repo_id)


# Points of a letter that matches, of one right after another, of one that begins a word; each letter skipped between two takes one.
MATCH, RUN, START = 16, 8, 10
NEVER = -(1 << 20)


def fuzzy_score(path: Column, query: str) -> Column:
    """The best score of an alignment of the query's letters, in order, with letters of the path; null where there is none.

    Letter case does not count. A word begins at the start, after a sign, and where a capital follows a small letter.
    """
    low = F.split(ascii_fold(path), "")
    letters = F.split(path, "")
    starts = F.transform(letters, lambda c, i: F.when((i == 0) | F.get(letters, i - 1).rlike(r"[^\p{L}\p{N}]") | (c.rlike(r"\p{Lu}") & F.get(letters, i - 1).rlike(r"\p{Ll}")), START).otherwise(0))
    wanted = query.translate({k: k + 32 for k in range(65, 91)})
    points = lambda letter: F.zip_with(low, starts, lambda c, b: F.when(c == letter, MATCH + b).otherwise(NEVER))

    def further(before: Column, letter: Column) -> Column:
        """The best scores of alignments that end at each place, from those of one letter less."""

        def reached(p: Column, i: Column) -> Column:
            apart = F.array_max(F.transform(F.slice(before, F.lit(1), i), lambda d, j: d - (i - 1 - j)))  # each letter between takes one
            return F.when((p > 0) & (i > 0), F.greatest(F.lit(NEVER), p + F.greatest(apart, F.get(before, i - 1) + RUN))).otherwise(NEVER)

        return F.transform(points(letter), reached)

    first = points(F.lit(wanted[:1]))
    best = F.array_max(F.aggregate(F.array(*map(F.lit, wanted[1:])), first, further) if wanted[1:] else first)
    return F.when(best > 0, best)


def ranked_files(paths: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """file_path, score: the distinct paths that hold the query's letters in order, the best alignments first, short paths before long."""
    import re

    if not query:
        raise ValueError("a query is needed")
    rows = paths.select("file_path").distinct().where(F.col("file_path").rlike("(?is)" + ".*".join(map(re.escape, query))))
    return rows.withColumn("score", fuzzy_score(F.col("file_path"), query)).where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.length("file_path"), "file_path").limit(limit)
