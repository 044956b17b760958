"""Personal data: exact base patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Base kinds are found by regular expressions, whose groups are possessive so that long runs cost linear time
and no stack, and checked by digit counts, number ranges and Luhn sums.

The method on top: seed entities (base matches, and strings of 32 or more hexadecimal digits, which are themselves
reported as secrets) induce lexical patterns: the two words before them, the one word before them, and the words on both
sides. A pattern needs a telling word: one that of all its places in the corpus stands next to a string with a digit in at
least a share of ``TELLING``, as words that stand anywhere (in, of, the) tell nothing. A graph joins patterns with the instances (distinct strings with a digit) that they surround. In each round a
pattern scores the share of its instances that are trusted, times a damping for few instances; it is accepted at a score
of ``confidence`` with ``support`` trusted instances. Trusted are the seeds, and from then on all that an accepted pattern
surrounds, so that identifiers found by one pattern induce the next. Rounds go on until none adds a pattern. Every string
with a digit that an accepted pattern surrounds gets the kind ``id``.

One pass over the texts writes what it finds to a narrow table, a second one counts their words; patterns and instances are counted before they
are joined, so a pattern that a third of all rows shares is one row for each distinct instance. Accepted patterns are
a written table, so that adaptive execution can split the rows of a common one in the joins.

Edge cases: a null text is empty; rows with one id and one text get equal results; null ids match null ids; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import table, text_of, whole, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
# Each finds the leftmost matches of the plain pattern: a match can only start where a run starts or where the
# match before it ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}
STRINGS = r"(?<!\S)(?=\S{5})(?=[^\s0-9]*+[0-9])\S++"  # white-space separated strings of 5 characters or more with a digit
SECRET = "^[0-9a-fA-F]{32,}$"
SPAN = "array<struct<start:int,end:int,value:string,context:string,after:string>>"
EXTRA = "array<struct<kind:string,start:int,end:int>>"
NEAR = 48  # code points of context on each side


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits(value))
    places = F.sequence(F.lit(1), F.char_length(back))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def spans(text: Column, pattern: str, hint: Column) -> Column:
    """Matches with their places in code points and up to ``NEAR`` code points of the text before and after them; empty
    where the hint is false.

    Lengths are summed in chunks of 256 matches, as an array that grows by one at a time would take quadratic time.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(SPAN)

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["value"])
        before = F.right(F.concat(acc["tail"], pair["gap"]), F.lit(NEAR))
        one = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), before.alias("context"), F.substring(pair["after"], 1, NEAR).alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, pair["value"]), F.lit(NEAR)).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        part = F.aggregate(chunk, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), add)
        return F.struct(part["at"].alias("at"), part["tail"].alias("tail"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    following = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("value"), following.alias("after")), F.lit(1), F.size(found))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / 256).cast("int")), lambda c: F.slice(pairs, c * 256 + 1, F.lit(256)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))
    none = F.array().cast("array<array<struct<gap:string,value:string,after:string>>>")
    return F.when(hint, F.flatten(F.aggregate(F.when(F.size(found) > 0, chunks).otherwise(none), start, add_chunk)["out"])).otherwise(empty)


def _checked(kind: str):
    return lambda s: valid(kind, s["value"])


def _listed(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _tagged(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))


def base_spans(text: Column) -> dict[str, Column]:
    """An array of spans for each base kind."""
    out = {}
    for kind, pattern in PATTERNS.items():
        hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(pattern)
        out[kind] = F.filter(spans(text, pattern, hint), _checked(kind))
    return out


def patterns_of(context: Column, after: Column) -> Column:
    """The lexical patterns around a span: two words before, one word before, and a word on each side. In lower case, runs
    of digits as #; each needs a letter. A word that the context's limit may have cut does not count."""

    def words(text: Column) -> Column:
        return F.split(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+")

    whole = F.when(F.char_length(context) == NEAR, F.regexp_replace(context, r"^\S*", "")).otherwise(context)
    left = F.array_remove(words(whole), "")
    last, before = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2)
    right = F.regexp_extract(F.lower(after), r"^\s*(\S*[\p{L}]\S*)\s", 1)
    kinds = F.array(F.concat(before, F.lit(" "), last, F.lit(" _")), F.concat(last, F.lit(" _")), F.when(right != "", F.concat(last, F.lit(" _ "), F.regexp_replace(right, "[0-9]+", "#"))))
    return F.filter(F.array_compact(kinds), lambda p: p.rlike(r"\p{L}"))


def found_in(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, h, the base spans by kind, and the strings with a digit; written, as all else starts from it."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    text = F.col("text")
    columns = [c.alias(k) for k, c in base_spans(text).items()]
    strings = spans(text, STRINGS, text.rlike("[0-9]"))
    return written(rows.select("doc_id", F.xxhash64("text").alias("h"), *columns, strings.alias("strings")), "pii")


def occurrences(found: DataFrame) -> DataFrame:
    """Strings and seeds with their patterns: doc_id, h, start, end, value, patterns, seed, secret."""
    trimmed = r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$"
    seeds = found.select("doc_id", "h", F.explode(F.concat(*KINDS)).alias("s"), F.lit(True).alias("base"))
    every = seeds.unionByName(found.select("doc_id", "h", F.explode("strings").alias("s"), F.lit(False).alias("base")))
    cut = every.select("doc_id", "h", "base", "s.start", "s.value", F.regexp_replace("s.value", trimmed, "").alias("core"), patterns_of(F.col("s.context"), F.col("s.after")).alias("patterns"))
    at = F.col("start") + F.instr("value", F.col("core")) - 1
    secret = ~F.col("base") & F.col("core").rlike(SECRET)
    return cut.where(F.char_length("core") >= 5).select("doc_id", "h", at.alias("start"), (at + F.char_length("core")).alias("end"), F.col("core").alias("value"), "patterns", (F.col("base") | secret).alias("seed"), secret.alias("secret"))


CONFIDENCE, SUPPORT, TELLING = 0.4, 3, 0.05


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word, total: how often each word stands in the texts, written as in patterns."""
    words = F.split(F.regexp_replace(F.lower(text_of(text_column)), "[0-9]+", "#"), r"\s+")
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("total"))


def telling_patterns(seen: DataFrame, spread: DataFrame, totals: DataFrame, support: int = SUPPORT, telling: float = TELLING) -> DataFrame:
    """Patterns of ``support`` instances or more with a telling word. ``seen`` has a row of patterns for each string, ``spread`` one for each of them."""
    words = lambda p: F.array_remove(F.split(p, " "), "_")
    near = seen.select(F.explode(F.array_distinct(F.flatten(F.transform("patterns", words)))).alias("word")).groupBy("word").agg(F.count("*").alias("near"))
    told = near.join(totals, "word").where(F.col("near") >= telling * F.col("total")).select("word")
    frequent = spread.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= support).select("pattern")
    return frequent.withColumn("word", F.explode(words(F.col("pattern")))).join(told, "word", "left_semi").select("pattern").distinct()


def score_patterns(seen: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Patterns that the bootstrapping trusts: pattern, confidence. ``seen`` has pattern, value, seed."""
    edges = written(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.where("seed").select("value").distinct()
    trusted, known = seeds, 0
    while True:
        held = edges.join(trusted.withColumn("good", F.lit(1)), "value", "left").select("pattern", "good")
        scored = held.groupBy("pattern").agg(F.count("*").alias("n"), F.count("good").alias("good"))
        score = F.round(F.col("good") / F.col("n") * (1 - 1 / (F.lit(1.0) + F.col("n"))), 9)
        accepted = written(scored.where(F.col("good") >= support).select("pattern", score.alias("confidence")).where(F.col("confidence") >= confidence), "pii-patterns")
        now = accepted.count()
        if now == known:
            return accepted
        known = now
        reached = edges.join(accepted.hint("merge"), "pattern").select("value")
        trusted = written(seeds.unionByName(reached).distinct(), "pii-trusted")


def discover(found: DataFrame, docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Spans beyond the base ones: doc_id, h, extra (an array of kind, start, end). ``found`` is what ``found_in`` gives for ``docs``."""
    seen = written(occurrences(found), "pii-seen")
    spread = seen.select("doc_id", "h", "start", "end", "value", "seed", "secret", F.explode("patterns").alias("pattern"))
    telling = written(telling_patterns(seen, spread, word_counts(docs), support), "pii-telling")
    spread = spread.join(telling.hint("merge"), "pattern", "left_semi")
    patterns = score_patterns(spread.select("pattern", "value", "seed"), confidence, support)
    met = spread.where(~F.col("secret")).join(patterns.hint("merge"), "pattern").select("doc_id", "h", F.lit("id").alias("kind"), "start", "end")
    hits = met.unionByName(seen.where("secret").select("doc_id", "h", F.lit("secret").alias("kind"), "start", "end")).distinct()
    return hits.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))


def with_extra(found: DataFrame, docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``found`` with the column extra, in order of start, without spans that overlap base ones."""
    more = written(discover(found, docs, confidence, support), "pii-extra")
    joined = found.drop("strings").join(more.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").drop("d", "g")
    base = F.concat(*KINDS)
    free = F.filter(F.coalesce("extra", F.array().cast(EXTRA)), lambda x: ~F.exists(base, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    ordered = F.array_sort(free, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))
    return joined.withColumn("extra", ordered)


METHOD = ["secret", "id"]  # kinds of the method, in the order in which they follow the base kinds


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = with_extra(found_in(docs), docs)
    base = F.concat(*[F.transform(k, _listed(k)) for k in KINDS])
    own = {k: F.filter("extra", _of_kind(k)) for k in METHOD}
    every = F.concat(base, *[F.transform(own[k], _listed(k)) for k in METHOD])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS] + [F.size(own[k]).cast("long").alias(f"n_{k}") for k in METHOD]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; n_chars, if there, follows."""
    found = with_extra(found_in(docs), docs)
    tagged = F.concat(*[F.transform(k, _tagged(k)) for k in KINDS], *[F.transform(F.filter("extra", _of_kind(k)), _tagged(k)) for k in METHOD])
    marks = found.select("doc_id", "h", F.array_sort(tagged).alias("marks")).where(F.size("marks") > 0).dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("_d"), F.col("h").alias("_g"), F.col("marks").alias("_marks"))
    own = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text"))
    joined = own.join(marks, F.col("_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_text") == F.col("_g")), "left")
    text = F.col("_text")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    new = F.aggregate("_marks", state, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    changed = joined.select("_all", F.when(F.col("_marks").isNotNull(), new).alias("_new"))
    replaced = {"text": F.col("_new"), "n_chars": F.char_length("_new").cast("long")}
    columns = [F.coalesce(replaced[c], F.col("_all")[c]).cast(docs.schema[c].dataType).alias(c) if c in replaced else F.col("_all")[c].alias(c) for c in docs.columns]
    return changed.select(*columns)
