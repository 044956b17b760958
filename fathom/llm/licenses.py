"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A template is a license notice, a block a window of ``2 * span`` words of a document; windows start every ``span`` words,
so that any ``span`` neighbouring words, wherever lines break, are together in one. Both are sets of words. Block B is linked
with template T of k words if some window of 2 k words of B, one starting every k, has at least ``threshold`` of T's words,
and holds T if such a window has all phrases that tell T's license from others, each with its words in a row. (So the words of a short notice that
stand apart are none.) The
words of all templates are put in one global order, rarest first by the number of documents that hold them, counted over
all documents that hold a gate word (no other document can match; see ``gate_words``). Then (1) prefix: a block that holds T shares a word
with the first n - a + 1 words of T, where n is T's size and a the least overlap; (2) length: it has at least a words;
(3) positions: from the first shared word on, both must have a words left. What a window of B holds, B holds, so no pair is lost; those that pass are verified.

Texts are read once: what is written is a row of numbers a document, with the template words and the blocks of those
documents that hold a gate word. Templates are a fixed parameter, so their words and prefixes are small whatever the
input's size; they are the only data that is broadcast or collected (a count for each of their words). Documents that
hold a template are grouped by id and text hash and joined to the narrow rows.

Edge cases: a null text is empty and has no words; rows with one id and one text get equal results; null ids
match null ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import table, text_of, written

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of common licenses, with the phrases that tell them from others.
TEMPLATES = [
    ("gpl-3.0", "gnu general public license;version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "gnu general public license;version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "gnu lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "gnu affero", "licensed under the GNU Affero General Public License"),
    ("apache-2.0", "apache license;version 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "apache;compliance", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission;hereby granted;charge;copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution;source;binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission;hereby granted;fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license;v 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "cc0", "Released under the CC0 1.0 Universal public domain dedication"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
]

SPAN = 40
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. ``lower`` is faster; of other characters it turns just two into ones with ASCII letters."""
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def spaced(low: Column) -> Column:
    """The words of a lower-cased text, a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NO_WORD, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(words: Column) -> Column:
    return F.when(F.char_length(words) > 2, spaces(words) - 1).otherwise(0).cast("long")


def runs_of_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def words_of(text: str) -> list[str]:
    return sorted(set(runs_of_words(text)))


def phrase_columns(words: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a spaced text."""
    doubled = F.replace(words, F.lit(" "), F.lit("  "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        one, two = f" {phrase} ", f" {phrase.replace(' ', '  ')} "
        there = words.contains(one)
        counts.append(F.when(there, F.floor((F.char_length(doubled) - F.char_length(F.replace(doubled, F.lit(two), F.lit("")))) / len(two))).otherwise(0))
        firsts.append(F.when(there, spaces(F.substring(words, F.lit(1), F.instr(words, one) - 1))))
        from_end = F.char_length(words) - F.instr(F.reverse(words), one[::-1]) - len(one) + 1
        lasts.append(F.when(there, spaces(F.substring(words, F.lit(1), from_end))))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return {
        "n_base": total.cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_list": F.array_compact(F.array(*labels)),
    }


def prepared(templates: list[tuple[str, str, str]], span: int) -> list[tuple[str, list[str], list[str], list[str], int]]:
    """Label, telling words (a telling one of each first), telling phrases, words and length of each template."""
    out = []
    for label, telling, text in templates:
        phrases = [" ".join(runs_of_words(x)) for x in telling.split(";")]
        told, every = [w for x in phrases for w in x.split()], words_of(text)
        if not told or not set(told) <= set(every):
            raise ValueError("each template needs telling words, all of them its own")
        if len(runs_of_words(text)) > span:
            raise ValueError(f"a template may have {span} words at most")
        out.append((label, list(dict.fromkeys(told)), [f" {x} " for x in phrases], every, len(runs_of_words(text))))
    return out


def least_words(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def gate_words(sets: list, threshold: float) -> list[str]:
    """Words one of which is in every block that has ``threshold`` of a template's words: of each the first n - a + 1, its
    telling words before others and long words before short ones."""
    firsts = [(told + sorted(set(ws) - set(told), key=lambda w: (-len(w), w)))[: len(ws) - least_words(len(ws), threshold) + 1] for _, told, _, ws, _ in sets]
    return sorted({w for x in firsts for w in x})


def any_of(words: set[str]) -> str:
    return " (?:" + "|".join(sorted(map(re.escape, words))) + ") "


def described(docs: DataFrame, templates: list[tuple[str, str, str]], span: int, id_column: str, text_column: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, h, the columns of the base phrases, and for documents with a gate word: terms (its template words) and
    blocks (those with a gate word; no other block can have ``threshold`` of a template's words)."""
    sets = prepared(templates, span)
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for *_, ws, _ in sets for w in ws})])
    gate = gate_words(sets, threshold)
    some = any_of(set(gate))
    words = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    words = words.select("doc_id", F.xxhash64("text").alias("h"), spaced(ascii_lower(F.col("text"))).alias("words"))
    told = words.select("doc_id", "h", "words", F.when(F.col("words").rlike(some), F.split(F.trim("words"), " ")).alias("list"))
    last = F.floor((F.size("list") - 1) / span).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda k: F.slice("list", k * span + 1, F.lit(2 * span)))
    blocks = F.filter(cut, lambda b: F.arrays_overlap(b, F.array(*map(F.lit, gate))))
    return told.select("doc_id", "h", word_count(F.col("words")).alias("n_words"), *(c.alias(k) for k, c in phrase_columns(F.col("words")).items()), F.array_intersect("list", vocabulary).alias("terms"), F.when(F.col("list").isNotNull(), blocks).alias("blocks"))


def best_window(block: Column, length: Column, template: Column, phrases: Column) -> Column:
    """The most words of the template in a window of 2 ``length`` words of the block, one starting every ``length``, that has all phrases; else null."""
    count = F.greatest(F.ceil(F.size(block) / length) - 1, F.lit(1)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(block, k * length + 1, 2 * length))
    told = F.filter(windows, lambda w: F.forall(phrases, lambda x: F.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), x)))
    return F.array_max(F.transform(told, lambda w: F.size(F.array_intersect(w, template))))


def find_templates(rows: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, span: int = SPAN) -> DataFrame:
    """Pairs of block and template of ``rows`` (doc_id, h, terms, blocks) from the threshold on: doc_id, h, template (its
    number), label and containment (null where no window that meets the threshold has the telling phrases)."""
    sets = prepared(templates, span)
    vocabulary = sorted({w for *_, ws, _ in sets for w in ws})
    count = {r["word"]: r["count"] for r in rows.select(F.explode("terms").alias("word")).groupBy("word").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)), 1)}
    prefixes = []
    for number, (label, _, phrases, ws, length) in enumerate(sets):
        ordered = sorted(ws, key=rank.__getitem__)
        least = least_words(len(ordered), threshold)
        prefixes += [(w, number, label, ordered, phrases, length, len(ordered), least, i) for i, w in enumerate(ordered[: len(ordered) - least + 1])]
    shortest = min(r[7] for r in prefixes)
    prefixes = rows.sparkSession.createDataFrame(prefixes, "word string, number int, label string, template array<string>, phrases array<string>, length int, n int, least int, i int")
    ranks = F.create_map(*(F.lit(x) for item in rank.items() for x in item))
    sized = rows.where(F.col("blocks").isNotNull()).select("doc_id", "h", F.explode("blocks").alias("block")).withColumn("set", F.array_distinct("block")).where(F.size("set") >= shortest)
    # words of no template come first in the global order, as the rarest; they match nothing
    shared = F.array_sort(F.transform(F.array_intersect("set", F.array(*map(F.lit, vocabulary))), lambda w: F.struct(ranks[w].alias("rank"), w.alias("word"))))
    listed = sized.select("doc_id", "h", "block", "set", F.size("set").alias("m"), shared.alias("shared"))
    listed = listed.select("doc_id", "h", "block", "set", "m", (F.col("m") - F.size("shared")).alias("before"), F.posexplode("shared").alias("j", "item")).select("doc_id", "h", "block", "set", "m", (F.col("before") + F.col("j")).alias("j"), F.col("item.word").alias("word"))
    pairs = listed.join(F.broadcast(prefixes), "word").where((F.col("m") >= F.col("least")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("least")))
    whole = pairs.where(F.size(F.array_intersect("set", "template")) >= F.col("least")).select("doc_id", "h", "block", "number", "label", "template", "phrases", "length", "n", "least")
    most = lambda phrases: best_window(F.col("block"), F.col("length"), F.col("template"), phrases)
    linked = whole.withColumn("linked", most(F.array().cast("array<string>"))).where(F.col("linked") >= F.col("least")).withColumn("overlap", most(F.col("phrases")))
    held = F.when(F.col("overlap") >= F.col("least"), F.col("overlap") / F.col("n"))
    return linked.select("doc_id", "h", F.col("number").alias("template"), "label", held.alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, span: int = SPAN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Phrases and templates of every document; the score is the best containment, or a half for a phrase alone.

    ``n_links`` counts all templates of which a window has ``threshold`` of the words; labels and score take those with the
    telling phrases too.
    """
    own = written(described(docs, templates, span, id_column, text_column, threshold), "licenses")
    found = find_templates(own, templates, threshold, span).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set(F.when(F.col("containment").isNotNull(), F.col("label"))).alias("found"), F.max("containment").alias("best"), F.count_distinct("template").alias("links"))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base_list", F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in PHRASES.items())
    listed = lambda xs: f"[{', '.join(map(quoted, xs))}]"
    templates = ", ".join(f"({quoted(label)}, {listed(telling)}, {listed(phrases)}, {listed(ws)}, {length}, {number})" for number, (label, telling, phrases, ws, length) in enumerate(prepared(TEMPLATES, SPAN)))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH phrases(phrase, label, k) AS (VALUES {phrases}),
templates(label, telling, phrases, tokens, length, number) AS (VALUES {templates}),
d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, r, low, regexp_extract_all(low, {word}) AS words FROM d),
places AS (
  SELECT r, p.label, i - 1 AS place FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE contains(low, 'license') OR contains(low, 'cc')) x, phrases p
  WHERE array_to_string(words[i : i + p.k - 1], ' ') = p.phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_list FROM places GROUP BY r),
blocks AS (SELECT r, words[k * {SPAN} + 1 : k * {SPAN} + {2 * SPAN}] AS tokens FROM (SELECT r, words, unnest(range(0, greatest(1, (len(words) - 1) // {SPAN}))) AS k FROM w WHERE len(words) > 0)),
windows AS (SELECT r, label, number, phrases, tokens, block[k * length + 1 : k * length + 2 * length] AS own FROM (SELECT b.r, t.label, t.number, t.phrases, t.tokens, t.length, b.tokens AS block, unnest(range(0, greatest(1, CAST(ceil(len(b.tokens) / t.length) AS BIGINT) - 1))) AS k FROM blocks b, templates t WHERE len(list_intersect(t.tokens, b.tokens)) >= ceil({THRESHOLD} * len(t.tokens) - 1e-9))),
hits AS (SELECT r, label, number, len(list_intersect(tokens, own)) AS overlap, len(tokens) AS n, list_bool_and(list_transform(phrases, lambda x: contains(concat(' ', array_to_string(own, ' '), ' '), x))) AS told FROM windows),
found AS (SELECT r, list(DISTINCT label) FILTER (told) AS found, max(overlap / n) FILTER (told) AS best, count(DISTINCT number) AS n_links FROM hits WHERE overlap >= ceil({THRESHOLD} * n - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_list, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(found, [])))), ','), '') AS labels,
  CAST(greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, coalesce(best, 0.0)) AS DOUBLE) AS score,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


OP1_SQL = _sql()
