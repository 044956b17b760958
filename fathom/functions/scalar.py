"""Scalar column functions: vectors, rounding, patterns, error texts, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision: 0 if a norm is 0, null if the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda acc, v: acc + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, p: acc + p * p))
    size = norm(x) * norm(y)
    return F.when(F.size(x) == F.size(y), F.when(size == 0, 0.0).otherwise(dot / size))


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def ascii_fold(x: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def loose_like(value: Column, pattern: Column) -> Column:
    """LIKE as an embedded store has it: A-Z count as a-z, % and _ are wildcards, and no character escapes them."""
    return F.call_function("like", ascii_fold(value), F.replace(ascii_fold(pattern), F.lit("\\"), F.lit("\\\\")))


def glob_to_like(glob: Column) -> Column:
    return F.replace(F.replace(glob, F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def normalize_error(message: Column) -> Column:
    """Numbers, quoted strings and paths become N, STR and PATH; white space is squeezed; 500 characters remain."""
    out = F.regexp_replace(message, r"[0-9]+", "N")
    out = F.regexp_replace(out, "['\"`][^\n\r  ]*?['\"`]", "STR")
    out = F.regexp_replace(out, r"/[A-Za-z0-9_\-./]+", "PATH")
    out = F.regexp_replace(out, r"[\s ﻿  ]+", " ")
    return F.substring(F.trim(out), 1, 500)


def error_signature(kind: Column, normalized: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kind, normalized), 256), 1, 16)


def reward(score: Column, outcome: Column) -> Column:
    return F.when(outcome == "success", score + 0.1 * (1 - score)).when(outcome == "partial", F.least(F.lit(1.0), score + 0.03)).when(outcome == "failure", F.greatest(F.lit(0.1), score - 0.15)).otherwise(score)


def reward_fold(events: Column, start: float = 0.5) -> Column:
    """Score after the outcomes of an array of structs, in the order of their leading fields."""
    return F.aggregate(F.array_sort(events), F.lit(start), lambda acc, e: reward(acc, e["outcome"]))


def success_rate(successes: Column, failures: Column) -> Column:
    return half_up(F.when(successes + failures > 0, successes / (successes + failures)).otherwise(0.5), 2)


def auto_complexity(text: Column, blocks: Column, prerequisites: Column, files: Column) -> Column:
    steps = 1 + F.least(F.lit(4), F.floor(F.length(text) / 500)) + F.least(F.lit(2), blocks) + F.least(F.lit(2), prerequisites) + F.least(F.lit(2), F.floor(files / 2))
    return F.greatest(F.lit(1), F.least(F.lit(10), steps)).cast("int")


def boosted(similarity: Column, same_repo: Column, repo_similarity: Column, gate: float = 0.7) -> Column:
    """Context boost, capped at 0.99 for every row."""
    lifted = F.when(same_repo, similarity * 1.15).when(repo_similarity > gate, similarity * 1.08).otherwise(similarity)
    return F.least(F.lit(0.99), lifted)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%.1fm", ms / 60000))


def decode_vector(blob: Column) -> Column:
    """float32 little-endian bytes as an array; an Arrow function, as Spark has no such expression."""
    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return decode(blob)


def encode_vector(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)
