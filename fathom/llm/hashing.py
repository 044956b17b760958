"""Vectorised hashes over bytes, and keys dealt to hash ranges as compact blobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm.base import cut, partitions

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """ODD to the powers 0 to n, modulo 2**64."""
    global _POWERS
    if len(_POWERS) <= n:
        _POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(n + (1 << 16), ODD, np.uint64)))
    return _POWERS[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX
    x ^= x >> np.uint64(27)
    x *= ODD
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(powers(len(a))[:-1] * (a.astype(np.uint64) + np.uint64(1)), out=out[1:])
    return out


def slice_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices of ``a``: equal slices, equal hashes, wherever they stand."""
    sums, p = prefix_sums(a), powers(len(a))
    return mix((sums[ends] - sums[starts]) * p[len(a) - starts] * _shift(len(a)) + (ends - starts).astype(np.uint64))


def _shift(n: int) -> np.uint64:
    """ODD to the power -n, so that hashes do not depend on the batch's length."""
    return np.uint64(pow(int(ODD), -n, 1 << 64))


def window_hashes(a: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` bytes."""
    n = len(a) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums, p = prefix_sums(a), powers(len(a))
    return mix((sums[width:] - sums[:n]) * p[len(a) - n + 1 : len(a) + 1][::-1] * _shift(len(a)))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct runs of ``words`` words of each text (A-Z in lower case, words between ASCII
    white space); of a text with fewer words, the whole run."""
    lows = [t.encode().lower() for t in texts]
    a = np.frombuffer(b"\n".join(lows) + b"\n", np.uint8)
    solid = np.append(~SPACES[a], False)
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.append(0, np.cumsum([len(x) + 1 for x in lows]))
    at = np.searchsorted(starts, bounds)
    h = slice_hashes(a, starts, ends)
    n = len(h) - words + 1
    if n > 0:
        runs = h[:n].copy()
        for k in range(1, words):
            runs = runs * ODD + h[k : k + n]
        runs = mix(runs)
    empty = np.empty(0, np.uint64)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(runs[lo : hi - words + 1]))
        elif hi > lo:
            x = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for v in h[lo:hi]:
                    x = x * ODD + v
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(empty)
    return out


BLOBS = "bucket long, blob binary"
TOP = np.uint64(0xFFFFFFFFFFFF0000)  # the bits of a key that blobs keep


def blobs_of(keys: np.ndarray, owners: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pairs of key and owner, sorted by key, cut by ranges of the keys: a blob holds the owners once, and 48 bits of each key."""
    width = -(-(1 << 64) // buckets)
    bucket = keys // np.uint64(width) if buckets > 1 else np.zeros(len(keys), np.uint64)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.empty(0, np.int64)
    rows, blobs = [], []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
        for at in range(lo, hi, 60_000):
            to = min(hi, at + 60_000)
            names, which = np.unique(owners[at:to], return_inverse=True)
            top = np.ascontiguousarray(keys[at:to].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
            rows.append(int(bucket[lo]))
            blobs.append(np.array([to - at, len(names)], "<i4").tobytes() + names.astype("<i8").tobytes() + which.astype("<u2").tobytes() + top.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def from_blobs(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (their upper 48 bits) and owners, sorted by key."""
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for x in blobs:
        n, m = np.frombuffer(x, "<i4", 2).tolist()
        names = np.frombuffer(x, "<i8", m, 8)
        which = np.frombuffer(x, "<u2", n, 8 + 8 * m)
        top = np.frombuffer(x, np.uint8, 6 * n, 8 + 8 * m + 2 * n).reshape(n, 6)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 2:] = top
        keys.append(wide.view("<u8").ravel())
        owners.append(names[which])
    k, o = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k, kind="stable")
    return k[order], o[order]


def held_pairs(found: Iterator[tuple[np.ndarray, np.ndarray]], flush: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct (key, owner) pairs, in order, of about ``flush`` pairs at a time; no more are held."""
    keys, owners, held = [], [], 0

    def distinct() -> tuple[np.ndarray, np.ndarray]:
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        once = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))
        return k[once], o[once]

    for k, o in found:
        keys.append(k)
        owners.append(o)
        held += len(k)
        if held >= flush:
            yield distinct()
            keys, owners, held = [], [], 0
    if held:
        yield distinct()


def deal(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int, flush: int = 1 << 19, size: int = 1 << 20) -> DataFrame:
    """Blobs of the (key, owner) pairs that ``keys_of`` gives for each batch; at most about ``flush`` pairs are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owners in held_pairs((keys_of(part) for batch in batches for part in cut(batch, size)), flush):
            yield blobs_of(keys & TOP, owners, buckets)

    return rows.mapInArrow(run, BLOBS)


def bucket_count(df: DataFrame) -> int:
    return partitions(df.sparkSession)
