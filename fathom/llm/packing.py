"""Hierarchical multi-length packing of tokenised documents.

Each document becomes its token ids and an end id. What is as long as the longest window fills whole windows. The rest
of it is routed to the tier of the smallest window that holds it. Tiers are packed one after another, the longest first:
a piece opens a window of its tier, and the gap is filled from the shorter tiers, the largest that fits first, and at
last by cutting one. The windows of all tiers have lengths that are powers of two, so a full one needs no padding; what
is left at the end of a partition is cut into such lengths too, at most one of each. Sequences are dealt to step groups
of exactly ``step_windows`` windows' tokens, each to the fullest open group that has room; only the last groups of a
partition, at most one open for each window length, stay below.

Every partition of the input is packed alone, with a bounded number of pending tokens, so nothing is shuffled, and a task
that is run again for a lost executor gives the same rows. The order of the input is kept but for the pending pieces.

Edge cases: a null or empty text is its end id alone; a null id and repeated rows are documents of their
own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.base import cut, table, text_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
TAIL = b".,;:!?|*&%$#"


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """Byte-pair merging of many words of one length at once.

    A row of symbols a word; in each round every row merges its lowest-ranked pair, the leftmost of equals.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[x] * self.size + vocab[y] for x, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.none = len(pairs)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.append(made, -1).astype(np.int32)
        self.slots = np.full(1 << 18, -1, np.int32)
        slot = self._slot(self.keys)
        self.slots[slot] = np.arange(len(keys))
        taken, count = np.unique(slot, return_counts=True)
        self.shared = np.zeros(1 << 18, bool)
        self.shared[taken[count > 1]] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        at = self.slots[slot]
        rank = np.where(self.keys[at] == key, self.ranks[at], self.none)
        again = self.shared[slot]
        if again.any():
            key = key[again]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[again] = np.where(self.keys[at] == key, self.ranks[at], self.none)
        return rank

    def ids(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters of one length, a row each: how many, and all of them in a row."""
        total = len(raw)
        symbols = self.first[raw]
        symbols[:, -1] = self.last[raw[:, -1]]
        counts = np.zeros(total, np.int64)
        found = []
        rows = np.arange(total)
        rank = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(total, -1)
        while len(rows):
            n = symbols.shape[1]
            done = rank.min(1) == self.none if n > 1 else np.ones(len(rows), bool)
            if done.any():
                counts[rows[done]] = n
                found.append((rows[done], symbols[done]))
                live = ~done
                symbols, rank, rows = symbols[live], rank[live], rows[live]
                if not len(rows):
                    break
            at = rank.argmin(1)
            i = np.arange(len(rows))
            merged = self.made[rank[i, at]]
            keep = np.arange(n)[None, :] != at[:, None] + 1
            symbols = symbols[keep].reshape(len(rows), n - 1)
            symbols[i, at] = merged
            if n > 2:
                rank = rank[keep[:, 1:]].reshape(len(rows), n - 2)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
                rank[left, at[left] - 1] = self.rank(symbols[left, at[left] - 1], merged[left])
                rank[right, at[right]] = self.rank(merged[right], symbols[right, at[right] + 1])
        begin = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), "<u4")
        for rows, symbols in found:
            out[begin[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return counts, out


SPACE, LETTER, DIGIT, SIGN, HIGH = range(5)
KIND = np.full(256, HIGH, np.uint8)
KIND[:128] = SIGN
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[97:123] = LETTER
KIND[48:58] = DIGIT
BASE = 0x9E3779B97F4A7C15 | 1


def spread(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for counts[0] places, then likewise from begin[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


class Encoder:
    """Texts to little-endian 32-bit ids: the distinct pieces of a batch of texts are encoded once each.

    No token spans ASCII white space, a change between Latin letters, digits and signs, or two digits, so
    texts are cut there. Pieces of letters go through ``Merges``. Words that hold other characters or an
    apostrophe stay whole; those that are not letters alone go to the tokenizer, and so do whole texts that
    may hold a special token or whose lower case depends on the neighbours (sigma).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.powers = np.ones(1, np.uint64)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _cut(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and which are of Latin letters."""
        kind = KIND[a]
        lead = np.flatnonzero(a[:-1] == 0xC3)  # letters from U+00C0 to U+00FF
        lead = lead[(a[lead + 1] != 0x97) & (a[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        solid = kind != SPACE
        word = solid & (before == SPACE)
        whole = (kind == HIGH) | (a == 39)
        begin = solid & ((kind != before) | (kind == DIGIT))
        if whole.any():  # no cuts within the words of such bytes
            number = np.cumsum(word) - 1
            odd = np.zeros(number[-1] + 1, bool)
            odd[number[whole]] = True
            begin &= word | ~odd[number]
        starts = np.flatnonzero(begin)
        final = solid.copy()
        final[:-1] &= begin[1:] | ~solid[1:]
        ends = np.flatnonzero(final) + 1
        letters = kind[starts] == LETTER
        if whole.any():
            letters &= ~odd[number[starts]]
        return starts, ends, letters

    def _hash(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(a):
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(a) + (1 << 16), BASE, np.uint64)))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.powers[: len(a)] * (a.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        key = (sums[ends] - sums[starts]) * self.powers[len(a) - starts]
        key ^= key >> np.uint64(29)
        return key * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)

    def _distinct(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct piece, and which of them each piece is: by a 64-bit hash, checked by length, first and
        last eight bytes, and where that fails by the bytes themselves."""
        _, at, which = np.unique(self._hash(a, starts, ends), return_index=True, return_inverse=True)
        padded = np.append(a, np.zeros(8, np.uint8))
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        size = ends - starts
        own = np.minimum(size, 8)
        mask = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * own.astype(np.uint64)))
        first = np.ascontiguousarray(eight[starts]).view("<u8").ravel() & mask
        last = np.ascontiguousarray(eight[ends - own]).view("<u8").ravel() & mask
        same = at[which]
        if ((size == size[same]) & (first == first[same]) & (last == last[same])).all():
            return at, which
        raw = a.tobytes()
        _, at, which = np.unique(np.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], object), return_index=True, return_inverse=True)
        return at, which

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        lows, rows = [], []
        for row, text in enumerate(texts):
            if "<|" in text or "\u03a3" in text:
                out[row] = self.plain(text).tobytes()
            elif text:
                lows.append((text if text.isascii() else normalize("NFC", text)).lower().encode())
                rows.append(row)
        if not rows:
            return out
        a = np.frombuffer(b"\n".join(lows), np.uint8)
        bounds = np.cumsum([len(x) + 1 for x in lows])
        starts, ends, letters = self._cut(a)
        if not len(starts):
            return out
        at, which = self._distinct(a, starts, ends)
        begin, end, plain = starts[at], ends[at], letters[at]
        size = end - begin
        raw, place = [a], np.where(plain & (size < 64), begin, -1)
        odd: dict[int, np.ndarray] = {}
        memo: dict[bytes, np.ndarray] = {}
        tails: dict[int, bytes] = {}
        offset, joined = len(a), a.tobytes()
        for k in np.flatnonzero(place < 0).tolist():
            word = joined[begin[k] : end[k]]
            core = word.rstrip(TAIL)
            text = core.decode()
            if core and len(core) < 64 and text.isalpha() and not (core.isascii() and core != word):
                if core != word:
                    tails[k] = word[len(core) :]
                raw.append(np.frombuffer(core, np.uint8))
                place[k], size[k] = offset, len(core)
                offset += len(core)
            else:
                odd[k] = self.plain(word.decode())
        pool = np.concatenate(raw)
        counts = np.zeros(len(at), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        quick = np.flatnonzero(place >= 0)
        quick = quick[np.argsort(size[quick], kind="stable")]
        for group in np.split(quick, np.flatnonzero(np.diff(size[quick])) + 1):
            if len(group):
                n, ids = self.merges.ids(pool[place[group][:, None] + np.arange(size[group[0]])])
                counts[group] = n
                parts.append((group, ids))
        for k, ids in odd.items():
            counts[k] = len(ids)
        extra = {}
        for k, tail in tails.items():
            if tail not in memo:
                memo[tail] = self.plain(tail.decode())
            extra[k] = counts[k]
            counts[k] += len(memo[tail])
        first = np.cumsum(counts) - counts
        table_ids = np.empty(counts.sum(), "<u4")
        own = counts.copy()
        for k, n in extra.items():
            own[k] = n
            table_ids[first[k] + n : first[k] + counts[k]] = memo[tails[k]]
        for group, ids in parts:
            table_ids[spread(own[group], first[group])] = ids
        for k, ids in odd.items():
            table_ids[first[k] : first[k] + counts[k]] = ids
        n = counts[which]
        ids = table_ids[spread(n, first[which])]
        stops = np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)]
        flat, left = ids.tobytes(), 0
        for row, stop in zip(rows, stops.tolist(), strict=True):
            out[row] = flat[4 * left : 4 * stop]
            left = stop
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs (document, ids) pieces that come one after another; ``take()`` gives the rows made so far."""

    def __init__(self, window: int, tiers: tuple[int, ...], base: int, pending_windows: int, step_windows: int):
        self.window, self.tiers, self.base = window, sorted(tiers), base
        self.most, self.step = pending_windows * window, step_windows * window
        self.waiting: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (length, number) of each tier's pieces, in order
        self.pieces: dict[int, tuple] = {}
        self.pending = self.number = self.sequence = self.groups = 0
        self.open: list[list[int]] = []  # room and number of the open step groups
        self.rows: list[tuple] = []

    def _group(self, size: int) -> int:
        """The step group of a sequence: the fullest open one that has room, or a new one."""
        fits = [g for g in self.open if g[0] >= size]
        if not fits:
            fits = [[self.step, self.groups]]
            self.open += fits
            self.groups += 1
        chosen = min(fits)
        chosen[0] -= size
        if not chosen[0]:
            self.open.remove(chosen)
        return self.base + chosen[1]

    def _emit(self, members: list[tuple], tier: int) -> None:
        group = self._group(sum(len(m[2]) for m in members) // 4)
        offset = 0
        for doc, start, ids, total in members:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.base + self.sequence, offset, tier, group))
            offset += n
        self.sequence += 1

    def _tier(self, n: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, n)]

    def _push(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        bisect.insort(self.waiting[self._tier(n)], (n, self.number))
        self.pieces[self.number] = piece
        self.number += 1
        self.pending += n

    def _pop(self, tier: int, at: int) -> tuple:
        n, number = self.waiting[tier].pop(at)
        self.pending -= n
        return self.pieces.pop(number)

    def _fill(self, members: list[tuple], gap: int) -> None:
        while gap:
            fits = ((t, at) for t in reversed(self.tiers) if t < 2 * gap or t == self.tiers[0] if (at := bisect.bisect_left(self.waiting[t], (gap + 1, -1)) - 1) >= 0)
            found = next(fits, None)
            if found:
                piece = self._pop(*found)
            else:
                doc, start, ids, total = self._pop(next(t for t in self.tiers if self.waiting[t]), 0)
                piece = (doc, start, ids[: 4 * gap], total)
                self._push((doc, start + gap, ids[4 * gap :], total))
            members.append(piece)
            gap -= len(piece[2]) // 4

    def add(self, doc, ids: bytes) -> None:
        total, at, full = len(ids) // 4, 0, 4 * self.window
        while len(ids) - at >= full:
            self._emit([(doc, at // 4, ids[at : at + full], total)], self.window)
            at += full
        if at < len(ids):
            self._push((doc, at // 4, ids[at:], total))
        if self.pending >= self.most:
            self._pack(self.most // 2)

    def _pack(self, left: int) -> None:
        for tier in reversed(self.tiers):
            while self.waiting[tier] and self.pending >= max(left, self.window):
                first = self._pop(tier, -1)
                members = [first]
                self._fill(members, tier - len(first[2]) // 4)
                self._emit(members, tier)

    def finish(self) -> None:
        self._pack(0)
        while self.pending:
            size = 1 << (self.pending.bit_length() - 1)
            members: list[tuple] = []
            self._fill(members, size)
            self._emit(members, size)

    def take(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096),
    end_id: int = 2,
    pending_windows: int = 64,
    step_windows: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The pieces of the packed sequences of ``docs``; see the module.

    ``tokenizer`` is the path of a tokenizers file that every executor has; ``tiers`` are powers of two, the
    largest is ``window``. ``sequence_id`` is the input partition's number times 2**32 plus a running number.
    """
    if window != max(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two up to the window")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, tiers, TaskContext.get().partitionId() << 32, pending_windows, step_windows)
        coder = encoder(tokenizer)
        for batch in batches:
            for part in cut(batch, 2 << 20):
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                if (out := packer.take()) is not None:
                    yield out
        packer.finish()
        if (out := packer.take()) is not None:
            yield out

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
