"""Byte-pair encoding and decoding by a tokenisation automaton.

The automaton reads tokens; it accepts exactly the sequences that the merges produce. It starts with one state that each
byte's arc leads back to. Merges are taken in their order, and each adds a gadget: wherever an arc ``a`` is followed by
an arc ``b``, an arc ``ab`` leads to where ``b`` led, and the state after ``a`` loses its arc ``b``. (After merges of a
token with itself, the state after ``a`` gets no arc ``aa`` either, as the leftmost two merge.) States and arcs are kept
in factored form. The state after ``ab`` is the state after ``b`` as it was when ``ab`` was made, less what merges took
from it since; where an arc ``ab`` leaves, an arc ``a`` left then. So a table of two parents and a birth for each token,
and one of the merges, hold the whole automaton, and ``follows`` is its transition function. A merge whose two arcs never
follow each other adds nothing.

Every prefix of a word has at most one accepted path. ``word_ids`` follows it by two tables: a trie of the labels gives the
longest arc that a place of the word spells, and ``follows``, whose answers are held, tells whether the state has it; else
the next shorter arc is tried, and a place without any is never tried again. Decoding emits the labels of the arcs.

The automaton is compiled once by the driver and broadcast; its size follows the vocabulary, never the corpus. Texts are
split and encoded in Arrow batches, the new words of a batch all at once; nothing is shuffled. Each worker keeps the ids of
words it has seen, of at most about ``CHARACTERS_HELD`` characters, and forgets them then; this changes no result.

Edge cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null ids of documents give
equal rows; an empty table gives no rows; further columns are ignored by the query and kept by ``encoded`` and
``decoded``; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from fathom.llm.base import map_batches, table, text_of
from fathom.llm.hashing import ODD
from fathom.llm.packing import byte_letters

CHARACTERS_HELD, ARCS_HELD, LONG = 4 << 20, 1 << 20, 64
NEVER = 1 << 60

# The pattern of words, as published with this kind of vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that the regex module takes for letters or numbers, and Unicode 16 does not (first and last).
YOUNGER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686
16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168
1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_SET = "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (x.split("-") for x in YOUNGER.split()))
WORDS = regex.compile(WORD)
YOUNG = regex.compile(f"[{_SET}]")
OLDER_WORDS = regex.compile("(?V1)" + WORD.replace(r"\p{L}+", rf"[\p{{L}}--[{_SET}]]+", 1).replace(r"\p{N}+", rf"[\p{{N}}--[{_SET}]]+", 1).replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_SET}]]"))


class Automaton:
    """The automaton of a byte-level BPE vocabulary: its tables are of plain lists and dicts, so that it can be broadcast."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int] | None = None) -> None:
        self.added = added or {}
        self.size = max([*labels.values(), *self.added.values()]) + 1
        self.labels: list[bytes] = [b""] * self.size
        for label, token in labels.items():
            self.labels[token] = label
        for label, token in self.added.items():
            self.labels[token] = label.encode()
        self.left, self.right, self.born = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.merged: dict[int, int] = {}
        live = [labels[bytes([b])] for b in range(256)]
        for rank, (a, b) in enumerate(merges):
            token = self._gadget(rank, labels[a], labels[b], labels[a + b])
            if token is not None:
                live.append(token)
        self._trie(live)
        self._memory()

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """From a byte-level BPE model's JSON file; ValueError where it asks for more than byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        if file["normalizer"] or any((model.get(k) or None) != (v or None) for k, v in plain.items()) or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE model")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands beside them")
        bytes_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        raw = {token: b"".join(map(bytes_of.__getitem__, token)) for token in model["vocab"] if all(c in bytes_of for c in token)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls({raw[t]: k for t, k in model["vocab"].items() if t in raw}, [(raw[x], raw[y]) for x, y in pairs], {x["content"]: x["id"] for x in file["added_tokens"]})

    def _gadget(self, rank: int, a: int, b: int, token: int) -> int | None:
        """Adds the gadget of the merge of ``a`` and ``b``; None where no path has one after the other."""
        if not self.follows(a, b, rank) or self.born[token] >= 0:
            return None
        self.left[token], self.right[token], self.born[token] = a, b, rank
        self.merged[a * self.size + b] = rank
        return token

    def follows(self, x: int, y: int, when: int = NEVER) -> bool:
        """Whether the state after token ``x`` has an arc ``y`` once the merges of ranks below ``when`` are in."""
        left, right, born, merged, size = self.left, self.right, self.born, self.merged, self.size
        while True:
            if merged.get(x * size + y, NEVER) < when:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            when = min(when, max(bx, by))
            if by > bx and left[y] == right[y] == x:
                return False
            x, y = right[x] if bx >= by else x, left[y] if by >= bx else y

    def _trie(self, live: list[int]) -> None:
        """Transitions by byte over the labels, the token that each node spells, and the longest shorter token that each token begins with."""
        goto: dict[int, int] = {}
        spelt, up = [-1], [0]
        for token in live:
            node = 0
            for byte in self.labels[token]:
                key = node << 8 | byte
                to = goto.get(key)
                if to is None:
                    to = goto[key] = len(spelt)
                    spelt.append(-1)
                    up.append(node)
                node = to
            spelt[node] = token
        self.goto, self.spelt, self.longest = goto, spelt, max(len(self.labels[t]) for t in live)
        self.sizes, self.shorter = [len(x) for x in self.labels], [-1] * self.size
        for node, token in enumerate(spelt):
            if token >= 0:
                above = up[node]
                while above and spelt[above] < 0:
                    above = up[above]
                self.shorter[token] = spelt[above]

    def _memory(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # the same tables as arrays; a token -1 is the start, which every arc leaves
        self.steps, self.merges = Numbers(self.goto), Numbers(self.merged)
        self.lefts, self.rights, self.births, self.lengths, self.less, self.spells = (np.array(x, np.int64) for x in (self.left, self.right, self.born, self.sizes, self.shorter, self.spelt))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "words", "held", "marks", "steps", "merges", "lefts", "rights", "births", "lengths", "less", "spells")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._memory()

    def word_ids(self, word: bytes) -> list[int]:
        """The tokens of the accepted path whose labels spell ``word``.

        From each place the longest arc is tried first. A place that no arc leads on from is dead: the path of a prefix
        is the only one, so none comes back to it.
        """
        goto, spelt, sizes, shorter, arcs = self.goto, self.spelt, self.sizes, self.shorter, self.arcs
        if len(arcs) > ARCS_HELD:
            arcs.clear()
        out: list[int] = []
        dead: set[int] = set()
        at, total = 0, len(word)
        while at < total:
            node, token = 0, -1
            for byte in word[at : at + self.longest]:
                node = goto.get(node << 8 | byte)
                if node is None:
                    break
                if spelt[node] >= 0:
                    token = spelt[node]
            while True:
                if token < 0:
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                elif at + sizes[token] not in dead:
                    if not out:
                        break
                    key = out[-1] << 32 | token
                    may = arcs.get(key)
                    if may is None:
                        may = arcs[key] = self.follows(out[-1], token)
                    if may:
                        break
                token = shorter[token]
            out.append(token)
            at += sizes[token]
        return out

    def all_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs of tokens."""
        out = np.ones(len(x), bool)
        rows = np.flatnonzero(x >= 0)
        x, y = x[rows], y[rows]
        when = np.full(len(rows), NEVER)
        while len(rows):
            bx, by = self.births[x], self.births[y]
            bad = (self.merges.get(x * self.size + y, NEVER) < when) | ((by > bx) & (self.lefts[y] == x) & (self.rights[y] == x))
            out[rows[bad]] = False
            on = ~bad & (np.maximum(bx, by) >= 0)
            rows, x, y, bx, by = rows[on], x[on], y[on], bx[on], by[on]
            when = np.minimum(when[on], np.maximum(bx, by))
            x, y = np.where(bx >= by, self.rights[x], x), np.where(by >= bx, self.lefts[y], y)
        return out

    def many_ids(self, words: list[bytes]) -> list[bytes]:
        """``word_ids`` of many words at once, each as little-endian unsigned 32-bit integers; all words take a step at a time."""
        a = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        stop = np.repeat(ends, ends - starts)
        best = np.full(len(a) + 1, -1)  # the longest arc from each place
        live, node, k = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        while len(live):
            node = self.steps.get(node << 8 | a[live + k], -1)
            k += 1
            on = node >= 0
            live, node = live[on], node[on]
            token = self.spells[node]
            best[live[token >= 0]] = token[token >= 0]
            on = live + k < stop[live]
            live, node = live[on], node[on]
        came, dead = np.full(len(a) + 1, -1), np.zeros(len(a) + 1, bool)  # the arc that leads to each place
        at, token, rows = starts.copy(), best[starts] if len(a) else ends, np.flatnonzero(ends > starts)
        first = starts
        while len(rows):
            here, arc = at[rows], token[rows]
            none = arc < 0
            if none.any():
                back = rows[none]
                dead[at[back]] = True
                arc[none] = came[at[back]]
                at[back] -= self.lengths[arc[none]]
                here = at[rows]
            tried = np.flatnonzero(~none)
            tried = tried[~dead[here[tried] + self.lengths[arc[tried]]]]
            before = np.where(here[tried] == first[rows[tried]], -1, came[here[tried]])
            tried = tried[self.all_follow(before, arc[tried])]
            token[rows] = self.less[arc]
            taken, to = rows[tried], here[tried] + self.lengths[arc[tried]]
            came[to], at[taken], token[taken] = arc[tried], to, best[to]
            rows = rows[at[rows] < ends[rows]]
        found, places, rows, at = [], [], np.flatnonzero(ends > starts), ends
        at = at[rows]
        while len(rows):
            found.append(came[at])
            at = at - self.lengths[found[-1]]
            places.append(at)
            on = at > first[rows]
            at, rows = at[on], rows[on]
        where = np.concatenate([np.empty(0, np.int64), *places])
        order = np.argsort(where)
        ids = np.concatenate([np.empty(0, np.int64), *found])[order].astype("<u4").tobytes()
        cuts = 4 * np.searchsorted(where[order], np.append(starts, len(a)))
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        outline, pieces = [], []
        for text in texts:
            at, parts = 0, []
            for found in self.marks.finditer(text) if self.marks else ():
                parts += [len(pieces), self.added[found.group()].to_bytes(4, "little")]
                pieces.append(text[at : found.start()])
                at = found.end()
            outline.append([*parts, len(pieces)])
            pieces.append(text[at:])
        if self.held > CHARACTERS_HELD:
            self.words.clear()
            self.held = 0
        words, odd = self.words, set()
        split = [WORDS.findall(piece) for piece in pieces]
        new = {w for found in split for w in found if w not in words}
        if YOUNG.search("\n".join(new)):
            odd = {k for k, piece in enumerate(pieces) if YOUNG.search(piece)}
            new = {w for k, found in enumerate(split) if k not in odd for w in found if w not in words}
        short = [w for w in new if len(w) <= LONG]
        words.update(zip(short, self.many_ids([w.encode() for w in short]), strict=True))
        words.update((w, self._bytes(w)) for w in new if len(w) > LONG)
        self.held += sum(map(len, new))
        ids = [b"".join(map(self._bytes, OLDER_WORDS.findall(pieces[k])) if k in odd else map(words.__getitem__, found)) for k, found in enumerate(split)]
        return [b"".join(ids[x] if isinstance(x, int) else x for x in parts) for parts in outline]

    def _bytes(self, word: str) -> bytes:
        return np.array(self.word_ids(word.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text that the arcs' labels spell; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Numbers:
    """A fixed map of whole numbers from 0 on, read for many keys at once: open addressing in two arrays."""

    def __init__(self, pairs: dict[int, int]) -> None:
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = self.keys[slot] != keys
            keys, values, slot = keys[left], values[left], slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * ODD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], default)
        rows = np.flatnonzero((held != keys) & (held >= 0))
        while len(rows):
            slot[rows] = slot[rows] + 1 & self.mask
            held = self.keys[slot[rows]]
            hit = held == keys[rows]
            out[rows[hit]] = self.values[slot[rows[hit]]]
            rows = rows[~hit & (held >= 0)]
        return out


def _mapped(df: DataFrame, column: str, into: str, kind, values: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` and, in the place of a column ``into`` or after all, what ``values`` makes of a column's cells."""
    at = df.columns.index(column)
    names = [*(c for c in df.columns if c != into), into]
    keep = [k for k, c in enumerate(df.columns) if c != into]
    schema = StructType([f for f in df.schema.fields if f.name != into]).add(into, kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), values(batch.column(at).to_pylist())], names)

    return map_batches(df, run, schema, size=1 << 20)


def encoded(docs: DataFrame, automaton: Automaton, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` and a column of the ids of each text, an array of integers."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def values(texts: list) -> pa.Array:
        ids = shared.value.encode_all([t or "" for t in texts])
        ends = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return _mapped(docs, column, into, ArrayType(IntegerType()), values)


def decoded(rows: DataFrame, automaton: Automaton, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` and a column of the text of each array of ids; a null array is an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def values(cells: list) -> pa.Array:
        return pa.array([shared.value.decode(np.array(x or [], "<u4").tobytes()) for x in cells], pa.string())

    return _mapped(rows, column, into, "string", values)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and digest of the text that they decode to."""
    import public_tokenizers

    shared = spark.sparkContext.broadcast(Automaton.from_file(public_tokenizers.path("byte_bpe_50k.json")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        counts, digests, back = [], [], []
        for ids in automaton.encode_all(batch.column(1).to_pylist()):
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", size=1 << 20)
