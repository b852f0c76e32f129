"""Byte-level BPE by monoid tree reduction.

Each match of the pattern is a sequence of bytes whose encoding is an element of a monoid: encode the
halves, recursively, and join neighbours.  Joining re-encodes a window at the boundary: the last i
tokens of the left and the first j of the right.  The window grows until its first and last tokens
are compatible with the neighbours outside: re-encoding the bytes of such a pair alone gives the same
pair.  A sequence all of whose adjacent pairs are compatible is the encoding of its bytes, since the
first merge across a border in the whole would be the first one in the pair as well; so everything
outside the window provably stays.  Matches are joined by plain concatenation, as the pattern's
matches are encoded separately.  Decoding concatenates bytes up the same kind of tree.

Null and empty texts have no tokens; decoding them gives empty bytes.  Texts are whole, whatever
their length; a single match of any length costs O(length log length).  Every row gives one row: repeated
rows repeat, rows without an id keep none, an empty table gives none, and other columns are left out
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import lean

LEAF = 12  # bytes that are merged directly
RUN = 256  # matches of a text that a leaf of its tree holds
MEMO = 400_000  # remembered matches, pieces and pairs each; a full memory starts afresh
NONE = np.iinfo(np.int32).max
CHUNK = 4096  # ids that decoding joins at a leaf


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def finder(pattern: str):
    """``findall`` of the pattern; its white space is Unicode's, without the separators U+001C to U+001F."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


class Memo(dict):
    """A bounded dictionary that computes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PairTable:
    """Merged ids of neighbouring ids, for arrays: open addressing in a power of two of slots."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = np.fromiter(pairs.keys(), np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self._slot(key), 0
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, value, at = key[left], value[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape
        key = (a.astype(np.int64) << 32 | b).ravel()
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        miss = np.flatnonzero((out == NONE) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[miss]] == key[miss]
            out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (self.keys[at[miss]] != -1)]
        return out.reshape(shape)


class Codec:
    """Encodes and decodes with the ranks of a byte-level BPE and the pattern that splits its texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = finder(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.table = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Memo(self._compatible)
        self.words = Memo(lambda word: tuple(self.encode_bytes(word.encode("utf-8"))))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the lowest rank, leftmost first, until no neighbours merge."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        near = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == 1 << 60:
                break
            i = near.index(low)
            parts[i] += parts.pop(i + 1)
            near.pop(i)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many short pieces at once: each round merges one pair in every piece."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, LEAF)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                if len(part):
                    self._merge_rows([pieces[i] for i in part], part, sizes[part], high, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, width: int, out: list) -> None:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.concatenate([self.single[flat], np.zeros((len(pieces), 1), np.int32)], axis=1)
        near = self.table(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        near[column[None, :] >= (size - 1)[:, None]] = NONE
        while len(rows):
            at = near.argmin(axis=1)
            every = np.arange(len(rows))
            best = near[every, at]
            done = best == NONE
            if done.any():
                for r, n, row in zip(rows[done].tolist(), size[done].tolist(), ids[done].tolist()):
                    out[r] = tuple(row[:n])
                go = ~done
                rows, size, ids, near, at, best = rows[go], size[go], ids[go], near[go], at[go], best[go]
                if not len(rows):
                    return
                every = np.arange(len(rows))
            after = column[None, :] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[every, at] = best
            near[:, :-1] = np.where(after[:, :-1], near[:, 1:], near[:, :-1])
            near[:, -1] = NONE
            size = size - 1
            near[every, at] = np.where(at < size - 1, self.table(best, ids[every, at + 1]), NONE)
            before = np.flatnonzero(at > 0)
            near[before, at[before] - 1] = self.table(ids[before, at[before] - 1], best[before])

    def learn(self, words: Iterator[str]) -> None:
        """Remember the encodings of all short ones of ``words``."""
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > MEMO:
            self.words.clear()
        raw = [w.encode("utf-8") for w in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LEAF]
        self.words.update(zip((new[i] for i in short), self.merge_all([raw[i] for i in short])))

    def encode_bytes(self, piece: bytes) -> Sequence[int]:
        """Ids of one match: short ones are merged, halves of longer ones joined."""
        if len(piece) <= LEAF:
            return self.merge(piece) if piece else ()
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == pair

    def join(self, left: Sequence[int], right: Sequence[int]) -> Sequence[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        if self.pairs[left[-1], right[0]]:
            return (*left, *right) if isinstance(left, tuple) else [*left, *right]
        i = j = 1
        while True:
            window = b"".join(self.tokens[t] for t in chain(left[len(left) - i :], right[:j]))
            middle = self.merge(window)
            ok_left = i >= len(left) or self.pairs[left[-i - 1], middle[0]]
            ok_right = j >= len(right) or self.pairs[middle[-1], right[j]]
            if ok_left and ok_right:
                return [*left[: len(left) - i], *middle, *right[j:]]
            i += 0 if ok_left else min(i, len(left) - i)
            j += 0 if ok_right else min(j, len(right) - j)

    def encode_many(self, texts: Sequence[str | None]) -> Iterator[list[int]]:
        """Ids of whole texts."""
        found = [self.find(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(found))
        for words in found:
            # matches are encoded separately, so neighbours of a text's tree are joined as they are
            level = [list(chain.from_iterable(map(self.words.__getitem__, words[i : i + RUN]))) for i in range(0, len(words), RUN)] or [[]]
            while len(level) > 1:
                level = [a + b for a, b in zip(level[::2], level[1::2])] + level[len(level) // 2 * 2 :]
            yield level[0]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of ids: halves are decoded and concatenated."""
        if len(ids) <= CHUNK:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; ``path`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = list(c.encode_many(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), f"{id_col} long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of every row of ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())], names=[id_col, "bytes"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(lean(run), f"{id_col} long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, SHA-256 of its ids in decimal joined by spaces, SHA-256 of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows = batch.slice(i, 64), []
                for ids in c.encode_many(part.column(1).to_pylist()):
                    said = " ".join(map(c.decimal.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
