"""Byte-level BPE by rounds over matrices of token ids.

Pre-tokens that a worker hasn't met yet are encoded together: they are laid out by length in padded
matrices of byte ids, one row each. In every round every row merges its leftmost pair of least rank and loses one
column; rows without a pair that can merge leave the matrix (compaction). Pair ranks come from a hash
table in numpy arrays. A pre-token that is itself in the vocabulary is one token, as the tiktoken library has
it. Pre-tokens of over LONG bytes, for which a matrix would need as many rounds as bytes, are merged by
a heap in the same order.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows; an empty
table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_slices, text_frame
from .token_counts import read_ranks

LONG = 192
#: Pre-tokens that a worker remembers (some 200 MB); beyond it, it begins anew.
MAX_KEPT = 300_000
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank of their concatenation; open addressing, probed for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, EMPTY, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, ranks_ = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slot(keys)
        while keys.size:  # those that come first to a free slot have it, the others go one on
            free = self.keys[at] == EMPTY
            _, first = np.unique(at, return_index=True)
            won = np.zeros(keys.size, bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks_[won]
            keys, ranks_, at = keys[~won], ranks_[~won], (at[~won] + 1) & self.mask
        self.one = pairs

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair can't merge. Negative ids (padding) never merge."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self.slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((held != keys) & (held != EMPTY))
        while todo.size:
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (held != EMPTY)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_kept: int = MAX_KEPT):
        self.ranks, self.table, self.max_kept = ranks, PairTable(ranks), max_kept
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge_matrix(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of like length."""
        width = max(map(len, words))
        ids = np.full((len(words), width), -1, np.int32)
        for i, w in enumerate(words):
            ids[i, : len(w)] = self.byte_ids[np.frombuffer(w, np.uint8)]
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        row = np.arange(len(words))
        out: list[tuple[int, ...]] = [()] * len(words)
        while row.size:
            j = rank.argmin(axis=1)  # the first of several equal ones: the leftmost
            best = rank[np.arange(row.size), j]
            go = best != NONE
            for k in np.flatnonzero(~go):
                out[row[k]] = tuple(x for x in ids[k].tolist() if x >= 0)
            if not go.any():
                break
            ids, rank, row, j, best = ids[go], rank[go], row[go], j[go], best[go]
            n, k = np.arange(row.size), ids.shape[1] - 1
            ids[n, j] = best
            keep = np.ones(ids.shape, bool)
            keep[n, j + 1] = False
            ids, rank = ids[keep].reshape(row.size, k), rank[keep].reshape(row.size, k)
            after, left = j + 1 < k, j > 0
            rank[n, j] = NONE
            rank[n[after], j[after]] = self.table.get(ids[n[after], j[after]], ids[n[after], j[after] + 1])
            rank[n[left], j[left] - 1] = self.table.get(ids[n[left], j[left] - 1], ids[n[left], j[left]])
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for one long word: a heap of (rank, place) over a linked list."""
        ids: list[int] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, one = len(ids), self.table.one
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := one.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := one.get(r << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (h := before[i]) >= 0 and (x := one.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def learn(self, tokens: set[str]) -> None:
        """Encodes pre-tokens that aren't kept yet."""
        new = tokens - self.kept.keys()
        if len(self.kept) + len(new) > self.max_kept:
            self.kept.clear()
            new = tokens
        groups: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for token in new:
            word = token.encode("utf-8")
            whole = self.ranks.get(word)
            if whole is not None:
                self.kept[token] = (whole,)
            elif len(word) > LONG:
                self.kept[token] = self.merge_long(word)
            else:
                groups[-(-len(word) // 4) if len(word) <= 32 else 8 + -(-len(word) // 32)].append((token, word))
        for group in groups.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                for (token, _), ids in zip(part, self.merge_matrix([w for _, w in part]), strict=True):
                    self.kept[token] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        found = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(found)))
        get = self.kept.__getitem__
        return [list(chain.from_iterable(map(get, tokens))) for tokens in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_ENCODERS: dict = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _ENCODERS:  # kept by the worker for its next tasks
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def _ranks_file(frame: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return frame.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the tables


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every row; with `decoded`, also the bytes that the ids decode to, in the same pass."""
    data = _ranks_file(docs, ranks_path)

    def make():
        coder = _encoder(data.value, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = coder.encode(batch.column(1).to_pylist())
            columns, names = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            if decoded:
                columns, names = [*columns, pa.array(map(coder.decode, ids), pa.binary())], [*names, "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    return map_slices(text_frame(docs, id_col, text_col), make, "doc_id long, ids array<int>" + ", decoded binary" * decoded, 256)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded binary of every row of ids; null ids count as none."""
    data = _ranks_file(encoded, ranks_path)

    def make():
        coder = _encoder(data.value, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

        return each

    return map_slices(encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")), make, "doc_id long, decoded binary", 256)
