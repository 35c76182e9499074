"""Token counts under a unigram model: one forward pass over a trie of distinct pre-tokens.

The pieces are those of a public vocabulary (a `.tiktoken` rank file). A piece of rank r costs
log(r + shift); pieces of two or more bytes then cost less than the bytes they replace. Among the
segmentations of least cost the one of fewest pieces counts. Costs are integers, so results don't
depend on the order of additions.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix, and its forward score (the least
cost of any segmentation of that prefix, with its number of pieces) is computed once, when the node is
made; pre-tokens that share the prefix use it again. The end of a pre-token stores the count.

Defined results: a null or empty text has 0 tokens; repeated rows give repeated rows; an empty table
gives an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_slices, text_frame

SHIFT = 256
#: A trie of so many nodes is begun anew; this bounds memory and changes no count.
MAX_NODES = 1_500_000
#: Pre-tokens longer than this are scored without the trie: they are hardly ever shared.
MAX_SHARED = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def piece_costs(ranks: dict[bytes, int], shift: int = SHIFT) -> dict[bytes, int]:
    """Cost of each piece: round(1e6 * log(rank + shift)) in the upper digits, and 1 for the piece in the lower ones."""
    return {piece: (round(1e6 * math.log(rank + shift)) << 40) + 1 for piece, rank in ranks.items()}


class PrefixTrie(dict):
    """Maps a pre-token to its number of tokens; what is missing is inserted in the trie."""

    def __init__(self, costs: dict[bytes, int], max_nodes: int = MAX_NODES):
        super().__init__()
        self.costs, self.max_nodes = costs, max_nodes
        self.longest = max(map(len, costs))
        self.lengths_ending = {}  # the piece lengths that exist for each last byte
        for piece in costs:
            self.lengths_ending.setdefault(piece[-1], set()).add(len(piece))
        self.lengths_ending = {k: sorted(v) for k, v in self.lengths_ending.items()}
        self.computed = 0
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.nodes = 1

    def forward(self, word: bytes, scores: list[int], i: int) -> int:
        """Least cost of word[:i], from the costs of all shorter prefixes."""
        self.computed += 1
        costs, best = self.costs, None
        for n in self.lengths_ending.get(word[i - 1], ()):
            if n > i:
                break
            cost = costs.get(word[i - n : i])
            if cost is not None and (best is None or scores[i - n] + cost < best):
                best = scores[i - n] + cost
        if best is None:
            raise ValueError("the vocabulary lacks a single byte")
        return best

    def count(self, word: bytes) -> int:
        """Number of pieces of the best segmentation, by way of the trie if the word is short enough to be shared."""
        scores = [0]
        if len(word) > MAX_SHARED:
            for i in range(1, len(word) + 1):
                scores.append(self.forward(word, scores, i))
        else:
            node, children, value = 0, self.children, self.value
            for i, byte in enumerate(word, 1):
                key = node << 8 | byte
                node = children.get(key, 0)
                if not node:
                    node = children[key] = self.nodes
                    self.nodes += 1
                    value[node] = self.forward(word, scores, i)
                scores.append(value[node])
        return scores[-1] & ((1 << 40) - 1)

    @property
    def value(self) -> dict[int, int]:
        return self.__dict__.setdefault("_value", {})

    def __missing__(self, token: str) -> int:
        if self.nodes > self.max_nodes:
            self.begin()
            self.value.clear()
        n = self.count(token.encode("utf-8"))
        if len(token) <= MAX_SHARED:
            self[token] = n
        return n


_TRIES: dict = {}


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", shift: int = SHIFT) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_bytes of every row. The vocabulary file's bytes go to the executors with the task."""
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the tables

    def make():
        key = (hash(data.value), shift)
        if key not in _TRIES:  # kept by the worker for its next tasks
            _TRIES.clear()
            _TRIES[key] = PrefixTrie(piece_costs(read_ranks(data.value), shift))
        trie, split = _TRIES[key], regex.compile(pattern).findall

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, pre, size = [], [], []
            for text in batch.column(1).to_pylist():
                found = split(text) if text else []
                tokens.append(sum(map(trie.__getitem__, found)))
                pre.append(len(found))
                size.append(len(text.encode("utf-8")) if text else 0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(pre, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

        return each

    return map_slices(text_frame(docs, id_col, text_col), make, "doc_id long, n_tokens long, n_pretokens long, n_bytes long")


def count_plainly(text: str | None, costs: dict[bytes, int], pattern: str) -> int:
    """The same count by a Viterbi pass over each pre-token by itself, for tests."""

    def best(word: bytes) -> int:
        scores = [0] + [None] * len(word)
        for i in range(1, len(word) + 1):
            scores[i] = min(scores[j] + costs[word[j:i]] for j in range(i) if word[j:i] in costs)
        return scores[-1] & ((1 << 40) - 1)

    words: Iterable[str] = regex.findall(pattern, text or "")
    return sum(best(w.encode("utf-8")) for w in words)
