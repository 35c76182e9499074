"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, words are runs of [0-9a-z] and of all that isn't ASCII.
An item's windows are its runs of `window` consecutive words; an item of fewer words, but not none, is one
window. The words of the benchmark are numbered, and a number is written in a fixed number of letters (`BASE` of
them at each place), so that the automaton has few nodes and its matches stand at word borders. Its patterns are the short
items and, of the longer ones, the consecutive pieces of half a window: every window holds one of these whole, so each
text is read once for all of them, and the words on both sides of a match tell exactly which windows it belongs to. A
benchmark word costs the automaton about one word's letters instead of a window's. Hit words are marked and
mapped to code points of the original text.

The benchmark goes to the executors in blocks of about `block_bytes`, one at a time: fetched, sent, used and given up. A
benchmark of more bytes takes several passes: each reads the texts again with the next block's automaton, and the marks are
united at last, so the result is the same for any number of blocks.

Defined results: null has no words; a document without words isn't contaminated; an item that is null or has
no words has no window; equal windows of several items count for each of them; items with equal ids are one
item; windows of an item whose id is null mark words but aren't listed; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, map_slices, written

#: Some 1.4 million words: an automaton of at most 4 million nodes of 40 bytes, and as much again for words and places.
BLOCK_BYTES = 8_000_000
#: Letters at each place of a word's number; nodes keep their children in a list, so few.
BASE = 64
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MARKS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = "doc_id long, text string, marks array<struct<first:int,last:int>>, item_ids array<string>"
_RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TO_WORDS).split() if text else []


def windows_of(words: list, size: int) -> list[tuple]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Patterns:
    """The automaton of some items, and what tells the windows of its matches."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.size, self.piece = size, (size + 1) // 2
        self.reach = size - self.piece  # words on either side of a piece that a window with it can hold
        texts = [(item_id, words) for item_id, text in items if (words := words_of(text))]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in texts for w in words), 1)}
        self.places = 1
        while BASE**self.places <= len(self.numbers):
            self.places += 1
        self.letters = {w: self._spelt(i) for w, i in self.numbers.items()}
        self.unknown = "\0" * self.places
        self.owners, starts, line = [], [], [np.full(self.reach, -1, np.int32)]
        held: dict[str, tuple[int, set, list]] = {}  # words, ids of short items, places of pieces
        at = self.reach
        for item_id, words in texts:
            if len(words) < size:
                ids = held.setdefault("".join(map(self.letters.__getitem__, words)), (len(words), set(), []))[1]
                ids.add(item_id)
                continue
            self.owners.append(item_id)
            starts.append(at)
            line += [np.array([self.numbers[w] for w in words], np.int32), np.full(self.reach, -1, np.int32)]  # no window leaves its item
            for i in range(0, len(words) - self.piece + 1, self.piece):
                held.setdefault("".join(map(self.letters.__getitem__, words[i : i + self.piece])), (self.piece, set(), []))[2].append(at + i)
            at += len(words) + self.reach
        self.line, self.starts = np.concatenate(line), np.array(starts, np.int64)
        self.found = ahocorasick.Automaton() if held else None
        for key, (n, ids, places) in held.items():
            self.found.add_word(key, (n, frozenset(ids), np.array(places, np.int64)))
        if held:
            self.found.make_automaton()

    def _spelt(self, number: int) -> str:
        out = ""
        for place in range(self.places):  # other letters at each place, so that matches begin with a word
            number, digit = divmod(number, BASE)
            out += chr(0x100 + BASE * place + digit)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last) and the ids of the items with an occurring window."""
        if self.found is None or not words:
            return [], set()
        text = "".join(map(self.letters.get, words, repeat(self.unknown)))
        edges, numbers, ids = None, None, set()
        back, on = np.arange(1, self.reach + 1), np.arange(self.reach)
        for end, (n, short, places) in self.found.iter(text):
            first = (end + 1) // self.places - n
            before = after = -1
            if short:
                before, after = 0, 0
                ids |= short
            if places.size:
                if numbers is None:
                    pad = [-2] * self.reach
                    numbers = np.array([*pad, *map(self.numbers.get, words, repeat(0)), *pad], np.int32)
                here = first + self.reach
                left = np.logical_and.accumulate(self.line[places[:, None] - back] == numbers[here - back], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(self.line[places[:, None] + n + on] == numbers[here + n + on], axis=1).sum(axis=1)
                whole = left + n + right >= self.size
                if whole.any():
                    before, after = max(before, int(left[whole].max())), max(after, int(right[whole].max()))
                    ids.update(self.owners[i] for i in set((np.searchsorted(self.starts, places[whole], "right") - 1).tolist()))
            if before >= 0:
                if edges is None:
                    edges = np.zeros(len(words) + 1, np.int64)
                edges[first - before] += 1
                edges[first + n + after] -= 1
        ids.discard(None)
        if edges is None:
            return [], ids
        step = np.diff(np.concatenate(([0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0])))
        return list(zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist(), strict=True)), ids


def _blocks(bench: DataFrame, block_bytes: int) -> tuple[int, Iterator[list]]:
    """How many blocks the benchmark's rows make, and the blocks, each fetched when it is asked for."""
    size = int(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = -(-size // block_bytes) or 1
    cut = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r.item_id, r.text) for r in (bench if n == 1 else bench.filter(cut == k)).toLocalIterator()] for k in range(n))


_BUILT: dict = {}


def _joined(text: str, marks: list[dict] | None) -> tuple[int, list[dict]]:
    """Number of hit words, and the runs as code points of the text."""
    runs: list[list[int]] = []
    for a, b in sorted((m["first"], m["last"]) for m in marks or ()):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    places = [m.span() for m in WORDS.finditer(text)] if runs else []
    return sum(b - a + 1 for a, b in runs), [{"start": places[a][0], "end": places[b][1]} for a, b in runs]


def _pass(frame: DataFrame, data, size: int, last: bool) -> DataFrame:
    """Adds one block's marks and ids to those a row has already; the last pass makes the result of them."""
    key = uuid.uuid4().hex

    def make():
        if key not in _BUILT:  # kept by the worker for its next tasks
            _BUILT.clear()
            _BUILT[key] = Patterns(data.value, size)
        found = _BUILT[key]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, marks, ids, hits, spans = [], [], [], [], []
            for text, before, old in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = words_of(text)
                runs, new = found.scan(words)
                n_words.append(len(words))
                marks.append([*(before or ()), *({"first": a, "last": b} for a, b in runs)])
                ids.append(sorted({*(old or ()), *new}))
                if last:
                    n, places = _joined(text, marks[-1])
                    hits.append(n)
                    spans.append(places)
            ids, more, names = pa.array(ids, pa.list_(pa.string())), batch.columns[4:], batch.schema.names[4:]
            if not last:
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, _MARKS), ids, *more], ["doc_id", "text", "marks", "item_ids", *names])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), ids, pa.array(spans, _SPANS), *more], ["doc_id", "n_words", "n_hit", "item_ids", "spans", *names])

        return each

    schema = T.StructType.fromDDL(_RESULT if last else _SCHEMA)
    return map_slices(frame, make, T.StructType([*schema.fields, *frame.schema.fields[4:]]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, item_ids (sorted as strings), spans, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. spans: [start, end) code points of the runs of hit words.
    `carry` names further columns of docs, which come in a struct `carried`.
    """
    bench = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[item_text].cast("string").alias("text"))
    extra = [docs[c].alias(f"carry_{i}") for i, c in enumerate(carry or [])]
    frame = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.lit(None).cast("array<struct<first:int,last:int>>").alias("marks"), F.lit(None).cast("array<string>").alias("item_ids"), *extra)
    n, blocks = _blocks(bench, block_bytes)
    before = None
    for k, items in enumerate(blocks):
        data = frame.sparkSession.sparkContext.broadcast(items)  # one block: about block_bytes of text
        frame = _pass(frame, data, window, k == n - 1)
        if k < n - 1:
            frame = written(frame)
            data.destroy()
            if before is not None:
                forget(before)
            before = frame
    back = [F.struct(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry))).alias("carried")] if carry else []
    return frame.select("doc_id", "n_words", "n_hit", "item_ids", "spans", ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *back)


def hits_plainly(text: str | None, items: list[tuple[str, str]], size: int = 13) -> tuple[int, int, list[str]]:
    """n_words, n_hit and item ids by comparing every window with every place, for tests."""
    words = words_of(text)
    hit: set[int] = set()
    ids = defaultdict(int)
    for item_id, item in items:
        for window in windows_of(words_of(item), size):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    ids[item_id] += 1
    return len(words), len(hit), sorted(ids)
