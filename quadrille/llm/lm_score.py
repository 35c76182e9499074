"""Cross-entropy difference of two matched n-gram models over one vocabulary.

Tokens are the bytes of a text and one end token (byte 0, which also fills the histories before the first token), so both models
share the vocabulary of 256 symbols. The target model is counted over the documents with a label of `target`, the background model over
all documents; its counts are scaled to the target's number of tokens, as those of a sample of that size would be on average, so both models
trust their counts alike. From order 1 up to `order`, with r = background tokens / target tokens (1 for the target, and without any):

    P_k(w | h) = (c(h w) / r + mu * P_{k-1}(w | h')) / (c(h) / r + mu),   P_0 = 1/256,   c(h) = sum over w of c(h w)

A target document's own counts are left out of the target's when it is scored, so that its label doesn't lower its loss. A document's score
is its mean over tokens of loss under the target model less loss under the background model, in bits: the lower, the more like the target.

The counts grow with the corpus, so no task and no driver holds them. Documents are dealt to parts of bounded
bytes; a part sends the counts of its distinct n-grams and histories of three tokens or more once, the sums are made by n-gram, and
each part gets back the sums of its own n-grams only. Those of up to two tokens occur in every part, and there are at most
2 * 65536 of them: they are summed by themselves and broadcast.

Defined results: a null text counts as empty and has its end token alone; without target documents target
counts are 0; repeated rows count as often as they come, and a target row leaves out its own counts once; a null doc_id has no label; very long
texts are worked on as a whole; equal scores are no matter, as nothing is ranked; labels that are null or name no document are left
out, and a document with any label of `target` belongs to the target; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, text_frame

#: Bytes of text in a part, and tokens and texts worked on at once.
PART_BYTES, CHUNK, CHUNK_TEXTS = 12_000_000, 2_000_000, 60_000
BROADCAST_LABELS = 2_000_000
CODE_BITS = 48
#: N-grams and histories of up to so many tokens are summed by themselves.
LOW = 2


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each token, as an integer of `order` bytes, and where each text's tokens begin."""
    pad = b"\0" * (order - 1)
    joined = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.zeros(joined.size, np.int64)
    for j in range(order):
        codes[j:] |= joined[: joined.size - j].astype(np.int64) << (8 * j)
    real = np.ones(joined.size, bool)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    for j in range(order - 1):
        real[starts + j] = False
    return codes[real], np.cumsum(sizes) - sizes


def _chunks(texts: list[bytes]):
    """Index ranges of texts of about CHUNK bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or i + 1 - at >= CHUNK_TEXTS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if keys.size else c for c in counts))


def gram_counts(texts: list[bytes], target: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the highest order, their counts in all texts and in target texts."""
    found = []
    for a, b in _chunks(texts):
        for flag in (0, 1):
            some = [t for t, f in zip(texts[a:b], target[a:b], strict=True) if f == flag]
            if some:
                keys, n = np.unique(_codes(some, order)[0], return_counts=True)
                found.append((keys, n, n * flag))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _grams(code: np.ndarray, k: int) -> np.ndarray:
    """Key of the last k tokens."""
    return (code & ((1 << 8 * k) - 1)) | (k << CODE_BITS)


def _histories(code: np.ndarray, k: int) -> np.ndarray:
    """Key of the k tokens before the last one."""
    return ((code >> 8) & ((1 << 8 * k) - 1)) | ((k + 16) << CODE_BITS)


def _all_keys(code: np.ndarray, everywhere: np.ndarray, target: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    kinds = [_summed(f(code, k), everywhere, target) for f, most in ((_grams, order + 1), (_histories, order)) for k in range(LOW + 1, most)]
    return tuple(np.concatenate(x) for x in zip(*kinds, strict=True)) if kinds else (np.zeros(0, np.int64),) * 3


def low_counts(texts: list[bytes]) -> np.ndarray:
    """How often each two tokens end at a token (line 0) and stand before one (line 1)."""
    out = np.zeros((2, 65536), np.int64)
    for a, b in _chunks(texts):
        joined = np.frombuffer(b"\0\0" + b"\0\0\0".join(texts[a:b]) + b"\0", np.uint8).astype(np.uint16)  # two tokens before a text and one after it
        pairs = joined[1:] | joined[:-1] << np.uint16(8)  # the pair that ends at each place from 1
        real = np.ones(pairs.size, bool)  # places of tokens: all but the two before each text
        starts = np.cumsum([0, *(len(t) + 3 for t in texts[a : b - 1])])
        real[starts] = False
        real[starts[1:] - 1] = False
        at = np.flatnonzero(real)
        out += np.stack([np.bincount(pairs[x], minlength=65536) for x in (at, at - 1)])
    return out


class Sums:
    """Counts of one model for the distinct n-grams `code` of the highest order: grams[k - 1] and histories[k - 1] for each order k."""

    def __init__(self, code: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int):
        one = low[0].reshape(256, 256).sum(axis=0), low[0].sum()
        before = low[0].reshape(256, 256).sum(axis=1)
        get = lambda key: counts[np.searchsorted(keys, key)]
        grams = {1: lambda: one[0][code & 255], 2: lambda: low[0][code & 65535]}
        histories = {0: lambda: np.full(code.size, one[1]), 1: lambda: before[(code >> 8) & 255], 2: lambda: low[1][(code >> 8) & 65535]}
        self.grams = [(grams[k]() if k <= LOW else get(_grams(code, k))).astype(np.float64) for k in range(1, order + 1)]
        self.histories = [(histories[k]() if k <= LOW else get(_histories(code, k))).astype(np.float64) for k in range(order)]


def losses(grams: list[np.ndarray], histories: list[np.ndarray], mu: float) -> np.ndarray:
    """Loss in bits of the last token of each n-gram, from its counts."""
    p = np.full(grams[0].size, 1 / 256)
    for g, h in zip(grams, histories, strict=True):
        p = (g + mu * p) / (h + mu)
    return -np.log2(p)


def _places(top: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where each of code stands in top: sorted first, so that equal ones are looked up once."""
    by = np.argsort(code)
    ordered = code[by]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.empty(code.size, np.int64)
    out[by] = np.repeat(np.searchsorted(top, ordered[first]), np.diff(np.append(first, code.size)))
    return out


def own_counts(code: np.ndarray, text: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token, how often the last k tokens, and the k tokens before it, occur in its own text. One sort each: with the latest token
    foremost, the n-grams of all orders are prefixes."""
    found = []
    for values in (code, code >> 8):
        key = (text.astype(np.uint64) << np.uint64(8 * order)) | (values.astype(np.uint64).byteswap() >> np.uint64(64 - 8 * order))
        by = np.argsort(key)
        key, counts = key[by], []
        for k in range(order + 1):
            prefix = key >> np.uint64(8 * (order - k))
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            n = np.diff(np.append(first, key.size))
            out = np.empty(key.size, np.float64)
            out[by] = np.repeat(n, n)
            counts.append(out)
        found.append(counts)
    return found[0][1:], found[1][:-1]


def _bytes(column) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8") for x in column.to_pylist()]


def score_documents(docs: DataFrame, labels: DataFrame, target: int = 1, label_col: str = "quality", order: int = 5, mu: float = 4.0, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (bits a token), score (their difference) of every row. docs is a table as it is read: its rows
    are told apart by their places in it."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    # the row's place in its input keeps even repeated rows of one document from meeting in one part
    rows = text_frame(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    good = labels.filter(labels[label_col] == target).select(labels[id_col].cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(1))
    if labels.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    texts = rows.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target"), "row")

    def lowest():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flag, all_ = batch.column(1).to_numpy(), _bytes(batch.column(0))
            n, t = low_counts(all_), low_counts([x for x, f in zip(all_, flag, strict=True) if f])
            kind, code = np.nonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(kind * 65536 + code), pa.array(n[kind, code]), pa.array(t[kind, code])], ["key", "n", "t"])

        return each

    held = np.zeros((2, 2 * 65536), np.int64)
    for r in map_slices(texts.select("text", "target"), lowest, "key long, n long, t long", 10_000).groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow().to_batches():  # at most 2 * 65536 rows
        held[:, r.column(0).to_numpy()] = np.stack([r.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)])
    low = docs.sparkSession.sparkContext.broadcast(held.reshape(2, 2, 65536))
    tokens, in_target = (int(x) for x in held[:, :65536].sum(axis=1))
    ratio = tokens / in_target if in_target else 1.0
    texts = texts.select("doc_id", "text", "target", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts)).cast("int").alias("part")).repartition(parts, "part")

    def count(left: pa.Table) -> pa.Table:
        code, n, t = gram_counts(_bytes(left.column("text")), left.column("target").to_numpy(), order) if order > LOW else (np.zeros(0, np.int64),) * 3
        key, n, t = _all_keys(code, n, t, order)
        return pa.table({"part": pa.array(np.full(key.size, left.column("part")[0].as_py(), np.int32)), "key": key, "n": n, "t": t})

    counts = texts.groupBy("part").applyInArrow(count, "part int, key long, n long, t long")
    same = Window.partitionBy("key")
    sums = counts.select("part", "key", F.sum("n").over(same).alias("n"), F.sum("t").over(same).alias("t"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy()
        by = np.argsort(keys)
        keys, n, t = keys[by], right.column("n").to_numpy()[by], right.column("t").to_numpy()[by]
        texts_, flags = _bytes(left.column("text")), left.column("target").to_numpy()
        if order > LOW:
            top = keys[np.searchsorted(keys, order << CODE_BITS) : np.searchsorted(keys, (order + 1) << CODE_BITS)] & ((1 << 8 * order) - 1)
        else:
            top = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(_codes(texts_[a:b], order)[0]) for a, b in _chunks(texts_))]))
        of_target = Sums(top, keys, t, low.value[1], order)
        background = Sums(top, keys, n, low.value[0], order)
        losses_ = losses(of_target.grams, of_target.histories, mu), losses(background.grams, background.histories, mu * ratio)
        means = [[], []]
        for a, b in _chunks(texts_):
            code, starts = _codes(texts_[a:b], order)
            at = _places(top, code)
            lengths = np.diff(np.append(starts, code.size))
            here = [loss[at] for loss in losses_]
            own = np.repeat(flags[a:b] > 0, lengths)
            if own.any():
                text = np.repeat(np.arange(b - a), lengths)[own]
                grams, histories = own_counts(code[own], text, order)
                place = at[own]
                here[0][own] = losses([c[place] - g for c, g in zip(of_target.grams, grams, strict=True)], [c[place] - h for c, h in zip(of_target.histories, histories, strict=True)], mu)
            for out, loss in zip(means, here, strict=True):
                out.append(np.add.reduceat(loss, starts) / lengths)
        target_, background_ = (np.concatenate(m) if m else np.zeros(0) for m in means)
        return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "n_tokens": pa.array([len(x) + 1 for x in texts_], pa.int64()), "loss_target": target_, "loss_background": background_, "score": target_ - background_})

    return texts.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
