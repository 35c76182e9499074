"""N-gram Jaccard join by chosen paths.

Documents become sets of word n-grams (five words; A-Z in lower case, words are runs of [0-9a-z] and of all that isn't
ASCII; a text of fewer words, but not none, is one n-gram). Equal sets are one class with a count. Classes are
embedded as `coords` min-hashes, the tokens of the join. A run starts at a root; a node samples some of the coordinates (at least one,
`fan` on average, by a hash of its path), and a class goes down to the child named by its token at each of them, so two classes share a path
with a chance that grows with their similarity. Buckets of at most `limit` classes are compared by brute force on their min-hashes.
In a larger one the first class is a pivot: classes near to it are tied to it, and if all are, the bucket is done. Else those that aren't much like it split again, down to `depth` levels; below,
they go to the next pivot, for as many rounds as it takes. A class that is much like the pivot and one that isn't tied lie further apart than a link, so
no pair is lost. `runs` runs take the recall of pairs at the threshold to at least `recall`: a pair of similarity s
misses all first-level coordinates with a chance of (1 - s) to their number, and the number of runs is raised until that is
below 1 - recall.

Buckets only say which classes may belong together; connected ones form candidate components. Inside these all pairs are
decided exactly on their n-grams (see _links): texts are read once, and no component lands in one task. Links are counted, not listed.

Defined results: a document without words (null, empty, punctuation only) has no n-grams, no links and is its own class; equal
sets are similar (1.0), so copies are links of each other; repeated rows are copies, each with a row in the result; ties don't
arise (class ids are the smallest doc_id of a class, with a null doc_id after all others); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_slices, release, text_frame, written
from .decontaminate import words_of

COORDS = 64
MAX_WORDS_KEPT = 500_000
#: Numbers in this many sets of a tile are counted by a matrix product.
DENSE = 48
#: How a class stands to the pivot of its bucket.
LIKE, TIED, APART = 0, 1, 2
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) for arrays."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct n-gram hashes of texts; remembers the hashes of words."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MAX_WORDS_KEPT:
            known.clear()
        try:
            ids = np.array(list(map(known.__getitem__, words)), np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.array(list(map(known.__getitem__, words)), np.uint64)
        n = min(self.n, len(words))
        x = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            x = mix(x ^ ids[j : len(ids) - n + 1 + j])
        return np.unique(x)


@lru_cache(4)
def _lines(coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(coords, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) | np.uint64(1)
    return a[:, None], mix(a)[:, None]


def min_hashes(grams: np.ndarray, coords: int, seed: int) -> np.ndarray:
    """One token (32 bits) a coordinate."""
    a, b = _lines(coords, seed)
    low = np.full(coords, 2**32 - 1, np.uint64)
    for at in range(0, grams.size, 8192):
        low = np.minimum(low, (((grams[at : at + 8192][None, :] ^ b) * a) >> np.uint64(32)).min(axis=1))
    return low.astype(np.uint32)


def chosen(paths: np.ndarray, coords: int, fan: float) -> np.ndarray:
    """Which coordinates (columns) each node (line) samples: each with a chance of fan / coords, and its first in any case."""
    u = mix(paths[:, None] ^ mix(np.arange(coords, dtype=np.uint64))[None, :])
    pick = u < np.uint64(int(fan / coords * 2**64))
    pick[np.arange(len(paths)), u.argmin(axis=1)] = True
    return pick


def roots(runs: int, seed: int) -> np.ndarray:
    return mix(np.arange(runs, dtype=np.uint64) + np.uint64(seed * 7919 + 13))


def runs_for(recall: float, similarity: float, coords: int, fan: float, seed: int, least: int = 6) -> int:
    """Runs whose first-level coordinates bring the chance of a miss below 1 - recall."""
    for runs in range(least, 65):
        if (1 - similarity) ** int(chosen(roots(runs, seed), coords, fan).any(axis=0).sum()) <= (1 - recall) / 2:
            return runs
    raise ValueError(f"64 runs don't reach a recall of {recall} at similarity {similarity}")


def children(paths: np.ndarray, tokens: np.ndarray, coords: int, fan: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, path of the child) for every line and every coordinate that its node samples."""
    line, c = np.nonzero(chosen(paths, coords, fan))
    return line, mix(mix(paths[line] ^ c.astype(np.uint64)) ^ tokens[line, c].astype(np.uint64))


def _tokens(column, coords: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coords)


def _short(tokens: np.ndarray) -> np.ndarray:
    """One byte of each token, to compare by: two different ones are equal in 1 of 256 cases."""
    return (tokens & np.uint32(255)).astype(np.uint8)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def sketches(docs: DataFrame, n: int, coords: int, seed: int) -> DataFrame:
    """doc_id, tx (hash of the text), h (hash of the n-gram set, null if it is empty), n_grams, tokens, short (a byte of each)."""

    def make():
        grams_of = Shingles(n)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, sizes, tokens, short = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = grams_of(text)
                sizes.append(grams.size)
                h.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if grams.size else None)
                low = min_hashes(grams, coords, seed) if grams.size else None
                tokens.append(None if low is None else low.tobytes())
                short.append(None if low is None else _short(low).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(h, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(short, pa.binary())], ["doc_id", "tx", "h", "n_grams", "tokens", "short"])

        return each

    rows = text_frame(docs).withColumn("tx", F.xxhash64("text"))
    return map_slices(rows, make, "doc_id long, tx long, h long, n_grams long, tokens binary, short binary")


def _grouped(frame: DataFrame, key: str, fn, schema: str, rows_a_task: int = 20_000) -> DataFrame:
    """Applies fn to the table of each key. Keys are dealt and sorted, so that small groups don't cost a call of Spark each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rest = fn(), None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = table.column(key).to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = [0, *edges.tolist()]
            for a, b in zip(starts, starts[1:]):
                yield from each(table.slice(a, b - a)).to_batches()
            rest = table.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield from each(rest).to_batches()

    return frame.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join at every size: neither side has a bound, and skewed keys are split at run time."""
    return left.join(right.hint("merge"), on, how)


def candidate_components(classes: DataFrame, runs: int, coords: int, fan: float, limit: int, depth: int, alike: int, seed: int, similarity: float) -> DataFrame:
    """node, comp of the classes that met another one in a bucket and may be similar to it. In small buckets each is tied to the
    first of its bucket's component, in large ones to pivots."""
    top = roots(runs, seed)

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens = _tokens(batch.column(1), coords)
            out = [children(np.full(len(tokens), r, np.uint64), tokens, coords, fan) for r in top]
            line, path = pa.array(np.concatenate([x for x, _ in out])), np.concatenate([p for _, p in out])
            return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(batch.column(k).take(line) for k in (0, 2, 3))], ["path", "h", "n_grams", "short"])

        return each

    # sets of a Jaccard similarity s have sizes of a ratio of at least s; up to 1/2 is let through in any case, as such classes link others
    ratio = min(Fraction(1, 2), Fraction(similarity).limit_denominator(10**6))
    over, under = ratio.numerator, ratio.denominator

    def compare():
        def each(table: pa.Table) -> pa.Table:
            h, sizes = table.column("h").to_numpy(), table.column("n_grams").to_numpy().astype(np.int64)
            tokens = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, coords)
            order = np.argsort(h)
            h, sizes, tokens = h[order], sizes[order], tokens[order]
            columns, pairs = np.ascontiguousarray(tokens.T), []
            for at in range(0, len(h), 256):  # a few lines against all that follow them
                n = min(256, len(h) - at)
                same = np.zeros((n, len(h) - at), np.uint8)
                for c in columns:
                    same += c[at : at + n, None] == c[None, at:]
                a, b = np.nonzero(same >= alike)
                a, b = a[b > a] + at, b[b > a] + at
                fit = under * np.minimum(sizes[a], sizes[b]) >= over * np.maximum(sizes[a], sizes[b])
                pairs.append((a[fit], b[fit]))
            root = _union(len(h), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*pairs, strict=True)))
            own = root != np.arange(len(h))
            return pa.table({"a": h[own], "b": h[root[own]]})

        return each

    # a member this like the pivot needs no other partner, and one this near to it is tied to it: wider by the distance of a link and the error of the sketches
    like_at = coords * (1 - 1.25 * (1 - similarity))
    tied_at = max(1.0, like_at - coords * (1 - similarity + 0.15))

    def mark():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, pivot = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, coords) for k in (3, 4))
            same = (own == pivot).sum(axis=1)
            state = np.where(same >= like_at, LIKE, np.where(same >= tied_at, TIED, APART)).astype(np.int8)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(state)], ["path", "h", "pivot", "state"])

        return each

    def part(split: bool):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            path, rest = batch.column(0).to_numpy().view(np.uint64), batch.columns[1:4]
            if split:
                line, path = children(path, _tokens(batch.column(4), coords), coords, fan)
                line = pa.array(line)
                rest = [c.take(line) for c in rest]
            else:
                path = mix(path)
            return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *rest], ["path", "h", "n_grams", "short"])

        return each

    shape = "path long, h long, n_grams long, short binary"
    members = map_slices(classes.select("h", "tokens", "n_grams", "short"), start, shape, 4096)
    leaves, found, used, level = [], [], [], 0
    while True:
        level += 1
        members = written(members)
        counts = written(members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        used += [members, counts]
        leaves.append(_merged(members, counts.filter(F.col("size") <= limit).select("path"), "path").select("path", "h", "n_grams", "short"))
        if counts.filter(F.col("size") > limit).isEmpty():
            break
        # each large bucket takes its first member as a pivot. If all are tied to it, it is done; else those that aren't like it go on, to smaller
        # buckets or, below `depth`, to the next pivot
        large = written(_merged(members, counts.filter(F.col("size") > limit).select("path"), "path").select("path", "h", "short"))
        pivots = large.groupBy("path").agg(F.min("h").alias("pivot"), F.min_by("short", "h").alias("pivot_short"))
        held = _merged(large, pivots, "path").select("path", "h", "pivot", "short", "pivot_short")
        marked = written(map_slices(held, mark, "path long, h long, pivot long, state byte", 4096))
        used += [large, marked]
        found.append(marked.filter((F.col("state") != APART) & (F.col("h") != F.col("pivot"))).select(F.col("h").alias("a"), F.col("pivot").alias("b")))
        apart = marked.filter(F.col("state") == APART).select("path").distinct()
        stay = _merged(marked.filter(F.col("state") != LIKE), apart, "path", "left_semi").select("path", "h")
        stay = _merged(stay, classes.select("h", "n_grams", "short", "tokens"), "h").select("path", "h", "n_grams", "short", "tokens")
        members = map_slices(stay, lambda split=level < depth: part(split), shape, 4096)
        release(classes.sparkSession)
    found.append(_grouped(reduce(DataFrame.unionByName, leaves), "path", compare, "a long, b long"))
    release(classes.sparkSession)
    out = components(reduce(DataFrame.unionByName, found))
    forget(*used)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of the component) for the nodes of edges (a, b), as a table: least labels with pointer jumping."""
    # a node that met several others: they are tied to the least of them, and so to each other, which leaves few distinct edges
    least = F.min("b").over(Window.partitionBy("a"))  # the larger node of an edge, so never the root of a star
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).select("a", "b", least.alias("m"))
    edges = edges.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
    # all run from a larger node to a smaller, so that both ways stay distinct
    both = written(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = _merged(both, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = written(_merged(labels, near, "node").select("node", F.least("comp", "m").alias("comp"), (F.col("m") < F.col("comp")).alias("moved")))
        if step.filter("moved").isEmpty():
            forget(both, step)
            return labels
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = written(_merged(step, jump, "comp").select("node", F.least("comp", "next").alias("comp")))
        forget(labels, step)
        labels = after


def jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, coords: int = COORDS, fan: float = 1.5, limit: int = 4096, depth: int = 8, block: int = 1024, block_grams: int = 2_000_000, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, tx (hash of its text), class_id (smallest doc_id of the documents it is linked to, by any
    number of steps), n_links (documents of similarity >= `similarity`, itself not counted), n_grams, is_first (whether it
    is the one of its class to keep: the smallest doc_id; of repeated rows with that id all are)."""
    if not 0 < coords < 256:
        raise ValueError("coords must be 1 to 255")
    docs = text_frame(docs, id_col, text_col)
    sketched = written(sketches(docs, n, coords, seed))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx")
    same = [F.any_value(c).alias(c) for c in ("n_grams", "tokens", "short")]  # equal in all of a class
    held = written(sketched.filter("h IS NOT NULL").groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), *same))
    rows = written(sketched.select("doc_id", "tx", "n_grams", "h"))
    forget(sketched)  # sketches are 320 bytes a document; only candidates need them
    runs = runs_for(recall, similarity, coords, fan, seed)
    spread = max(0.05, 6 * (similarity * (1 - similarity) / coords) ** 0.5)
    alike = max(1, int(coords * (similarity - spread)))
    near = candidate_components(held, runs, coords, fan, limit, depth, alike, seed, similarity)
    classes = written(held.select("h", "first", "copies", "n_grams"))
    forget(held)
    release(docs.sparkSession)
    found = written(_links(docs, _merged(near.withColumnRenamed("node", "h"), classes, "h"), n, similarity, block, block_grams))
    links = found.groupBy("h").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    classes = _merged(classes, links, "h", "left")
    comp = F.coalesce("root", "h")
    parted = found.filter("parted AND h <> root")
    if not parted.isEmpty():  # what a tile of several shows is a part of a class of links; a component in one tile shows it whole
        linked = components(parted.select(F.col("h").alias("a"), F.col("root").alias("b")))
        classes = _merged(classes, linked.withColumnRenamed("node", "h"), "h", "left")
        comp = F.coalesce("comp", "root", "h")
    classes = written(classes.select("h", "first", comp.alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    groups = classes.groupBy("comp").agg(F.min("first").alias("class_first"))
    classes = _merged(classes.select("h", "comp", "n_links"), groups, "comp").select("h", "class_first", "n_links")
    out = _merged(rows.select("doc_id", "tx", "n_grams", "h"), classes, "h", "left")
    return out.select(
        "doc_id",
        "tx",
        F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_grams",
        (F.col("h").isNull() | (F.col("class_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("class_first.tx") == F.col("tx")))).alias("is_first"),
    )


def _links(docs: DataFrame, near: DataFrame, n: int, similarity: float, block: int, block_grams: int) -> DataFrame:
    """(h, links, root, parted) of the classes of candidate components (h, comp, first, copies, n_grams), in one row a class, or in several if its
    component is `parted`: links to be added up, and the first class of those it is linked with.

    A component of one block is compared as a whole. In larger ones every class is held against one of them, the pivot, and
    goes on as its symmetric difference from it, x ^ p; as x ^ y = (x ^ p) ^ (y ^ p), these and the sizes give the similarity of
    any two classes exactly, and those of near copies are short. Classes within half the distance of a link of the pivot (`inner`) are all
    linked to each other, since Jaccard distance is a metric: their links are sums. Pairs with the others are compared in tiles of two blocks."""
    part = Fraction(similarity).limit_denominator(10**6)
    near = written(near)
    centre = F.max_by("h", F.struct("copies", -F.col("h"))).alias("pivot")
    sizes = near.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"), centre)
    sizes = written(sizes.select("comp", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("grams") / block_grams)).cast("int").alias("blocks"), "pivot").filter("blocks > 1"))
    held = _merged(near, sizes, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = held.withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int"))
    # a member goes to its block; the pivot goes to all blocks besides
    places = F.array(F.struct("block", F.lit(False).alias("centre")))
    all_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("centre")))
    held = held.withColumn("place", F.explode(F.when(F.col("h").eqNullSafe(F.col("pivot")), F.concat(places, all_)).otherwise(places)))
    held = held.select(F.col("first.doc_id").alias("doc_id"), F.col("first.tx").alias("tx"), "h", "comp", "copies", "place.centre", (F.col("blocks") > 1).alias("large"), F.xxhash64("comp", "place.block").alias("tile"))
    held = held.alias("w")
    texts = docs.withColumn("tx", F.xxhash64("text")).alias("d")
    texts = _merged(texts, held, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tx") == F.col("w.tx"))).select("tile", "h", "comp", "copies", "centre", "large", "text")

    def look():
        grams_of = Shingles(n)

        def each(table: pa.Table) -> pa.Table:
            h, at = table.column("h").to_numpy(), table.column("centre").to_numpy()
            middle = np.flatnonzero(at)[:1]
            own = np.flatnonzero(~at)
            h, place = np.unique(h[own], return_index=True)  # repeated rows of the first document once
            own = own[place]
            if not len(own):  # a block without members
                return pa.table({k: pa.array([], t) for k, t in (("h", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("comp", pa.int64()), ("copies", pa.int64()), ("size", pa.int64()), ("inner", pa.bool_()), ("apart", pa.binary()))})
            rest = table.take(pa.array(own))
            copies, sets = rest.column("copies").to_numpy(), [grams_of(t) for t in rest.column("text").to_pylist()]
            none = lambda t: pa.nulls(len(h), t)
            if not table.column("large")[0].as_py():
                links, root = _weigh(similar(sets, None, similarity), copies)
                return pa.table({"h": h, "links": links, "root": h[root], "comp": rest.column("comp"), "copies": copies, "size": none(pa.int64()), "inner": none(pa.bool_()), "apart": none(pa.binary())})
            pivot = grams_of(table.column("text")[int(middle[0])].as_py())
            apart, inner = [], []
            for grams in sets:
                off = np.setxor1d(grams, pivot, assume_unique=True)
                union = (grams.size + pivot.size + off.size) // 2
                inner.append(2 * int(off.size) * part.denominator <= (part.denominator - part.numerator) * union)
                apart.append(off.tobytes())
            return pa.table({"h": h, "links": none(pa.int64()), "root": none(pa.int64()), "comp": rest.column("comp"), "copies": copies, "size": pa.array([s.size for s in sets], pa.int64()), "inner": pa.array(inner, pa.bool_()), "apart": pa.array(apart, pa.binary())})

        return each

    looked = written(_grouped(texts, "tile", look, "h long, links long, root long, comp long, copies long, size long, inner boolean, apart binary"))
    del texts
    release(docs.sparkSession)  # the texts that were shuffled
    links = looked.filter("links IS NOT NULL").select("h", "links", "root", F.lit(False).alias("parted"))
    if sizes.isEmpty():
        return links
    members = looked.filter("links IS NULL").drop("links", "root")
    blocks = lambda own: F.greatest(F.ceil(F.sum(own) / block), F.ceil(F.sum(F.when(own == 1, F.octet_length("apart") / 8)) / block_grams)).cast("int")
    inside, outside = F.col("inner").cast("int"), (~F.col("inner")).cast("int")
    sums = members.groupBy("comp").agg(F.sum(F.when(F.col("inner"), F.col("copies"))).alias("weight"), F.min(F.when(F.col("inner"), F.col("h"))).alias("root"), F.coalesce(blocks(inside), F.lit(0)).alias("ins"), F.coalesce(blocks(outside), F.lit(0)).alias("outs"))
    members = written(_merged(members, sums, "comp"))
    sure = members.filter("inner").select("h", (F.col("weight") - F.col("copies")).alias("links"), "root", F.lit(True).alias("parted"))
    # tiles: an outer block with each outer and each inner block of its component; an inner block with each outer one
    own = F.pmod(F.xxhash64("h", F.lit(2)), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    numbers = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    to_outer = F.transform(numbers("outs"), lambda j: F.when(F.col("inner"), F.struct(F.lit(1).alias("kind"), j.alias("i"), F.col("own").alias("j"), F.lit(True).alias("second"))).otherwise(F.struct(F.lit(0).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).alias("second"))))
    to_inner = F.transform(numbers("ins"), lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("second")))
    tiles = members.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("inner"), to_outer).otherwise(F.concat(to_outer, to_inner))))
    tiles = tiles.select(F.xxhash64("comp", "at.kind", "at.i", "at.j").alias("tile"), ((F.col("at.kind") == 0) & (F.col("at.i") == F.col("at.j"))).alias("alone"), "at.second", "h", "copies", "size", "apart")

    def check():
        def each(table: pa.Table) -> pa.Table:
            h, size, copies = (table.column(k).to_numpy() for k in ("h", "size", "copies"))
            second = table.column("second").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()]
            if table.column("alone")[0].as_py():
                pairs, order = similar(sets, None, similarity, size), np.arange(len(h))
            else:
                a, b = np.flatnonzero(~second), np.flatnonzero(second)
                order = np.concatenate((a, b))
                pairs = similar([sets[i] for i in a], [sets[i] for i in b], similarity, size[order])
            links, root = _weigh(pairs, copies[order])
            return pa.table({"h": h[order], "links": links, "root": h[order][root]})

        return each

    return links.unionByName(sure).unionByName(_grouped(tiles, "tile", check, "h long, links long, root long").withColumn("parted", F.lit(True)))


def _weigh(pairs: tuple[np.ndarray, np.ndarray], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class the copies that its partners have, and the first member of its component."""
    a, b = pairs
    n = len(copies)
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    return links.astype(np.int64), _union(n, a, b)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many numbers each set of `left` shares with each of `right`, or of `left` itself (above the diagonal). Sets are sorted and
    distinct. Numbers in many sets are counted by a matrix product, those in few by their pairs."""
    sets, n = left + (right or []), len(left)
    low, width = (0, n) if right is None else (n, len(right))
    out = np.zeros(n * width, np.int64)
    sizes = np.array([s.size for s in sets], np.int64)
    if not sizes.sum():
        return out.reshape(n, width)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")  # owners ascend within a gram
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    shared = np.diff(np.append(first, grams.size))
    for k in np.unique(shared[(shared > 1) & (shared < DENSE)]).tolist():
        at, (i, j) = first[shared == k], np.triu_indices(k, 1)
        step = max(1, 2_000_000 // i.size)
        for s in range(0, at.size, step):
            own = owner[at[s : s + step, None] + np.arange(k)]
            a, b = own[:, i].ravel(), own[:, j].ravel()
            if right is not None:
                cross = (a < n) & (b >= n)
                a, b = a[cross], b[cross]
            np.add.at(out, a * width + b - low, 1)
    out = out.reshape(n, width)
    many = np.flatnonzero(shared >= DENSE)
    for s in range(0, many.size, 1024):
        some = many[s : s + 1024]
        dense = np.zeros((len(sets), some.size), np.float32)
        dense[np.concatenate([owner[first[g] : first[g] + shared[g]] for g in some]), np.repeat(np.arange(some.size), shared[some])] = 1
        out += (dense[:n] @ dense[low:].T).astype(np.int64)
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j (those of `right` follow those of `left`) whose Jaccard similarity is at least `similarity`; exact.
    The sets are given as they are, or, with the `sizes` of the real ones, as their symmetric differences from one set."""
    own = np.array([s.size for s in left + (right or [])], np.int64)
    sizes = own if sizes is None else sizes
    n, low = len(left), 0 if right is None else len(left)
    both = overlaps(left, right)
    total = sizes[:n, None] + sizes[None, low:]
    apart = own[:n, None] + own[None, low:] - 2 * both
    part = Fraction(similarity).limit_denominator(10**6)
    fit = (total - apart) * part.denominator >= (total + apart) * part.numerator
    a, b = np.nonzero(np.triu(fit, 1) if right is None else fit)
    return a, b + low


def links_plainly(texts: list[str | None], n: int = 5, similarity: float = 0.8) -> list[tuple[int, int]]:
    """Pairs of places i < j that are similar, by comparing all, for tests."""
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= Fraction(similarity).limit_denominator(10**6) * len(sets[i] | sets[j])]
