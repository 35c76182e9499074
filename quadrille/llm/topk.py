"""Exact top-k by tiled matrix products.

Every component x becomes floor(256 * x), x as double, and the score is the integer inner product. Queries of at most
`group_bytes` in all are broadcast; more are dealt to groups of that size, which meet the shards of the vectors in a cogroup, so nothing
of them lies on the driver. Each task multiplies its queries with the vectors of its shard tile by tile, keeps the best of each tile
(np.partition, ties to smaller ids) and merges them into one list a query. Lists of all tasks meet in a
tree: first in groups of tasks, then by query. Numbers stay exact: doubles hold all products whose sums are under 2^53;
tiles beyond that are computed in Python integers.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; a vector of
another length than the query's isn't its candidate; every row but the query's own is a candidate, repeated
rows too; rows with a null vec_id are no queries and come last among equal scores; scores beyond 64 bits are cut to the
nearest long after ranking; with fewer candidates than k all come; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GROUP_BYTES = 32_000_000
TILE = 2_048
FAN_IN = 16
#: Order of a null vec_id among equal scores.
LAST = 2**63 - 1
EXACT = 2.0**53


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), length)


def _top(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each line: highest score, then smallest id, then smallest row number."""
    if scores.dtype != object and scores.shape[1] > 4 * k:  # partial selection; all that tie with the k-th stay in
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        width = int((scores >= floor[:, None]).sum(axis=1).max())
        pick = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, ids, uids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1), np.take_along_axis(uids, pick, 1)
    out = []
    for s, i, u in zip(scores, ids, uids, strict=True):
        best = sorted(zip((-s).tolist(), i.tolist(), u.tolist(), strict=True))[:k]
        out.append(best)
    k = max(map(len, out), default=0)
    fill = (np.inf, LAST, -1)
    table = [row + [fill] * (k - len(row)) for row in out]
    exact = scores.dtype == object
    return (
        np.array([[-c[0] for c in row] for row in table], object if exact else np.float64).reshape(len(out), k),
        np.array([[c[1] for c in row] for row in table], np.int64).reshape(len(out), k),
        np.array([[c[2] for c in row] for row in table], np.int64).reshape(len(out), k),
    )


class Lists:
    """The best candidates so far of every query of a group."""

    def __init__(self, queries: np.ndarray, uids: np.ndarray, k: int):
        self.queries, self.uids, self.k = queries, uids, k
        self.most = float(np.abs(queries).max(initial=0))
        n = len(queries)
        self.scores, self.ids, self.rows = np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)

    def tile(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        exact = self.most * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < EXACT
        whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)
        scores = self.queries @ vectors.T if exact else whole(self.queries) @ whole(vectors).T
        own = self.uids[:, None] == rows[None, :]
        if own.any():
            scores = scores.astype(object) if not exact else scores
            scores[own] = -np.inf
        s, i, r = _top(scores, np.broadcast_to(ids, scores.shape), np.broadcast_to(rows, scores.shape), self.k)
        if s.dtype != self.scores.dtype:
            s, self.scores = s.astype(object), self.scores.astype(object)
        self.scores, self.ids, self.rows = _top(np.concatenate((self.scores, s), 1), np.concatenate((self.ids, i), 1), np.concatenate((self.rows, r), 1), self.k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of every query (the rows whose id is divisible by `every`)."""
    raw = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = raw.filter(F.col("v").isNotNull() & ~F.exists("v", bad)).select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("v"), F.size("v").alias("d"))
    rows = written(rows)  # a row keeps its number, by which a query knows its own row
    ask = rows.filter(F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0))
    asked = int(ask.agg(F.sum(8 * F.greatest("d", F.lit(1)).cast("long"))).first()[0] or 0)
    lists = _search_all(rows, ask, k) if asked <= group_bytes else _search_tiles(rows, ask, k, group_bytes)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("uid")]
    lists = lists.withColumn("score", F.col("score").cast("decimal(38,0)"))
    for level in (["quid", "leaf"], ["quid"]):  # the tree: lists of FAN_IN tasks or shards, then all of a query
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*level).orderBy(*order))).filter(F.col("rank") <= k)
    low, high = F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")
    return lists.select("query_id", "rank", "vec_id", F.least(F.greatest(F.col("score"), low), high).cast("long").alias("score"))


def _floors(table, d: int) -> np.ndarray:
    column = table.column("v")
    return np.floor(256 * _matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, d))


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).fill_null(LAST).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).fill_null(LAST).to_numpy()


def _rows_of(best: Lists, names: np.ndarray, leaf: int) -> pa.RecordBatch:
    at, j = np.nonzero(best.rows >= 0) if best.rows.size else (np.zeros(0, int), np.zeros(0, int))
    real = [(a, b) for a, b in zip(at.tolist(), j.tolist(), strict=True) if best.scores[a, b] != -np.inf]
    ids = [int(best.ids[a, b]) for a, b in real]
    big = 10**38 - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(best.uids[a]) for a, _ in real], pa.int64()),
            pa.array([int(names[a]) for a, _ in real], pa.int64()),
            pa.array([leaf] * len(real), pa.int32()),
            pa.array([int(best.rows[a, b]) for a, b in real], pa.int64()),
            pa.array([None if i == LAST else i for i in ids], pa.int64()),
            pa.array([str(max(-big, min(big, int(best.scores[a, b])))) for a, b in real], pa.string()),
        ],
        ["quid", "query_id", "leaf", "uid", "vec_id", "score"],
    )


_LISTS = "quid long, query_id long, leaf int, uid long, vec_id long, score string"


def _search_all(rows: DataFrame, ask: DataFrame, k: int) -> DataFrame:
    """Each task's best lists of all queries, which fit a broadcast."""
    got = ask.toArrow().sort_by("uid")  # at most group_bytes
    lengths = got.column("d").to_numpy()
    queries = {}
    for d in np.unique(lengths).tolist():
        own = got.filter(pa.array(lengths == d))
        queries[d] = (_floors(own, d), own.column("uid").to_numpy(), own.column("vec_id").to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = {d: Lists(q, uids, k) for d, (q, uids, _) in sent.value.items()}
        for batch in batches:
            lengths = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d not in best:
                    continue
                same = batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))
                for at in range(0, same.num_rows, TILE):
                    part = same.slice(at, TILE)
                    best[d].tile(_floors(part, d), _numbers(part, "vec_id"), _numbers(part, "uid"))
        for d, lists in best.items():
            yield _rows_of(lists, sent.value[d][2], TaskContext.get().partitionId() // FAN_IN)

    return rows.select("uid", "vec_id", "v", "d").mapInArrow(run, _LISTS)


def _search_tiles(rows: DataFrame, ask: DataFrame, k: int, group_bytes: int) -> DataFrame:
    """The best lists of every group of queries in every shard of vectors, for any number of queries: the vectors are dealt to shards
    and the queries to groups of at most about `group_bytes`, and each pair of a group and a shard is a task's tile."""
    kinds = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.join(ask.groupBy("d").agg(F.count(F.lit(1)).alias("n_asked")), "d")
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * 8 * F.greatest("d", F.lit(1)) / group_bytes)).cast("int")
    kinds = written(kinds.select("d", pieces("n").alias("shards"), pieces("n_asked").alias("groups")))
    dealt = lambda n: F.pmod(F.xxhash64("uid", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = F.xxhash64("d", "group", "shard").alias("tile")
    asked = ask.join(kinds.hint("merge"), "d").withColumn("group", dealt("groups")).withColumn("shard", F.explode(every("shards"))).select(key, "uid", "vec_id", "v", "d")
    held = rows.join(kinds.hint("merge"), "d").withColumn("shard", dealt("shards")).withColumn("group", F.explode(every("groups"))).select(key, "shard", "uid", "vec_id", "v", "d")
    held = held.toDF(*held.columns)  # columns of its own, apart from those of asked

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_rows_of(Lists(np.zeros((0, 1)), np.zeros(0, np.int64), k), np.zeros(0), 0)])
        d = left.column("d")[0].as_py()
        best = Lists(_floors(left, d), left.column("uid").to_numpy(), k)
        for at in range(0, right.num_rows, TILE):
            part = right.slice(at, TILE)
            best.tile(_floors(part, d), _numbers(part, "vec_id"), _numbers(part, "uid"))
        return pa.Table.from_batches([_rows_of(best, left.column("vec_id").to_numpy(), right.column("shard")[0].as_py() // FAN_IN)])

    return asked.groupBy("tile").cogroup(held.groupBy("tile")).applyInArrow(search, _LISTS)
