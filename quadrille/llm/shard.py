"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows get a number of their own in a table in the shared folder, which deals them to P source partitions of
like size. How many rows each partition sends to each shard is drawn on the driver, partition by partition, from
the multivariate hypergeometric distribution whose margins are the partitions' counts and the exact shard
sizes: just what a uniform shuffle of all rows would give. Every partition permutes its rows and cuts them by its line of the matrix; after the
exchange every shard permutes what it got, in blocks of its random keys, so no task holds a whole shard.

Law `rows`: shard counts are at most one apart. Rows of equal texts aren't held together. The same table and
seed give the same sizes and matrix; which row goes where follows from its row number and the seed.

Defined results: a null text has size 8 and the CRC of no bytes; a null doc_id stays null; repeated rows are rows of
their own; with fewer rows than shards some shards are empty; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_frame, written

#: Numbers from which on numpy draws no hypergeometric numbers.
NUMPY_BOUND = 10**9
#: Rows that a partition or a block should hold, and the most partitions: bounds of the matrix on the driver.
ROWS_PER_PART, MAX_PARTS = 20_000, 8_192


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Line p: how many of the rows of partition p go to each shard. Lines sum to counts, columns to sizes."""
    rng, left = np.random.default_rng(seed), np.array(sizes, np.int64)
    out = np.zeros((len(counts), len(left)), np.int64)
    for p, n in enumerate(counts):
        out[p] = _line(rng, left, n)
        left -= out[p]
    return out


def _line(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """One draw of n places without replacement from shards that have so many left: shard by shard, each from what is left."""
    total = int(left.sum())
    if total < NUMPY_BOUND:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros_like(left)
    for s, good in enumerate(left.tolist()):
        total -= good
        out[s] = n if total == 0 else hypergeometric(rng, good, total, n)
        n -= int(out[s])
    return out


def _log_factorial(n: int) -> np.longdouble:
    if n < 256:
        return np.longdouble(math.lgamma(n + 1))
    x = np.longdouble(n)  # Stirling's series; 80 bits keep the error of differences under 1e-6 for 10^12
    return x * np.log(x) - x + np.log(2 * np.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n places drawn without replacement are good. Beyond numpy's bound by rejection under the ratio-of-uniforms hat
    for log-concave distributions, in a time that doesn't depend on the numbers."""
    total = good + bad
    if total < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (total + 2)
    weight = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(n - k) + _log_factorial(bad - n + k))
    top = weight(mode)
    mean, variance = n * good / total, n * (good / total) * (bad / total) * (total - n) / (total - 1)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    rows = text_frame(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows)  # from here on a row keeps its number, whatever is lost or run again
    total = rows.count()
    parts = max(1, min(MAX_PARTS, -(-total // ROWS_PER_PART)))
    key = lambda name: F.xxhash64("row", F.lit(f"{name} {seed}"))
    rows = rows.withColumn("part", F.pmod(key("part"), F.lit(parts)).cast("int"))
    held = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # at most MAX_PARTS numbers
    counts = [held.get(p, 0) for p in range(parts)]
    matrix = communication_matrix(counts, shard_sizes(total, shards), seed)
    lines = spark.createDataFrame([(p, np.cumsum(x).tolist()) for p, x in enumerate(matrix)], "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy("k1", "row")
    sent = (
        rows.withColumn("k1", key("local"))
        .withColumn("at", F.row_number().over(local))
        .join(F.broadcast(lines), "part")  # at most MAX_PARTS lines of `shards` numbers
        .select("doc_id", "size", "text_crc32", "row", F.size(F.filter("ends", lambda x: x < F.col("at"))).alias("shard"))
    )
    blocks = max(1, min(MAX_PARTS // shards, -(-total // (ROWS_PER_PART * shards))))
    # a block is a range of the random key: the key shifted to 31 bits times the number of blocks, without remainder
    sent = written(sent).withColumn("k2", F.shiftrightunsigned(key("shard"), 1)).withColumn("block", F.shiftright(F.shiftright("k2", 32) * F.lit(blocks), 31).cast("int"))
    per = {(r.shard, r.block): r["count"] for r in sent.groupBy("shard", "block").count().collect()}  # at most MAX_PARTS numbers
    offsets, at = [], {}
    for s in range(shards):
        at[s] = 0
        for b in range(blocks):
            offsets.append((s, b, at[s]))
            at[s] += per.get((s, b), 0)
    offsets = spark.createDataFrame(offsets, "shard int, block int, before long")
    inside = Window.partitionBy("shard", "block").orderBy("k2", "row")
    return (
        sent.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"))
    )
