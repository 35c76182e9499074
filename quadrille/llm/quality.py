"""Quality by hierarchical empirical Bayes.

Evidence of a document is a log likelihood ratio from a classifier of text statistics: each
statistic is cut into bins, and a logistic regression over the bins is fitted to labelled documents, at most
`max_labelled` of them (those of least hash; 20,000 by default). Posteriors of sites then come from all documents, labelled or
not: a host's share of good documents is shrunk toward the global share, and a path's share toward its
host's, both by grouped sums. How strongly is estimated from how much the shares differ between sites beyond
chance (method of moments). A document's posterior combines its evidence with its path's share.

Tables without a url take their source as host and their language as path.

Defined results: null host or path is a site of its own; a document that is null or has no words gets the
statistics of an empty text; without labels of both classes evidence is 0 and all are kept; repeated rows count as often as they
come; labels that are null or name no document are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_slices, text_frame, written

MAX_LABELLED = 20_000
#: Labels are broadcast up to so many rows; a longer table is joined by a shuffle.
BROADCAST_LABELS = 2_000_000
BINS = 16
#: Sites up to this number are broadcast; more are joined with salted keys.
BROADCAST_SITES, SALTS = 200_000, 32
STATS = ["symbols", "distinct", "top", "same_next", "short", "mean_length", "words", "bare_symbols", "same_lines", "upper", "digits", "stops", "odd_ends"]
#: Words whose kind a worker remembers.
MAX_KEPT = 100_000
_KINDS = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)]), np.array([65 <= b <= 90 for b in range(256)]), np.array([48 <= b <= 57 for b in range(256)])


class _Kinds(dict):
    """Of a word: 1 if it is short, 2 if it has no letter or digit, 4 if it ends a sentence, 8 if it ends in two symbols."""

    def __missing__(self, w: str) -> int:
        if len(self) > MAX_KEPT:
            self.clear()
        end = len(w) > 3 and not w[-1].isalnum() and not w[-2].isalnum()
        self[w] = kind = (len(w) <= 3) + 2 * (not any(map(str.isalnum, w))) + 4 * (w[-1] in ".!?") + 8 * end
        return kind


_kind = _Kinds()


def text_stats(text: str | None) -> list[float]:
    """Statistics of a whole text. Shares have 8 neutral words added, so short texts lie near the middle."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    held = Counter(words)
    lines = [x for x in text.split("\n") if x]
    of_byte = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    symbols, upper, digits = (int(of_byte[k].sum()) for k in _KINDS)
    letters = sum(map(len, words))
    kinds = np.bincount(np.fromiter(map(_kind.__getitem__, held), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held)), 16)
    short, bare, stops, odd = (float(kinds[(np.arange(16) >> k) % 2 == 1].sum()) for k in range(4))
    share = lambda x, middle: (x + 8 * middle) / (n + 8)
    return [
        (symbols + 8 * 0.14) / (letters + 48),
        share(len(held), 0.8),
        share(max(held.values(), default=0), 0.05),
        share(sum(map(str.__eq__, words, words[1:])), 0.004),
        share(short, 0.32),
        share(letters, 5.0),
        float(np.log1p(n)),
        share(bare, 0.0),
        (len(lines) - len(set(lines))) / (len(lines) + 2),
        (upper + 8 * 0.07) / (chars + 40),
        digits / (chars + 40),
        share(stops, 0.08),
        share(odd, 0.0),
    ]


class Classifier:
    """Logistic regression over binned statistics; `evidence` is the log odds beyond those of the training rows."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def spread(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(STATS) * BINS + 1))
        for j in range(len(STATS)):
            cell = np.searchsorted(self.edges[j], x[:, j], "right")
            out[:, j * BINS : (j + 1) * BINS] = cell[:, None] == np.arange(BINS)
        return out

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights - self.prior if len(x) else np.zeros(0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Classifier:
        """Newton steps on the penalised likelihood. The bin edges are quantiles within both classes, so that rare kinds have bins too."""
        if len(y) == 0 or y.min() == y.max():
            return cls(np.zeros((len(STATS), BINS - 1)), np.zeros(len(STATS) * BINS + 1), 0.0)
        at = [np.linspace(0, 1, k + 2)[1:-1] for k in ((BINS - 1) // 2, BINS // 2)]
        edges = np.sort(np.stack([np.concatenate([np.quantile(x[y == c, j], at[c]) for c in (0, 1)]) for j in range(x.shape[1])]), axis=1)
        prior = float(np.log(y.mean() / (1 - y.mean())))
        model = cls(edges, np.zeros(len(STATS) * BINS + 1), prior)
        z, w = model.spread(x), model.weights
        ridge = np.full(len(w), penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        model.weights = w
        return model


def _with_stats(frame: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Replaces column 0, the text, by its statistics, or by its evidence under the model; columns after it stay."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            stats = [text_stats(t) for t in batch.column(0).to_pylist()]
            x = pa.array(stats, pa.list_(pa.float64())) if model is None else pa.array(model.evidence(np.array(stats).reshape(-1, len(STATS))), pa.float64())
            return pa.RecordBatch.from_arrays([x, *batch.columns[1:]], ["x", *batch.schema.names[1:]])

        return each

    x = T.StructField("x", T.ArrayType(T.DoubleType()) if model is None else T.DoubleType())
    return map_slices(frame, make, T.StructType([x, *frame.schema.fields[1:]]))


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fits to at most max_labelled rows; only their statistics come to the driver (a dozen numbers each)."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    n = known.count()
    if n > max_labelled:  # a share of the hash range first, so that the sort is of few rows
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(2_000_000 * max_labelled / n) + 10))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    rows = text_frame(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("text", "y", "doc_id")  # bounded by max_labelled
    got = _with_stats(rows).orderBy("doc_id", "y", "x").limit(2 * max_labelled).toPandas()
    return Classifier.fit(np.array(got["x"].tolist(), float).reshape(-1, len(STATS)), got["y"].to_numpy(float))


def _strength(sites: DataFrame, n: str, share: str, prior) -> float:
    """Pseudo-observations that a prior is worth, by moments: the less sites differ beyond chance, the more."""
    r = sites.agg(
        F.sum(F.col(n) * (F.col(share) - prior) ** 2).alias("between"),
        F.sum(F.col("spread")).alias("within"),
        F.sum(prior * (1 - prior) * F.col(n)).alias("var"),
        F.sum(n).alias("rows"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not r.rows:
        return 1.0
    chance = r["within"] / r.rows  # mean variance of one document's posterior within its site
    tau2 = max((r["between"] - r.sites * chance) / r.rows, 1e-6)
    return float(min(max(r["var"] / r.rows / tau2 - 1, 1.0), 1e6))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", max_labelled: int = MAX_LABELLED, carry: list[str] | None = None) -> DataFrame:
    """doc_id, evidence, host_prior, path_prior, posterior, keep (posterior >= threshold) of every row.

    `carry` names further columns of docs, which come in a struct `carried`.
    """
    spark = docs.sparkSession
    model = fit_classifier(docs, labels, id_col, text_col, label_col, max_labelled)
    base = 1 / (1 + float(np.exp(-model.prior)))
    extra = [docs[c].alias(f"carry_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[host_col].cast("string"), F.lit("\0null")).alias("host"), F.coalesce(docs[path_col].cast("string"), F.lit("\0null")).alias("path"), *extra)
    scored = written(_with_stats(rows, model).withColumnRenamed("x", "evidence"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior))))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"), F.sum(p * p).alias("sq"))
    paths = written(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"), F.sum("sq").alias("hsq"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good")).first()
    world = (total.good + base) / (total.n + 1) if total.n else base
    hosts = hosts.withColumn("hshare", F.col("hgood") / F.col("hn")).withColumn("spread", F.col("hsq") - F.col("hgood") * F.col("hshare"))
    k_host = _strength(hosts, "hn", "hshare", F.lit(world))
    hosts = hosts.select("host", ((F.col("hgood") + k_host * world) / (F.col("hn") + k_host)).alias("host_prior"))
    sites = paths.join(hosts, "host").withColumn("share", F.col("good") / F.col("n")).withColumn("spread", F.col("sq") - F.col("good") * F.col("share"))
    k_path = _strength(sites, "n", "share", F.col("host_prior"))
    sites = sites.select("host", "path", "host_prior", ((F.col("good") + k_path * F.col("host_prior")) / (F.col("n") + k_path)).alias("path_prior"))
    if paths.count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(sites), ["host", "path"])
    else:  # a hot site's rows go to SALTS tasks
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    inner = F.least(F.greatest(F.col("path_prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(inner / (1 - inner)))))
    out = joined.withColumn("posterior", posterior)
    back = [F.struct(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry))).alias("carried")] if carry else []
    return out.select("doc_id", "evidence", "host_prior", "path_prior", "posterior", (F.col("posterior") >= threshold).alias("keep"), *back)
