import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
from quadrille.llm import byte_bpe, decontaminate, jaccard_join, quality
from quadrille.llm.token_counts import read_ranks


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    keep = {r.doc_id for r in quality.score_quality(docs, labels).filter("keep").collect()}
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    linked, root = jaccard_join.links_plainly([t for _, t in left]), list(range(len(left)))
    for i, j in linked:
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    left = [x for i, x in enumerate(left) if root[i] == i]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for doc_id, text in left:
        n, hit, _ = decontaminate.hits_plainly(text, items)
        if not (hit and 20 * hit >= n):
            clean.append((doc_id, text))
    coder = byte_bpe.Encoder(read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)
    want = [(d, ids) for (d, _), ids in zip(clean, coder.encode([t for _, t in clean]))]
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, list(r.ids)) for r in got.collect()) == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, sf):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, None, None), (None, None, None), (2, "", "z"), (3, "w " * 30000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tx string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "k_id": F.lit(1), "carry_0": F.lit("c")})
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns
            found = out.collect()
            assert (len(found) > 0) == (frame is docs)
            if name == "n-gram Jaccard join" and frame is docs:
                kept = sorted((r.doc_id or 0, r.text or "") for r in found)
    assert kept == [(0, ""), (0, ""), (1, "a"), (2, ""), (3, "w " * 30000)]


def test_last_stage_and_whole_runs_on_odd_tables(spark, sf, tmp_path):
    """Empty documents and odd ones go through run() as a whole."""
    shape = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, ""), (3, "w " * 30000)], "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in shape.dtypes if c not in ("doc_id", "text")}).select(shape.columns)
    for name, docs in (("empty", shape.limit(0)), ("odd", odd)):
        folder = tmp_path / name
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == ([] if name == "empty" else [(0, False), (1, True), (2, False), (3, True)])
        assert all(len(r.ids) == r.n_tokens for r in got)


def test_repeated_rows_leave_a_defined_one(spark, sf):
    docs = spark.createDataFrame([(1, "same text", "b"), (1, "same text", "a"), (1, "same text", "c")], "doc_id long, text string, lang string")
    assert [r.lang for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()] == ["a"]


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
