import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, decontaminate, html_extract, jaccard_join, licenses, lm_score, quality, queries, shard, token_counts, topk

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, shard string, ids string"
ODD = [None, "", " ", "\n\n", "a", "don't stop", "x" * 1000, "ab" * 3000, "日本語 テキスト 🙂🙂", "tab\tnew\r\nline  two   three", "%%%%*** $$$ 12345 6789", "naïve Ünï’s", "\x00\x01 zero", "the the the the the"]


def read_ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names clash with results."""
    rows = [(i, t, "en", "s", 7, "x", "y") for i, t in enumerate(ODD)] + [(4, "a", None, None, None, None, None)] * 2 + [(None, "nameless text", None, None, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_token_counts(spark, docs, odd, empty):
    costs = token_counts.piece_costs(read_ranks())
    for frame in (docs.limit(60), odd):
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        want = sorted((-1 if r.doc_id is None else r.doc_id, token_counts.count_plainly(r.text, costs, PATTERN), len((r.text or "").encode())) for r in frame.collect())
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts.token_counts(frame, RANKS, PATTERN).collect())
        assert got == want
    assert token_counts.token_counts(empty, RANKS, PATTERN).count() == 0


def test_trie_computes_a_prefix_once_and_may_begin_anew():
    costs = token_counts.piece_costs(read_ranks())
    trie = token_counts.PrefixTrie(costs)
    words = ["interest", "interesting", "interested", "interest"]
    found = [trie[w] for w in words]
    assert trie.computed == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    small = token_counts.PrefixTrie(costs, max_nodes=5)
    assert [small[w] for w in words] == found


def test_bpe_is_tiktoken(spark, docs, odd, empty):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})
    for frame in (docs, odd):
        rows = byte_bpe.encode(frame, RANKS, PATTERN, decoded=True).collect()
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == Counter({(d, tuple(own.encode_ordinary(t or "")), (t or "").encode()): n for (d, t), n in texts.items()})
    assert byte_bpe.encode(empty, RANKS, PATTERN).count() == 0
    some = spark.createDataFrame([(1, [32, 15496]), (2, None)], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(some, RANKS, PATTERN).collect()) == [(1, own.decode_bytes([32, 15496])), (2, b"")]


def test_bpe_matrix_and_heap_agree():
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})
    coder, rng = byte_bpe.Encoder(read_ranks(), PATTERN, max_kept=50), random.Random(1)
    for n in (2, 3, 7, 31, 33, 190, 700):
        words = [bytes(rng.choice(b"aabcdehinorst ") for _ in range(n)) for _ in range(20)]
        want = [tuple(own._encode_single_piece(w)) if len(w) < 1 else tuple(coder.merge_long(w)) for w in words]
        assert coder.merge_matrix(words) == want
    texts = ["".join(rng.choice("abcdefgh xyz ") for _ in range(500)) for _ in range(20)]
    assert coder.encode(texts) == [own.encode_ordinary(t) for t in texts]


def test_query_op3_digests(spark, sf):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def long_items():
    rng = random.Random(5)
    words = [f"w{rng.randrange(40)}" for _ in range(60)]
    return words, [("1", " ".join(words[:20])), ("2", " ".join(words[10:40])), ("2", "Short, ITEM!"), ("3", ""), ("4", None), (None, "orphan item words")]


@pytest.mark.parametrize("block_bytes", [10**7, 60])
def test_decontaminate(spark, odd, empty, block_bytes):
    words, items = long_items()
    rng, texts = random.Random(6), [*ODD]
    for _ in range(40):
        a = rng.randrange(40)
        texts.append(" ".join([*(f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))), *words[a : a + rng.randrange(25)], "short-item", "Orphan ITEM, words", *("z" for _ in range(rng.randrange(9)))]))
    texts += ["short item", "é short  ITEM ù", "shorter item"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit(3))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench, block_bytes=block_bytes, carry=["n_hit"]).collect()}
    named = [(a, b) for a, b in items if a is not None]
    for i, t in enumerate(texts):
        n, hits, _ = decontaminate.hits_plainly(t, [(a or "?", b) for a, b in items])
        ids = decontaminate.hits_plainly(t, named)[2]
        r = got[i]
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated, r.carried.n_hit) == (n, hits, ids, hits > 0 and 20 * hits >= n, 3)
        inside = [w for s in r.spans for w in decontaminate.words_of(t[s.start : s.end])]
        assert len(inside) == hits
    assert decontaminate.decontaminate(empty, bench).count() == 0
    some = spark.createDataFrame([("7", "tab new line two three"), ("8", "the the the"), ("8", "日本語 テキスト")], "item_id string, text string")
    held = sorted((r.doc_id or -1, r.n_hit, r.item_ids) for r in decontaminate.decontaminate(odd, some, block_bytes=block_bytes).collect())
    told = [(a, b) for a, b in ((r.item_id, r.text) for r in some.collect())]
    assert held == sorted((r.doc_id or -1, *decontaminate.hits_plainly(r.text, told)[1:]) for r in odd.collect())
    assert {r.n_hit for r in decontaminate.decontaminate(odd, spark.createDataFrame([], "item_id string, text string")).collect()} == {0}


@pytest.mark.parametrize("size", [1, 2, 5, 13])
def test_patterns_find_all_windows(size):
    rng = random.Random(size)
    words = lambda n, of=6: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    items = [(str(i), words(rng.randrange(30))) for i in range(12)] + [("x", "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0"), ("y", None)]
    found = decontaminate.Patterns(items, size)
    for _ in range(60):
        k = rng.randrange(12)
        text = f"{words(rng.randrange(9), 8)} {' '.join((items[k][1]).split()[rng.randrange(5) :])} {words(rng.randrange(20), 7)}"
        runs, ids = found.scan(decontaminate.words_of(text))
        n, hits, named = decontaminate.hits_plainly(text, items, size)
        assert (sum(b - a + 1 for a, b in runs), sorted(ids)) == (hits, named)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        columns = sorted(want.columns)
        want = Counter(map(tuple, want.select(*columns).fetchall()))
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got.select(*columns).collect())) == want


def test_licenses(spark, odd, empty):
    mit = next(t for a, t in licenses.KNOWN if a == "MIT")
    texts = [mit.upper(), "Copyright (c) 2020 Somebody\n\n" + mit.replace(", ", " ,  "), "Intro here.\n\n" + mit, "Released under the MIT Licence", "a\nReleased under the MIT license!\nb\r\nLicensed under CC BY-NC 4.0.", "We said: Released under the MIT License.", "© 2020 A\n(c) B\nAll rights reserved.", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit(1))
    got = {r.doc_id: (r.whole, r.licenses, r.n_notices) for r in licenses.scan_licenses(frame).collect()}
    assert got[0] == (["MIT"], ["MIT"], 1) and got[1][:2] == (["MIT"], ["MIT"])
    assert got[2] == ([], [], 0)  # the licence is two paragraphs long, and no part is a known text by itself
    assert got[3] == (["MIT"], ["MIT"], 1)
    assert got[4] == ([], ["CC-BY-NC-4.0", "MIT"], 2)
    assert all(got[i] == ([], [], 0) for i in (5, 6, 7, 8))
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0
    twice = licenses.scan_licenses(frame.unionByName(frame)).collect()
    assert Counter((r.doc_id, tuple(r.whole), tuple(r.licenses), r.n_notices) for r in twice) == Counter({(i, tuple(a), tuple(b), c): 2 for i, (a, b, c) in got.items()})
    none = spark.createDataFrame([(None, "x"), ("y", None), ("z", "!!")], "license string, text string")
    assert {r.n_notices for r in licenses.scan_licenses(odd, none).collect()} == {0}


def test_licenses_wrapped(spark):
    import textwrap

    texts = {}
    for width in range(30, 100):
        for a, known in licenses.KNOWN[:10]:
            if len(known) > 500:
                text = "\n\n".join(textwrap.fill(x, width) for x in known.split("\n\n"))
                texts[len(texts)] = (a, f"Copyright (c) 2020, Some Body <s@b.example>\nAll rights reserved.\n\n{text}")
    frame = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.whole for r in licenses.scan_licenses(frame).collect()} == {i: [a] for i, (a, _) in texts.items()}
    stated = ["Copyright (c) 2020 A", "COPYRIGHT 2020 A", "Copyright: 2020", "# Copyright The Authors", "copyright Andrew Noto", "Copyright Lawson", "COPYRIGHT ACME", "(c) 2020 A", "(C) Some Body", "© A", " * Copyright <year> <name>", "Copyright [yyyy] [name of copyright owner]", "Copyright by A", "Copyright Ö", "All rights reserved.", "(c) Copyright 2020 A"]
    spoken = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "COPYRIGHT", '"Copyright Holder" is whoever', "copyright law: that is", "copyright and related rights", "(c) You must retain, in the Source", "(c) under Patent Claims", "COPYRIGHT OWNER OR CONTRIBUTORS", "copyrighted by the Free", "Copyright Notice", "copyright the software, and", "COPYRIGHT AND THE"]
    rows = spark.createDataFrame([(x,) for x in stated + spoken], "x string")
    left = {r.x: r.y for r in rows.select("x", licenses.without_copyright(F.concat(F.lit("a\n"), "x", F.lit("\nb"))).alias("y")).collect()}
    assert left == {x: "a\nb" for x in stated} | {x: f"a\n{x}\nb" for x in spoken}
    with duckdb.connect() as db:
        for x, y in left.items():
            assert db.execute("SELECT regexp_replace(?, ?, '', 'g')", [f"a\n{x}\nb", licenses.COPYRIGHT]).fetchone()[0] == y


def test_licenses_entire_texts(spark):
    import pathlib

    folder = pathlib.Path(licenses.__file__).parent / "license_texts"
    read = lambda name: (folder / f"{name}.txt").read_text()
    bsd = read("BSD").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR").replace("The Regents", "2020 Some Body, the Regents")
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")]
    agpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."
    both = lambda x: [f"{x}-only", f"{x}-or-later"]
    cases = [
        (["Apache-2.0"], read("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2020 Some Body")),
        (["Apache-2.0"], read("Apache-2.0").partition("   APPENDIX")[0]),
        (["BSD-2-Clause"], "BSD 2-Clause License\n\n" + bsd.replace(third, "")),
        (["BSD-3-Clause"], bsd),
        (["BSD-3-Clause"], bsd.replace("the University", "the copyright holder")),
        (both("GPL-2.0"), read("GPL-2")),
        (both("GPL-3.0"), read("GPL-3").replace("https:", "http:")),
        (both("LGPL-2.1"), read("LGPL-2.1")),
        (both("LGPL-3.0"), read("LGPL-3")),
        (["MPL-2.0"], read("MPL-2.0")),
        (["CC0-1.0"], read("CC0-1.0")),
        (["Unlicense"], read("Unlicense").replace("\n", "\r\n")),
        (["AGPL-3.0-or-later"], agpl),
        (["AGPL-3.0-or-later"], "SPDX-License-Identifier: AGPL-3.0-or-later"),
        ([], read("GPL-3").replace("freedom", "fredom", 1)),
    ]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.whole for r in licenses.scan_licenses(frame).collect()} == {i: want for i, (want, _) in enumerate(cases)}


def test_license_plan_is_native(spark, docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [0, 1, 23, 24, 25, 1000])
def test_shard(spark, rows):
    frame = spark.range(rows).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é"), F.col("id").cast("int") % 5)).alias("text"), F.lit(1).alias("slot"))
    got = shard.shard_rows(frame).collect()
    assert len(got) == rows
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        text = ("é" * (r.doc_id % 5) if r.doc_id % 7 else "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    sizes = [len(per[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shard_of_odd_rows(spark, odd):
    """Null ids and texts, repeated rows and very long texts are rows like others; the same rows give the same shards."""
    long = spark.createDataFrame([(90, "é" * 300_000, None, None, 0, "", "")], SCHEMA)
    frame = odd.unionByName(long).coalesce(1)
    rows = shard.shard_rows(frame, shards=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    again = shard.shard_rows(frame, shards=3).collect()
    key = lambda r: (r.shard, r.slot, r["size"], r.text_crc32)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_shard_matrix_and_uniformity(spark, monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 40).tolist()
    sizes = shard.shard_sizes(sum(counts), 24)
    matrix = shard.communication_matrix(counts, sizes, 1)
    assert (matrix.sum(1) == counts).all() and (matrix.sum(0) == sizes).all()
    big = shard._line(np.random.default_rng(0), np.array([2 * 10**9, 10**9]), 30_000)
    assert big.sum() == 30_000 and abs(big[0] - 20_000) < 500
    rng, monkey = np.random.default_rng(5), [(40, 60, 30), (5, 95, 50), (300, 700, 400), (1, 99, 3)]
    for good, bad, n in monkey:  # by rejection, against numpy's own
        with monkeypatch.context() as m:
            m.setattr(shard, "NUMPY_BOUND", 0)
            drawn = [shard.hypergeometric(rng, good, bad, n) for _ in range(4000)]
        own = rng.hypergeometric(good, bad, n, 200_000)
        assert abs(np.mean(drawn) - own.mean()) < 5 * own.std() / 4000**0.5 and abs(np.std(drawn) - own.std()) < 0.06 * own.std() + 0.01
        low = np.bincount(drawn, minlength=n + 1)[: n + 1] / 4000 - np.bincount(own, minlength=n + 1)[: n + 1] / 200_000
        assert np.abs(low).max() < 0.035
    many = shard.communication_matrix([5 * 10**9] * 20, shard.shard_sizes(10**11, 24), 3)
    assert (many.sum(1) == 5 * 10**9).all() and (many.sum(0) == shard.shard_sizes(10**11, 24)).all()
    monkeypatch.setattr(shard, "ROWS_PER_PART", 10)  # many partitions and blocks
    got = shard.shard_rows(spark.range(2400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")), seed=4).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append((r.slot, r.doc_id))
    assert all(sorted(s for s, _ in v) == list(range(100)) for v in per.values())
    first = [d for v in per.values() for s, d in v if s < 50]
    assert abs(np.mean(first) - 1199.5) < 100  # early slots hold rows from everywhere
    assert abs(np.mean([d for _, d in per[0]]) - 1199.5) < 300


def test_quality(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    held = {r.doc_id: r.keep for r in quality.score_quality(docs, labels.filter(half == 0)).collect()}
    assert len(held) == docs.count()
    told = [(held[r.doc_id], r.quality) for r in labels.filter(half == 1).collect()]
    assert sum(k == bool(q) for k, q in told) / len(told) > 0.95  # held-out accuracy
    assert sum(k for k, q in told if q) / sum(q for _, q in told) > 0.98  # good documents are kept
    assert quality.score_quality(odd, labels).count() == odd.count()
    assert quality.score_quality(empty, labels).count() == 0
    nothing = quality.score_quality(odd, labels.filter("quality = 1"), carry=["shard"]).collect()
    assert all(r.keep for r in nothing) and "carried" in nothing[0]
    broken = spark.createDataFrame([(None, 1), (1, None), (99999, 0)], "doc_id long, quality int")
    assert quality.score_quality(odd, broken).count() == odd.count()


def test_quality_against_plain_sums(spark):
    """Shares of hosts and paths against sums in Python; sparse sites lie nearer to their prior."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        host = rng.choice("aaab")
        good = rng.random() < (0.9 if host == "a" else 0.2)
        rows.append((i, " ".join(rng.choice(["house", "tree", "river.", "a"]) if good else "| x" for _ in range(30)), rng.choice(["p", "q"]), host))
        labels.append((i, int(good)))
    rows.append((600, "house tree river. a house tree", "p", "lonely"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i].keep == bool(q) for i, q in labels)
    a, b, lonely = (next(got[r[0]].host_prior for r in rows if r[3] == h) for h in ("a", "b", "lonely"))
    share = lambda h: np.mean([q for (i, q), r in zip(labels, rows) if r[3] == h])
    assert abs(a - share("a")) < 0.05 and abs(b - share("b")) < 0.1 and b < lonely < 1
    world = np.mean([q for _, q in labels])
    assert abs(lonely - world) < abs(1 - world)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_quality_against_plain_posteriors(spark, folder):
    """The same fit, and every posterior from sums in Python, by the formulas of the docstring."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_classifier(docs, labels)
    rows = [(r.doc_id, r.source, r.lang, float(model.evidence(np.array([quality.text_stats(r.text)]))[0])) for r in docs.collect()]
    logit = lambda p: math.log(p / (1 - p))
    odds = lambda x: 1 / (1 + math.exp(-x))
    base = odds(model.prior)
    sites = {"host": defaultdict(list), "path": defaultdict(list)}
    for _, host, path, e in rows:
        sites["host"][host].append(odds(e + model.prior))
        sites["path"][host, path].append(odds(e + model.prior))
    world = (sum(map(sum, sites["host"].values())) + base) / (len(rows) + 1)

    def strength(groups, prior):
        n = sum(map(len, groups.values()))
        between = sum(len(g) * (np.mean(g) - prior(k)) ** 2 for k, g in groups.items())
        chance = sum(len(g) * np.var(g) for g in groups.values()) / n
        var = sum(len(g) * prior(k) * (1 - prior(k)) for k, g in groups.items()) / n
        tau2 = max((between - len(groups) * chance) / n, 1e-6)
        return min(max(var / tau2 - 1, 1.0), 1e6)

    k = strength(sites["host"], lambda _: world)
    hosts = {h: (sum(g) + k * world) / (len(g) + k) for h, g in sites["host"].items()}
    k = strength(sites["path"], lambda key: hosts[key[0]])
    paths = {key: (sum(g) + k * hosts[key[0]]) / (len(g) + k) for key, g in sites["path"].items()}
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    for doc_id, host, path, e in rows:
        r, inner = got[doc_id], min(max(paths[host, path], 1e-6), 1 - 1e-6)
        want = (e, hosts[host], paths[host, path], odds(e + logit(inner)))
        assert np.allclose((r.evidence, r.host_prior, r.path_prior, r.posterior), want, rtol=1e-6, atol=1e-9) and r.keep == (r.posterior >= 0.5)


def test_quality_of_odd_rows(spark, odd):
    """Null, blank and very long texts: those without words have equal evidence; ties at the threshold are kept."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 12)], "doc_id long, quality int")
    long = spark.createDataFrame([(50, "word " * 200_000, None, None, 0, "", ""), (51, None, "", "", 0, "", "")], SCHEMA)
    rows = quality.score_quality(odd.unionByName(long), labels).collect()
    assert len(rows) == odd.count() + 2 and len({r.evidence for r in rows if r.doc_id in (0, 1, 51)}) == 1
    assert len({(r.evidence, r.posterior) for r in rows if r.doc_id == 4}) <= 2  # one row of three has another source
    assert all(math.isfinite(r.posterior) and r.keep == (r.posterior >= 0.5) for r in rows)
    edge = next(r for r in rows if r.doc_id == 50).posterior
    assert next(r for r in quality.score_quality(odd.unionByName(long), labels, threshold=edge).collect() if r.doc_id == 50).keep


def plain_top(rows, k, every):
    ok = [(u, i, [math.floor(256 * float(x)) for x in v]) for u, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, i, q in ok:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), 2**62 if j is None else j) for w, j, c in ok if w != u and len(c) == len(q))[:k]
            out += [(i, r, None if j == 2**62 else j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found, 1)]
    return Counter(out)


def test_topk(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(50, [1.0, 1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0, 9.0]), (400, None), (401, [1.0, None, 1.0, 1.0]), (450, [float("nan"), 1.0, 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0, 1.0]), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (600, []), (650, [1e9, 3e9, 1e8, 1.0]), (651, [2e9, 1e9, 1.0, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).repartition(5)
    want = plain_top(rows, 5, 50)
    got = lambda **a: Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, **a).collect())
    assert got() == want
    monkeypatch.setattr(topk, "TILE", 16)
    assert got(group_bytes=100) == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_topk_of_many_queries_is_one_plan(spark):
    """Over a hundred groups of queries: dealt to tiles by one plan, without a loop on the driver."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, every=1, group_bytes=64 * 5)  # 500 queries in 100 groups of about 5
    assert found._jdf.queryExecution().toString().count("Union") == 0
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, every=1).collect())


def plain_losses(texts, target, order, mu):
    counts = [defaultdict(int), defaultdict(int)]
    own = [defaultdict(int) for _ in texts]
    tokens = [0, 0]
    for t, f, mine in zip(texts, target, own):
        b = b"\0" * (order - 1) + t + b"\0"
        for k in range(2 if f else 1):
            tokens[k] += len(t) + 1
        for i in range(order - 1, len(b)):
            for k in range(1, order + 1):
                for c in [*(counts if f else counts[:1]), mine]:
                    c["g", b[i - k + 1 : i + 1]] += 1
                    c["h", k, b[i - k + 1 : i]] += 1
    ratio, out = tokens[0] / tokens[1] if tokens[1] else 1, []
    for t, f, mine in zip(texts, target, own):
        b, sums = b"\0" * (order - 1) + t + b"\0", []
        for c, r, less in ((counts[0], ratio, {}), (counts[1], 1, mine if f else {})):
            loss = 0
            for i in range(order - 1, len(b)):
                p = 1 / 256
                for k in range(1, order + 1):
                    n = lambda key: (c[key] - less.get(key, 0)) / r
                    p = (n(("g", b[i - k + 1 : i + 1])) + mu * p) / (n(("h", k, b[i - k + 1 : i])) + mu)
                loss -= math.log2(p)
            sums.append(loss / (len(t) + 1))
        out.append((sums[1], sums[0]))
    return out


@pytest.mark.parametrize("order,part_bytes", [(6, 10**6), (5, 10**6), (3, 40), (2, 60), (1, 100)])
def test_lm_score(spark, empty, order, part_bytes):
    texts = ["the cat sat", "the cat ran", "zzz qqq", "", None, "naïve cat", "the cat sat", "x" * 300]
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = [*enumerate(texts), (None, "the cat sat"), (1, "the cat ran"), (1, "the cat ran")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("target", F.lit("x")).withColumn("row", F.lit("y"))
    got = lm_score.score_documents(frame, labels, order=order, part_bytes=part_bytes).collect()
    want = plain_losses([(t or "").encode() for _, t in rows], [i in (0, 1) for i, _ in rows], order, 4.0)
    plain = sorted((-1 if i is None else i, len((x or "").encode()) + 1, t, b) for (i, x), (t, b) in zip(rows, want))
    assert len(got) == len(rows)
    for r, (i, n, t, b) in zip(sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens)), plain):
        assert (-1 if r.doc_id is None else r.doc_id, r.n_tokens) == (i, n)
        assert math.isclose(r.loss_target, t, rel_tol=1e-9) and math.isclose(r.loss_background, b, rel_tol=1e-9)
        assert math.isclose(r.score, t - b, rel_tol=1e-6, abs_tol=1e-9)
    assert lm_score.score_documents(empty, labels).count() == 0


def test_lm_score_of_held_out_documents(spark):
    """A label of its own doesn't move a document's score."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropDuplicates(["doc_id"])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    both = {r.doc_id: r.score for r in lm_score.score_documents(docs, labels).collect()}
    some = {r.doc_id: r.score for r in lm_score.score_documents(docs, labels.filter(half)).collect()}
    good = {r.doc_id: r.held for r in labels.filter("quality = 1").select("doc_id", half.alias("held")).collect()}
    own, out = [some[d] for d, h in good.items() if h], [some[d] for d, h in good.items() if not h]
    assert abs(np.mean(own) - np.mean(out)) < 0.1
    bad = [both[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert np.mean([both[d] for d in good]) < np.mean(bad)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>c</p> -->
<article class="post"><h1>Head &amp; line</h1><p><b>First   par.<br>next<p>Second &eacute; &#8212; <i>in</i>line</p><div class="ad">Buy</div><ul><li>one<li>two</ul>
<aside>See also</aside><form><p>Name</p></form><section id="comments"><p>Nice!</p></section><p>Last &lt;b&gt;</p></article><footer>&copy; x</footer></body></html>"""


def test_extract():
    assert html_extract.extract(PAGE) == "Head & line\nFirst par. next\nSecond é — inline\none\ntwo\nLast <b>"
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("plain text &amp; more") == "plain text & more"
    assert html_extract.extract("<p>a<script>never ends <p>b") == "a"
    assert html_extract.extract("<p>1 < 2 and 3 > 2</p><p title='a>b'>x</p><!-- open") == "1 < 2 and 3 > 2\nx"
    assert html_extract.extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert html_extract.extract("<main><p>m</p></main><p>out</p>") == "m"
    assert html_extract.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_extract_keeps_what_holds_the_text():
    story = "<h1>Title</h1><p>A story that is long enough to be the text of the page.</p>"
    want = "Title\nA story that is long enough to be the text of the page."
    for wrap in ('<div class="content no-sidebar">%s</div>', '<div class="layout has-sidebar">%s</div>', '<div id="header-fixed-page">%s</div>', '<div class="post tags-news">%s</div>', '<form id="aspnetForm">%s</form>', '<div class="sidebar">%s</div>'):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", story):
            assert html_extract.extract("<body><nav>Menu</nav>" + wrap % inner + "</body>") == want
    assert html_extract.extract(f'<article>{story}<section class="legal-analysis"><p>Law</p></section><div class="social-science">Science</div></article>') == want + "\nLaw\nScience"
    assert html_extract.extract(f'<article>{story}<div class="related-posts">More</div><div class="cookieNotice">Cookies</div></article>') == want
    assert html_extract.extract(f'<article><div class="legal">{story}</div></article>') == want
    assert html_extract.extract(f'<article><p>Short</p></article><div class="ad">{story}</div><div id="comments">{story}</div>') == "Short"
    assert html_extract.extract(f'<article>{story}<section id="comments">{story * 3}</section></article>') == want


def test_extract_keeps_headings_named_by_their_words():
    page = '<article><h2 id="related-work">Related work</h2><p>One.</p><h2 id="search">Search</h2><p class="legal-theory">Two.</p><p id="comments-on">Three.</p><p class="ad">Buy</p></article>'
    assert html_extract.extract(page) == "Related work\nOne.\nSearch\nTwo.\nThree."


def plain_templates(rows, min_pages=html_extract.MIN_PAGES, min_share=html_extract.MIN_SHARE):
    """Keys of template parts by counting in dictionaries."""
    seen, pages = defaultdict(set), defaultdict(set)
    for url, page in rows:
        if page:
            host, root = html_extract.host_of(url), html_extract.parse(page)
            digest = html_extract.xxhash.xxh3_64_intdigest(page) - 2**63
            pages[host].add(digest)
            for _, h, container, at in html_extract._parts(root, html_extract._content(root), digest):
                seen[host, h, container].add(at)
    return {html_extract._key(host, h, c) for (host, h, c), at in seen.items() if len(at) >= min_pages and (c or len(at) >= min_share * len(pages[host]))}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_templates_against_plain_counts(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    rows = [(r.url, r.html) for r in pages.collect()]
    want = plain_templates(rows)
    assert {r.key for r in html_extract.template_keys(pages.select("page_id", "url", "html")).collect()} == want
    got = Counter((r.page_id, r.text) for r in html_extract.extract_pages(pages).collect())
    assert got == Counter((r.page_id, html_extract.extract(r.html, html_extract.host_of(r.url), want)) for r in pages.collect())


def test_templates_change_pages_with_articles(spark):
    """What recurs in the articles of a host goes by the counts alone: without them it stays."""
    box = "<div class=letter>Get our letter<p>It comes each week</p></div>"
    rows = [(i, "http://a.example/", f"<article><h1>Head {i}</h1><p>Story {i} of {i * i} words</p>{box}</article>") for i in range(20)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in html_extract.extract_pages(pages).collect())
    assert got == Counter({(i, f"Head {i}\nStory {i} of {i * i} words"): 2 for i in range(20)})  # repeated rows stay rows
    assert html_extract.extract(rows[0][2]) == "Head 0\nStory 0 of 0 words\nGet our letter\nIt comes each week"


def test_extract_main_beside_teasers():
    text = "<div><p>" + "The main text of the page. " * 8 + "</p></div>"
    want = ("The main text of the page. " * 8).strip()
    cards = "".join(f'<article class="card"><h2>Teaser {i}</h2><p>Read about {i}</p></article>' for i in range(6))
    for many in (cards, cards.replace(' class="card"', ""), '<article class="card">One</article>', '<article><a href="/x">Read more</a></article>'):
        assert html_extract.extract(f"<body><main>{text}</main>{many}</body>") == want
        assert html_extract.extract(f"<body><main>{text}{many}</main></body>") == want
        assert html_extract.extract(f"<body>{text}{many}</body>") == want
    assert html_extract.extract(f"<main><p>Intro</p><article>{text}</article><article class=card>One</article></main>") == want
    assert html_extract.extract(f"<main><h1>News</h1>{cards}</main>").count("Teaser") == 6  # a list of articles is all the text there is
    assert html_extract.extract(f"<main><article><p>Story</p></article>{text}</main>") == "Story\n" + want  # nothing says that it's a teaser
    assert html_extract.extract(f"<main><p>m</p></main><article>{text}</article>") == want
    assert html_extract.extract(f"<article><main>{text}</main></article>") == want


@pytest.mark.parametrize("most", [10**6, 0])
def test_site_templates(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", most)
    page = lambda i: f"<body><div class=box>Welcome to our site<p>Join us</p></div><div><p>Story {i} about {i * i}</p><p>Same line</p></div></body>"
    rows = [(i, "http://A.example/x", page(i)) for i in range(20)] + [(50, "http://b.example/", page(50)), (51, None, None), (52, "nonsense", "")]
    rows += [(60 + i, "http://c.example/", "<body><div>Mirrored text</div></body>") for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract_pages(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i} about {i * i}" for i in range(20))  # "Same line" recurs as well
    assert got[50] == "Welcome to our site\nJoin us\nStory 50 about 2500\nSame line"
    assert got[51] == got[52] == ""
    assert {got[60 + i] for i in range(30)} == {"Mirrored text"}  # copies of one page are no template
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_site_templates_in_articles(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", most)
    box = "<div class=letter>Get our letter<p>It comes each week</p></div>"
    page = lambda i, tag, inner: f"<body><{tag}><h2>Head {i}</h2><p>Story {i} about {i * i} things</p>{inner}<p>Same line</p><ul><li>Item {i}</li><li>Same item</li></ul></{tag}><p>Out {i}</p></body>"
    text = lambda i: f"Head {i}\nStory {i} about {i * i} things\nSame line\nItem {i}\nSame item"
    rows = [(i, "http://a.example/", page(i, "article", box if i < 10 else "")) for i in range(200)]  # a twentieth of the host
    rows += [(300 + i, "http://b.example/", page(i, "main", box)) for i in range(20)]
    rows += [(400 + i, "http://c.example/", page(i, "article", box)) for i in range(3)]
    body = "<div class=body><p>A story that is told again and again, on many pages of this host.</p></div>"
    rows += [(500 + i, "http://d.example/", f"<nav>{i}</nav><article><h1>One and the same</h1>{body}</article>") for i in range(20)]
    rows += [(600 + i, "http://e.example/", f"<article><h1>One and the same</h1>{body}<p>Views: {i}</p></article>") for i in range(20)]
    rows += [(700 + i, "http://f.example/", f"<article><p>Brief {i}</p>{box}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text(i) for i in range(200)) and all(got[300 + i] == text(i) for i in range(20))
    assert all("Get our letter\nIt comes each week" in got[400 + i] for i in range(3))
    assert all("told again" in got[500 + i] and "told again" in got[600 + i] and got[700 + i] == f"Brief {i}" for i in range(20))


def test_op9_keeps_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html_extract(spark, sf).collect():
        inner = regex.search(r"<article>(.*)</article>", pages[r.page_id], regex.S)[1]
        import html

        parts = [" ".join(html.unescape(regex.sub(r"<[^>]*>", " ", p)).split()) for p in regex.split(r"<p>|</p>|</h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def groups_of(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def near_copies(seed, n=60, words=80):
    rng, texts = random.Random(seed), []
    for g in range(n):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy[: rng.choice([words, words, words - 3])]))
    return texts


@pytest.mark.parametrize("small", [{}, {"limit": 3, "depth": 2, "block": 2}, {"limit": 1, "depth": 1, "block_grams": 200}])
def test_jaccard_join(spark, small):
    texts = near_copies(3) + [None, "", "...", "one two", "One, two!", "one two three", "a b c d e", "a b c d e f"]
    texts += texts[:7]
    pairs = jaccard_join.links_plainly(texts)
    links, roots = Counter(x for p in pairs for x in p), groups_of(pairs, len(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit("clash"))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame, **small).collect()}
    assert len(got) == len(texts)
    found = sum(got[i].n_links for i in range(len(texts))) / max(1, sum(links.values()))
    assert 0.999 <= found <= 1
    assert [got[i].class_id for i in range(len(texts))] == roots
    assert [got[i].is_first for i in range(len(texts))] == [r == i for i, r in enumerate(roots)]


def test_jaccard_join_of_unequal_sizes(spark):
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[:204]), " ".join(words[:484]), " ".join(words[1000:1104]), " ".join(words[1000:1204])]  # 200 of 480 5-grams, 100 of 200
    assert jaccard_join.links_plainly(texts, similarity=0.4) == [(0, 1), (2, 3)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.4).collect()
    assert [(r.class_id, r.n_links) for r in sorted(got, key=lambda r: r.doc_id)] == [(0, 1), (0, 1), (2, 1), (2, 1)]
    with pytest.raises(ValueError, match="recall"):
        jaccard_join.runs_for(0.999, 0.01, 64, 1.5, 0)


def test_jaccard_join_of_a_crowd(spark):
    """A group of near copies that fills several blocks, beside exact copies and common lines: links are those of brute force."""
    rng, words = random.Random(4), [f"w{i}" for i in range(120)]
    texts = [" ".join(words)] * 5
    for _ in range(150):
        copy = list(words)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(["common", "line", "of", "all", "texts", "here", *(f"x{rng.randrange(10**6)}" for _ in range(20))]) for _ in range(60)]
    pairs = jaccard_join.links_plainly(texts)
    links, roots = Counter(x for p in pairs for x in p), groups_of(pairs, len(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small in ({"limit": 8, "block": 16}, {"limit": 8, "block": 16, "depth": 1}, {"block_grams": 3000}):
        got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame, **small).collect()}
        assert [got[i].n_links for i in range(len(texts))] == [links[i] for i in range(len(texts))]
        assert [got[i].class_id for i in range(len(texts))] == roots


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    for dense in (2, 6, 100):
        monkeypatch.setattr(jaccard_join, "DENSE", dense)
        both = jaccard_join.overlaps(sets, None)
        assert all(both[i, j] == np.intersect1d(sets[i], sets[j]).size for i in range(30) for j in range(i + 1, 30))
        cross = jaccard_join.overlaps(sets[:10], sets[10:])
        assert all(cross[i, j] == np.intersect1d(sets[i], sets[10 + j]).size for i in range(10) for j in range(20))


@pytest.mark.parametrize("similarity", [0.4, 0.6, 0.9])
def test_jaccard_join_at_other_similarities(spark, similarity):
    texts = near_copies(9, 25, 40)
    want = jaccard_join.links_plainly(texts, similarity=similarity)
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=similarity).collect()
    assert 0.98 * 2 * len(want) <= sum(r.n_links for r in got) <= 2 * len(want)


def test_jaccard_join_odd_rows(spark, odd, empty):
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert [r.n_links for r in got if r.doc_id == 4] == [2, 2, 2]
    assert [(r.class_id, r.is_first) for r in got if r.doc_id is None] == [(None, True)]
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id in (0, 1, 2, 3))
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_sketches_go_before_texts_are_read(spark, tmp_path, monkeypatch):
    """When candidates are known, no table of sketches is left in the shared folder, and results are those of all pairs."""
    import pyarrow.parquet as pq

    from quadrille.llm import jaccard_join as jj

    seen, links, written = [], jj._links, jj.written
    places = []
    monkeypatch.setattr(jj, "written", lambda frame: (places.append((out := written(frame)).stored_at), out)[1])

    def watched(*args):
        import pathlib

        folders = [pathlib.Path(p.removeprefix("file:")) for p in places]
        seen.extend(pq.read_schema(f).names for d in folders if d.exists() for f in d.glob("*.parquet"))
        return links(*args)

    monkeypatch.setattr(jj, "_links", watched)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}
    assert seen and not any("tokens" in names or "short" in names for names in seen)
