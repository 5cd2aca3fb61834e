"""Crowds: very many rows of one key."""

import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, substring


def test_many_documents_without_an_id(spark):
    """100,000 texts without an id: only those that repeat lose words, and those alone."""
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("w"), (F.col("id") * 40 + k).cast("string")))
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.array_join(words, " ").alias("text"))
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(36)), lambda k: F.concat(F.lit("same"), k.cast("string"))), " "), F.lit(" tail"), F.col("id").cast("string")).alias("text")))
    got = {(r.n_words, r.n_removed): r.n for r in substring.digests(docs).groupBy("n_words", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {(40, 0): 100_000, (38, 37): 3}


def test_texts_with_one_id_and_equal_short_hashes(spark):
    """Texts whose hashes agree in 27 bits, and rows with one id, don't share what they lose."""
    repeat = " ".join(f"r{k}" for k in range(40))
    own = lambda i: " ".join(f"o{i}x{k}" for k in range(60))
    seen: dict = {}
    for i in itertools.count():
        tag = xxhash.xxh64_intdigest(own(i).encode(), 7) >> 37
        if tag in seen:
            break
        seen[tag] = i
    a, b = own(seen[tag]), own(i)
    rows = [(None, a), (None, b), (None, repeat), (7, repeat + " " + a.replace("o", "p")), (7, b.replace("o", "q"))]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 60, 0), (None, 60, 0), (None, 40, 40), (7, 100, 40), (7, 60, 0)], key=str)


def joined(fps, distance):
    """The smallest that each reaches, by all pairs."""
    root = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count((fps ^ x).view(np.uint64)) <= distance) for x in fps]
    while True:
        new = np.array([root[n].min() for n in near])
        new = new[new]
        if (new == root).all():
            return dict(zip(fps.tolist(), fps[root].tolist()))
        root = new


def test_crowded_postings_are_refined(spark):
    rng = np.random.default_rng(5)
    crowd = np.unique(rng.integers(0, 1 << 15, 3000) << 22 | 0x7F)  # all in the postings of the other bytes
    fps = np.sort(np.unique(np.concatenate([crowd, rng.integers(-(1 << 62), 1 << 62, 500)])).astype(np.int64))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {int(x): int(x) for x in fps} | {r.node: r.root for r in simhash.components(simhash.links(df, 2)).collect()}
    assert got == joined(fps, 2)


def test_a_component_of_a_hundred_thousand(spark):
    """Half of them on one hub, half in chains of chains."""
    n = 100_000
    hub = spark.range(1, n // 2).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    chain = spark.range(n // 2, n).select(F.col("id").alias("u"), (F.col("id") - F.when(F.col("id") % 100 == 0, 100).otherwise(1)).alias("v"))
    got = simhash.components(hub.unionByName(chain)).groupBy("root").count().collect()
    assert {r.root for r in got} == {0} and sum(r["count"] for r in got) == n - 1


def test_merging_is_joining_anew(spark):
    rng = np.random.default_rng(6)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (250, 2))]
    frame = lambda es: spark.createDataFrame([e for e in es if e[0] != e[1]], "u long, v long")
    whole = sorted(map(tuple, simhash.components(frame(edges)).collect()))
    some = simhash.components(frame(edges[:120]))
    assert sorted(map(tuple, simhash.merged(simhash.merged(some, frame(edges[120:])), frame(edges[:50])).collect())) == whole
