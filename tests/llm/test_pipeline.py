"""Every stage of the pipeline, on what the one before it left, against brute force; and the whole run."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_corpus_results import repeated
from test_similar import kept_by_brute_force

import corpus_pipeline
from tidemark.llm import common, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "substring", "mixing", "packing"]
    docs = common.read(spark, SF, "documents")
    names, seen = docs.columns, {}

    def run(name, before):
        out = stages[name](spark, before, SF)
        assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        return seen[name]

    # toxicity: what the scores of the same documents say
    kept = run("toxicity", docs)
    scored = {r.doc_id: r.predicted for r in toxicity.toxic_documents(docs, common.read(spark, SF, "labels")).collect()}
    assert Counter(plain(kept)) == Counter(r for r in plain(docs) if not scored[r[names.index("doc_id")]])

    # near-duplicates: all pairs of texts
    before, kept = kept, run("simhash", kept)
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
    assert set(plain(kept)) <= set(plain(before)) and kept.count() < before.count()

    # substrings: all windows
    before, kept = kept, run("substring", kept)
    want = {d: sha for d, _, _, sha in repeated([(r.doc_id, r.text) for r in before.collect()])}
    lost = {d for d, _, gone, _ in repeated([(r.doc_id, r.text) for r in before.collect()]) if gone}
    assert {d: sha for d, _, _, sha in repeated([(r.doc_id, r.text) for r in kept.collect()], w=10**9)} == want
    old = {r.doc_id: r for r in before.collect()}
    for r in kept.collect():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)
        assert r.text == old[r.doc_id].text or r.doc_id in lost

    # mixing: the SQL of the operator over this stage's input
    before, kept = kept, run("mixing", kept)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/substring/*.parquet'")
    taken = con.execute(mixing.ORACLE).df()
    sizes = Counter({r.doc_id: len((r.text or "").split()) for r in before.collect()})
    assert all(r.size == sizes[r.doc_id] for r in taken.itertuples())
    copies = Counter(r.doc_id for r in kept.collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in taken.itertuples())
    assert set(plain(kept)) <= set(plain(before))

    # packing: the tokenizer itself, and no gap or overlap
    t = Tokenizer.from_file(queries.tokenizer_path())
    pieces, ids_of = Counter(), {}
    for r in kept.collect():
        if r.doc_id not in ids_of:
            ids_of[r.doc_id] = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
    packed = stages["packing"](spark, kept, SF).collect()
    starts: dict = {}
    for r in packed:
        own = ids_of[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids_of[r.doc_id])
        starts.setdefault(r.doc_id, Counter()).update(range(r.start, r.start + r.length))
        pieces[r.sequence_id, r.offset] += 1
    assert {d: set(c.values()) for d, c in starts.items()} == {d: {copies[d]} for d in ids_of} and all(len(starts[d]) == len(ids_of[d]) for d in ids_of)
    assert set(pieces.values()) == {1}
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096

    # the whole run gives what the stages give one by one
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, corpus_pipeline.run(spark, SF).collect())) == Counter(map(piece, packed))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and columns of clashing names."""
    rows = [(1, "plain words here.", "en", "a", 1, 0), (1, "plain words here.", "en", "a", 1, 0), (2, None, None, None, None, None), (3, "", "en", "b", 0, 0), (None, "no id at all.", "en", None, 1, 1), (None, None, None, None, None, None), (5, " \t", "de", "a", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k0 int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the texts without words, which are alike, the first may stay
    assert {r.doc_id for r in got} <= {1, 2, None} and all(r.length == 1 for r in got if r.doc_id == 2)
