"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, licenses, maxscore, media, mixing, packing, queries, resample, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, _id string, score string, copies int"
LABELS = "doc_id long, quality int, toxic int, text string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs(spark, empty=False):
    rows = [] if empty else [
        (1, "plain words here.", "en", "a", 1, 0, "x", "s", 1), (1, "plain words here.", "en", "a", 1, 0, "x", "s", 1), (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 0, "", "", 0), (None, "no id at all.", "en", None, 1, 1, "1", "1", 1), (None, None, None, None, None, None, None, None, None), (4, LONG, "en", "c", 5, 5, "y", "t", 2), (5, "  \t\n ", "de", "a", 3, 3, "z", "u", 3), (6, "   x\x00y \x1f", "en", "a", 1, 1, "", "", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, 1, 0, "t"), (2, 0, 1, "t"), (None, 1, 1, None), (3, None, None, "x"), (4, 1, 1, "y"), (4, 1, 1, "y")], LABELS)


OPS = {
    "op1": lambda d, l: toxicity.toxic_documents(d, l),
    "reject": lambda d, l: toxicity.reject(d, l),
    "op2": lambda d, l: substring.digests(d),
    "removed": lambda d, l: substring.removed(d),
    "op3": lambda d, l: licenses.scan(d),
    "op4": lambda d, l: resample.sample(d, l),
    "op5": lambda d, l: packing.pack(d, queries.tokenizer_path()),
    "op6": lambda d, l: media.digests(d),
    "op7": lambda d, l: simhash.near_duplicates(d),
    "keep_one": lambda d, l: simhash.keep_one(d),
    "op10": lambda d, l: mixing.mix(d),
    "emit": lambda d, l: mixing.emit(d),
    "containers": lambda d, l: media.media_columns(media.containers(d).withColumn("found", F.lit(1))),
    "format_turns": lambda d, l: chat.format_turns(d.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", "score")).withColumnRenamed("conv_id", "doc_id"),
}


def test_ids_that_are_no_numbers_are_null(spark):
    d = docs(spark).where("doc_id < 4").withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    for name in ("op1", "op2", "op4", "op5", "op6", "op7", "op10"):
        rows = OPS[name](d, labels(spark)).collect()
        assert rows and all(r.doc_id is None for r in rows), name


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, name):
    rows = OPS[name](docs(spark), labels(spark)).collect()
    if name == "containers":
        assert all(r.tracks[0].codec == "raw " for r in rows)
    if name == "format_turns":
        assert len(rows) == 9 and {r.text for r in rows if r.doc_id == 2} == {""}
    if name in ("op1", "op2", "op3", "op6", "op7", "op10", "removed"):
        assert len(rows) == 9 and sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6]
    by = {r.doc_id: r for r in rows}
    if name == "op1":
        assert all(0 <= r.score <= 1 for r in rows) and not by[None].held_out
    if name == "op2":
        assert (by[2].n_words, by[3].n_words, by[5].n_words, by[4].n_words, by[4].n_removed) == (0, 0, 0, 60_000, 60_000)
    if name == "op5":
        assert {r.doc_id: r.doc_tokens for r in rows}[2] == 1 and sum(r.doc_id == 1 for r in rows) == 2
        spans: dict = {}
        for r in rows:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 4096
    if name == "op6":
        assert (by[2].n_bytes, by[2].payload_bytes) == (0, 64) and by[2].media_sha256 == by[3].media_sha256
    if name == "op7":
        assert by[2].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[5].component_id == 2
        assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    if name == "keep_one":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 4, 6] and rows[0].asDict().keys() == set(docs(spark).columns)
    if name == "op10":
        assert by[2].size == by[3].size == 0 and all(r.taken <= 2 * r.size for r in rows)
    if name in ("reject", "removed", "emit"):
        assert set(rows[0].asDict()) == set(docs(spark).columns)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](docs(spark, True), labels(spark, True)).count() == 0


def test_without_labels(spark):
    assert {round(r.score, 6) for r in OPS["op1"](docs(spark), labels(spark, True)).collect()} == {0.25}
    assert OPS["op4"](docs(spark), labels(spark, True)).count() >= 4


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf]), (6, [1.0, None]), (None, [0.5, 0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") % 100 == 0, k=4).orderBy("query_id", "rank").collect()]
    u = 1024 * 1024
    assert got[:4] == [(0, 1, 7, 5 * u), (0, 2, 7, 5 * u), (0, 3, None, 3 * u // 2), (0, 4, 1, u)]
    # an empty vector scores 0 and takes part
    assert [g[2:] for g in got[4:]] == [(3, 0), (None, -u // 2), (0, -u), (1, -u)]
    assert maxscore.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert maxscore.top_k(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_do_not_crash(spark):
    df = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 2.0])], "vec_id long, embedding array<double>")
    r = maxscore.top_k(df, F.col("vec_id") == 0).first()
    exact = int(1024 * 1e8) ** 2 + 1024 * 2048
    assert r.score == (exact + (1 << 63)) % (1 << 64) - (1 << 63)


def test_chat_edges(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 1, None, "x"), (2, 1, "to<ol[", "[/ROLE] \\ <\\s> "), (2, None, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert {k: (v.n_turns, v.loss_chars) for k, v in got.items()} == {1: (3, 0), None: (1, 0), 2: (2, 4)}
    assert chat.digests(df.where("false")).count() == 0


def test_pipeline_keeps_columns(spark, tmp_path):
    d = spark.createDataFrame([(i, f"doc {i} " + " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(80)), "en", f"s{i % 3}", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.unionByName(d.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 100))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, True).write.parquet(str(tmp_path / "labels.parquet"))
    now = d
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, str(tmp_path))
        assert now.columns == d.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            assert now.count() == 63  # without labels nothing is rejected
        if name == "simhash":
            assert sorted(r.doc_id for r in now.collect()) == list(range(60))
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count() > 0


def test_many_sources_and_copies(spark, monkeypatch):
    """The ways beyond the checked sizes give what the plain ones give."""
    d = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    plain = sorted(map(tuple, mixing.mix(d).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(d).collect())) == plain
    same = spark.createDataFrame([(1, "same words again", "a")] * 50 + [(2, "other", "a")], "doc_id long, text string, source string")
    rows = packing.pack(same, queries.tokenizer_path(), length=16, group_pieces=8).collect()
    assert len(rows) == 51 and len({(r.sequence_id, r.offset) for r in rows}) == 51 and len({r.sequence_id >> 32 for r in rows}) > 1


def test_empty_vectors_take_part(spark):
    df = spark.createDataFrame([(0, [-1.0]), (1, []), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in maxscore.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 0), (2, 2, -1024 * 1024)]
    assert [r.score for r in maxscore.top_k(df.withColumn("embedding", F.array().cast("array<double>")), F.col("vec_id") == 0).collect()] == [0, 0]


def test_search_grid(spark, monkeypatch):
    """Many shards, tasks and rounds of queries; thresholds from a small sample."""
    monkeypatch.setattr(maxscore, "SHARD", 40)
    monkeypatch.setattr(maxscore, "SAMPLE", 12)
    monkeypatch.setattr(maxscore, "ROUND_BYTES", 8 * 6 * 3)
    rows = [(i, [((i * 7 + k * 13) % 19 - 9) / 8 for k in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(df, F.col("vec_id") % 30 == 0, k=5).collect()
    v = {i: [int(1024 * x // 1) for x in e] for i, e in rows}
    for q in range(0, 300, 30):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    w = maxscore.work(df, F.col("vec_id") % 30 == 0, k=5).first()
    assert w.terms == 10 * 300 * 6 and w.scored <= w.terms and 0 <= w.skipped < w.cells


def test_shards_out_of_reach_are_skipped(spark):
    rows = [(i, [1.0 if i < 6 else 0.001, 0.5]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w = maxscore.work(df, F.col("vec_id") == 0, k=5).first()
    assert w.skipped >= 2 and w.scored < 0.6 * w.terms
    assert [r.vec_id for r in maxscore.top_k(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
