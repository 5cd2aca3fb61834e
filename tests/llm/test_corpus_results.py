"""Operators against brute force, round trips, held-out labels and SQL."""

import hashlib
import itertools
import os
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, common, licenses, maxscore, media, mixing, packing, queries, resample, simhash, substring, toxicity

SF = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@TABLES
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    rows = lambda df: sorted(map(str, df[c].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want) and len(got)


# --- toxicity


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    size = np.array([4, 1, 3])
    start = np.cumsum(size) - size
    emit, moves, first = rng.normal(size=8), rng.normal(size=(2, 2)), 0.3
    odds, _ = toxicity.marginals(emit, start, size, moves, first)
    for s, n in zip(start, size):
        total, one = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            score = first * path[0] + sum(emit[s + k] for k in range(n) if path[k]) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(score)
            one += np.exp(score) * np.array(path)
        assert np.allclose(toxicity.expit(odds[s : s + n]), one / total)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    bad = ["nasty", "vile", "foul"]
    rows = []
    for i in range(n):
        words = [rng.choice("abcdefghij") + rng.choice("klmnopqrs") + rng.choice("tuvw") for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_held_out_and_spans(spark):
    rows = toxic_rows(600, 5)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[i].predicted == t for i, _, t in held]) > 0.97
    for i, text, t in held:
        if t and got[i].predicted:
            assert {text[s.start : s.end].strip(".") for s in got[i].spans} <= {"nasty", "vile", "foul"} and got[i].spans


# --- substring dedup


def repeated(rows, w=35):
    split = [((t or "").encode().split(), d) for d, t in rows]
    c = Counter(tuple(x[i : i + w]) for x, _ in split for i in range(len(x) - w + 1))
    out = []
    for x, d in split:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if c[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        kept = [a for a, g in zip(x, gone) if not g]
        out.append((d, len(x), len(x) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words[:k]) for _ in range(400)] for k in (2, 3, 5, 30, 30)]
    rows = []
    for d in range(120):
        t: list[str] = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                b, i = rng.choice(base), rng.randint(0, 360)
                t += b[i : i + rng.randint(1, 90)]
            elif kind < 0.5:
                t += [rng.choice(words)] * rng.randint(1, 120)
            elif kind < 0.6:
                t += ["x", "y"] * rng.randint(1, 40)
            else:
                t += [rng.choice(words) + str(rng.randint(0, 5000)) for _ in range(rng.randint(1, 60))]
        rows.append((d if rng.random() < 0.95 else 3, " ".join(t)))
    rows += [(None, None), (500, rows[4][1]), (4, rows[4][1]), (None, rows[9][1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.digests(df).collect()), key=str) == repeated(rows)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(7)
    core = [str(rng.randint(0, 400)).encode() for _ in range(60)]
    texts = [b" ".join([str(rng.random()).encode() for _ in range(rng.randint(0, 50))] + core + [b"z"] * rng.randint(0, 9)) for _ in range(20)]
    chunk = substring.Chunk(texts)
    text, first, n, anchor, _ = substring.segments(chunk)
    by: dict = {}
    for t, f, k, a in zip(text, first, n, anchor):
        words = texts[t].split()
        for i in range(f, f + k):
            by.setdefault(tuple(words[i : i + 35]), set()).add(int(a))
    assert all(len(a) == 1 for a in by.values()) and len(by) > 26


# --- licences


def test_license_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nMore prose."), (2, "We never released under the MIT License anything."), (3, "Copyright (c) 2020 Some Body\n" + mit + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS."),
        (4, "x | Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (5, "This work is licensed under the GNU General Public\nLicense, version 3."), (6, None),
    ]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("", ""), 3: ("MIT", "copyright"), 4: ("CC-BY-NC-4.0", ""), 5: ("GPL-3.0-only", ""), 6: ("", "")}


def test_every_sentence_has_a_keyword_and_is_found_by_itself(spark):
    first = lambda s: " ".join(w.split("|")[0] for w in s.split())
    rows = [(i, first(s).replace("#", "2020 holder").replace("*", "some words")) for i, s in licenses.SENTENCES.items()]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert r.sentence_ids == r.doc_id
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


# --- resampling


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(50)] + [5] * 10 + [-1, 0, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    order = sorted(values, reverse=True)
    for k in (1, 2, 25, 30, len(values)):
        assert resample.kth_largest(df, "v", k) == order[k - 1]


@pytest.mark.parametrize("words,most", [(30, None), (400, None), (400, 200)])
def test_gumbel_top_k_by_brute_force(spark, words, most):
    rows = [(i, " ".join(random.Random(i).choices(["good", "fine", "text"] if i % 2 else ["junk", "spam", "text"], k=words))) for i in range(200)] + [(None, "text"), (None, "good text")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    word = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) // 2
    bag = lambda t: Counter([word(w) % 10_000 for w in t] + [(word(a) * 40_503 + word(b)) % (2**31 - 1) % 10_000 for a, b in itertools.pairwise(t)])
    bags = [bag(t.split()) for _, t in rows]
    raw, target = sum(bags, Counter()), sum((bags[i] for i in range(1, 100, 2)), Counter())
    ratio = lambda b: np.log((target[b] + 1) / (target.total() + 10_000)) - np.log((raw[b] + 1) / (raw.total() + 10_000))
    noise = lambda i, t: -np.log(-np.log((int(hashlib.md5(f"{'null' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52))
    scale = lambda b: 1 if most is None else most / max(most, b.total())
    want = sorted((sum(n * ratio(k) for k, n in b.items()) * scale(b) + noise(*row) for b, row in zip(bags, rows)), reverse=True)[:101]
    got = sorted((r.noisy for r in resample.sample(docs, labels, most=most).collect()), reverse=True)
    assert got == pytest.approx(want, abs=1e-9)


# --- packing


@TABLES
def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r.doc_id: r.text for r in common.read(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op5_packing"](spark, SF).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for i, text in docs.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in bins.values():
        assert [o for o, _ in sorted(s)] == list(itertools.accumulate([n for _, n in sorted(s)], initial=0))[:-1] and sum(n for _, n in s) <= 4096
    assert sum(r.length for r in rows) / (4096 * len(bins)) > 0.97


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_first_fit_by_scanning(lengths):
    lengths.sort(reverse=True)
    room: list[int] = []
    want = []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= n
    assert packing.first_fit_decreasing(lengths, 100) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_word_ids_are_the_tokenizers(texts):
    w = packing.word_ids(queries.tokenizer_path())
    ids, sizes = w.encode(t.encode() for t in texts)
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == common.flat(want) and sizes.tolist() == list(map(len, want))


def test_word_ids_of_letters_and_signs():
    """Scripts, a letter that lowers to two signs, conjoining letters, marks, special strings: by themselves and before signs."""
    words = ["the", "Été", "İ", "ΣΑΣ", "Жук", "가", "\u1100\u1161", "か\u3099", "漢字", "a\u0338", "ªµº", "ſt", "x's", "2023", "<|endoftext|>", "A<|", ""]
    texts = [w + signs for w in words for signs in ("", ".", "!!", ',"')]
    w = packing.WordIds(queries.tokenizer_path())
    ids, sizes = w.encode(t.encode() for t in texts)
    want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == common.flat(want) and sizes.tolist() == list(map(len, want))


def test_repeated_words_are_no_python_objects():
    """1.1 MB of text with 48 distinct words: its 200,000 words are counted out by Arrow, not made and looked up one by one."""
    some = [a + b + signs for a in ("th", "an", "er", "in") for b in ("e", "on", "es") for signs in ("", ".", ",", "!!")]
    text = " ".join(random.Random(4).choices(some, k=200_000)).encode()
    w = packing.WordIds(queries.tokenizer_path())
    w.encode([text])
    tracemalloc.start()
    try:
        ids, sizes = w.encode([text])
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert ids.tolist() == w.tokenizer.encode(text.decode(), add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
    assert peak < 15, f"{peak:.0f} MB"


# --- media


def parsed(data):
    """An own reader of one-track files of this writer: tables by name, wherever they stand."""
    table = lambda name, n, at=0: struct.unpack_from(f">{n}I", data, data.index(name) + 8 + at)
    size, n = table(b"stsz", 2)
    (chunks,) = table(b"stco", 1)
    offsets = table(b"stco", chunks, 4)
    (runs,) = table(b"stsc", 1)
    runs = [table(b"stsc", 3, 4 + 12 * k)[:2] for k in range(runs)] + [(chunks + 1, 0)]
    per = [p for (a, p), (b, _) in itertools.pairwise(runs) for _ in range(a, b)]
    places = [(offset + k * size, size) for offset, m in zip(offsets, per) for k in range(m)]
    (syncs,) = table(b"stss", 1)
    return n, places, [places[k - 1] for k in table(b"stss", syncs, 4)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_media_round_trip(data):
    payload = media.padded(data)
    stored = media.store(payload)
    (track,) = media.index(stored)
    n, places, keys = parsed(stored)
    assert b"".join(stored[a : a + n] for a, n in track.chunk_ranges()) == b"".join(stored[a : a + n] for a, n in places) == payload
    assert track.duration == track.ticks == len(payload) and track.codec == "raw " and track.samples == n and track.keyframes() == keys


@TABLES
def test_media_query_by_an_own_reader(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in common.read(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op6_media_columns"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        payload = text + bytes(-len(text) % 64 if text else 64)
        stored = media.store(payload)
        _, places, keys = parsed(stored)
        assert b"".join(stored[a : a + n] for a, n in places) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.codec, r.seconds, [tuple(k) for k in r.keyframes]) == ("raw", len(payload) / 8000, keys)
        assert f"samples={len(places)};keyframes={len(keys)};first={keys[0][0]}+64" in r.feature


def container(*tables, extra=b"", end=b""):
    box, full = media.box, media.full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(70))), *tables)
    trak = box(b"trak", full(b"tkhd", bytes(8), struct.pack(">I", 7), bytes(68)), box(b"mdia", full(b"mdhd", bytes(8), struct.pack(">2I", 1000, 40), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl)))
    return box(b"ftyp", b"isom") + box(b"moov", trak, extra) + end


def times(*pairs):
    return media.full(b"stts", struct.pack(f">{1 + 2 * len(pairs)}I", len(pairs), *common.flat(pairs)))


def ints(name, *values, kind="I"):
    return media.full(name, struct.pack(f">I{len(values)}{kind}", len(values), *values))


def test_foreign_containers(spark):
    places = (media.full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)), ints(b"co64", 100, 500, kind="Q"))
    good = container(times((2, 10), (1, 20)), media.full(b"stsz", struct.pack(">5I", 0, 3, 5, 7, 3)), *places, ints(b"stss", 1, 3), end=media.box(b"mdat", bytes(400)))
    small = container(times((3, 10)), media.full(b"stz2", struct.pack(">2I2B", 4, 3, 0x57, 0x30)), *places, end=media.box(b"mdat", bytes(400)))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-3])), (3, None), (4, bytearray(small)), (5, bytearray(b""))], "tracks int, media binary").withColumn("row", F.lit("x"))
    got = {r.row_id: r for r in media.media_columns(df.withColumn("row_id", F.col("tracks"))).collect()}
    (t,) = got[1].tracks
    assert (t.codec, t.kind, t.duration_ticks, t.timescale, t.samples, t.seconds) == ("avc1", "vide", 40, 1000, 3, 0.04) and got[1].row == "x"
    assert [tuple(k) for k in t.keyframes] == [(100, 5), (500, 3)]
    assert got[2].tracks is None and got[2].media_error and got[3].tracks is None and got[3].media_error is None
    # without a table of sync samples all are: whole chunks
    assert [tuple(k) for k in got[4].tracks[0].keyframes] == [(100, 12), (500, 3)] and got[5].tracks == []


def test_fragments():
    box, full = media.box, media.full
    empty = (times(), full(b"stsz", bytes(8)), ints(b"stsc"), ints(b"stco"))
    trex = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0x10000)))

    def moof(*runs, base=b"", flags=media.TF_MOOF):
        return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), base, flags=flags), *runs))

    head = container(*empty, extra=trex)
    sized = full(b"trun", struct.pack(">IiI4I", 2, 0, 0, 5, 20, 6, 30), flags=media.TR_OFFSET | media.TR_FIRST | media.TR_DURATION | media.TR_SIZE)
    plain = full(b"trun", struct.pack(">I", 3), flags=0)
    data = head + moof(sized, plain) + box(b"mdat", bytes(100))
    (t,) = media.index(data)
    # times of the runs: given ones (5 and 6 ticks), then the default of the track
    assert t.samples == 5 and t.ticks == 5 + 6 + 30 and t.chunk_ranges() == [(len(head), 50), (len(head) + 50, 12)]
    assert t.keyframes() == [(len(head), 20)]
    with pytest.raises(media.BadContainer):
        media.index(head + moof(full(b"trun", struct.pack(">I", 4_000_000_000))))
    with pytest.raises(media.BadContainer):
        media.index(head + moof(plain, base=struct.pack(">Q", 1 << 60), flags=media.TF_BASE))


def test_hostile_containers_raise_and_take_no_memory():
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    fine = (times((1, 1)), ints(b"stco", 40), media.full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)))
    bad = [
        nested, struct.pack(">I4s", 4, b"free"), struct.pack(">I4sI", 1, b"free", 9), media.box(b"moov", b"123"),
        container(*fine, media.full(b"stsz", struct.pack(">2I", 1, (1 << 32) - 1))), container(*fine, media.full(b"stsz", struct.pack(">2I", 0, 20_000_000))),
        container(*fine, media.full(b"stsz", struct.pack(">2I", 4, 1)), ints(b"stss", 0)), container(*fine, media.full(b"stsz", struct.pack(">2I", 4, 1)), ints(b"stss", 2)),
        container(times((1, 1)), ints(b"stco", 4), media.full(b"stsc", struct.pack(">4I", 1, 1, (1 << 32) - 1, 1)), media.full(b"stsz", struct.pack(">2I", 4, 1))),
        container(times((1, 1)), ints(b"stco", 1 << 31), media.full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)), media.full(b"stsz", struct.pack(">2I", 4, 1))), container(media.full(b"stsd")[:10]),
    ]
    import tracemalloc

    tracemalloc.start()
    for data in bad:
        with pytest.raises(media.BadContainer):
            media.index(data)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_damaged_containers_raise_or_fit(data):
    stored = bytearray(media.store(media.padded(bytes(range(256)) * 40)))
    for _ in range(data.draw(st.integers(0, 4))):
        stored[data.draw(st.integers(0, 700))] = data.draw(st.integers(0, 255))
    cut = data.draw(st.integers(0, len(stored)) | st.just(len(stored)))
    try:
        for t in media.index(bytes(stored[:cut])):
            assert all(0 <= a and a + n <= cut for a, n in t.keyframes())
    except media.BadContainer:
        pass


# --- SimHash


def bits(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "Edit" + str(rng.randint(0, 3))
        else:
            w = [f"Ä{rng.randint(0, 300)}" for _ in range(rng.randint(1, 400))]
        rows.append((i * 7 % 150, " ".join(w)))
    fp = {i: bits(t) for i, t in rows}
    root = {i: i for i in fp}
    for _ in range(len(fp)):
        for a, b in itertools.combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


@pytest.mark.parametrize("n", [40, 700])
def test_forest_joins_what_hangs_together(n):
    rng = random.Random(n)
    fps = np.array(sorted({rng.getrandbits(13) << 20 for _ in range(n)}), np.int64)
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(map(int, fps), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {int(x): int(x) for x in fps} | {int(v): int(u) for u, v in zip(*simhash.forest(fps, 2))}
    assert {x: find(x) for x in root} == got


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (-5, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: -5, 1001: -5}


# --- search


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 12), st.integers(1, 12))
def test_maxscore_by_sorting(seed, n, d, k):
    rng = np.random.default_rng(seed)
    c = rng.integers(-4, 5, (d, n)).astype(float) * (rng.random((d, 1)) < 0.7)
    q = rng.integers(-3, 4, d).astype(float)
    maxscore.STEP, step = 64, maxscore.STEP
    try:
        ids, scores, _ = maxscore.search(q, c, np.arange(n), (c.max(1), c.min(1)), k)
    finally:
        maxscore.STEP = step
    want = sorted(zip((-(q @ c)).tolist(), range(n)))[:k]
    assert sorted(zip((-scores).tolist(), ids.tolist())) == want


# --- chat

texts = st.text(st.sampled_from("ab<[\\/s>INSTROLE] \n"), max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<s><s>", " ", "[ROLE] \"x\" "])
roles = st.sampled_from(["user", "assistant", "system", "", "[/ROLE]", "<s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=5))
def test_chat_round_trip(turns):
    whole = "".join(chat.safe_turn(r, t)[0] for r, t in turns)
    assert [p[:2] for p in chat.parse(whole)] == turns


def test_chat_digests(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", own), (-1, 1, "assistant", own), (-1, 2, "assistant", None)]
    r = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\nassistant\n\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(own.encode()).hexdigest() and r.loss_chars == len(own)
    shown = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert r.formatted_chars == sum(len(x.formatted) for x in shown) and shown[0].loss_start is None
    assert chat.unescape(shown[1].formatted[shown[1].loss_start : shown[1].loss_end]) == own


# --- mixing


def test_targets_stop_at_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 20, None: 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in sizes}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


@TABLES
def test_mixture_is_near_its_targets(spark):
    rows = queries.QUERIES["op10_mixing"](spark, "/root/testdata/sf0.01").withColumn("k", F.col("source_size")).groupBy("target", "k").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 0.03 * r.target and r.most <= 2 for r in rows)
    again = [queries.QUERIES["op10_mixing"](spark, SF).orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1]


def test_emitted_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), f"s{i % 2}", "x") for i in range(40)], "doc_id long, text string, source string, draw string")
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in mixing.emit(docs).collect()) == Counter({i: n for i, n in taken.items() if n})
