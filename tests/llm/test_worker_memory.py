"""What a Python worker holds in the steps of op2: no cache beside it, and little more than a batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import common, substring


class Rows:
    """Stands for a DataFrame: hands out the function that a worker would run."""

    sparkSession = None

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def texts(n):
    rng = random.Random(3)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)).encode() for _ in range(n)]


def segments_of(monkeypatch, own):
    monkeypatch.setattr(substring, "_text", lambda docs: docs)
    monkeypatch.setattr(common, "prepare", lambda spark: None)
    return substring.all_segments(Rows(), 35, 3), pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["text"])


def windows_of(monkeypatch, own):
    zip_, all_windows = zstandard.ZstdCompressor(level=1), [{"place": int(substring.packed(k, 61)), "anchor": 1} for k in range(0, 366, 61)]
    k0, k1 = substring.text_keys(own).T
    columns = [pa.array(k0.copy()), pa.array(k1.copy()), pa.array([zip_.compress(t) for t in own]), pa.array([all_windows] * len(own), pa.list_(pa.struct([("place", pa.int64()), ("anchor", pa.int64())])))]
    return substring.single_windows(Rows(), 35), pa.RecordBatch.from_arrays(columns, ["k0", "k1", "text", "segments"])


@pytest.mark.parametrize("step", [segments_of, windows_of])
def test_a_worker_holds_little(monkeypatch, step):
    """3 MB of texts in one batch: all their windows come out, and the words of a small part of them exist at a time."""
    own = texts(1000)
    run, batch = step(monkeypatch, own)
    common._cache[:] = "another operator", object()
    tracemalloc.start()
    try:
        windows = 0
        for out in run(iter([batch])):
            windows += int(substring.unpacked(out.column("place").to_numpy())[1].sum())
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert windows == 1000 * 366
    assert common._cache[1] is None, "what another operator cached, or a cache of words, is still there"
    assert peak < 40, f"{peak:.0f} MB"


def test_word_hashes_leave_no_cache():
    common._cache[:] = "", None
    assert substring.word_hashes([b"a", b"b", b"a"]).tolist()[::2] == [15154266338359012955] * 2
    assert common._cache == ["", None] and substring.word_hashes([]).dtype == np.uint64
