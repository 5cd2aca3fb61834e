"""The pipeline's near-duplicate stage against brute force over all pairs of texts."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import similar

LINE = " ".join(f"common{k}" for k in range(30))


def texts(seed):
    """Originals and copies with edits, of all lengths; many hold a common line, some hardly more than that."""
    rng = random.Random(seed)
    rows: list[list[str]] = []
    for _ in range(160):
        if rows and rng.random() < 0.5:
            w = list(rng.choice(rows))
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 3)}"
            w = w + [f"tail{rng.randint(0, 9)}"] * rng.randint(0, 8) if rng.random() < 0.3 else w
        else:
            w = [f"Ä{rng.randint(0, 300)}" for _ in range(rng.choice([1, 3, 4, 5, 8, 30, 100, 400]))]
            w = LINE.split() + w if rng.random() < 0.4 else w
        rows.append(w)
    return [(i * 7 % 160, " ".join(w)) for i, w in enumerate(rows)] + [(None, "no id"), (500, None), (501, " \t"), (502, "no id")]


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_brute_force(rows):
    g = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if near(g[i], g[j]):
            root[find(j)] = find(i)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min((d for d in ds if d is not None), default=-1) for ds in groups.values())


@pytest.mark.parametrize("seed,shared", [(1, 4), (2, 4), (3, 10**9)])
def test_similar_texts_go(spark, monkeypatch, seed, shared):
    monkeypatch.setattr(similar, "SHARED", shared)  # with or without an order by frequency: the same result
    rows = texts(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect())
    assert got == kept_by_brute_force(rows)


def test_texts_that_differ_from_the_hub_of_their_keys(spark):
    """The smallest text of a key is like none of the others, which are like each other by pairs only."""
    rows = []
    for i in range(40):
        own = [f"o{i // 2}x{k}" for k in range(60)]
        rows.append((i, " ".join(["shared"] * 3 + [f"s{k}" for k in range(12)] + own + [f"end{i}"])))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == list(range(0, 40, 2)) == kept_by_brute_force(rows)


def test_similar_sets_meet_in_their_prefixes():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        often = np.sort(rng.choice(a, n // 2, replace=False))
        for cut in range(n // 5 + 1):
            b = np.sort(rng.choice(a, n - cut, replace=False))
            if similar.alike(a, b):
                rank = np.arange(1, len(often) + 1)
                assert set(similar.prefix(a, often, rank)) & set(similar.prefix(b, often, rank))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m in [(1, 1), (5, 900), (300, 310), (3000, 2500), (40_000, 39_000)]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: min(n, m) // 2 + 1], rng.integers(0, 1 << 63, m // 2).astype(np.uint64)]))
        assert similar.least_difference(similar.parity(a).tobytes(), similar.parity(b).tobytes()) <= len(np.setxor1d(a, b))
