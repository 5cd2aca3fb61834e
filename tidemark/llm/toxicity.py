"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from document labels: an affix or word that is far more frequent in
toxic than in clean training documents marks the tokens that carry it. The field (states:
clean, toxic) is trained on sentences with these labels, by gradient ascent on the exact
likelihood. Forward-backward marginals of every token of a whole text give the offending
offsets (code points) and, summed up, the document score, which is calibrated on
training documents that the field has not seen, and shifted to the classes' shares among all rows that may train, which are counted.

Bounds: training takes at most TRAIN_DOCS labelled documents of each class, in the order
of a hash of their ids, TRAIN_BYTES of text, no text of more than a 64th of that, and TRAIN_SENTENCES sentences with and
without signs, of at most LONGEST words; scoring has no bound.

Defined results: a null or empty text has no tokens and the score that follows from that; a very long text is scored whole, some 100 bytes of memory a word; a
null doc_id, or one that is no number, is scored, is not held out and never trains; where labels of one id differ it counts as toxic; repeated rows score alike;
without toxic (or without clean) training rows every score is the smoothed share of toxic
ones, a quarter if there are no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS, TRAIN_BYTES, TRAIN_SENTENCES, LONGEST = 2500, 48 << 20, 8000, 2000
SLOTS = 1 << 18
CACHE_WORDS = 150_000
ENDS = (".", "!", "?")
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def features(word: str) -> list[str]:
    """Of a bare word: itself, its prefixes and its suffixes."""
    n = len(word)
    return ["=" + word, *("<" + word[:k] for k in range(3, min(n, 8))), *(">" + word[-k:] for k in range(3, min(n, 6)))]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def bare(word: str) -> str:
    return word.strip(PUNCTUATION)


@dataclass
class Field:
    """Weights: of own features, of the words before and after (SLOTS each), transitions, start, and the calibration."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray
    start: float
    scale: np.ndarray
    constant: float | None = None


class Words:
    """Codes of distinct words and what the field makes of each."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.own, self.before, self.after, self.end = [np.zeros(0)] * 3 + [np.zeros(0, bool)]

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.code) > CACHE_WORDS:
            self.clear()
        if new := list(set(words).difference(self.code)):
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
            bares = [bare(w) for w in new]
            slots = [[slot(f) for f in features(b)] if b else [] for b in bares]
            sizes = np.array([len(s) for s in slots])
            own = np.zeros(len(new))
            np.add.at(own, np.repeat(np.arange(len(new)), sizes), self.field.own[np.array(common.flat(slots), np.int64)])
            first = np.array([s[0] if s else slot("=") for s in slots])
            self.own, self.before, self.after = np.append(self.own, own), np.append(self.before, self.field.before[first]), np.append(self.after, self.field.after[first])
            self.end = np.append(self.end, [w.endswith(ENDS) for w in new])
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))


def sequences(ends: np.ndarray, doc_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sentences; a document ends one, too."""
    last = ends.copy()
    stops = np.cumsum(doc_sizes)
    last[stops[doc_sizes > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    return start, stop - start


def marginals(emit: np.ndarray, start: np.ndarray, size: np.ndarray, moves: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of toxic at each token by forward-backward over all sequences at once, and forward log odds."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    m00, m01, m10, m11 = moves.ravel()
    a = np.full(len(start), first)
    for t, n in enumerate(alive.tolist()):
        at = start[:n] + t
        if t:
            a = a[:n]
            a = np.logaddexp(m01, m11 + a) - np.logaddexp(m00, m10 + a)
        a = a + emit[at]
        ahead[at] = a
    b = np.zeros(0)
    for t in range(len(alive) - 2, -1, -1):
        n, at = alive[t + 1], start[: alive[t + 1]] + t
        x = np.zeros(n)
        x[: len(b)] = b
        x += emit[at + 1]
        b = np.logaddexp(m10, m11 + x) - np.logaddexp(m00, m01 + x)
        back[at] = b
    return ahead + back, ahead


def emissions(codes: np.ndarray, words: Words, start: np.ndarray) -> np.ndarray:
    emit = words.own[codes]
    before, after = np.zeros_like(emit), np.zeros_like(emit)
    before[1:] = words.before[codes[:-1]]
    after[:-1] = words.after[codes[1:]]
    before[start] = 0
    after[start[1:] - 1] = 0
    if len(after):
        after[-1] = 0
    return emit + before + after


def expit(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def summed(p: np.ndarray, doc_sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, log(1 + sum of marginals), the largest marginal, its share of tokens (log)."""
    upto = np.concatenate([[0.0], np.cumsum(p)])
    edge = np.concatenate([[0], np.cumsum(doc_sizes)])
    total = np.maximum(upto[edge[1:]] - upto[edge[:-1]], 0)
    top = np.zeros(len(doc_sizes))
    some = doc_sizes > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, edge[:-1][some])
    return np.stack([np.ones(len(doc_sizes)), np.log1p(total), top, np.log1p(1000 * total / np.maximum(doc_sizes, 1))], axis=1)


def tag(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens and the number of tokens of each text."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    codes = words.codes(common.flat(split))
    if not len(codes):
        return np.zeros(0), sizes
    start, size = sequences(words.end[codes], sizes)
    odds, _ = marginals(emissions(codes, words, start), start, size, words.field.moves, words.field.start)
    return expit(odds), sizes


# --- training ---------------------------------------------------------------


@dataclass
class Vocabulary:
    """Distinct words of the training texts by code: the numbers of their features, one list behind the other, and whether they end a sentence.

    Features are kept by their 32-bit hash, so that a word's are worked out once and take four bytes each.
    """

    codes: list[np.ndarray]
    slots: np.ndarray
    sizes: np.ndarray
    feature: np.ndarray
    n_features: int
    ends: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Vocabulary:
        known: dict[str, int] = {}
        number = lambda w: known.setdefault(w, len(known))
        codes = [np.fromiter(map(number, t.lower().split()), np.int32) for t in texts]
        sizes = np.zeros(len(known), np.int64)

        def hashes():
            for k, w in enumerate(known):
                own = features(b) if (b := bare(w)) else []
                sizes[k] = len(own)
                for f in own:
                    yield zlib.crc32(f.encode())

        flat = np.fromiter(hashes(), np.uint32)
        distinct, feature = np.unique(flat, return_inverse=True)
        return Vocabulary(codes, (flat % SLOTS).astype(np.int64), sizes, feature, len(distinct), np.array([w.endswith(ENDS) for w in known], bool))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def first(self) -> np.ndarray:
        """The slot of each word itself."""
        return np.where(self.sizes > 0, np.append(self.slots, 0)[np.minimum(self.starts, len(self.slots))], slot("="))

    def features_of(self, codes: np.ndarray) -> np.ndarray:
        """The distinct features of a text."""
        words = np.unique(codes)
        n = self.sizes[words]
        return np.unique(self.feature[np.repeat(self.starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())])

    def signs(self, which: list[int], toxic: list[int], least: int = 4, odds: float = 2.5) -> np.ndarray:
        """Whether each word has a feature whose share among toxic documents is far above that among clean ones."""
        seen, n = np.zeros((2, self.n_features), np.int64), np.zeros(2, np.int64)
        for i in which:
            seen[toxic[i], self.features_of(self.codes[i])] += 1
            n[toxic[i]] += 1
        n = np.maximum(n, 1)
        clean, hits = seen
        ratio = np.log((hits + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
        far_above = (hits >= least) & (ratio >= odds) & (hits / n[1] > 4 * np.sqrt((clean + 1) / n[0] / n[1]))
        has = np.zeros(len(self.sizes), np.int64)
        np.add.at(has, np.repeat(np.arange(len(self.sizes)), self.sizes), far_above[self.feature])
        return has > 0

    def sentences(self, codes: np.ndarray) -> list[np.ndarray]:
        stops = np.flatnonzero(self.ends[codes]) + 1
        return [s for s in np.split(codes, stops) if 0 < len(s) <= LONGEST]


def learn(texts: list[str], toxic: list[int], shift: float = 0.0, rounds: int = 40, rate: float = 0.4, decay: float = 1e-5) -> Field:
    """shift: what the log odds of toxic among all rows are above those among these."""
    n = len(toxic)
    zero = np.zeros(SLOTS)
    field = Field(zero, zero.copy(), zero.copy(), np.zeros((2, 2)), 0.0, np.zeros(4), (sum(toxic) + 0.5) / (n + 2))
    if len(set(toxic)) < 2:
        return field
    fit = [i for i in range(n) if i % 10 < 6]  # the others calibrate
    known = Vocabulary.of(texts)
    sign = known.signs(fit, toxic)
    # Sentences with a sign and others: of each kind every k-th, so that at most TRAIN_SENTENCES train.
    kinds: dict[bool, list[tuple[np.ndarray, int]]] = {True: [], False: []}
    for i in fit:
        for s in known.sentences(known.codes[i]):
            kinds[bool(toxic[i] and sign[s].any())].append((s, toxic[i]))
    train = [x for own in kinds.values() for x in own[:: -(-len(own) // TRAIN_SENTENCES) or 1]]
    if not train:
        return field
    label = np.concatenate([sign[s] & bool(t) for s, t in train]).astype(float)
    sizes = np.array([len(s) for s, _ in train], np.int64)
    start = np.cumsum(sizes) - sizes
    # From here on the words of these sentences only.
    words, codes = np.unique(np.concatenate([s for s, _ in train]), return_inverse=True)
    counts = known.sizes[words]
    row = np.repeat(np.arange(len(words)), counts)
    col = known.slots[np.repeat(known.starts[words] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    first = known.first()[words]
    inner = np.ones(len(codes), bool)
    inner[start] = False
    here, there = np.flatnonzero(inner), np.flatnonzero(inner) - 1
    gathered = [np.full(SLOTS, 1e-6) for _ in range(3)]
    moved, started = np.full((2, 2), 1e-6), 1e-6
    weights = [field.own, field.before, field.after]
    # Expected less observed counts are the gradient of the negative log likelihood.
    for _ in range(rounds):
        own = np.bincount(row, field.own[col], len(words))
        emit = own[codes]
        emit[here] += field.before[first][codes[there]]
        emit[there] += field.after[first][codes[here]]
        odds, ahead = marginals(emit, start, sizes, field.moves, field.start)
        p = expit(odds)
        off = p - label
        by_word = np.bincount(codes, off, len(words))
        grads = [np.bincount(col, by_word[row], SLOTS), np.bincount(first[codes[there]], off[here], SLOTS), np.bincount(first[codes[here]], off[there], SLOTS)]
        for w, g, h in zip(weights, grads, gathered):
            g = g + decay * len(codes) * w
            h += g * g
            w -= rate * g / np.sqrt(h)
        # Pair marginals: forward odds, a move, and what is ahead of the second token (its odds less its forward part).
        if len(here):
            later = odds[here] - ahead[here] + emit[here]
            score = np.stack([np.full(len(here), field.moves[0, 0]), field.moves[0, 1] + later, field.moves[1, 0] + ahead[there], field.moves[1, 1] + ahead[there] + later])
            pair = np.exp(score - score.max(0))
            pair /= pair.sum(0)
            x, y = label[there], label[here]
            seen = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y])
            g = (pair - seen).sum(1).reshape(2, 2)
            moved += g * g
            field.moves -= rate * g / np.sqrt(moved)
        g0 = float(off[start].sum())
        started += g0 * g0
        field.start -= rate * g0 / np.sqrt(started)
    held = [i for i in range(n) if i % 10 >= 6]
    if len({toxic[i] for i in held}) < 2:
        held = list(range(n))
    words = Words(field)
    parts = [tag([texts[i] for i in held[k : k + 64]], words) for k in range(0, len(held), 64)]
    p, doc_sizes = map(np.concatenate, zip(*parts))
    field.scale, field.constant = calibrate(summed(p, doc_sizes), np.array([toxic[i] for i in held], float)), None
    field.scale[0] += shift
    return field


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = expit(x @ w)
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").try_cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from the labelled rows that are not held out."""
    known = labels.select(common.doc_id(), F.col("toxic").try_cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    # Ids and labels of at most twice TRAIN_DOCS rows, then their sizes, then as many texts as the bound holds.
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [r for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy(*order).limit(TRAIN_DOCS).collect()]
    toxic = {r.doc_id: r.toxic for r in sample}
    if not toxic:
        return learn([], [])
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in toxic], "id long"))
    found = common.with_text(docs, common.doc_id()).join(ids, F.col("doc_id") == F.col("id"), "left_semi").where("text is not null")
    # One row an id, and a text that is longer than a part of the bound is left to scoring.
    found = found.where(F.octet_length("text") <= TRAIN_BYTES // 64).groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.xxhash64("doc_id").alias("h")).toArrow()
    room, texts, own = TRAIN_BYTES, {}, found["doc_id"].to_pylist()
    for k in sorted(range(len(own)), key=found["h"].to_pylist().__getitem__):
        text = found["text"][k].as_py()
        if len(text.encode()) <= room and text not in texts:
            texts[text] = toxic[own[k]]
            room -= len(text.encode())
    del found
    all_of = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    seen = Counter(texts.values())
    shift = 0.0 if len(seen) < 2 else float(np.log(all_of[1] / all_of[0]) - np.log(seen[1] / seen[0]))
    field = learn(list(texts), list(texts.values()), shift)
    del texts
    common.trim()  # the driver has other things to do with that memory
    return field


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
_TOKEN = re.compile(r"\S+")


def _cached(field: Field) -> Words:
    return common.only_cache(f"toxicity {id(field)}", lambda: Words(field))


def score(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, and the spans (code points) of tokens whose marginal reaches the threshold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # of fixed size: three tables of SLOTS weights

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        model = shared.value
        strings = [(t or b"").decode() for t in texts]
        p, sizes = tag(strings, _cached(model))
        scores = expit(summed(p, sizes) @ model.scale) if model.constant is None else np.full(len(texts), model.constant)
        spans: list[list] = [[] for _ in texts]
        hot = np.flatnonzero(p >= threshold)
        doc_of = np.searchsorted(np.cumsum(sizes), hot, side="right")
        first = np.cumsum(sizes) - sizes
        for d in np.unique(doc_of).tolist():
            own = hot[doc_of == d]
            probable = dict(zip((own - first[d]).tolist(), p[own].tolist()))
            for k, m in enumerate(_TOKEN.finditer(strings[d])):
                if k in probable:
                    spans[d].append({"start": m.start(), "end": m.end(), "p": probable[k]})
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], ["doc_id", "score", "spans"])

    common.prepare(spark)
    return common.with_text(docs, common.doc_id()).mapInArrow(common.per_chunk(run), SCORED)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    columns = docs.columns
    field = train(docs, labels)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        model = shared.value
        p, sizes = tag([(t or b"").decode() for t in texts], _cached(model))
        scores = expit(summed(p, sizes) @ model.scale) if model.constant is None else np.full(len(texts), model.constant)
        return batch.filter(pa.array(scores < threshold))

    common.prepare(spark)
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(common.per_chunk(run), typed.schema).select(*columns)
