"""Exact substring dedup by recompression.

Rounds rename the words of every text: first runs of one word become a symbol, then, round
by round, pairs of a left and a right symbol do, where a hash of the symbol's name decides
which it is. Names are hashes of what they stand for, hence the same in every task without a
dictionary, and equal substrings get equal symbols except near their ends. Each symbol
knows the stretch of words it depends on, its reach. A window of `window` words holds the symbols
whose reach lies inside it; the longest (ties: smallest hash, then leftmost) is its anchor.
The anchor follows from the words of the window alone, so equal windows have
the same anchor at the same place. Neighbouring windows with the same anchor make a
segment, the only thing that is shuffled:

1. anchors that occur once are dropped: their windows are unique;
2. segments equal to another as a whole are repeated in all their windows;
3. segments that share an anchor with a different segment are compared window by window,
   one of each kind.

A window without any symbol inside (in long runs) is its own anchor. A repeat is verified by
its words: besides the anchor, which is made of hashes of words, a 64-bit hash of the
segment's bytes from first to last word must agree, so that neither decides alone.

Segments refer to their text by 128 bits of its hash, whatever its doc_id: rows with the
same id, or none, never mix, and equal texts, which lose the same words, share one entry.

Defined results: a null text has no words; texts of fewer words than a window lose none; very
long texts are handled whole, up to 2^31 words; a null doc_id, or one that is no number, is a
document like any other with a null id; repeated rows repeat each other's windows; ties between
anchors go to the leftmost; an empty table gives no rows; other columns are kept where documents are returned and
ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, ROUNDS = 35, 3
#: Text that a worker handles in one go: its words and numbers take some thirty times that.
CHUNK_BYTES = 256 << 10
_U = np.uint64
# Odd multipliers.
MIX1, MIX2, BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: Of a 64-bit order key: bits for the place, then for the hash, then for the length.
PLACE, HASH = 31, 25


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[h == 0] = 1
    return h


def recompress(words: np.ndarray, gap: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """Names, starts and reaches (low, high) of the symbols that `rounds` rounds leave; gap marks separators, which stay alone."""
    n = len(words)
    name, start = words.copy(), np.arange(n)
    low, high = start, start + 1
    for r in range(rounds):
        salt = mix(np.array([2 * r + 1], np.uint64))[0]
        # Runs of words. A symbol stands alone, or a run ends, because both neighbours differ.
        if r == 0:
            same = np.zeros(len(name), bool)
            same[1:] = (name[1:] == name[:-1]) & ~gap[1:]
            first = np.flatnonzero(~same)
            count = np.diff(np.append(first, len(name)))
            last = first + count - 1
            named = name[first]
            runs = count > 1
            named[runs] = mix(named[runs] * MIX1 + count[runs].astype(np.uint64) * BASE + salt)
            left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
            g = gap[first]
            low, high = np.where(g, low[first], low[left]), np.where(g, high[last], high[right])
            name, start, gap = named, start[first], g
        # Pairs: a left symbol before a right one.
        side = (mix(name ^ salt) >> _U(17)) & _U(1)
        is_left, is_right = (side == 0) & ~gap, (side == 1) & ~gap
        pair = np.zeros(len(name), bool)
        pair[:-1] = is_left[:-1] & is_right[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        keep = np.flatnonzero(~second)
        merged = pair[keep]
        right, left = np.minimum(keep + 1, len(name) - 1), np.maximum(keep - 1, 0)
        named = name[keep]
        named[merged] = mix((named[merged] + salt) * MIX2 + name[right[merged]] * BASE)
        low, high = np.where(is_right[keep], low[left], low[keep]), np.where(is_left[keep], high[right], high[keep])
        name, start, gap = named, start[keep], gap[keep]
    return name, start, low, high, gap


class Chunk:
    """The words of neighbouring texts, one behind the other."""

    def __init__(self, texts: list[bytes | None]):
        self.split = [t.split() if t else [] for t in texts]
        self.sizes = np.array([len(s) for s in self.split], np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        self.words = common.flat(self.split)
        self.bytes = memoryview(b" ".join(self.words))
        self.at = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1, out=self.at[1:])

    def content(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of the words from first to end (exclusive), joined by one space."""
        own, digest = self.bytes, xxhash.xxh3_64_intdigest
        spans = zip(self.at[first].tolist(), (self.at[end] - 1).tolist())
        return np.fromiter((digest(own[a:b]) for a, b in spans), np.uint64, len(first))

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window, and its text."""
        n = np.maximum(self.sizes - window + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return np.repeat(self.base - (np.cumsum(n) - n), n) + np.arange(n.sum()), text

    def symbols(self, rounds: int) -> tuple[np.ndarray, ...]:
        """recompress() over all texts with a separator before each and after the last."""
        gap = np.zeros(len(self.words) + len(self.split) + 1, bool)
        gap[self.base + np.arange(len(self.split))] = gap[-1] = True
        names = np.zeros(len(gap), np.uint64)
        names[~gap] = word_hashes(self.words)
        return recompress(names, gap, rounds)


def segments(chunk: Chunk, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Text, first window (from the text's start), number of windows, anchor and content hash of each segment."""
    at, text = chunk.windows(window)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    name, start, low, high, _ = chunk.symbols(rounds)
    length = np.diff(np.append(start, len(chunk.words) + len(chunk.split) + 1))
    key = (_U(255) - np.minimum(length, 255).astype(np.uint64)) << _U(PLACE + HASH)
    key |= (mix(name) >> _U(64 - HASH)) << _U(PLACE)
    key |= np.arange(len(name), dtype=np.uint64)
    # Smallest key of a range of symbols, from tables of ranges of 1, 2, 4, ... symbols.
    tables = [key]
    while 1 << len(tables) <= window:
        prior, d = tables[-1], 1 << len(tables) - 1
        step = prior.copy()
        np.minimum(prior[:-d], prior[d:], out=step[:-d])
        tables.append(step)
    tables = np.stack(tables)
    place = at + text + 1  # among the words with their separators
    from_, to = np.searchsorted(low, place, "left"), np.searchsorted(high, place + window, "right")
    count = to - from_
    has = count > 0
    level = np.frexp(np.where(has, count, 1))[1] - 1
    least = np.minimum(tables[level, np.minimum(from_, len(name) - 1)], tables[level, np.where(has, to - (1 << level), 0)])
    anchor = np.where(has, (least & _U((1 << PLACE) - 1)).astype(np.int64), -1)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    at, place, text, anchor = at[first], place[first], text[first], anchor[first]
    words = chunk.content(at, at + n - 1 + window)
    lone = anchor < 0
    offset = np.where(lone, 0, start[anchor] - place).astype(np.uint64)
    content = mix(words + (offset << _U(32)) * MIX1 + n.astype(np.uint64) * MIX2)
    named = mix(np.where(lone, words * MIX2 + _U(1), name[anchor] ^ BASE))
    return text, at - chunk.base[text], n, named, content


KEY = ["k0", "k1"]
SEGMENT = "k0 long, k1 long, anchor long, content long, place long"


def text_keys(texts: list[bytes | None]) -> np.ndarray:
    """Two columns: 128 bits that stand for a text."""
    digests = b"".join(xxhash.xxh3_128_digest(t or b"", 7) for t in texts)
    return np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)


def packed(first: np.ndarray, n: np.ndarray, lonely: np.ndarray | int = 0) -> np.ndarray:
    """First window, number of windows (6 bits), and whether its kind occurs once."""
    return first << 7 | n << 1 | lonely


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 7, place >> 1 & 63, place & 1


def _text(docs: DataFrame, *keep) -> DataFrame:
    return docs.select(*keep, F.col("text").cast("string").alias("text"))


def all_segments(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    def run(_: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        common.drop_cache()
        text, first, n, anchor, content = segments(Chunk(texts), window, rounds)
        own = text_keys(texts)[text]
        columns = [own[:, 0].copy(), own[:, 1].copy(), anchor.view(np.int64), content.view(np.int64), packed(first, n)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [x.split()[0] for x in SEGMENT.split(", ")])

    common.prepare(docs.sparkSession)
    return _text(docs).mapInArrow(common.per_chunk(run, CHUNK_BYTES), SEGMENT)


def compressed(docs: DataFrame) -> DataFrame:
    """docs with k0 and k1 and with the text compressed, to be dealt out by them; no other column has these names."""
    out = docs.withColumn("text", F.col("text").cast("binary")).withColumns({k: F.lit(0).cast("long") for k in KEY}).schema

    def run(batches):
        common.drop_cache()
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            k = b.schema.get_field_index("text")
            texts = b.column(k).cast(pa.binary()).to_pylist()
            b = b.set_column(k, "text", pa.array([None if t is None else zip_.compress(t) for t in texts], pa.binary()))
            for name, column in zip(KEY, text_keys(texts).T):
                b = b.append_column(name, pa.array(column.copy()))
            yield b
        common.trim()

    return docs.mapInArrow(run, out)


def _unzipped(batch: pa.RecordBatch) -> list[bytes | None]:
    unzip = zstandard.ZstdDecompressor()
    return [None if z is None else unzip.decompress(z) for z in batch.column("text").to_pylist()]


def _bounded(batches):
    """Slices of batches of compressed texts that hold a bounded amount of text."""
    common.drop_cache()
    for batch in batches:
        sizes = [0 if z is None else zstandard.get_frame_parameters(z).content_size for z in batch.column("text").to_pylist()]
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)
    common.trim()


def single_windows(held: DataFrame, window: int) -> DataFrame:
    """The windows, one by one, of segments: held has k0, k1, compressed text, segments (array of place and anchor)."""

    def run(batches):
        for b in _bounded(batches):
            chunk = Chunk(_unzipped(b))
            keys = np.stack([b.column(k).to_numpy() for k in KEY])
            rows: list[tuple[np.ndarray, ...]] = []
            for i, own in enumerate(b.column("segments")):
                place, anchor = (x.to_numpy() for x in own.values.flatten())
                first, n, lonely = unpacked(place)
                each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = each + chunk.base[i]
                rows.append((*np.repeat(keys[:, i : i + 1], len(each), 1), np.repeat(anchor, n), chunk.content(at, at + window).view(np.int64), packed(each, 1, np.repeat(lonely, n))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], [x.split()[0] for x in SEGMENT.split(", ")])

    return held.select(*KEY, "text", "segments").mapInArrow(run, SEGMENT)


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """k0, k1 and places (packed stretches of windows that occur elsewhere, too) of texts that have any."""
    if not 1 <= window < 64:
        raise ValueError("a window has 1 to 63 words")
    # What an aggregation gives is written before it is joined: a join right behind one could not split a hot key.
    kind = ["anchor", "content"]
    every = common.table(all_segments(docs, window, rounds))
    several = common.table(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    shared = common.table(every.join(several, "anchor", "left_semi"))
    common.forget(every, several)
    kinds = common.table(shared.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place")).alias("one")))
    mixed = common.table(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    lone = F.when(F.col("n") == 1, F.lit(1)).otherwise(0).cast("long")
    ones = kinds.join(mixed, "anchor", "left_semi").select(*(f"one.{k}" for k in KEY), F.struct(F.col("one.place").bitwiseOR(lone).alias("place"), "anchor").alias("segment"))
    # At most one segment a kind, and no more of a text than it has itself.
    by_text = common.table(ones.groupBy(*KEY).agg(F.collect_list("segment").alias("segments")))
    held = compressed(_text(docs)).join(by_text, KEY)
    windows = common.table(single_windows(held, window).distinct())
    lonely = F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1
    again = common.table(windows.groupBy(*kind).agg(F.count("*").alias("n"), F.max(lonely).alias("some")).where("n > 1 and some").select(*kind))
    whole = shared.join(kinds.where("n > 1").select(*kind), kind, "left_semi").select(*KEY, "place")
    parts = windows.where(lonely).join(again, kind, "left_semi").select(*KEY, "place")
    found = common.table(whole.unionByName(parts).groupBy(*KEY).agg(F.collect_set("place").alias("places")))
    common.forget(shared, kinds, mixed, by_text, windows, again)
    return found


def _kept(text: bytes | None, places: np.ndarray | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """All words, and those that no repeated window covers."""
    words = (text or b"").split()
    if places is None:
        return words, words
    edge = np.zeros(len(words) + 1, np.int64)
    first, count, _ = unpacked(places)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count - 1 + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return words, [w for w, g in zip(words, gone.tolist()) if not g]


def _with_places(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """docs (a column of any name and the text) compressed, with the places of their repeated windows."""
    return compressed(docs).join(repeats(docs, window, rounds), KEY, "left").drop(*KEY)


def _places(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    return [x.values.to_numpy() if x.is_valid else None for x in batch.column("places")]


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digests(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches):
        for b in _bounded(batches):
            rows = []
            for doc_id, text, places in zip(b.column("doc_id").to_pylist(), _unzipped(b), _places(b)):
                words, kept = _kept(text, places, window)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*[pa.int64()] * 3, pa.string()])], [x.split()[0] for x in KEPT.split(", ")])

    return _with_places(_text(docs, common.doc_id()), window, rounds).mapInArrow(run, KEPT)


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """The documents without their repeated windows; a text that loses words has the others joined by one space."""
    # All other columns travel in one, so that no name can clash.
    boxed = _text(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("box"))

    def run(batches):
        for b in _bounded(batches):
            texts = []
            for text, places in zip(_unzipped(b), _places(b)):
                words, kept = _kept(text, places, window)
                texts.append(text if text is None or len(kept) == len(words) else b" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("box"), pa.array(texts, pa.binary()).cast(pa.string())], ["box", "text"])

    found = _with_places(boxed, window, rounds).mapInArrow(run, boxed.schema)
    return found.select(*(F.col("text") if c == "text" else F.col(f"box.`{c}`") for c in docs.columns))


#: DuckDB SQL for digests() over documents: windows are compared as strings.
ORACLE = """
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
u as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (select r, i, word, case when count(*) over f = 35 then string_agg(word, ' ') over f end as win from u
      window f as (partition by r order by i rows between current row and 34 following)),
d as (select win from g where win is not null group by win having count(*) > 1),
c as (select r, i, word, bool_or(d.win is not null) over (partition by r order by i rows between 34 preceding and current row) as gone
      from g left join d on g.win = d.win),
k as (select r, count(*) as n, count(*) filter (gone) as m, string_agg(word, ' ' order by i) filter (not gone) as kept from c group by r)
select doc_id, coalesce(n, 0) as n_words, coalesce(m, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on w.r = k.r
"""
