"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint of 64 bits is 8 positional bytes. Fingerprints that differ in at most k bits
differ in at most k bytes, so they share at least 8 - k positional bytes: the guaranteed
minimum. Posting lists of one byte would hold a 256th of all fingerprints each; the index
therefore takes several positional bytes to a posting. The positions are split into k + 2 blocks, and a fingerprint has
a posting for each two of them: k bytes spoil k blocks at most, so two are whole, and pairs that share
the minimum meet in a posting. There the shared positional bytes of each pair are tallied,
pairs that reach the minimum are retained, and their bits are verified.

Postings are counted before they are gathered. A posting of more than LIST fingerprints, as
thousands of near copies make, is not gathered: its fingerprints go to a finer index with
a posting for each choice of 8 - k positions, where to meet is to share the minimum. Only k bytes differ within such a posting, so it never
holds more than 256^k distinct fingerprints, and each looks up its neighbours. The links of a
posting go out as a star to the smallest of those that hang together, which is linear in its size and loses no
connection. Components join by alternating large and small stars.

Defined results: a null or wordless text has fingerprint zero and links like any other; a
text of fewer words than a shingle is one shingle; very long texts are hashed whole, 2 bytes of
memory a byte of text; a null doc_id, or one that is no number, takes part but is never
the smallest unless it is alone, then its component is null; a bit set in exactly half of the hashes is 0; repeated rows are
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints of a posting that are gathered and compared by pairs.
LIST = 512

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints_of(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    values: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        before = len(values)
        if len(words) >= shingle:
            values.extend(map(hashed, map(b" ".join, zip(*(words[k:] for k in range(shingle))))))
        elif words:
            values.append(hashed(b" ".join(words)))
        counts[i] = len(values) - before
    hashes = np.array(values, np.uint64).view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts)) * 256, counts)
    out = np.zeros(len(texts), np.uint64)
    for k in range(8):  # the bytes of the hashes, lowest first
        tally = np.bincount(row + hashes[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS
        out |= ((2 * tally > counts[:, None]) @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * k)
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of one list of unsigned 64-bit hashes."""
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, tag (a hash that tells texts apart) and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        common.drop_cache()
        fp = fingerprints_of(texts, shingle, seed).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(fp)], ["doc_id", "tag", "fp"])

    common.prepare(docs.sparkSession)
    tagged = common.with_text(docs, common.doc_id(), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    return tagged.mapInArrow(common.per_chunk(run), "doc_id long, tag long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(positions) -> int:
    return _signed(sum(0xFF << 8 * int(k) for k in positions))


def coarse_masks(distance: int) -> list[int]:
    """Two of distance + 2 blocks of positions each."""
    blocks = np.array_split(np.arange(8), distance + 2)
    return [_mask([*x, *y]) for x, y in itertools.combinations(blocks, 2)]


def fine_masks(distance: int) -> list[int]:
    """All but `distance` positions each."""
    return [_mask(x) for x in itertools.combinations(range(8), 8 - distance)]


def postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """choice, shared (the bytes at its positions), fp: a row for each fingerprint and mask; fps: distinct fp."""
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(masks))))
    return fps.select("fp", each.alias("p")).select("p.choice", "p.shared", "fp")


def retained(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a posting that share the guaranteed minimum of positional bytes and pass the verification."""
    if len(fps) <= LIST:
        own = fps.view(np.uint8).reshape(-1, 8)
        tally = (own[:, None, :] == own[None, :, :]).sum(2)
        i, j = np.nonzero(np.triu(tally >= 8 - distance, 1))
        near = np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= distance
        return i[near], j[near]
    # A large posting, sorted: look up the neighbours of each, a fixed number.
    differ = int(np.bitwise_or.reduce(fps ^ fps[0])) & (1 << 64) - 1
    bits = [k for k in range(64) if differ >> k & 1]
    pairs = []
    for n in range(1, distance + 1):
        for ks in itertools.combinations(bits, n):
            other = fps ^ np.int64(_signed(sum(1 << k for k in ks)))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            i = np.flatnonzero((fps[at] == other) & (other > fps))
            pairs.append((i, at[i]))
    return tuple(map(np.concatenate, zip(*pairs)))


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest, other) that join all of fps that hang together by links of at most `distance` bits."""
    fps = np.sort(fps)
    i, j = retained(fps, distance)
    root = np.arange(len(fps))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    other = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[other]], fps[other]


def _gathered(rows: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of postings that may be gathered."""

    def run(batches):
        common.drop_cache()
        for batch in batches:
            edges = [forest(row.values.to_numpy(), distance) for row in batch.column("fps")]
            u, v = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.groupBy("choice", "shared").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "u long, v long")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges u < v between distinct fingerprints: enough to join all that hang together by links. fps: distinct fp, to be read several times."""
    if not 0 <= distance <= 3:
        raise ValueError("a distance is of 0 to 3 bits")
    key = ["choice", "shared"]

    coarse = postings(fps, coarse_masks(distance))
    counts = common.checkpoint(coarse.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    few = coarse.join(counts.where(F.col("n") <= LIST).select(*key), key, "left_semi")
    crowded = counts.where(F.col("n") > LIST)
    found = _gathered(few, distance)
    if not crowded.isEmpty():
        many = common.checkpoint(coarse.join(crowded.select(*key), key, "left_semi").select("fp").distinct())
        fine = postings(many, fine_masks(distance))
        several = common.checkpoint(fine.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        found = found.unionByName(_gathered(fine.join(several, key, "left_semi"), distance))
    return found.distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one that has none itself: then that is the smallest of all it reaches."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node) for every node of edges (u, v) but the roots.

    Alternating large and small stars: minima and joins only. Minima are written before
    they are joined, so that the edges of a node with very many neighbours, as the root of a
    whole component, are an ordinary skewed join that Spark splits.
    """
    edges = common.checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = common.checkpoint(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small_least = common.checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        to_least = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.checkpoint(to_least.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots, as components() gives them, after further edges: only what these join is worked out anew."""
    at = roots.select("node", "root")
    ends = more
    for end in ("u", "v"):
        ends = ends.join(at.withColumnsRenamed({"node": f"_{end}", "root": f"root_{end}"}), F.col(end) == F.col(f"_{end}"), "left")
    new = components(ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    if new.isEmpty():
        return roots
    moved = at.join(new.withColumnsRenamed({"node": "_old", "root": "_new"}), F.col("root") == F.col("_old"), "left")
    return common.checkpoint(moved.select("node", F.coalesce("_new", "root").alias("root")).unionByName(new))


def linked(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, tag, fp, root (the smallest fingerprint that links reach), component_id of every document."""
    rows = common.table(fingerprints(docs, shingle, seed))
    # Dealt out again: what adaptive execution has made few partitions of grows by the postings.
    per = common.checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition("fp"))
    return rows.join(roots_of(per, "fp", components(links(per.select("fp"), distance))), "fp")


def roots_of(per: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """node, root and component_id of each node; per has every node with its least doc_id, roots those that are linked."""
    lonely = common.checkpoint(per.join(roots, F.col(node) == F.col("node"), "left").select(node, "least", F.coalesce("root", node).alias("root")))
    # A minimum a component, written before it is joined: one component may hold a third of all nodes.
    of_root = common.checkpoint(lonely.groupBy("root").agg(F.min("least").alias("component_id")))
    return lonely.join(of_root, "root").select(node, "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach) of every document."""
    found = linked(docs, distance, shingle, seed)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The documents without the near-duplicates of another: of each component one document with the smallest doc_id stays.

    A document without a doc_id stays only if its component has none that has one.
    """
    return first_of(docs, linked(docs.select("doc_id", "text"), distance, shingle, seed))


def first_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each root in rows (doc_id, tag, root, component_id of every document) the one document that keep_one() keeps."""
    found = common.table(rows.where("doc_id <=> component_id"))
    stay = common.checkpoint(found.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("tag").alias("_tag")))
    rows = found.join(stay.withColumnRenamed("root", "_root"), (F.col("root") == F.col("_root")) & (F.col("tag") == F.col("_tag")))
    stay = common.checkpoint(rows.groupBy("_id", "_tag").count())
    same = docs["doc_id"].try_cast("long").eqNullSafe(stay["_id"]) & (F.xxhash64(docs["text"].cast("string")) == stay["_tag"])
    kept = docs.join(stay, same, "left_semi")
    # Only rows that are the same in id and text are left to tell apart.
    return kept if stay.where("count > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
