"""SimHash near-duplicates at a similarity: links are pairs of texts whose 5-word shingles have 4/5 in common of all they have.

The byte index of simhash.py finds fingerprints (here of 5-word shingles) of 2 bits apart or less, but texts of such a similarity
(Jaccard, of distinct shingles) differ in 3 to 11 bits as a rule, which no eight bytes can promise to show.
So what the index finds is verified by the shingles, and the search is completed so that no pair is missed: in
any one order of all shingles, two sets that are alike meet in the first `n - ceil(4n/5) + 1` of each,
their prefixes. The order puts shingles that a bounded sample of texts shares last, rarest first, so that
common lines are in few prefixes; what the sample holds changes the work only, never the result.

1. In each round every key (a shingle in prefixes) whose texts are of several components names one of them: the smallest in the first round,
   then one in an order of the key's own. The texts of other components are candidates with it; in the first round only with the smallest
   that their keys name, and with the smallest of their component in the byte index. So there are at most as many candidates as postings.
2. Candidates are held to the sizes and to parity bits, which differ in no more places than the sets do: first 256,
   then about as many as a text has shingles. What is left is held to the shingles of the texts themselves.
3. When a round joins nothing more, or ROUNDS are over, the keys whose texts still are of several components give their pairs of
   texts of different components, held to the same bounds within the join. Large groups of copies hang together by then.

Components join as in simhash.

Defined results: null and wordless texts have no shingles and are alike; a text of fewer words than a
shingle is one shingle; very long texts are compared whole; ids, repeated rows, ties and empty tables as in simhash.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: The sample that finds common shingles: texts, texts that must share one, most that are kept.
SAMPLE, SHARED, COMMON = 5_000, 4, 50_000
#: Rounds of candidates that grow with the postings alone, before pairs.
ROUNDS = 3
#: Up to so many texts, those to be compared are looked up by a broadcast of their hashes.
BROADCAST = 100_000


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split() if text else []
    if len(words) >= size:
        grams = map(b" ".join, zip(*(words[k:] for k in range(size))))
    else:
        grams = [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=5), grams), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix(found: np.ndarray, common_hash: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a text that is alike has one in its prefix, too; common_hash is sorted, rank is above 0."""
    n = len(found)
    keep = n - (4 * n + 4) // 5 + 1 if n else 0
    if n and len(common_hash):
        at = np.minimum(np.searchsorted(common_hash, found), len(common_hash) - 1)
        found = found[np.lexsort((found, np.where(common_hash[at] == found, rank[at], 0)))]
    return found[:keep]


def parity(found: np.ndarray) -> np.ndarray:
    """For each of some residues whether the number of shingles in it is odd, as bytes; about as many bits as shingles."""
    m = 1 << min(15, max(8, len(found).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1)


def least_difference(a: bytes, b: bytes) -> int:
    """Two sets with these parities differ in so many shingles at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, m)) for z in (x, y))  # residues of a smaller power of two
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, as sorted hashes and the number of texts."""

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        common.drop_cache()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t).view(np.int64) for t in texts]))], ["h"])

    some = common.with_text(docs).where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(max(1, -(-total // SAMPLE)))) == 0)
    counted = some.mapInArrow(common.per_chunk(run), "h long").groupBy("h").count().where(F.col("count") >= SHARED)
    got = counted.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sets(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, tag (a hash of the text), mark (a hash of its shingles), fp (their fingerprint), n, s0 to s3 (parity bits), bits (more of them) and keys, the prefix."""

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        common.drop_cache()
        found = [shingles(t) for t in texts]
        mark = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
        fp = np.array([simhash.majority(s) for s in found], np.uint64).view(np.int64)
        bits = [np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64) for s in found]
        keys = [prefix(s, *often).view(np.int64) for s in found]
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
        columns = [batch.column("doc_id"), batch.column("tag"), pa.array(mark), pa.array(fp), pa.array([len(s) for s in found], pa.int32()), *map(pa.array, np.array(bits).T.copy()), pa.array([parity(s).tobytes() for s in found], pa.binary()), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "mark", "fp", "n", "s0", "s1", "s2", "s3", "bits", "keys"])

    tagged = common.with_text(docs, common.doc_id(), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    return tagged.mapInArrow(common.per_chunk(run), "doc_id long, tag long, mark long, fp long, n int, s0 long, s1 long, s2 long, s3 long, bits binary, keys array<long>")


def may_be_alike(a: str, b: str) -> Column:
    """Bounds that no pair of similar texts fails."""
    c = lambda x, y: F.col(f"{x}.{y}")
    differ = reduce(lambda x, y: x + y, (F.bit_count(c(a, f"s{k}").bitwiseXOR(c(b, f"s{k}"))) for k in range(4)))
    return (5 * F.least(c(a, "n"), c(b, "n")) >= 4 * F.greatest(c(a, "n"), c(b, "n"))) & (9 * differ <= c(a, "n") + c(b, "n"))


def verified(docs: DataFrame, uniq: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (u, v) of marks whose texts are alike."""
    facts = uniq.select("mark", "n", "s0", "s1", "s2", "s3")
    left = pairs.join(facts.alias("a"), F.col("u") == F.col("a.mark")).join(facts.alias("b"), F.col("v") == F.col("b.mark")).where(may_be_alike("a", "b"))
    first = common.table(left.select("u", "v", (F.col("a.n") + F.col("b.n")).alias("both")))
    if first.isEmpty():
        return first.select("u", "v")

    def near(batches):
        common.drop_cache()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bu", "bv", "both"))
            yield batch.select(["u", "v"]).filter(pa.array([9 * least_difference(x, y) <= n for x, y, n in zip(*columns)], pa.bool_()))

    with_bits = first.join(uniq.select(F.col("mark").alias("u"), F.col("bits").alias("bu")), "u")
    with_bits = with_bits.join(uniq.select(F.col("mark").alias("v"), F.col("bits").alias("bv")), "v")
    left = common.table(with_bits.select("u", "v", "both", "bu", "bv").mapInArrow(near, "u long, v long"))
    both = left.select("u").union(left.select("v")).distinct().withColumnRenamed("u", "mark")
    needed = common.checkpoint(uniq.join(both, "mark", "left_semi").select("mark", F.col("tag").alias("_tag")))
    small = needed.count() <= BROADCAST
    texts = docs.select(F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(needed) if small else needed, F.xxhash64("text") == F.col("_tag")).groupBy("mark").agg(F.min("text").alias("text"))
    texts = common.table(texts)

    def run(batches):
        common.drop_cache()
        known: dict[int, np.ndarray] = {}

        def of(mark: int, text) -> np.ndarray:
            if mark not in known:
                if len(known) >= 64:
                    known.clear()
                known[mark] = shingles(text.as_buffer().to_pybytes())
            return known[mark]

        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            good = [alike(of(a, x), of(b, y)) for a, b, x, y in zip(u, v, batch.column("tu"), batch.column("tv"))]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
        known.clear()
        common.trim()

    one = left.join(texts.select(F.col("mark").alias("u"), F.col("text").alias("tu")), "u")
    two = one.join(texts.select(F.col("mark").alias("v"), F.col("text").alias("tv")), "v").select("u", "v", "tu", "tv")
    out = common.checkpoint(two.mapInArrow(run, "u long, v long"))
    common.forget(first, left, texts)
    return out


def indexed(uniq: DataFrame) -> DataFrame:
    """Pairs (u, v) of marks: each with the smallest of its component in the byte index of fingerprints."""
    fps = common.checkpoint(uniq.groupBy("fp").agg(F.min("mark").alias("least")))
    linked = simhash.roots_of(fps, "fp", simhash.components(simhash.links(fps.select("fp")))).select("fp", F.col("component_id").alias("u"))
    return uniq.select("mark", "fp").join(linked, "fp").where("mark <> u").select("u", F.col("mark").alias("v"))


def placed(rows: DataFrame, roots: DataFrame, mark: str, comp: str) -> DataFrame:
    """rows with the component of a mark."""
    at = roots.select(F.col("node").alias(mark), F.col("root").alias(comp))
    return rows.join(at, mark, "left").withColumn(comp, F.coalesce(comp, mark))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, tag, root (the smallest mark that links reach), component_id of every document."""
    common.prepare(docs.sparkSession)
    rows = common.table(sets(docs, common_shingles(docs, docs.count())))
    uniq = common.table(rows.groupBy("mark").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("tag", "fp", "n", "s0", "s1", "s2", "s3", "bits", "keys"))))
    slim = common.table(rows.select("doc_id", "tag", "mark"))
    common.forget(rows)
    rows, roots = uniq.select(F.explode("keys").alias("key"), "mark"), None
    for r in range(ROUNDS):
        # Marks are hashes: turned by bits of the key and round, they come in another order.
        turn = F.lit(0).cast("long") if r == 0 else F.xxhash64("key", F.lit(r))
        now = rows if roots is None else placed(rows, roots, "mark", "comp")
        own = F.col("mark") if roots is None else F.col("comp")
        named = now.groupBy("key").agg(F.min(F.col("mark").bitwiseXOR(turn)).alias("hub"), F.min(own).alias("x"), F.max(own).alias("y")).where("x < y").select("key", F.col("hub").bitwiseXOR(turn).alias("hub"))
        named = common.table(named)
        before, rows = rows, common.table(rows.join(named, "key", "left_semi"))
        if roots is None:
            at = rows.withColumn("comp", F.col("mark")).join(named.withColumn("hub_comp", F.col("hub")), "key")
        else:
            at = placed(rows, roots, "mark", "comp").join(common.checkpoint(placed(named, roots, "hub", "hub_comp")), "key")
        at = at.where("comp <> hub_comp").select(F.col("hub").alias("u"), F.col("mark").alias("v"))
        if roots is None:
            pairs = at.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
            roots = simhash.components(verified(docs, uniq, pairs.unionByName(indexed(uniq)).distinct()))
        else:
            more = verified(docs, uniq, at.distinct())
            joins = not more.isEmpty()
            roots = simhash.merged(roots, more) if joins else roots
        common.forget(named, *([before] if r else []))
        if r and not joins:
            break

    # Keys whose texts are of several components still.
    at = common.table(placed(rows, roots, "mark", "comp"))
    open_keys = common.checkpoint(at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key"))
    rest = common.table(at.join(open_keys, "key", "left_semi").join(uniq.select("mark", "n", "s0", "s1", "s2", "s3"), "mark"))
    a, b = rest.alias("a"), rest.alias("b")
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.mark") < F.col("b.mark")) & (F.col("a.comp") != F.col("b.comp")) & may_be_alike("a", "b"))
    more = verified(docs, uniq, more.select(F.col("a.mark").alias("u"), F.col("b.mark").alias("v")).distinct())
    roots = simhash.merged(roots, more)
    found = common.table(simhash.roots_of(uniq.select("mark", "least"), "mark", roots))
    common.forget(uniq, rows, at, rest)
    return slim.join(found, "mark")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those similar to another: of each component one document with the smallest doc_id stays, as in simhash."""
    return simhash.first_of(docs, linked(docs.select("doc_id", "text")))
