"""Quality by importance resampling of hashed n-grams.

Two bag-of-n-grams models over hashed words and word pairs: one of target text, one of
all raw text. The log weight of a document is the log ratio of both models, summed over
its n-grams. A document's Gumbel noise, seeded by its id and text, is added, and the k documents
with the largest sums are the sample (Gumbel top-k: sampling without replacement in
proportion to the weights). k is the share of good rows among the labelled ones times all
documents, unless given. The k-th largest sum is found by radix selection: counts of 2^16 buckets,
four times, so nothing is sorted or gathered.

A word's hash is the first 31 bits of its MD5; a pair's follows from those of its words, so that
SQL can repeat both.

Bounds: the target model is fitted to at most TARGET_DOCS good labelled documents, in the
order of the MD5 of their ids; the raw model counts every whole text.

Defined results: a null or empty text has log weight 0; very long texts count whole; a null doc_id, or one that is no number, is sampled like any
other; repeated rows, and others with equal sums, are taken or left together; without labels half of the documents are taken; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, TARGET_DOCS, CACHE_WORDS = 10_000, 5000, 500_000
#: A pair's hash is its first word's hash times STEP plus its second word's, modulo PRIME.
STEP, PRIME = 40_503, (1 << 31) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4]) >> 1
        return h


def grams(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts, then of the pairs; and the text of each."""
    split = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    h = np.fromiter(map(common.only_cache("gram hashes", _Hashes).__getitem__, common.flat(split)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    inner = text[1:] == text[:-1]
    pair = ((h[:-1] * STEP + h[1:]) % PRIME)[inner]
    return np.concatenate([h, pair]) % buckets, np.concatenate([text, text[1:][inner]])


def counts(docs: DataFrame, target_ids: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket of all documents, and of those in target_ids (a bounded table with id)."""

    def run(batches):
        both = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            target = np.array(batch.column("target").to_pylist(), bool)
            for s in common.chunks(texts):
                bucket, text = grams(texts[s], buckets)
                both[0] += np.bincount(bucket, minlength=buckets)
                both[1] += np.bincount(bucket[target[s][text]], minlength=buckets)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "raw", "target"])

    common.prepare(docs.sparkSession)
    marked = common.with_text(docs, common.doc_id()).join(F.broadcast(target_ids), F.col("doc_id") == F.col("id"), "left")
    found = marked.select("text", F.col("id").isNotNull().alias("target")).mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # one row a bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def noise(doc_id: int | None, text: bytes | None) -> float:
    seed = f"{'null' if doc_id is None else doc_id}:{hashlib.md5(text or b'').hexdigest()}"
    u = (int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return -math.log(-math.log(u))


def weights(docs: DataFrame, ratio: np.ndarray, most: int | None = None) -> DataFrame:
    """doc_id, log_weight, noisy (log weight with Gumbel noise), place (as a long in the same order)."""

    def run(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        bucket, text = grams(texts, len(ratio))
        log = np.bincount(text, ratio[bucket], len(texts)).astype(float)
        if most is not None:
            log *= most / np.maximum(np.bincount(text, minlength=len(texts)), most)
        noisy = log + np.array([noise(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]) + 0.0
        bits = noisy.view(np.int64)
        place = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (log, noisy, place))], ["doc_id", "log_weight", "noisy", "place"])

    common.prepare(docs.sparkSession)
    return common.with_text(docs, common.doc_id()).mapInArrow(common.per_chunk(run), "doc_id long, log_weight double, noisy double, place long")


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a column of longs (k from 1 to the number of rows)."""
    prefix = 0
    unsigned = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    for shift in (48, 32, 16, 0):
        bucket = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        within = df if shift == 48 else df.where(F.shiftrightunsigned(unsigned, shift + 16) == prefix)
        for r in within.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():  # at most 2^16 rows
            if k <= r["count"]:
                prefix = prefix << 16 | r.b
                break
            k -= r["count"]
    return prefix - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, most: int | None = None) -> DataFrame:
    """The sampled documents: doc_id, log_weight, noisy.

    most: beyond so many n-grams the log weight is their mean times `most`; None: always the sum.
    """
    known = labels.select(F.col("doc_id").try_cast("long").alias("id"), F.col("quality").try_cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("id").isNotNull())
    if share is None:
        share = known.agg(F.avg("quality")).first()[0]
        share = 0.5 if share is None else share
    good = known.where("quality = 1").select("id").distinct().orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(TARGET_DOCS)
    raw, target = counts(docs, good, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.any() else np.zeros(buckets)
    scored = common.checkpoint(weights(docs, ratio, most))
    k = math.floor(share * scored.count() + 0.5)
    found = scored.where(F.col("place") >= kth_largest(scored, "place", k)) if k else scored.where("false")
    return found.select("doc_id", "log_weight", "noisy")


#: DuckDB SQL for the query: sample() over documents and labels, sums rounded to 6 digits.
ORACLE = """
with d as (
  select row_number() over () as r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
h as (select r, i, ('0x' || substr(md5(word), 1, 8))::bigint // 2 as h from w),
p as (select r, h, lead(h) over (partition by r order by i) as after from h),
g as (select r, h % {buckets} as b from p union all select r, (h * {step} + after) % {prime} % {buckets} from p where after is not null),
known as (select doc_id as id, quality from labels where quality in (0, 1) and doc_id is not null),
good as (select id from (select distinct id from known where quality = 1) order by md5(id::varchar), id limit {docs}),
t as (select r from d where doc_id in (select id from good)),
raw as (select b, count(*) as n, count(*) filter (r in (select r from t)) as m from g group by b),
total as (select sum(n) + {buckets} as n, sum(m) + {buckets} as m from raw),
ratio as (select b, ln((raw.m + 1) / total.m) - ln((raw.n + 1) / total.n) as x from raw, total),
s as (
  select d.r, doc_id, coalesce((select sum(x) from g join ratio using (b) where g.r = d.r), 0) as log_weight,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5::double) / 4503599627370496 as u from d),
n as (select doc_id, log_weight, log_weight - ln(-ln(u)) as noisy from s),
k as (select floor((select avg(quality) from known) * count(*) + 0.5)::bigint as k from d)
select doc_id, round(log_weight, 6) as log_weight, round(noisy, 6) as noisy from n
where noisy >= (select min(noisy) from (select noisy from n order by noisy desc limit (select k from k)))
""".format(buckets=BUCKETS, step=STEP, prime=PRIME, docs=TARGET_DOCS)
