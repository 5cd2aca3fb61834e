"""Exact top-k search over vectors by MaxScore.

The dimensions of a query are its terms. In a shard of candidates each term has a bound,
the most that its component can add. By falling bounds the terms split: essential terms
are scored for all candidates, the others, whose bounds together cannot close the gap to
the k-th best score so far, only for candidates that may still reach it, dimension by
dimension while they may. A shard whose bounds together stay below a query's k-th best is skipped.

Candidates stay where they are: a task takes them in shards of SHARD and carries the k best of
each query from shard to shard, so what tasks hand on to be merged is at most k rows a query
and task. Queries come in rounds, each broadcast, of at most ROUND_BYTES. Their k-th best
score among a sample of SAMPLE candidates is known beforehand and is the threshold that tasks begin with.
What the sample holds changes the work only.

Defined results: vectors that are null or hold a null or non-finite component take
no part; a shorter vector, an empty one too, counts as filled up with zeros; rows with the query's own vec_id
are no candidates of it; a row without a vec_id, or with one that is no number, is no query, and comes last among ties;
equal rows are one query, and as candidates count each; scores are exact while they are
below 2^53 and else taken modulo 2^64; fewer candidates give fewer rows; an empty table
gives none; other columns are ignored. Very long vectors make smaller rounds and shards of the same number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, SAMPLE, STEP, PROBE = 8192, 4096, 2048, 8
ROUND_BYTES = 32 << 20
#: Tasks that search at least, if Spark would make fewer of a small table.
TASKS = 64
FOUND = "query_id long, vec_id long, score long, cells long, skipped long, terms long, scored long"
MISSING = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").try_cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(x.isNotNull() & ~odd)


def search(query: np.ndarray, candidates: np.ndarray, ids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], k: int, threshold: float = -np.inf, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best that reach the threshold, and how many components were scored; candidates: one row a dimension; smaller ids win ties; own: no candidate."""
    upper = np.maximum(query * bounds[0], query * bounds[1])
    lower = np.minimum(query * bounds[0], query * bounds[1])
    order = np.argsort(lower - upper, kind="stable")
    query, upper = query[order], upper[order]
    open_ = np.append(np.cumsum(upper[::-1])[::-1], 0.0)  # the most that terms from here on add
    spread = np.append(np.cumsum((upper - lower[order])[::-1])[::-1], 0.0)
    base = float(lower.sum())
    best_ids, best, scored = np.zeros(0, np.int64), np.zeros(0), 0
    for at in range(0, len(ids), STEP):
        block = candidates[:, at : at + STEP]
        # Terms that all together add less than what is missing even above the least score are not essential.
        essential = int(np.argmax(base + spread < threshold)) if base + spread[-1] < threshold else len(query)
        partial = query[:essential] @ block[order[:essential]]
        scored += essential * block.shape[1]
        alive = np.arange(block.shape[1])
        for e in range(essential, len(query) + 1, PROBE):
            fit = partial + open_[e] >= threshold
            alive, partial = alive[fit], partial[fit]
            if e < len(query) and len(alive):
                terms = slice(e, e + PROBE)
                partial = partial + query[terms] @ block[np.ix_(order[terms], alive)]
                scored += len(query[terms]) * len(alive)
            else:
                break
        fit = partial >= threshold
        if own is not None:
            fit &= ids[at + alive] != own
        best_ids, best = np.concatenate([best_ids, ids[at + alive[fit]]]), np.concatenate([best, partial[fit]])
        if len(best) > k:
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
        if len(best) == k:
            threshold = max(threshold, best.min())
    return best_ids, best, scored


def _matrix(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """Scaled and floored components, one row a vector."""
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    x = np.zeros((len(lists), width))
    x[np.arange(width) < sizes[:, None]] = np.floor(scale * lists.flatten().to_numpy())
    return x


def _wrapped(a: np.ndarray, b: np.ndarray) -> int:
    return (sum(int(x) * int(y) for x, y in zip(a, b)) + (1 << 63)) % (1 << 64) - (1 << 63)


class _Round:
    """The queries of a round, and the best that a task has found for each."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, exact: bool):
        self.ids, self.queries, self.k, self.exact = ids, queries, k, exact
        self.floors = floors.copy()
        self.positive, self.negative = np.maximum(queries, 0), np.minimum(queries, 0)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object if not exact else float))] * len(ids)
        self.cells = self.skipped = self.terms = self.scored = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """A shard of candidates."""
        self.cells += len(self.ids)
        self.terms += len(self.ids) * rows.size
        columns = np.ascontiguousarray(rows.T)
        bounds = columns.max(1), columns.min(1)
        may = self.positive @ bounds[0] + self.negative @ bounds[1] >= self.floors if self.exact else np.ones(len(self.ids), bool)
        self.skipped += int((~may).sum())
        for q in np.flatnonzero(may).tolist():
            own = int(self.ids[q])
            if self.exact:
                found, scores, n = search(self.queries[q], columns, ids, bounds, self.k, self.floors[q], own)
                self.scored += n
            else:
                other = ids != own
                found, scores = ids[other], np.array([_wrapped(self.queries[q], x) for x in rows[other]], object)
                self.scored += rows.size
            if len(found):
                found, scores = np.concatenate([self.best[q][0], found]), np.concatenate([self.best[q][1], scores])
                top = np.array(sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))[: self.k])
                self.best[q] = found[top], scores[top]
                if len(top) == self.k and self.exact:
                    self.floors[q] = max(self.floors[q], scores[top[-1]])

    def rows(self) -> pa.RecordBatch:
        """What was found, and a row without a query that counts cells and components."""
        query = [int(q) for q, (ids, _) in zip(self.ids, self.best) for _ in ids] + [None]
        ids = [None if v == MISSING else int(v) for found, _ in self.best for v in found] + [None]
        scores = [int(s) for _, found in self.best for s in found] + [None]
        counts = [[None] * (len(ids) - 1) + [n] for n in (self.cells, self.skipped, self.terms, self.scored)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, ids, scores, *counts)], [x.split()[0] for x in FOUND.split(", ")])


def searched(vectors: DataFrame, is_query: F.Column, k: int, scale: float) -> DataFrame | None:
    """What the tasks found (see _Round.rows), or None if nothing can be."""
    spark = vectors.sparkSession
    common.prepare(spark)
    # Equal rows travel as one; beyond k of them none can matter.
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    rows = common.table(rows.withColumn("is_query", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()))
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    queries, width, largest = rows.agg(F.sum(F.col("is_query").cast("long")), F.max(F.size("embedding")), F.coalesce(largest, F.lit(0.0))).first()
    if not queries:
        return None
    exact = (scale * largest + 1) ** 2 * max(1, width) < 2**53
    tasks = min(TASKS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = rows.select(F.spark_partition_id()).distinct().count() < tasks
    candidates = (rows.repartition(tasks) if few else rows).select("vec_id", "embedding", "copies")

    # Of the candidates a bounded sample, against which the queries, where they are, learn their thresholds.
    sample = rows.select("vec_id", "embedding").limit(max(k + 1, min(SAMPLE, ROUND_BYTES // (8 * max(1, width)))) if exact else 0).toArrow()
    near = spark.sparkContext.broadcast((sample["vec_id"].fill_null(MISSING).to_numpy(), _matrix(sample["embedding"].combine_chunks(), width, scale).T))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns = near.value
        for b in batches:
            own = b.column("vec_id").to_numpy()
            scores = _matrix(b.column("embedding"), width, scale) @ columns
            scores[own[:, None] == ids] = -np.inf
            floors = np.partition(scores, -k, 1)[:, -k] if len(ids) >= k else np.full(len(own), -np.inf)
            yield b.append_column("floor", pa.array(floors))

    per_round = max(1, ROUND_BYTES // (8 * max(1, width)))
    asking = rows.where("is_query").select("vec_id", "embedding").mapInArrow(seeded, "vec_id long, embedding array<double>, floor double")
    rounds = -(-queries // per_round)
    # Numbered within parts of about per_round queries by hash, so that no round holds more, and a round is read by its number.
    part = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rounds)).cast("int")
    nth = F.row_number().over(Window.partitionBy(part).orderBy("vec_id", "embedding")) - 1
    asking = common.table(asking.withColumn("round", F.floor(nth / per_round) * rounds + part))
    found = []
    for r in sorted(x[0] for x in asking.select("round").distinct().collect()):  # a row a round
        own = asking.where(F.col("round") == r).toArrow()
        shared = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), _matrix(own["embedding"].combine_chunks(), width, scale), own["floor"].to_numpy(), k, exact))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, ids, held, n = _Round(*shared.value), [], [], 0

            def close() -> None:
                if n:
                    now.add(np.concatenate(ids), np.concatenate(held))

            for b in batches:
                copies = b.column("copies").to_numpy()
                ids.append(np.repeat(b.column("vec_id").fill_null(MISSING).to_numpy(), copies))
                held.append(np.repeat(_matrix(b.column("embedding"), width, scale), copies, 0))
                n += len(ids[-1])
                if n >= SHARD:
                    close()
                    ids, held, n = [], [], 0
            close()
            yield now.rows()

        found.append(common.table(candidates.mapInArrow(task, FOUND)))
    return reduce(DataFrame.unionByName, found)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of the scaled, floored components for each query row."""
    found = searched(vectors, is_query, k, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.where("query_id is not null").select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def work(vectors: DataFrame, is_query: F.Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """One row: cells (a query and a shard), those skipped, components of all cells, components scored."""
    return searched(vectors, is_query, k, scale).where("query_id is null").agg(*(F.sum(c).alias(c) for c in ("cells", "skipped", "terms", "scored")))


#: DuckDB SQL for op8: queries are the rows whose vec_id is divisible by 100.
ORACLE = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)]), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
