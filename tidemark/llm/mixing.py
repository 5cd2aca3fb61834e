"""Mixing sources to target weights.

Words are summed per source; targets share a budget by weight, and a source whose share
passes its cap stops there while the excess is shared again among the others. The rate of
a source is its target over its words. A document is taken floor(rate) times, plus one
copy if its hash-seeded draw falls below the fraction of the rate. The draw of a document
depends on nothing but the document. A source's thresholds are read off its own draws (the words
below each of 2^12 steps of the draw) at the step where the extra words come
nearest to what the fraction asks for: first for documents of a LARGE-th of the source or more, then, with what those leave to
be taken, for the others, so that heavy-tailed sources keep to their targets.

Defined results: a null text has size 0, very long texts count whole; null sources are one source, the last; a source
without words has target 0 and is taken 0 times; a null doc_id, or one that is no number, draws like any other value;
repeated rows draw alike; of steps that come equally near the first counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

STEPS, LARGE, BROADCAST_SOURCES = 4096, 32, 10_000
#: Weights of the sources, by code point of their names, repeated.
WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2.0


def ranked(per: DataFrame) -> DataFrame:
    """per, a row a source, with rank: its place from 0 by code point, null last; from a sort in ranges and the counts of its parts."""
    order = F.col("source").asc_nulls_last()
    marked = per.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "mono": F.monotonically_increasing_id()})
    marked = common.checkpoint(marked)
    shifts, total = [], 0
    for r in marked.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("m")).orderBy("part").collect():  # a row a partition
        shifts += [F.lit(r.part), F.lit(total - r.m).cast("long")]
        total += r.n
    shift = F.element_at(F.create_map(*shifts), F.col("part")) if shifts else F.lit(0)
    return marked.withColumn("rank", (shift + F.col("mono")).cast("long")).drop("part", "mono")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target from a table with source and size.

    Shares below the caps are one level times the weight. The level rises, one aggregation a
    step, by what the sources above their caps leave over, until no other source passes its cap.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    words, whole = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = None, -1
    while words is not None:
        over = F.lit(False) if level is None else F.col("most") < F.lit(level) * F.col("weight")
        n, stopped, heavy = per.where(over).agg(F.count("*"), F.coalesce(F.sum("most"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == full or heavy == whole:
            break
        level, full = (words * float(budget) - stopped) / (whole - heavy), n
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def draw() -> Column:
    """0 to 2^32 - 1 from the document alone."""
    seed = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":mix"))
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """keep, source, size, draw."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*keep, F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), draw().alias("draw"))


def _bits(size: Column) -> Column:
    return F.length(F.bin(size))


def _large(bits: Column) -> Column:
    """Whether sizes of so many bits are a LARGE-th of their source at least."""
    return F.pow(F.lit(2.0), bits - 1) * LARGE >= F.col("source_size")


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, target, whole copies, and the draws below which a large document, and another, is taken once more.

    sizes: source, size, draw.
    """
    rates = targets(sizes, weights, budget, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    rates = common.checkpoint(rates)
    # At most STEPS rows a source and number of bits, whatever its documents.
    width = (1 << 32) // STEPS
    steps = sizes.groupBy("source", _bits(F.col("size")).alias("bits"), F.expr(f"draw div {width}").alias("step")).agg(F.sum("size").alias("words"))
    same = F.col("s").eqNullSafe(F.col("source"))
    known = rates.select(F.col("source").alias("s"), "source_size", "extra")
    steps = steps.join(known, same).groupBy("source", _large(F.col("bits")).alias("large"), "step", "source_size", "extra").agg(F.sum("words").alias("words"))
    kind = Window.partitionBy("source", "large")
    upto = steps.withColumn("upto", F.sum("words").over(kind.orderBy("step"))).withColumn("words", F.sum("words").over(kind))
    upto = common.checkpoint(upto)

    def nearest(rows: DataFrame, goal: Column) -> DataFrame:
        """s, step, upto and off of the step that comes nearest to the goal."""
        off = F.abs(F.col("upto") - goal)
        near = F.struct(off, F.col("step"))
        return rows.groupBy(F.col("source").alias("s")).agg(F.min_by("step", near).alias("step"), F.min_by("upto", near).alias("upto"), F.min(off).alias("off"), F.first(goal).alias("goal"))

    some = F.col("off") < F.col("goal")
    below = F.when(some, (F.col("step") + 1) * width).otherwise(F.lit(0)).cast("long")
    goal = F.col("extra") * F.col("words") / F.col("source_size")
    large = rates.join(nearest(upto.where("large and source_size > 0"), goal), same, "left")
    large = large.select("source", "source_size", "target", "whole", below.alias("below_large"), (F.col("extra") - F.when(some, F.col("upto")).otherwise(F.lit(0))).alias("rest"))
    large = common.checkpoint(large)
    left = large.select(F.col("source").alias("s"), "rest")
    others = large.join(nearest(upto.where("not large").join(left, same), F.col("rest")), same, "left")
    return others.select("source", "source_size", "target", F.col("whole").alias("copies"), "below_large", below.alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    rows = common.checkpoint(sized(docs, common.doc_id()))
    limits = common.checkpoint(thresholds(rows, weights, budget, cap))
    return _taken(rows, limits).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def _taken(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with the limits of their source, and how often each is taken; limits are a checkpointed table.

    Beyond BROADCAST_SOURCES this is a join of two tables as they stand, whose hot sources Spark splits.
    """
    few = limits.count() <= BROADCAST_SOURCES
    limits = limits.withColumnRenamed("source", "_s")
    joined = rows.join(F.broadcast(limits) if few else limits, F.col("source").eqNullSafe(F.col("_s")))
    below = F.when(_large(_bits(F.col("size"))), F.col("below_large")).otherwise(F.col("below"))
    return joined.withColumn("copies", F.col("copies") + (F.col("draw") < below).cast("long"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the columns it came with."""
    sizes = sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    limits = common.checkpoint(thresholds(sizes.drop("_row"), weights, budget, cap))
    taken = _taken(sizes, limits).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


#: DuckDB SQL for mix(), without the column copies.
ORACLE = """
with recursive rows_ as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':mix'), 1, 8)) as bigint) as draw
  from documents),
per0 as (select source, sum(size)::bigint as source_size from rows_ group by source),
per1 as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, source_size * 2.0 as most from per0),
fill as (
  select 0 as round, []::varchar[] as full_, false as null_full, (select sum(weight) from per1) as w, (select sum(source_size) * 1.5 from per1)::double as room
  union all
  select round + 1, f, n, (select coalesce(sum(weight), 0) from per1 where not (case when source is null then n else list_contains(f, source) end)),
         (select sum(source_size) * 1.5 from per1)::double - (select coalesce(sum(most), 0) from per1 where case when source is null then n else list_contains(f, source) end)::double
  from (select fill.round, fill.w as w0, fill.room as room0, fill.full_ as f0, fill.null_full as n0,
               (select coalesce(list(source), []) from per1 where source is not null and (list_contains(fill.full_, source) or most < fill.room / fill.w * weight)) as f,
               (select coalesce(bool_or(fill.null_full or most < fill.room / fill.w * weight), false) from per1 where source is null) as n
        from fill where fill.w > 0) where len(f) > len(f0) or n <> n0),
last_ as (select * from fill order by round desc limit 1),
rates as (
  select p.source, source_size, least(most, case when l.w > 0 then l.room / l.w * weight else most end)::double as target from per1 p, last_ l),
rates2 as (select *, floor(case when source_size > 0 then target / source_size else 0 end)::bigint as whole_ from rates),
rates3 as (select *, target - whole_ * source_size as extra from rates2),
steps as (
  select r.source, pow(2, length(bin(size)) - 1) * 32 >= source_size as large, draw // 1048576 as step, sum(size) as words
  from rows_ r join rates3 t on r.source is not distinct from t.source group by all),
upto as (select source, large, step, sum(words) over (partition by source, large order by step) as upto, sum(words) over (partition by source, large) as words from steps),
big as (
  select u.source as s, extra * any_value(words) / source_size as goal, arg_min(step, {'a': abs(upto - extra * words / source_size), 'b': step}) as step,
         arg_min(upto, {'a': abs(upto - extra * words / source_size), 'b': step}) as upto, min(abs(upto - extra * words / source_size)) as off
  from upto u join rates3 r on u.source is not distinct from r.source where large and source_size > 0 group by u.source, extra, source_size),
big2 as (
  select r.*, case when off < goal then (step + 1) * 1048576 else 0 end as below_large, extra - case when off < goal then upto else 0 end as rest
  from rates3 r left join big on s is not distinct from r.source),
small as (
  select u.source as s, arg_min(step, {'a': abs(upto - rest), 'b': step}) as step, min(abs(upto - rest)) as off
  from upto u join big2 b on u.source is not distinct from b.source where not large group by 1),
lim as (
  select b.*, case when off < rest then (step + 1) * 1048576 else 0 end as below from big2 b left join small on s is not distinct from b.source)
select doc_id, size, source_size, target,
       (size * (whole_ + case when draw < case when pow(2, length(bin(size)) - 1) * 32 >= source_size then below_large else below end then 1 else 0 end))::bigint as taken
from rows_ join lim on rows_.source is not distinct from lim.source
"""
