"""Steps of the store that large tables take: what they shuffle, and that they give what the plain way gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import PENDING, START, EventFilter, EventSchema, ReadCursor, Scope
from tidemark.operators import fold
from tidemark.operators.commands import CommandHandler, Evolve
from tidemark.sources.log import EventLog, nth, tag_index
from tidemark.sources.store import Store
from tidemark.streaming import projector

USER = Scope("user")
HIT = EventSchema("hit", "user long", scopes=((USER, "user"),))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def shuffled(spark, f) -> int:
    """Bytes of shuffle that f() writes."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    f()
    return total() - before


def events(spark, n: int, first: int = 0):
    """In order: hits of 50 users."""
    user = F.col("id") % 50
    payload = F.to_json(F.struct(user.alias("user")))
    tags = F.array(F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("day:"), (F.col("id") % 7).cast("string")))
    return spark.range(first, first + n, 1, 4).select(F.lit(None).cast("string").alias("event_id"), F.lit("hit").alias("event_type"), F.lit(1).alias("event_version"), tags.alias("tags"), payload.alias("payload"), F.lit(False).alias("is_external"), F.create_map().cast("map<string,string>").alias("headers"), F.col("id").alias("ordinal"))


def ordinals(store):
    """Payloads by position, which are without gaps."""
    rows = store.snapshot().log.read_from(ordered=True).select("sequence_number", "payload").collect()
    assert [r.sequence_number for r in rows] == list(range(1, len(rows) + 1))
    return [r.payload for r in rows]


def test_events_in_order_are_not_shuffled(spark, store):
    assert shuffled(spark, lambda: store.append(events(spark, 20_000))) < 20_000
    # Every other one, too, though the steps of the order are not one.
    assert shuffled(spark, lambda: store.append(events(spark, 20_000).where("hash(ordinal) % 2 = 0"))) < 20_000
    assert store.snapshot().table("tags").where("tag = 'day:3'").count() == store.snapshot().log.rows.where("array_contains(tags, 'day:3')").count() > 2857


@pytest.mark.parametrize("way", ["within", "across", "null", "double", "interleaved"])
def test_events_out_of_order(spark, store, way):
    rows = events(spark, 300).withColumn("payload", F.col("ordinal").cast("string"))
    if way == "within":
        rows, want = rows.sortWithinPartitions(F.desc("ordinal")), range(300)
    elif way == "across":
        rows, want = rows.withColumn("ordinal", (F.col("ordinal") + 150) % 300), [*range(150, 300), *range(150)]
    elif way == "null":
        rows, want = rows.withColumn("ordinal", F.when(F.col("ordinal") != 200, F.col("ordinal"))), [200, *range(200), *range(201, 300)]
    elif way == "double":
        rows, want = rows.withColumn("ordinal", -F.col("ordinal").cast("double")), range(299, -1, -1)
    else:
        rows, want = rows.repartition(3), range(300)
    store.append(rows)
    assert ordinals(store) == [str(x) for x in want]


def test_partitions_in_another_order_stay(spark, store):
    """Partitions that are in order each and don't overlap get their positions by their ranges."""
    rows = events(spark, 300).withColumn("payload", F.col("ordinal").cast("string"))
    rows = rows.where("ordinal >= 150").unionByName(rows.where("ordinal < 150"))
    assert shuffled(spark, lambda: store.append(rows)) < 10_000
    assert ordinals(store) == [str(x) for x in range(300)]


def test_repeated_ids_among_many(spark, store):
    """Known, repeated and new ids mixed, over several rows of bits; positions are without gaps, tags are complete."""
    random.seed(4)
    first = [f"e{i}" for i in range(0, 900, 3)]
    second = [f"e{random.randrange(45_000)}" for _ in range(70_000)]
    frame = lambda ids, tag: spark.createDataFrame([(x, "A", 1, [f"{tag}:{i % 3}", "all:1"], x, i % 2 == 0, None, i) for i, x in enumerate(ids)], f"{PENDING}, ordinal long")
    store.append(frame(first, "one"))
    done = store.append(frame(second, "two"))
    position, tags, external = {}, set(), {}
    for name, ids in (("one", first), ("two", second)):
        for i, x in enumerate(ids):
            at = position.setdefault(x, len(position) + 1)
            external.setdefault(at, i % 2 == 0)
            tags |= {(f"{name}:{i % 3}", at), ("all:1", at)}
    now = store.snapshot()
    assert {(r.event_id, r.sequence_number) for r in now.log.rows.select("event_id", "sequence_number").collect()} == set(position.items())
    index = [tuple(r) for r in now.table("tags").collect()]
    assert len(index) == len(set(index)) and set(index) == tags
    assert sorted(r[0] for r in now.table("event_outbox").collect()) == sorted(p for p, x in external.items() if not x)
    assert [(r.event_id, r.sequence_number) for r in done.select("event_id", "sequence_number").collect()] == [(x, position[x]) for x in second]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_pages_are_filters(spark, store):
    """The first of an order would come to one task."""
    store.append(events(spark, 6000))
    store.enqueue(spark.range(6000).select(F.lit("t").alias("topic"), F.lit(None).cast("string").alias("key"), F.col("id").cast("string").alias("payload"), F.create_map().cast("map<string,string>").alias("headers")))
    store.mark_published(store.snapshot().log.rows.where("sequence_number % 5 = 0").select("sequence_number"))
    store.mark_sent(store.snapshot().messages().where("id <= 100").select("id"))
    now = store.snapshot()
    pages = {"outbox": now.outbox(3000), "messages": now.messages(3000), "position": now.log.read_from(10, most=3000), "delivery": now.log.delivery(ReadCursor(1, 20), most=3000)}
    for name, page in pages.items():
        assert "GlobalLimit" not in plan(page) and "Sort" not in plan(page), name
    got = {n: sorted(r[0] for r in p.select("id" if n == "messages" else "sequence_number").collect()) for n, p in pages.items()}
    assert got == {"outbox": [x for x in range(1, 6001) if x % 5][:3000], "messages": list(range(101, 3101)), "position": list(range(11, 3011)), "delivery": list(range(21, 3021))}


def test_pages_of_a_log_whose_groups_cross(spark):
    rows = spark.range(1, 5001).select(F.col("id").alias("sequence_number"), F.lit("hit").alias("event_type"), F.array(F.lit("user:1")).alias("tags"), F.expr("(id div 10) ^ 1").alias("commit_group"))
    log = EventLog(rows, tag_index(rows))
    want = sorted((r.commit_group, r.sequence_number) for r in rows.collect())
    for most, at in ((1500, START), (1, ReadCursor(9, 85)), (2222, ReadCursor(9, 85)), (5000, START), (9999, START)):
        page = log.page(at, EventFilter(), most)
        behind = [x for x in want if x > (at.commit_group, at.position)][:most]
        assert sorted((r.commit_group, r.sequence_number) for r in page.events.collect()) == behind
        assert page.n == len(behind) and page.cursor == ReadCursor(*behind[-1])
    assert log.page(ReadCursor(10**6, 0), EventFilter(), 5).cursor is None


def test_nth(spark):
    values = [-7, 3, 3, 900_000_000_000, 12, -(1 << 40)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n, v in enumerate(sorted(values), 1):
        assert nth(rows, "v", n, min(values), max(values)) == (v, sum(x < v for x in values))


def test_pages_look_no_further_than_they_reach(spark, store):
    """A page's filter has an upper end, however long the log is behind it."""
    store.append(events(spark, 5000))
    page = store.snapshot().log.page(ReadCursor(1, 100), EventFilter.of(["hit"]), 50)
    assert page.n == 50 and page.cursor == ReadCursor(1, 150) and "sequence_number" in plan(page.events) and "<= 1100" in plan(page.events)
    counts = fold.Projection("counts", "bigint", "struct<user:bigint>", [fold.on(HIT).upsert(lambda s, e: F.coalesce(s, F.lit(0)) + 1)], scopes=(USER,))
    p = projector.Projector(store, counts, page=1700)
    p.catch_up()
    assert p.measured["pages"] == 3 and {tuple(r) for r in p.states().collect()} == {(str(k), 100) for k in range(50)}


def test_what_a_command_starts_from_is_computed_once(spark):
    rows = events(spark, 2000).select((F.col("ordinal") + 1).alias("sequence_number"), "event_type", "tags", "payload")
    log = EventLog(rows, tag_index(rows))
    zero = F.lit(0).cast("long")
    h = CommandHandler("c", "user bigint", "bigint", "struct<user:bigint>", lambda c: zero, [(USER, lambda c: F.array(c["user"]))], [Evolve(HIT, lambda s, e, c: s + 1)], [], lambda s, c: F.array().cast("array<struct<event_type:string,payload:string,tags:array<string>>>"))
    commands = spark.range(51).select(F.col("id").alias("command_id"), F.struct(F.col("id").alias("user")).alias("command"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    starts = spark.range(50).select(F.col("id").alias("command_id"), F.lit(1000).cast("long").alias("state"), F.lit(1000).cast("long").alias("position"), F.lit(20).cast("long").alias("events"))
    done = h.evaluate(log, commands, starts.mapInArrow(counted, starts.schema), longest=100).select("command_id", "state", "events", "revision").collect()
    assert {tuple(r) for r in done} == {(k, 1020, 40, 1951 + k) for k in range(50)} | {(50, 0, 0, 0)}
    assert seen.value == 50
