"""Registered queries of handlers, commands, the store, delivery, sagas and their operation, each with the SQL it is held against."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import ops
from tidemark.functions import codec, ids
from tidemark.model import SAGA, SNAPSHOT, START, Checkpoint, EventFilter, EventSchema, ReadCursor, Registry, Scope
from tidemark.operators import fold
from tidemark.operators.commands import CommandHandler, Evolve, Rejected
from tidemark.operators.table import Table, columns_of
from tidemark.sources.log import log_of_events
from tidemark.sources.scratch import new_folder
from tidemark.sources.store import Conflict, Lost, Store
from tidemark.streaming import delivery, projector, saga

from .catalog import ACCOUNT_SQL, EVENT, HALF, LOG, LONGEST, NOW, ORACLE_SQL, PLACE, SCHEMAS, USER, UUID3, account, all_commands, customers, half, order_saga, orders, pending, read, register, suppliers, withdrawals

on = fold.on


def counts(name: str, *types: str, **more) -> fold.Projection:
    """How many events of some types each user has."""
    return fold.Projection(name, "bigint", EVENT, [on(*(SCHEMAS[t] for t in types), **more).upsert(lambda s, e, *_: F.coalesce(s, F.lit(0)) + 1)], scopes=(USER,))


def whole(p: fold.Projection, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_columns(p, log_of_events(spark, sf_dir).rows, longest=LONGEST)


def filled(spark: SparkSession, sf_dir: str) -> Store:
    """A new store that holds all events, in one commit."""
    store = Store(spark, new_folder(spark))
    store.append(pending(spark, sf_dir, ids=False))
    return store


def failures(done: DataFrame) -> DataFrame:
    """Counts, with the error and the position of the first failing event of each key, if there is one."""
    return done.select("key", F.coalesce("state", F.lit(0)).alias("n"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("position", F.lit(-1)).cast("long").alias("position"))


def refused(f) -> bool:
    """Whether f() raises ValueError."""
    try:
        f()
    except ValueError:
        return True
    return False


# --- handlers -------------------------------------------------------------------


@register(
    "envelope_projection",
    f"""with l as (select *, {PLACE} as place from events)
    select cast(user_id as varchar) as key, count(*) as n, arg_max(event_id + 1, place) as position, strftime(arg_max(ts, place), '%Y-%m-%d %H:%M:%S') as recorded,
           'day:' || strftime(arg_max(ts, place), '%Y-%m-%d') as day_tag, arg_max(event_type = 'error', place) as is_external from l group by 1""",
)
def _(spark, sf_dir):
    """State functions that see the metadata: number of events, and place, time, tag and origin of the last one."""
    state = "struct<n:bigint,position:bigint,recorded:timestamp,day_tag:string,is_external:boolean>"
    seen = lambda s, e, m: F.struct((F.coalesce(s["n"], F.lit(0)) + 1).alias("n"), m["sequence_number"].alias("position"), m["recorded_at"].alias("recorded"), m["tags"][1].alias("day_tag"), m["is_external"].alias("is_external"))
    p = fold.Projection("seen", state, EVENT, [on(*SCHEMAS.values(), envelope=True).upsert(seen)], scopes=(USER,))
    return whole(p, spark, sf_dir).select("key", "state.n", "state.position", F.date_format("state.recorded", "yyyy-MM-dd HH:mm:ss").alias("recorded"), "state.day_tag", "state.is_external")


@register("handle_projection", "select cast(user_id as varchar) as key, count(*) % 4 as n from events where event_type = 'click' group by 1 having count(*) % 4 > 0")
def _(spark, sf_dir):
    """A state that its own function removes: every fourth click."""
    step = lambda s, e: F.when(F.coalesce(s, F.lit(0)) < 3, F.coalesce(s, F.lit(0)) + 1)
    p = fold.Projection("fours", "bigint", EVENT, [on(SCHEMAS["click"]).handle(step)], scopes=(USER,))
    return whole(p, spark, sf_dir).where("state is not null").select("key", F.col("state").alias("n"))


@register(
    "rejecting_projection",
    f"""with l as (select user_id, value, event_id + 1 as pos, {PLACE} as place, row_number() over (partition by user_id order by {PLACE}) as r from events where event_type = 'purchase'),
    bad as (select *, case when value > 90 then 'too large' when r > 3 then 'too many' end as error from l),
    f as (select user_id, min(place) as place, arg_min(error, place) as error, arg_min(pos, place) as position from bad where error is not null group by 1)
    select cast(l.user_id as varchar) as key, count(*) filter (f.place is null or l.place < f.place) as n, coalesce(any_value(f.error), '') as error, coalesce(any_value(f.position), -1) as position from l left join f on l.user_id = f.user_id group by 1""",
)
def _(spark, sf_dir):
    """Rules before the operation; the first that holds stops the key."""
    h = on(SCHEMAS["purchase"]).upsert(lambda s, e: F.coalesce(s, F.lit(0)) + 1).reject((lambda s, e: e["value"] > 90, "too large"), (lambda s, e: s >= 3, "too many"))
    done = whole(fold.Projection("limited", "bigint", EVENT, [h], scopes=(USER,)), spark, sf_dir)
    return failures(done)


@register("family_projection", "select cast(user_id as varchar) as key, count(*) as n from events where event_type in ('click', 'view', 'error') group by 1")
def _(spark, sf_dir):
    """One operation for a family of events."""
    return whole(counts("family", "click", "view", "error"), spark, sf_dir).select("key", F.col("state").alias("n"))


@register("widened_projection", "select cast(user_id as varchar) as key, count(*) as n from events where event_type = 'signup' group by 1")
def _(spark, sf_dir):
    """A projection of one type over a log of all: other events drop out."""
    return whole(counts("signups", "signup"), spark, sf_dir).select("key", F.col("state").alias("n"))


@register(
    "payload_mismatch",
    f"""with l as (select user_id, event_id + 1 as pos, {PLACE} as place, cast(json_extract(props, '$.k') as bigint) % 5 = 0 as broken from events where event_type = 'view'),
    f as (select user_id, min(place) as place, arg_min(pos, place) as position from l where broken group by 1)
    select cast(l.user_id as varchar) as key, count(*) filter (f.place is null or l.place < f.place) as n, case when any_value(f.place) is not null then 'payload does not fit' else '' end as error, coalesce(any_value(f.position), -1) as position
    from l left join f on l.user_id = f.user_id group by 1""",
)
def _(spark, sf_dir):
    rows = log_of_events(spark, sf_dir).rows
    broken = F.get_json_object("payload", "$.k").cast("long") % 5 == 0
    rows = rows.withColumn("payload", F.when(broken, F.lit("[1]")).otherwise(F.col("payload")))
    return failures(fold.fold_columns(counts("views", "view"), rows, longest=LONGEST))


@register(
    "list_state",
    f"""with l as (select *, cast(json_extract(props, '$.k') as bigint) as k, {PLACE} as place from events),
    p as (select user_id, k, place, exists (select 1 from l e where e.user_id = p.user_id and e.event_type = 'error' and e.k = p.k and e.place > p.place) as gone from l p where event_type = 'purchase')
    select cast(user_id as varchar) as key, coalesce(string_agg(k, ',' order by place) filter (not gone), '') as held from p group by 1""",
)
def _(spark, sf_dir):
    """A state that is a list: purchases append, errors take their value out."""
    add = lambda s, e: F.array_append(F.coalesce(s, F.array().cast("array<bigint>")), e["k"])
    take = lambda s, e: F.filter(s, lambda x: x != e["k"])
    p = fold.Projection("held", "array<bigint>", EVENT, [on(SCHEMAS["purchase"]).upsert(add), on(SCHEMAS["error"]).handle(take)], scopes=(USER,))
    return whole(p, spark, sf_dir).where("state is not null").select("key", F.array_join(F.col("state").cast("array<string>"), ",").alias("held"))


@register("states_after_each_event", f"select cast(user_id as varchar) as key, event_id + 1 as position, row_number() over (partition by user_id order by {PLACE}) as n from events where event_type = 'purchase'")
def _(spark, sf_dir):
    done = fold.fold_steps(counts("purchases", "purchase"), log_of_events(spark, sf_dir).rows)
    return done.select("key", F.col("sequence_number").alias("position"), F.col("state").alias("n"))


def stopping(name: str) -> fold.Projection:
    """Fails at a purchase of a user without a signup."""
    return fold.Projection(name, "bigint", EVENT, [on(SCHEMAS["signup"]).set(lambda e: F.lit(1).cast("long")), on(SCHEMAS["purchase"]).update(lambda s, e: s + 1)], scopes=(USER,))


#: States before the first event that fails; place orders the events.
STOPPED = """with l as (select user_id, event_type, event_id + 1 as pos, {place} as place from events where event_type in ('signup', 'purchase')),
    f as (select min(place) as stop from (select *, max(place) filter (event_type = 'signup') over (partition by user_id order by place) as s from l) where s is null),
    b as (select * from l, f where stop is null or place < stop),
    u as (select user_id, max(place) filter (event_type = 'signup') as s from b group by 1),
    states as (select cast(user_id as varchar) as key, (select count(*) from b where b.user_id = u.user_id and b.place > u.s) + 1 as n from u)
    """


@register("replayed_page", STOPPED.format(place=PLACE) + " select key, n, (select arg_max(pos, place) from b) as cursor_position from states")
def _(spark, sf_dir):
    """A page that fails is folded again up to the failing event, for all keys."""
    out = fold.project(stopping("page"), log_of_events(spark, sf_dir).rows.where(F.col("event_type").isin("signup", "purchase")))
    at = None if out.cursor is None else out.cursor.position  # no cursor: the first event fails, and no state is left
    return out.states.select("key", F.col("state").alias("n"), F.lit(at).cast("long").alias("cursor_position"))


@register("refused_definitions", "select unnest(['no handler', 'type twice', 'no key', 'scope not declared', 'event evolves twice', 'no shared scope', 'key assigned', 'assigned twice', 'nothing set', 'negative limit', 'order in a delete', 'names twice', 'version 0']) as rule, true as refused")
def _(spark, sf_dir):
    """Definitions and pages that are refused before anything runs."""
    day = EventSchema("day", "x int", scopes=((Scope("day"), "x"),))
    up = on(SCHEMAS["click"]).upsert(lambda s, e: F.lit(1).cast("long"))
    command = lambda evolves: CommandHandler("c", "user_id bigint", "bigint", EVENT, lambda c: F.lit(1).cast("long"), [(USER, lambda c: F.array(c["user_id"]))], evolves, [], lambda s, c: F.array())
    c = customers(spark, sf_dir)
    update = lambda: c.update({"c_custkey": 1})
    p = counts("same", "click")
    cases = {
        "no handler": lambda: fold.Projection("x", "bigint", EVENT, [], scopes=(USER,)), "type twice": lambda: fold.Projection("x", "bigint", EVENT, [up, up], scopes=(USER,)),
        "no key": lambda: fold.Projection("x", "bigint", EVENT, [up]), "scope not declared": lambda: fold.Projection("x", "bigint", EVENT, [on(day).upsert(lambda s, e: F.lit(1).cast("long"))], scopes=(USER,)),
        "event evolves twice": lambda: command([Evolve(SCHEMAS["click"], None), Evolve(SCHEMAS["click"], None)]), "no shared scope": lambda: command([Evolve(day, lambda s, e, c: s)]),
        "key assigned": lambda: update().set("c_custkey", 2), "assigned twice": lambda: update().set("c_name", "a").set("c_name", "b"), "nothing set": lambda: update().run(),
        "negative limit": lambda: c.query().with_limit(-1).run(), "order in a delete": lambda: c.delete_where(lambda q: q.where("c_nationkey").equal_to(1).order_by("c_name")),
        "names twice": lambda: projector.run_live([projector.Projector(None, p), projector.Projector(None, p)], ""), "version 0": lambda: EventSchema("x", "a int", 0),
    }
    return spark.createDataFrame([(rule, refused(f)) for rule, f in cases.items()], "rule string, refused boolean")


# --- commands -------------------------------------------------------------------


@register(
    "commands_scoped",
    """with c as (select distinct user_id, cast(user_id % 100 as double) as amount from events)
    select c.user_id, count(*) filter (event_type = 'purchase' and value >= amount) as large, count(*) filter (event_type = 'click') as own, count(*) filter (event_type = 'view') as every from c join events e on c.user_id = e.user_id group by 1""",
)
def _(spark, sf_dir):
    """Events that count by a condition with the command, by a shared scope, and in any case."""
    bump = lambda which: lambda s, e, c: F.struct(*((s[n] + (1 if n == which else 0)).alias(n) for n in ("large", "own", "every")))
    zero = F.lit(0).cast("long")
    h = CommandHandler(
        "look", "user_id bigint, amount double", "struct<large:bigint,own:bigint,every:bigint>", EVENT, lambda c: F.struct(zero.alias("large"), zero.alias("own"), zero.alias("every")), [(USER, lambda c: F.array(c["user_id"]))],
        [Evolve(SCHEMAS["purchase"], bump("large"), when=lambda e, c: e["value"] >= c["amount"]), Evolve(SCHEMAS["click"], bump("own"), within=(USER,)), Evolve(SCHEMAS["view"], bump("every"), all_events=True)],
        [], lambda s, c: F.array().cast("array<struct<event_type:string,payload:string,tags:array<string>>>"),
    )
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    asked = users.select(F.col("user_id").alias("command_id"), F.struct("user_id", (F.col("user_id") % 100).cast("double").alias("amount")).alias("command"))
    return h.evaluate(log_of_events(spark, sf_dir), asked, longest=LONGEST).select("command.user_id", "state.large", "state.own", "state.every")


def decided(done: DataFrame) -> DataFrame:
    return done.select("command.user_id", "revision", "events", F.round("state.spent", 2).alias("spent"), "rejection", F.size("emitted").alias("emitted"))


EVALUATED = ORACLE_SQL["evaluate_commands"].replace(", case when known and spent >= amount then 'user:' || user_id end as emitted_tag", "")


@register("commands_resumed", EVALUATED)
def _(spark, sf_dir):
    """From the states that the first half of the log gives; only what is behind them is folded."""
    log, h, asked = log_of_events(spark, sf_dir), withdrawals(), all_commands(spark, sf_dir)
    n = half(spark, sf_dir)
    first = h.evaluate(type(log)(log.rows.where(F.col("sequence_number") <= n), log.index.where(F.col("sequence_number") <= n)), asked, longest=LONGEST)
    starts = first.where("events > 0").select("command_id", "state", F.col("revision").alias("position"), "events")
    return decided(h.evaluate(log, asked, starts, longest=LONGEST))


@register("legacy_commands", EVALUATED.replace("max(event_id) + 1 as rev, count(*) as events from events group by 1", "max(event_id) filter (event_type in ('signup', 'purchase', 'error')) + 1 as rev, count(*) filter (event_type in ('signup', 'purchase', 'error')) as events from events group by 1"))
def _(spark, sf_dir):
    """Handlers that read the types they evolve by only."""
    h = withdrawals()
    h.all_event_types = False
    return decided(h.evaluate(log_of_events(spark, sf_dir), all_commands(spark, sf_dir), longest=LONGEST))


@register("command_run", "select * from (values ('known', null, 1, 1), ('unknown', 'unknown', 0, 0), ('raised', 'unknown', 0, 0), ('appended', null, 1, 0)) v(command, rejection, appended, messages)")
def _(spark, sf_dir):
    """Single commands against a store with all events: one is accepted and brings a message, two are rejected."""
    store, h = filled(spark, sf_dir), withdrawals()
    before = store.snapshot().log.rows.count()
    known = read(spark, sf_dir, "events").where("event_type = 'signup'").agg(F.max_by("user_id", "event_id")).first()[0]
    note = spark.createDataFrame([("notes", None, "done", {})], "topic string, key string, payload string, headers map<string,string>")
    rows = []
    rejection, done = h.run(store, {"user_id": known, "amount": 0.0}, note)
    rows.append(("known", rejection, done.count(), store.snapshot().messages().count()))
    rejection, done = h.run(store, {"user_id": -1, "amount": 0.0}, note)
    rows.append(("unknown", rejection, 0 if done is None else done.count(), store.snapshot().messages().count() - 1))
    try:
        h.run_or_raise(store, {"user_id": -1, "amount": 0.0})
    except Rejected as e:
        rows.append(("raised", str(e), 0, 0))
    rows.append(("appended", None, store.snapshot().log.rows.count() - before, 0))
    return spark.createDataFrame(rows, "command string, rejection string, appended int, messages int")


@register("command_snapshots", f"{LOG} select user_tag as snapshot_key, max(sequence_number) as global_position, count(*) as event_count from log where user_id <> (select min(user_id) from log) group by 1")
def _(spark, sf_dir):
    """One of every user; those that would go back change nothing, and one is deleted."""
    store = Store(spark, new_folder(spark))
    e = log_of_events(spark, sf_dir).rows.groupBy(F.col("tags")[0].alias("key")).agg(F.max("sequence_number").alias("p"), F.count("*").alias("n"))
    row = lambda p: e.select(F.lit("users").alias("snapshot_id"), F.col("key").alias("snapshot_key"), F.lit(1).alias("snapshot_version"), p.alias("global_position"), F.col("n").alias("event_count"), F.lit("f").alias("filter_fingerprint"), F.lit("{}").alias("payload"), F.current_timestamp().alias("updated_at"))
    store.save_snapshot(row(F.col("p")))
    store.save_snapshot(row(F.col("p") - 1))
    least = read(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    store.delete_snapshot("users", f"user:{least}", 1)
    return store.snapshot().state("command_snapshots", SNAPSHOT).select("snapshot_key", "global_position", "event_count")


@register("command_and_projection", "select 'own' as reader, count(*) filter (event_type = 'purchase') + 1 as n from events where user_id = (select arg_max(user_id, event_id) from events where event_type = 'signup')")
def _(spark, sf_dir):
    """A command whose caller waits until the projection has its event."""
    store, h = filled(spark, sf_dir), withdrawals()
    known = read(spark, sf_dir, "events").where("event_type = 'signup'").agg(F.max_by("user_id", "event_id")).first()[0]
    p = projector.Projector(store, counts("purchases_read", "purchase"))
    p.catch_up()
    runs = threading.Event()
    worker = threading.Thread(target=lambda: [p.catch_up() for _ in iter(lambda: runs.wait(0.2), True)])
    worker.start()
    try:
        projector.run_sync(h, {"user_id": known, "amount": 0.0}, p, 120.0)
    finally:
        runs.set()
        worker.join()
    return p.states().where(F.col("key") == str(known)).select(F.lit("own").alias("reader"), F.col("state").alias("n"))


# --- the store ------------------------------------------------------------------


@register("stored_tag_index", f"{LOG} , again as (select 'again:' || k as tag, sequence_number from log where event_type = 'signup') select tag, count(*) as n, max(sequence_number) as last from (select * from tags union all select * from again) group by 1")
def _(spark, sf_dir):
    """Events that come again under other tags keep their row and are found under those, too."""
    store = Store(spark, new_folder(spark))
    store.append(pending(spark, sf_dir))
    again = pending(spark, sf_dir, "event_type = 'signup'")
    for _ in range(2):
        store.append(again.withColumn("tags", F.array(F.concat(F.lit("again:"), F.get_json_object("payload", "$.k")))))
    return store.snapshot().table("tags").groupBy("tag").agg(F.count("*").alias("n"), F.max("sequence_number").alias("last"))


@register("events_with_messages", "select * from (select 'first' as append_, count(*) as events, count(distinct user_id) as messages, false as conflict from events union all select 'wrong revision', count(*), count(distinct user_id), true from events union all select 'messages alone', count(*), 2 * count(distinct user_id), false from events)")
def _(spark, sf_dir):
    """Events and messages of one commit; a conflict leaves both out, and without events none is looked for."""
    store = Store(spark, new_folder(spark))
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    notes = users.select(F.lit("users").alias("topic"), F.col("user_id").cast("string").alias("key"), F.lit("{}").alias("payload"), F.create_map().cast("map<string,string>").alias("headers"))
    rows = []

    def attempt(name: str, where: str, expected: int | None) -> None:
        conflict = False
        try:
            store.append(pending(spark, sf_dir, where, ids=False), EventFilter(), expected, notes)
        except Conflict:
            conflict = True
        now = store.snapshot()
        rows.append((name, now.log.rows.count(), now.messages().count(), conflict))

    attempt("first", "true", 0)
    attempt("wrong revision", "true", 0)
    attempt("messages alone", "false", 0)
    return spark.createDataFrame(rows, "append_ string, events long, messages long, conflict boolean")


@register("store_compacted", f"{LOG} select event_type, count(*) as n, sum(sequence_number)::bigint as positions, count(*) filter (not is_external and sequence_number > {HALF}) as waiting from log group by 1")
def _(spark, sf_dir):
    """Four commits and a mark, then one folder a table, and nothing of what was delivered in the outbox."""
    store, n = Store(spark, new_folder(spark)), half(spark, sf_dir)
    for k in range(4):
        store.append(pending(spark, sf_dir, f"sequence_number > {k * n // 2} and sequence_number <= {(k + 1) * n // 2 if k < 3 else 4 * n + 4}", ids=False))
    store.mark_published(store.snapshot().outbox().where(F.col("sequence_number") <= n).select("sequence_number"))
    store.compact(folders=1)
    store.vacuum(-1)
    now = store.snapshot()
    assert all(len(now.manifest.tables[t]) <= 1 for t in now.manifest.tables)
    waiting = now.outbox().groupBy("event_type").agg(F.count("*").alias("waiting"))
    per = now.log.rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("sequence_number").alias("positions"))
    return per.join(waiting, "event_type", "left").fillna(0, ["waiting"])


@register("start_up_check", """select unnest(['event_outbox', 'log', 'message_outbox', 'tags']) as "table", true as whole""")
def _(spark, sf_dir):
    """Whether the stored files have all columns."""
    store = filled(spark, sf_dir)
    store.enqueue(spark.createDataFrame([("t", None, "p", {})], "topic string, key string, payload string, headers map<string,string>"))
    return store.check()


@register("one_writer", "select unnest(['first', 'second', 'after']) as writer, unnest([true, false, true]) as committed")
def _(spark, sf_dir):
    """Of two writers of one manifest one succeeds; the other's commit comes behind it."""
    store = Store(spark, new_folder(spark))
    rows = []
    for name in ("first", "second"):
        try:
            store.files.create(1, store.snapshot(None if name == "first" else 1).manifest.__dict__ | {"version": 1})
            rows.append((name, True))
        except Lost:
            rows.append((name, False))
    store.enqueue(spark.createDataFrame([("t", None, "p", {})], "topic string, key string, payload string, headers map<string,string>"))
    rows.append(("after", store.snapshot().manifest.version == 2))
    return spark.createDataFrame(rows, "writer string, committed boolean")


@register("message_outbox", "select o_orderpriority as topic, case when o_orderstatus <> 'F' then cast(o_orderkey as varchar) end as key, cast(o_totalprice as varchar) as payload, o_orderstatus as status from orders")
def _(spark, sf_dir):
    """Messages of all orders through the outbox to topics and back, page by page."""
    o = orders(spark, sf_dir).rows
    store, topics = Store(spark, new_folder(spark)), delivery.FileTopics(spark, new_folder(spark))
    store.enqueue(o.select(F.col("o_orderpriority").alias("topic"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("key"), F.col("o_totalprice").cast("string").alias("payload"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("headers")))
    delivery.relay_messages(store, topics.publish, o.count() // 2 + 1)
    got = [delivery.received_messages(topics.read(r[0])) for r in o.select("o_orderpriority").distinct().collect()]
    out = got[0]
    for more in got[1:]:
        out = out.unionByName(more)
    return out.select("topic", "key", "payload", F.col("headers")["status"].alias("status"))


@register("relayed_events", f"{LOG} select event_type, user_tag, day_tag, count(*) as n from log where not is_external group by 1, 2, 3")
def _(spark, sf_dir):
    """Events leave a store's outbox and come into another one, twice; there they are external and go no further."""
    store, topics, other = filled(spark, sf_dir), delivery.FileTopics(spark, new_folder(spark)), Store(spark, new_folder(spark))
    most = half(spark, sf_dir) + 1
    while delivery.relay_events(store, topics.publish, "events", most):
        pass
    for _ in range(2):
        delivery.ingest_events(other, topics.read("events"))
    rows = other.snapshot().log.rows.where("is_external")
    assert other.snapshot().outbox().isEmpty()
    return rows.groupBy("event_type", F.col("tags")[0].alias("user_tag"), F.col("tags")[1].alias("day_tag")).agg(F.count("*").alias("n"))


@register("row_key_mismatch", "select s_suppkey, s_name || '!' as s_name, s_nationkey, s_acctbal, true as refused from supplier")
def _(spark, sf_dir):
    """Rows under their own keys are written; one under another's fails."""
    t = suppliers(spark, sf_dir)
    named = t.rows.withColumn("s_name", F.concat("s_name", F.lit("!")))
    fails = False
    try:
        t.upsert_keyed(named.withColumn("key", F.struct((F.col("s_suppkey") + 1).alias("s_suppkey")))).rows.count()
        t.upsert_keyed(named.withColumn("key", F.struct((F.col("s_suppkey") + 1).alias("s_suppkey")))).rows.collect()
    except Exception as e:
        fails = "stored under" in str(e)
    return t.upsert_keyed(named.withColumn("key", F.struct("s_suppkey"))).rows.withColumn("refused", F.lit(fails))


@register("column_names", "select c_custkey as cust_key, c_name as name, cast(c_acctbal as decimal(12, 2)) as account_balance from customer")
def _(spark, sf_dir):
    """Fields as columns under snake-case or given names, with their types."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custKey"), F.col("c_name").alias("theName"), F.col("c_acctbal").cast("decimal(12,2)").alias("accountBalance"))
    return rows.select(*columns_of("custKey bigint, theName string, accountBalance decimal(12,2)", {"theName": "name"}))


# --- projectors -----------------------------------------------------------------


@register("projection_stopped", STOPPED.format(place="event_id") + " select (select max(pos) from b) as position, (select stop is null from f) as running, (select case when stop is not null then 'state not found' end from f) as error, count(*) as n_keys, sum(n)::bigint as total from states")
def _(spark, sf_dir):
    """A projection that a failing event stops: what was before it is kept, with the checkpoint there."""
    store = filled(spark, sf_dir)
    p = projector.Projector(store, stopping("stopped"), page=half(spark, sf_dir) + 1)
    p.catch_up()
    c = store.snapshot().checkpoint("stopped")
    states = p.states().agg(F.count("*").alias("n_keys"), F.sum("state").alias("total"))
    at = None if c.cursor == START else c.cursor.position  # nothing is before a first event that fails
    return states.select(F.lit(at).cast("long").alias("position"), F.lit(c.running).alias("running"), F.lit(c.error).alias("error"), "n_keys", "total")


@register("projection_control", "select unnest(['pause::last', 'resume::last', 'move:10:last', 'reindex::last', 'none']) as request, unnest([0, n, n, n, n]) as n_keys from (select count(distinct user_id) as n from events where event_type = 'view')")
def _(spark, sf_dir):
    """Control by texts; the last of several checkpoints stands."""
    store = filled(spark, sf_dir)
    p = projector.Projector(store, fold.Projection("last", "double", EVENT, [on(SCHEMAS["view"]).set(lambda e: e["value"])], scopes=(USER,)))
    rows = []
    for text in (ops.control_text("pause", "last"), ops.control_text("resume", "last"), ops.control_text("move", "last", 10), ops.control_text("reindex", "last"), "none"):
        if parsed := ops.parse_control(text):
            ops.control(p, parsed[0], parsed[2])
        p.catch_up()
        rows.append((text, p.states().count()))
    return spark.createDataFrame(rows, "request string, n_keys long")


@register("checkpoint_conflict", "select true as conflict, count(distinct user_id) as n_keys, count(*) as total from events where event_type = 'click'")
def _(spark, sf_dir):
    """A page whose checkpoint was moved meanwhile is not committed but read again, and no event counts twice."""
    store = filled(spark, sf_dir)
    p = projector.Projector(store, counts("clicks", "click"))
    real = store.persist

    def once(*args, **kwargs):
        store.persist = real
        other = projector.Projector(store, counts("clicks", "click"))
        other.catch_up()
        return real(*args, **kwargs)

    store.persist = once
    p.catch_up()
    return p.states().agg(F.lit(p.measured["conflicts"] == 1).alias("conflict"), F.count("*").alias("n_keys"), F.sum("state").alias("total"))


@register("held_back_released", ACCOUNT_SQL.format(place=PLACE))
def _(spark, sf_dir):
    """What a horizon withholds comes with the next page, in order, once."""
    rows, p = log_of_events(spark, sf_dir).rows, account()
    states, cursor = None, ReadCursor()
    for horizon in (80, 100_000_000):
        log = log_of_events(spark, sf_dir, horizon=horizon)
        page = log.read_for_projection(cursor, EventFilter.of(p.seen))
        assert page.held_back == (horizon == 80 and not rows.where(F.col("event_type").isin(*p.seen) & (F.col("commit_group") >= 80)).isEmpty())
        done = fold.fold_columns(p, page.events, states, LONGEST).select("key", "state")
        last = page.events.agg(F.max(F.struct("commit_group", "sequence_number")).alias("x")).first().x
        cursor = ReadCursor(*last) if last else cursor
        states = done if states is None else Table(states, ("key",)).upsert(done).rows
    return states.where("state is not null").select("key", "state.n", F.round("state.total", 2).alias("total"))


@register("live_projections", "select 'clicks' as projection, cast(user_id as varchar) as key, count(*) as n from events where event_type = 'click' group by 2 union all select 'views', cast(user_id as varchar), count(*) from events where event_type = 'view' group by 2")
def _(spark, sf_dir):
    """Two projections in one streaming query, restarted from its checkpoint; each wakes for its own types of events."""
    store, place = Store(spark, new_folder(spark)), new_folder(spark)
    both = [projector.Projector(store, counts("live_clicks", "click")), projector.Projector(store, counts("live_views", "view"))]
    for types in (("click", "error"), ("view",)):
        store.append(pending(spark, sf_dir, f"event_type in {types + ('',)}", ids=False))
        projector.run_live(both, place, once=True).awaitTermination()
    named = [p.states().select(F.lit(name).alias("projection"), "key", F.col("state").alias("n")) for p, name in zip(both, ("clicks", "views"))]
    return named[0].unionByName(named[1])


@register("side_effects", "select event_type, count(*) as n, sum(event_id)::bigint as events from events group by 1")
def _(spark, sf_dir):
    """A projection without state writes what it sees."""
    schema, out = read(spark, sf_dir, "events").schema, new_folder(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t")
    projector.each_event(stream, lambda df, batch: df.select("event_id", "event_type").write.mode("overwrite").parquet(f"{out}/rows/{batch}"), f"{out}/checkpoint").awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


@register("checkpoints_listed", "select * from (values ('a', 3, 7, true, null), ('b', 0, -1, false, 'broken'), ('c', 1, 1, true, null)) v(projection_name, commit_group, global_position, running, error)")
def _(spark, sf_dir):
    store = Store(spark, new_folder(spark))
    for c in (Checkpoint("c", ReadCursor(9, 9)), Checkpoint("b", running=False, error="broken"), Checkpoint("a", ReadCursor(3, 7)), Checkpoint("c", ReadCursor(1, 1))):
        store.save_checkpoint(c)
    return ops.checkpoints(store)


@register("checkpoints_rendered", """select '[{"projection_name": "<p>", "commit_group": 2, "global_position": 5, "running": false, "error": "x & y"}]' as json_text, '<td>&lt;p&gt;</td><td>2</td><td>5</td><td>paused</td><td>x &amp; y</td>' as cells""")
def _(spark, sf_dir):
    store = Store(spark, new_folder(spark))
    store.save_checkpoint(Checkpoint("<p>", ReadCursor(2, 5), False, "x & y"))
    cells = ops.as_html(store).partition("</th></tr><tr>")[2].partition("</tr>")[0]
    return spark.createDataFrame([(ops.as_json(store), cells)], "json_text string, cells string")


@register("control_texts", "select * from (values ('pause::a:b', 'pause', 'a:b', null), ('move:7:books', 'move', 'books', '7'), ('resume::x', 'resume', 'x', null), ('move::x', null, null, null), ('pause:1:x', null, null, null), ('stop::x', null, null, null)) v(text, action, name, position)")
def _(spark, sf_dir):
    texts = ("pause::a:b", "move:7:books", "resume::x", "move::x", "pause:1:x", "stop::x")
    parsed = [(t, *(ops.parse_control(t) or (None, None, None))) for t in texts]
    return spark.createDataFrame([(t, action, name, None if at is None else str(at)) for t, action, name, at in parsed], "text string, action string, name string, position string")


@register("leases", "select * from (values (1, 'one', true), (2, 'two', false), (3, 'one', true), (4, 'two', true), (5, 'one', false)) v(step, holder, held)")
def _(spark, sf_dir):
    """The lease of a name goes to another holder once it has run out."""
    store = Store(spark, new_folder(spark))
    asked = (("one", 100.0), ("two", 110.0), ("one", 120.0), ("two", 151.0), ("one", 152.0))
    return spark.createDataFrame([(k, who, store.lease("p", who, 30.0, now)) for k, (who, now) in enumerate(asked, 1)], "step int, holder string, held boolean")


@register("backoff", "select unnest([1, 2, 3, 4, 5]) as run, unnest([1, 2, 3, 1, 2]) as pause")
def _(spark, sf_dir):
    """Pauses double up to the most, and begin anew after a calm run."""
    pauses, clock, runs = [], [0.0], []

    def task():
        runs.append(1)
        clock[0] += 100.0 if len(runs) == 4 else 0.0
        if len(runs) <= 5:
            raise RuntimeError

    delivery.supervised(task, 1.0, 3.0, 60.0, sleep=pauses.append, clock=lambda: clock[0])
    return spark.createDataFrame([(k, int(p)) for k, p in enumerate(pauses, 1)], "run int, pause int")


@register("measured_appends", "select count(*) as events, 1 as appends, 1 as conflicts, 2 as pages, count(*) filter (event_type = 'click') as projected from events")
def _(spark, sf_dir):
    store = Store(spark, new_folder(spark))
    measured = ops.Measured(store)
    measured.append(pending(spark, sf_dir, ids=False), EventFilter(), 0)
    try:
        measured.append(pending(spark, sf_dir, ids=False), EventFilter(), 0)
    except Conflict:
        pass
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'").count()
    p = projector.Projector(store, counts("measured", "click"), page=clicks // 2 + 1)
    p.catch_up()
    c = measured.counts
    return spark.createDataFrame([(c["events"], c["appends"], c["conflicts"], int(p.measured["pages"]), int(p.measured["events"]))], "events long, appends int, conflicts int, pages int, projected long")


# --- sagas ----------------------------------------------------------------------


def t0():
    return F.expr(NOW)


def started_store(spark: SparkSession, sf_dir: str) -> tuple[Store, saga.SagaRunner]:
    store = filled(spark, sf_dir)
    runner = saga.SagaRunner(store, order_saga(), batch=64)
    runner.start(t0())
    return store, runner


def answers(requests: DataFrame) -> DataFrame:
    """Every second user is refused."""
    user = F.get_json_object("payload", "$.user_id").cast("long")
    partner = saga.Participant([("reserve", lambda p: F.when(F.get_json_object(p, "$.user_id").cast("long") % 2 == 0, '{"ok":"true"}').otherwise('{"ok":"false"}'))], {"own": "x", saga.H_SAGA: "lost"})
    return partner.replies(requests.where(user.isNotNull()), t0())


@register(
    "saga_advanced",
    "with u as (select distinct user_id from events where event_type = 'purchase') select cast(user_id as varchar) as saga_key, case when user_id % 2 = 0 then 'Completed' else 'Compensated' end as status, 1 as step, (select count(*) from u) as moved, 0 as again, (select count(*) + count(*) filter (user_id % 2 <> 0) from u) as messages from u",
)
def _(spark, sf_dir):
    """Replies move instances once: what comes again, or for a step that is over, changes nothing and sends nothing."""
    store, runner = started_store(spark, sf_dir)
    replies = answers(store.snapshot().messages())
    late = saga.replied(runner.saga, replies, runner.instances(), t0())
    moved, again = runner.reply(replies, t0()), runner.reply(replies, t0()) + runner._apply(late)
    sent = store.snapshot().messages().count()
    return runner.instances().select("saga_key", "status", "step", F.lit(moved).cast("long").alias("moved"), F.lit(again).alias("again"), F.lit(sent).cast("long").alias("messages"))


@register("saga_claimed", "select row_number() over (order by o_orderdate, lpad(cast(o_orderkey as varchar), 20, '0')) as nth, o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1996-01-01' order by nth limit 128")
def _(spark, sf_dir):
    """Two claims take the first and the second page of what is due; both pages are out of reach until the claims run out."""
    store, now = Store(spark, new_folder(spark)), F.expr("timestamp'1996-01-01'")
    o = read(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 20, "0")
    i = o.select(key.alias("id"), F.lit("orders").alias("saga_name"), F.col("o_orderkey").cast("string").alias("saga_key"), F.when(F.col("o_orderstatus") == "O", saga.PENDING).otherwise(saga.COMPLETED).alias("status"), F.lit(0).alias("step"), F.lit("{}").alias("data"), F.col("o_orderdate").cast("timestamp").alias("deadline"), now.alias("created_at"), now.alias("updated_at"))
    store.persist("orders", SAGA, ("id",), i)
    before = saga.due(store.snapshot().state("orders", SAGA), now, 1 << 30).count()
    pages = [saga.claim(store, "orders", "orders", now).select("id") for _ in range(2)]
    assert saga.due(store.snapshot().state("orders", SAGA), now, 1 << 30).count() == max(0, before - 128)
    both = pages[0].withColumn("page", F.lit(0)).unionByName(pages[1].withColumn("page", F.lit(1)))
    ranked = both.join(i.select("id", F.col("deadline").alias("was")), "id")
    nth = F.row_number().over(Window.orderBy("page", "was", "id"))  # two pages
    return ranked.select(nth.cast("long").alias("nth"), F.col("id").cast("long").alias("o_orderkey"))


@register("saga_timed_out", "select cast(user_id as varchar) as saga_key, case when user_id % 2 = 0 then 'Completed' else 'Failed' end as status, 1 as step from (select distinct user_id from events where event_type = 'purchase')")
def _(spark, sf_dir):
    """Deadlines fail what has no answer; answers that come after them are too late."""
    store, runner = started_store(spark, sf_dir)
    replies = answers(store.snapshot().messages())
    runner.reply(replies.where(F.get_json_object("payload", "$.ok") == "true"), t0())
    runner.batch = 100_000
    runner.expire(F.expr("timestamp'2024-06-01 00:01:00'"))
    runner.reply(replies, t0())
    return runner.instances().select("saga_key", "status", "step")


@register("participant_replies", f"select {UUID3} as key, 'replies' as topic, case when user_id % 2 = 0 then 'true' else 'false' end as ok, 'order' as saga_name, {UUID3} || ':0:0:reserve' as idempotency_key, 'x' as own from (select user_id, md5('order:' || user_id) as h from events where event_type = 'purchase' group by user_id)")
def _(spark, sf_dir):
    """Answers by request type; the request's correlation headers win over the partner's own."""
    s = saga.started(order_saga(), log_of_events(spark, sf_dir).rows, spark.createDataFrame([], saga.SAGA), t0())
    h = F.col("headers")
    return answers(s.messages).select("key", "topic", F.get_json_object("payload", "$.ok").alias("ok"), h[saga.H_SAGA].alias("saga_name"), h[saga.H_KEY].alias("idempotency_key"), h["own"].alias("own"))


# --- codecs and values ------------------------------------------------------------


@register("legacy_codec", "select event_id, case when event_id % 3 > 0 then 'view: version ' || (event_id % 3 + 1) || ' is newer than 1' end as decode_error, case when event_id % 3 = 0 then value end as value from events where event_type = 'view'")
def _(spark, sf_dir):
    """Without upcasters only version 1 is read."""
    e = read(spark, sf_dir, "events").where("event_type = 'view'")
    log = e.select("event_id", "event_type", (F.col("event_id") % 3 + 1).cast("int").alias("event_version"), F.to_json(F.struct("value")).alias("payload"))
    schema = EventSchema("view", "value double")
    return codec.EventCodec(Registry([schema])).decoded(log, schema).select("event_id", "decode_error", "event.value")


@register("message_codec", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(spark, sf_dir):
    """A payload as text and back."""
    o = orders(spark, sf_dir).rows
    text = codec.EventCodec.encode(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    return o.select(F.from_json(text, "o_orderkey bigint, o_orderstatus string, o_totalprice double").alias("m")).select("m.*")


@register("snake_names", "select * from (values ('bookId', 'book_id'), ('HTTPStatus', 'http_status'), ('already_snake', 'already_snake'), ('aB', 'a_b')) v(name, snake)")
def _(spark, sf_dir):
    return spark.createDataFrame([(n, ids.snake_case(n)) for n in ("bookId", "HTTPStatus", "already_snake", "aB")], "name string, snake string")


@register("fingerprints", "select user_id, string_agg(length(t) || ':' || t, '' order by t) || '|4:user' as fingerprint from (select distinct user_id, event_type || '@1' as t from events) group by 1")
def _(spark, sf_dir):
    """Canonical texts of the types that each user has."""
    types = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.concat("event_type", F.lit("@1"))).alias("types"))
    return types.select("user_id", ids.fingerprint_column(F.col("types"), F.array(F.lit("user"))).alias("fingerprint"))


@register("expired_requests", "select event_id, case event_id % 3 when 0 then false when 1 then true else ts < timestamp '2024-01-15' end as expired from events")
def _(spark, sf_dir):
    """No deadline: never; one that can't be read: at once; else strictly after it."""
    deadline = F.when(F.col("event_id") % 3 == 1, "soon").when(F.col("event_id") % 3 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return read(spark, sf_dir, "events").select("event_id", ids.expired(deadline, F.expr("timestamp'2024-01-15'")).alias("expired"))

