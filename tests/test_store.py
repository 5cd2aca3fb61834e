import threading

import pytest
from pyspark.sql import functions as F

from tidemark import ops
from tidemark.model import PENDING, SNAPSHOT, START, Checkpoint, EventFilter, EventSchema, ReadCursor, Scope
from tidemark.operators import fold
from tidemark.operators.commands import CommandHandler, Evolve, Rejected
from tidemark.sources.store import Conflict, Lost, Store
from tidemark.streaming import delivery, projector, saga

BOOK = Scope("book")
ADDED = EventSchema("Added", "book string, n long", scopes=((BOOK, "book"),))
LENT = EventSchema("Lent", "book string, n long", scopes=((BOOK, "book"),))
EVENT = "struct<book:string,n:bigint>"


def pending(spark, *events):
    rows = [(e.get("id"), e["type"], 1, e.get("tags", []), e.get("payload", "{}"), e.get("external", False), None, i) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, f"{PENDING}, ordinal long")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_append_and_read(spark, store):
    done = store.append(pending(spark, {"type": "A", "tags": ["x:1"]}, {"type": "B", "tags": ["x:1", "y:2"], "external": True}))
    assert [(r.sequence_number, r.event_type, r.commit_group) for r in done.collect()] == [(1, "A", 1), (2, "B", 1)]
    store.append(pending(spark, {"type": "A", "tags": ["y:2"]}))
    log = store.snapshot().log
    assert [r.sequence_number for r in log.read_from(1, ordered=True).collect()] == [2, 3]
    assert [r.sequence_number for r in log.read_from(0, EventFilter.of(["A"], ["y:2", "x:9"])).collect()] == [3]
    assert log.revision(EventFilter.of(tags=["x:1"])).first().revision == 2 and log.revision(EventFilter.of(["Z"])).first().revision == 0
    assert log.cursor_at(2) == ReadCursor(1, 2) and log.cursor_at(0) == START
    assert [r.sequence_number for r in store.snapshot().outbox(99).collect()] == [1, 3]
    assert not log.held_back()


def test_conflicts(spark, store):
    f = EventFilter.of(tags=["x:1"])
    store.append(pending(spark, {"type": "A", "tags": ["x:1"]}), f, 0)
    for wrong in (0, 2):
        with pytest.raises(Conflict):
            store.append(pending(spark, {"type": "A", "tags": ["x:1"]}), f, wrong)
    store.append(pending(spark, {"type": "A", "tags": ["z:1"]}), f, 1)
    assert store.append(pending(spark), f, 99).count() == 0
    assert store.snapshot().log.rows.count() == 2


def test_ids_are_stored_once(spark, store):
    store.append(pending(spark, {"id": "e1", "type": "A", "tags": ["x:1"], "payload": "1"}))
    done = store.append(pending(spark, {"id": "e2", "type": "B", "payload": "2"}, {"id": "e1", "type": "A", "tags": ["x:2"], "payload": "9"}, {"id": "e2", "type": "C"}))
    assert [(r.event_id, r.sequence_number, r.payload) for r in done.collect()] == [("e2", 2, "2"), ("e1", 1, "9"), ("e2", 2, "{}")]
    log = store.snapshot().log
    assert [(r.event_id, r.payload) for r in log.read_from(ordered=True).collect()] == [("e1", "1"), ("e2", "2")]
    assert [r.event_id for r in log.read_from(0, EventFilter.of(tags=["x:2"])).collect()] == ["e1"]
    assert store.snapshot().outbox().count() == 2


def test_many_given_ids_and_vacuum(spark, store):
    store.append(pending(spark, *({"id": f"e{i}", "type": "A", "tags": ["x:1"]} for i in range(30))))
    done = store.append(pending(spark, *({"id": f"e{i}", "type": "B", "tags": ["x:1", "y:1"]} for i in range(20, 50))))
    assert [r.sequence_number for r in done.collect()] == list(range(21, 51))
    now = store.snapshot()
    assert now.log.rows.count() == 50 and now.log.index.count() == now.log.index.distinct().count() == 50 + 30
    assert store.vacuum(3600) == 0 and store.vacuum(-1) > 0
    assert store.snapshot().log.rows.count() == 50


def test_messages_in_the_same_commit(spark, store):
    m = spark.createDataFrame([("t", None, "p1", {"a": "b"}), ("t", "k", "p2", {})], "topic string, key string, payload string, headers map<string,string>")
    store.append(pending(spark, {"type": "A"}), messages=m)
    store.append(pending(spark), EventFilter.of(["A"]), 77, m)
    assert [(r.id, r.payload) for r in store.snapshot().messages(99).collect()] == [(1, "p1"), (2, "p2"), (3, "p1"), (4, "p2")]
    with pytest.raises(Conflict):
        store.append(pending(spark, {"type": "A"}), EventFilter.of(["A"]), 77, m)
    assert store.snapshot().messages().count() == 4


def test_one_writer_a_manifest(store):
    store.files.create(1, {"version": 1})
    with pytest.raises(Lost):
        store.files.create(1, {"version": 1})


def test_racing_writers(spark, store):
    ts = [threading.Thread(target=lambda: store.append(pending(spark, {"type": "A"}))) for _ in range(3)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert [r.sequence_number for r in store.snapshot().log.read_from(ordered=True).collect()] == [1, 2, 3]


def test_persist_with_checkpoint(spark, store):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    store.persist("t", "k string, v int", ("k",), rows, None, Checkpoint("p", ReadCursor(1, 5)), START)
    with pytest.raises(Conflict):
        store.persist("t", "k string, v int", ("k",), rows.withColumn("v", F.lit(9)), None, Checkpoint("p", ReadCursor(2, 0)), START)
    store.persist("t", "k string, v int", ("k",), rows.where("k = 'a'").withColumn("v", F.lit(7)), rows.select("k"))
    now = store.snapshot()
    assert [(r.k, r.v) for r in now.state("t", "k string, v int").collect()] == [("a", 7)]
    assert now.checkpoint("p").cursor == ReadCursor(1, 5)
    assert {(r.k, r.v) for r in store.snapshot(1).state("t", "k string, v int").collect()} == {("a", 1), ("b", 2)}


def test_snapshots_never_go_back(spark, store):
    row = lambda p: spark.createDataFrame([("s", "k", 1, p, p, "f", str(p), None)], SNAPSHOT)
    for p in (5, 3, 8):
        store.save_snapshot(row(p))
    assert store.load_snapshot("s", "k", 1).first().global_position == 8
    store.delete_snapshot("s", "k", 1)
    assert store.load_snapshot("s", "k", 1).isEmpty()


def books(name="books"):
    on = fold.on
    return fold.Projection(name, "bigint", EVENT, [on(ADDED).create(lambda e: e["n"]), on(LENT).update(lambda s, e: s - e["n"])], scopes=(BOOK,))


def event(kind, book, n=1, **more):
    return {"type": kind, "tags": [f"book:{book}"], "payload": f'{{"book":"{book}","n":{n}}}', **more}


def test_projector(spark, store):
    p = projector.Projector(store, books(), page=2)
    store.append(pending(spark, event("Added", "a", 5), event("Added", "b", 3), event("Lent", "a"), event("Other", "a")))
    p.catch_up()
    state, cursor = p.read_with_cursor()
    assert {(r.key, r.state) for r in state.collect()} == {("a", 4), ("b", 3)} and cursor == ReadCursor(1, 3)
    assert p.wait_for(ReadCursor(1, 3), 1)
    store.append(pending(spark, event("Lent", "b"), event("Lent", "zz"), event("Lent", "b")))
    p.catch_up()
    c = store.snapshot().checkpoint("books")
    assert not c.running and c.error == "state not found" and c.cursor == ReadCursor(store.snapshot().log.cursor_at(5).commit_group, 5)
    assert {(r.key, r.state) for r in p.states().collect()} == {("a", 4), ("b", 2)}
    p.catch_up()
    assert not p.wait_for(ReadCursor(99, 99), 1)
    ops.control(p, "move", 6)
    assert not store.snapshot().checkpoint("books").running and store.snapshot().checkpoint("books").error is None
    ops.control(p, "resume")
    p.catch_up()
    assert {(r.key, r.state) for r in p.states().collect()} == {("a", 4), ("b", 1)}
    assert '"projection_name": "books"' in ops.as_json(store) and "<td>books</td>" in ops.as_html(store)
    ops.control(p, "pause")
    ops.control(p, "reindex")
    assert p.states().isEmpty() and store.snapshot().checkpoint("books").cursor == START


def test_live_projections_equal_batch(spark, store, tmp_path):
    p = projector.Projector(store, books())
    store.append(pending(spark, event("Added", "a", 5)))
    projector.run_live([p], str(tmp_path / "cp"), once=True).awaitTermination(60)
    store.append(pending(spark, event("Lent", "a"), event("Added", "b", 2)))
    projector.run_live([p], str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert {(r.key, r.state) for r in p.states().collect()} == {("a", 4), ("b", 2)}
    with pytest.raises(ValueError):
        projector.run_live([p, p], str(tmp_path / "cp2"))


def test_stream_fold(spark, tmp_path):
    got: dict = {}
    schema = "key string, commit_group long, sequence_number long, value long"
    for rows in ([("a", 1, 1, 5), ("b", 1, 2, 1)], [("a", 2, 3, 7)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = projector.stream_fold(stream, "n long, total long", lambda s, r: ((s or (0, 0))[0] + 1, (s or (0, 0))[1] + r["value"]), str(tmp_path / "cp"), lambda df, _: got.update({r.key: (r.n, r.total) for r in df.collect()}))
        q.awaitTermination(60)
    assert got == {"a": (2, 12), "b": (1, 1)}


def lend(**more):
    h = CommandHandler(
        "lend", "book string, n bigint", "struct<there:boolean,left:bigint>", EVENT,
        lambda c: F.struct(F.lit(False).alias("there"), F.lit(0).cast("bigint").alias("left")),
        [(BOOK, lambda c: F.array(c["book"]))],
        [Evolve(ADDED, lambda s, e, c: F.struct(F.lit(True).alias("there"), e["n"].alias("left"))), Evolve(LENT, lambda s, e, c: F.struct(s["there"].alias("there"), (s["left"] - e["n"]).alias("left")))],
        [(lambda s, c: ~s["there"], "missing"), (lambda s, c: s["left"] < c["n"], "too-few")],
        lambda s, c: F.array().cast("array<struct<event_type:string,payload:string,tags:array<string>>>"), **more,
    )
    h.decide = lambda s, c: F.array(h.emit(LENT, F.struct(c["book"].alias("book"), c["n"].alias("n"))))
    return h


def test_commands(spark, store):
    store.append(pending(spark, event("Added", "a", 3)))
    h = lend()
    assert h.run(store, {"book": "x", "n": 1})[0] == "missing"
    rejection, done = h.run(store, {"book": "a", "n": 2})
    assert rejection is None and [(r.event_type, r.tags) for r in done.collect()] == [("Lent", ["book:a"])]
    assert h.run(store, {"book": "a", "n": 2})[0] == "too-few"
    with pytest.raises(Rejected):
        h.run_or_raise(store, {"book": "a", "n": 2})


def test_command_conflict_is_retried(spark, store, monkeypatch):
    store.append(pending(spark, event("Added", "a", 3)))
    real, calls = store.append, []

    def append(df, f=None, expected=None, messages=None):
        if not calls:
            calls.append(real(pending(spark, event("Lent", "a"))))
        return real(df, f, expected, messages)

    monkeypatch.setattr(store, "append", append)
    assert lend().run(store, {"book": "a", "n": 2})[0] is None
    assert store.snapshot().log.rows.count() == 3


def test_command_snapshots(spark, store):
    store.append(pending(spark, event("Added", "a", 9)))
    h = lend(snapshot_every=2)
    for _ in range(3):
        assert h.run(store, {"book": "a", "n": 1})[0] is None
    s = store.load_snapshot("lend", "book:a", 1).first()
    assert s and s.event_count == 2 and s.filter_fingerprint == h.fingerprint
    assert h.run(store, {"book": "a", "n": 7})[0] == "too-few"


def test_run_and_wait(spark, store, tmp_path):
    p = projector.Projector(store, books())
    store.append(pending(spark, event("Added", "a", 3)))
    with pytest.raises(TimeoutError):
        projector.run_sync(lend(), {"book": "a", "n": 1}, p, 0.1)
    q = projector.run_live([p], str(tmp_path / "cp"))
    assert projector.run_sync(lend(), {"book": "a", "n": 1}, p, 60)[0] is None
    q.stop()
    assert p.states().first().state == 1
    assert projector.run_sync(lend(), {"book": "a", "n": 9}, p)[0] == "too-few"


def test_side_effects(spark, tmp_path):
    """A projection without state sees every event once its checkpoint moves on."""
    seen: list = []
    for n in (1, 2):
        spark.createDataFrame([(n,)], "sequence_number long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sequence_number long").parquet(str(tmp_path / "in"))
        projector.each_event(stream, lambda df, _: seen.extend(r[0] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [1, 2]


def test_leases(spark, store):
    assert store.lease("p", "one", 30, 100.0) and store.lease("p", "one", 30, 110.0) and not store.lease("p", "two", 30, 120.0)
    assert store.lease("p", "two", 30, 150.0) and not store.lease("p", "one", 30, 151.0)
    store.release("p", "one")
    assert not store.lease("p", "one", 30, 152.0)
    store.release("p", "two")
    assert projector.leased(projector.Projector(store, books("p")), "one") and not projector.leased(projector.Projector(store, books("p")), "two")


def test_control_texts():
    for x in (("pause", "a:b", None), ("move", "books", 7), ("resume", "x", None)):
        assert ops.parse_control(ops.control_text(x[0], x[1], x[2])) == x
    assert [ops.parse_control(t) for t in ("", "pause", "pause:", "pause::", "move::x", "pause:1:x", "stop::x")] == [None] * 7


def test_command_definitions():
    with pytest.raises(ValueError):
        CommandHandler("x", "a int", "int", EVENT, lambda c: F.lit(0), [], [Evolve(ADDED, lambda s, e, c: s)], [], lambda s, c: F.array())
    with pytest.raises(ValueError):
        lend(emits=[EventSchema("M", "m string", scopes=((Scope("member"), "m"),))])


def test_relays(spark, store, tmp_path):
    topics = delivery.FileTopics(spark, str(tmp_path / "topics"))
    store.append(pending(spark, event("Added", "a", id="e1"), event("Lent", "a", id="e2", external=True)))
    store.enqueue(spark.createDataFrame([("m", None, str(i), {"h": str(i)}) for i in range(5)], "topic string, key string, payload string, headers map<string,string>"))
    with pytest.raises(RuntimeError):
        delivery.relay_messages(store, lambda df: (_ for _ in ()).throw(RuntimeError("down")))
    assert delivery.relay_messages(store, topics.publish, 2) == 5 and delivery.relay_messages(store, topics.publish) == 0
    assert delivery.relay_events(store, topics.publish, "events") == 1 and delivery.relay_events(store, topics.publish, "events") == 0
    got = delivery.received_messages(topics.read("m"))
    assert {(r.key, r.payload, r.headers["h"]) for r in got.collect()} == {(None, str(i), str(i)) for i in range(5)}
    other = Store(spark, str(tmp_path / "other"))
    for _ in range(2):
        delivery.ingest_events(other, topics.read("events"))
    assert [(r.event_id, r.is_external, r.tags, dict(r.headers)) for r in other.snapshot().log.read_from().collect()] == [("e1", True, ["book:a"], {})]
    assert other.snapshot().outbox().isEmpty()


def test_supervision():
    pauses, runs = [], []

    def task():
        runs.append(1)
        if len(runs) < 4:
            raise RuntimeError
        return "done"

    assert delivery.supervised(task, 1, 3, sleep=pauses.append, clock=lambda: 0.0) == "done"
    assert [int(p) for p in pauses] == [1, 2, 3]
    with pytest.raises(RuntimeError):
        delivery.supervised(lambda: (_ for _ in ()).throw(RuntimeError), tries=2, sleep=pauses.append)


def test_saga(spark, store):
    data = lambda p: F.get_json_object(p, "$.book")
    s = saga.Saga(
        "lend", "Lent", data,
        lambda p: saga.decision(saga.PENDING, data(p), [saga.message("stock", p, "reserve")], deadline=30.0),
        lambda d, r: F.when(F.get_json_object(r, "$.ok") == "true", saga.decision(saga.COMPLETED, d, events=[F.struct(F.lit("Done").alias("event_type"), F.lit("{}").alias("payload"), F.array(F.concat(F.lit("book:"), d)).alias("tags"))])).otherwise(saga.decision(saga.COMPENSATED, d)),
        lambda d: saga.decision(saga.FAILED, d),
    )
    store.append(pending(spark, event("Lent", "a"), event("Lent", "a"), event("Lent", "b"), event("Lent", "c")))
    runner = saga.SagaRunner(store, s)
    t0 = F.expr("timestamp'2024-01-01 00:00:00'")
    assert runner.start(t0) == 3 and runner.start(t0) == 0
    requests = store.snapshot().messages()
    assert requests.count() == 3
    partner = saga.Participant([("reserve", lambda p: F.when(data(p) == "a", '{"ok":"true"}').when(data(p) == "b", '{"ok":"false"}'))], {"own": "x", saga.H_SAGA: "lost"})
    replies = partner.replies(requests, t0)
    assert {(r.topic, r.headers["own"], r.headers[saga.H_SAGA]) for r in replies.collect()} == {("replies", "x", "lend")}
    assert runner.reply(replies, t0) == 2 and runner.reply(replies, t0) == 0
    assert runner.expire(t0) == 0 and runner.expire(F.expr("timestamp'2024-01-01 00:01:00'")) == 1
    assert {(r.saga_key, r.status) for r in runner.instances().collect()} == {("a", "Completed"), ("b", "Compensated"), ("c", "Failed")}
    assert store.snapshot().log.read_from(0, EventFilter.of(["Done"])).first().tags == ["book:a"]


def test_two_runners_move_an_instance_once(spark, store):
    """A reply and a deadline, decided on the same state, race: the first one moves the instance, the other one changes and sends nothing."""
    s = saga.Saga(
        "lend", "Lent", lambda p: F.get_json_object(p, "$.book"),
        lambda p: saga.decision(saga.PENDING, p, [saga.message("stock", p, "reserve")], deadline=30.0),
        lambda d, r: saga.decision(saga.COMPLETED, d, [saga.message("stock", d, "done")]),
        lambda d: saga.decision(saga.FAILED, d, [saga.message("stock", d, "failed")]),
    )
    store.append(pending(spark, event("Lent", "a"), event("Lent", "b")))
    one, two = saga.SagaRunner(store, s), saga.SagaRunner(store, s)
    t0, t1 = F.expr("timestamp'2024-01-01 00:00:00'"), F.expr("timestamp'2024-01-01 00:01:00'")
    assert one.start(t0) == 2 and two.start(t0) == 0
    replies = saga.Participant([("reserve", lambda p: F.lit('{"ok":"true"}'))]).replies(store.snapshot().messages(), t0)
    answered = saga.replied(s, replies.where(F.get_json_object(F.col("payload"), "$.ok") == "true"), one.instances(), t0)
    failed = saga.timed_out(s, saga.due(two.instances(), t1), t1)
    done: dict = {}
    ts = [threading.Thread(target=lambda k=k, r=r, x=x: done.__setitem__(k, r._apply(x))) for k, r, x in (("reply", one, answered), ("deadline", two, failed))]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert sorted(done.values()) == [0, 2]
    assert {r.status for r in one.instances().collect()} == {"Completed" if done["reply"] else "Failed"} and store.snapshot().messages().count() == 4


def test_claims_are_out_of_reach_until_they_run_out(spark, store):
    now = F.expr("timestamp'2024-01-01 00:01:00'")
    row = lambda k: (f"i{k}", "s", str(k), "Pending", 0, "{}")
    rows = spark.createDataFrame([row(k) for k in range(5)], "id string, saga_name string, saga_key string, status string, step int, data string")
    t = F.expr("timestamp'2024-01-01 00:00:00'")
    store.persist("saga_instances", saga.SAGA, ("id",), rows.withColumns({"deadline": t, "created_at": t, "updated_at": t}))
    took: list = []
    ts = [threading.Thread(target=lambda: took.extend(r.id for r in saga.claim(store, "saga_instances", "s", now, 3).collect())) for _ in range(2)]
    for x in ts:
        x.start()
    for x in ts:
        x.join()
    assert sorted(took) == [f"i{k}" for k in range(5)]
    version = store.snapshot().manifest.version
    assert saga.claim(store, "saga_instances", "s", now).isEmpty() and store.snapshot().manifest.version == version
    assert saga.claim(store, "saga_instances", "s", F.expr("timestamp'2024-01-01 00:02:00'")).count() == 5


def test_upkeep(spark, store):
    for k in range(4):
        store.append(pending(spark, {"id": f"e{k}", "type": "A", "tags": [f"x:{k}"]}))
        store.enqueue(spark.createDataFrame([("t", None, str(k), {})], "topic string, key string, payload string, headers map<string,string>"))
    store.mark_published(store.snapshot().outbox(2).select("sequence_number"))
    store.mark_sent(store.snapshot().messages(3).select("id"))
    old = store.snapshot()
    assert store.compact(9) == [] and sorted(store.compact(2)) == ["event_outbox", "log", "message_done", "message_outbox", "published", "tags"]
    now = store.snapshot()
    assert old.log.rows.count() == now.log.rows.count() == 4 and all(len(d) <= 1 for d in now.manifest.tables.values())
    assert [r.event_id for r in now.outbox(9).collect()] == ["e2", "e3"] and [r.payload for r in now.messages(9).collect()] == ["3"]
    assert store.vacuum(3600) == 0 and store.vacuum(-1) > 10
    assert store.files.versions() == [now.manifest.version] and store.snapshot().log.revision(EventFilter.of(tags=["x:3"])).first().revision == 4
    store.append(pending(spark, {"id": "e1", "type": "A"}, {"id": "e9", "type": "A"}))
    assert [r.sequence_number for r in store.snapshot().log.read_from(ordered=True).collect()] == [1, 2, 3, 4, 5]


def test_commits_that_change_nothing_leave_no_manifest(spark, store):
    store.append(pending(spark, {"type": "A"}))
    store.commit(lambda now, m: None)
    assert store.files.versions() == [1]


def test_object_stores_need_a_conditional_create(spark):
    """A file system that renames by copying is asked for a conditional create; one that knows none is refused."""
    asked: list = []

    class Builder:
        def __init__(self, knows):
            self.knows = knows

        def recursive(self):
            return self

        def overwrite(self, yes):
            assert not yes
            return self

        def must(self, option, value):
            asked.append((option, value))
            if not self.knows:
                raise ValueError("unknown option")
            return self

        def build(self):
            raise RuntimeError("FileAlreadyExistsException")

    for knows, error in ((True, Lost), (False, NotImplementedError)):
        files = Store(spark, "s3a://bucket/store").files
        files._fs = lambda path, knows=knows: (type("Fs", (), {"createFile": lambda self, p: Builder(knows)})(), path)
        with pytest.raises(error):
            files.create(1, {})
    assert asked == [("fs.option.create.conditional.overwrite", True)] * 2


def test_live_projections_wake_for_their_own_events(spark, store, tmp_path):
    both = [projector.Projector(store, books()), projector.Projector(store, fold.Projection("others", "bigint", EVENT, [fold.on(EventSchema("Other", "book string")).set(lambda e: F.lit(1).cast("bigint"))], scopes=(BOOK,)))]
    passes: list = []
    for p in both:
        real = p.catch_up
        p.catch_up = lambda p=p, real=real: (passes.append(p.name), real())
    q = projector.run_live(both, str(tmp_path / "cp"))
    store.append(pending(spark, event("Added", "a", 5)))
    assert both[0].wait_for(ReadCursor(1, 1), 60)
    q.processAllAvailable()
    assert set(passes) == {"books", "others"}  # the first time all of them
    passes.clear()
    store.append(pending(spark, event("Lent", "a")))
    q.processAllAvailable()
    assert "others" not in passes and "books" in passes
    passes.clear()
    both[1].pause()
    q.processAllAvailable()
    q.stop()
    assert "others" in passes


def test_kafka_options(spark):
    t = delivery.KafkaTopics(spark, "host:9092")
    assert t.write_options["kafka.enable.idempotence"] == "true" and t.write_options["includeHeaders"] == "true"
    assert t.read_options("x")["subscribe"] == "x" and t.read_options("x")["startingOffsets"] == "earliest"
    for f in (t.read, t.stream):  # the connector is not there
        with pytest.raises(Exception, match="(?i)kafka"):
            f("x")


def test_long_histories_by_parts(spark, store):
    for n in (5, 3):
        store.append(pending(spark, *(event("Added" if k == 0 and n == 5 else "Lent", "ab"[k % 7 == 6 and n == 3]) for k in range(n * 4)), event("Added", f"b{n}")))
    log = store.snapshot().log
    c = fold.Projection("c", "struct<n:bigint,last:bigint>", EVENT, [fold.on(ADDED, LENT, envelope=True).upsert(lambda s, e, m: F.struct((F.coalesce(s["n"], F.lit(0)) + 1).alias("n"), m["sequence_number"].alias("last")))], scopes=(BOOK,))
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(fold.fold_columns(c, log.rows))
    before = spark.createDataFrame([("a", (100, 0)), ("zz", (1, 1))], "key string, state struct<n:bigint,last:bigint>")
    for longest in (1, 4, 7, 1000):
        assert rows(fold.fold_columns(c, log.rows, longest=longest)) == whole
        assert rows(fold.fold_columns(c, log.rows, before, longest)) == rows(fold.fold_columns(c, log.rows, before))
    h = lend()
    h.rejects = []
    commands = spark.createDataFrame([(1, ("a", 1)), (2, ("a", 1)), (3, ("a", 2)), (4, ("b5", 1)), (5, ("none", 1))], "command_id int, command struct<book:string,n:bigint>")
    assert not h.folds_by_command
    want = rows(h.evaluate(log, commands))
    assert all(rows(h.evaluate(log, commands, longest=k)) == want for k in (3, 1000))
    h.evolves = [Evolve(ADDED, lambda s, e, c: F.struct(F.lit(True).alias("there"), c["n"].alias("left"))), Evolve(LENT, lambda s, e, c: F.struct(s["there"].alias("there"), (s["left"] + 1).alias("left")))]
    assert h.folds_by_command and rows(h.evaluate(log, commands, longest=3)) == rows(h.evaluate(log, commands))
