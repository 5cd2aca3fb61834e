import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import EventSchema, ReadCursor, Scope
from tidemark.operators import fold

ITEM = Scope("item")
E = {n: EventSchema(n, "id string, value long", scopes=((ITEM, "id"),)) for n in ("Created", "Added", "Replaced", "Removed", "Guarded", "Ignored")}
LOG = "commit_group long, sequence_number long, event_type string, tags array<string>, payload string"
EVENT = "struct<id:string,value:bigint>"


def log(spark, *events):
    rows = [(g, i + 1, kind, [f"item:{k}" for k in keys], '{"id":"%s","value":%d}' % (keys[0] if keys else "", v)) for i, (g, kind, keys, v) in enumerate(events)]
    return spark.createDataFrame(rows, LOG)


def strict():
    on, v = fold.on, lambda e: e["value"]
    return fold.Projection(
        "items", "bigint", EVENT,
        [on(E["Created"]).create(v), on(E["Added"]).update(lambda s, e: s + e["value"]), on(E["Replaced"]).set(v), on(E["Removed"]).delete(), on(E["Guarded"]).upsert(lambda s, e: e["value"]).reject((lambda s, e: s.isNull(), "missing"), (lambda s, e: e["value"] < 0, "negative"))],
        scopes=(ITEM,),
    )


def states(result):
    return {r.key: r.state for r in result.states.collect()}


def test_operations(spark):
    out = fold.project(strict(), log(spark, (1, "Created", ["a"], 1), (1, "Added", ["a"], 5), (1, "Created", ["b"], 1), (1, "Removed", ["b"], 0), (1, "Removed", ["z"], 0), (1, "Created", ["b"], 8), (1, "Replaced", ["c"], 4), (1, "Ignored", ["q"], 0)))
    assert out.error is None and out.cursor == ReadCursor(1, 8)
    assert states(out) == {"a": 6, "b": 8, "c": 4, "z": None}


def test_delivery_order_wins(spark):
    assert states(fold.project(strict(), log(spark, (2, "Added", ["a"], 5), (1, "Created", ["a"], 1))))["a"] == 6


@pytest.mark.parametrize(
    ("event", "error"),
    [((2, "Created", ["a"], 1), "state already exists"), ((2, "Added", ["x"], 1), "state not found"), ((2, "Guarded", ["x"], 1), "missing"), ((2, "Guarded", ["a"], -1), "negative")],
)
def test_failure_keeps_what_was_before(spark, event, error):
    """An event with two keys fails for both."""
    out = fold.project(strict(), log(spark, (1, "Created", ["a"], 1), (1, "Replaced", ["b"], 2), (2, event[1], [*event[2], "b"], event[3]), (3, "Replaced", ["b"], 9)))
    assert out.error == error and out.cursor == ReadCursor(1, 2) and states(out) == {"a": 1, "b": 2}


def test_first_event_fails(spark):
    out = fold.project(strict(), log(spark, (1, "Added", ["a"], 1)))
    assert out.error and out.cursor is None and states(out) == {}


def test_resumes_from_states(spark):
    before = spark.createDataFrame([("a", 10)], "key string, state long")
    assert states(fold.project(strict(), log(spark, (1, "Added", ["a"], 1)), before)) == {"a": 11}


def test_definitions():
    on = fold.on
    with pytest.raises(ValueError):
        fold.Projection("x", "bigint", EVENT, [])
    with pytest.raises(ValueError):
        fold.Projection("x", "bigint", EVENT, [on(E["Added"]).delete(), on(EventSchema("y", "id string", aliases=("Added",))).delete()], scopes=(ITEM,))
    with pytest.raises(ValueError):
        fold.Projection("x", "bigint", EVENT, [on(E["Added"]).delete()])
    with pytest.raises(ValueError):
        fold.Projection("x", "bigint", EVENT, [on(E["Added"]).delete()], scopes=(Scope("other"),))


def test_metadata_keys_and_families(spark):
    p = fold.Projection("n", "bigint", EVENT, [fold.on(E["Created"], E["Added"], key=lambda: F.col("sequence_number") % 2).upsert(lambda s, e: F.coalesce(s, F.lit(0)) + 1)], key_type="bigint")
    assert states(fold.project(p, log(spark, (1, "Created", [], 1), (1, "Added", [], 1), (1, "Added", [], 1)))) == {0: 1, 1: 2}


def test_three_ways_agree(spark):
    rng = random.Random(3)
    events = [(rng.randint(0, 60), rng.choice(["Replaced", "Guarded", "Removed"]), [rng.choice("abcdef")], rng.randint(0, 9)) for _ in range(400)]
    df = log(spark, *events)
    on = fold.on
    p = fold.Projection("s", "struct<n:bigint,total:bigint>", EVENT, [
        on(E["Replaced"]).set(lambda e: F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))),
        on(E["Guarded"]).upsert(lambda s, e: F.struct((F.coalesce(s["n"], F.lit(0)) + 1).alias("n"), (F.coalesce(s["total"], F.lit(0)) + e["value"]).alias("total"))),
        on(E["Removed"]).delete()], scopes=(ITEM,))
    one = {r.key: (r.state.n, r.state.total) for r in fold.fold_columns(p, df).collect() if r.state}
    keyed = p.keyed(df).select("key", "commit_group", "sequence_number", "event_type", "event.value")
    two = {r.key: (r.n, r.total) for r in fold.fold_sums(fold.Sums(("Replaced",), ("Removed",), ("Guarded",), {"n": F.lit(1), "total": F.col("value")}), keyed).collect()}

    def step(s, row):
        if row["event_type"] == "Replaced":
            return (0, 0)
        return None if row["event_type"] == "Removed" else ((s or (0, 0))[0] + 1, (s or (0, 0))[1] + row["value"])

    three = {r.key: (r.n, r.total) for r in fold.fold_rows(keyed, None, step, lambda s: s and {"n": s[0], "total": s[1]}, "key string, n long, total long").collect()}
    want: dict = {}
    for g, i, kind, keys, v in sorted((g, i, kind, keys, v) for i, (g, kind, keys, v) in enumerate(events)):
        want[keys[0]] = step(want.get(keys[0]), {"event_type": kind, "value": v})
    want = {k: v for k, v in want.items() if v is not None}
    assert one == two == three == want


def test_list_valued_state(spark):
    """Reservations are appended and taken out of a list."""
    on, none = fold.on, F.array().cast("array<bigint>")
    p = fold.Projection("r", "array<bigint>", EVENT, [
        on(E["Added"]).upsert(lambda s, e: F.array_append(F.coalesce(s, none), e["value"])),
        on(E["Guarded"]).update(lambda s, e: F.filter(s, lambda x: x != e["value"]))], scopes=(ITEM,))
    assert states(fold.project(p, log(spark, (1, "Added", ["a"], 4), (1, "Added", ["a"], 5), (1, "Guarded", ["a"], 4), (2, "Added", ["a"], 6)))) == {"a": [5, 6]}


def test_widest():
    assert fold.widest(["a int, b string", "b string, c long"]) == "a int, b string, c bigint"
    with pytest.raises(ValueError):
        fold.widest(["a int", "a string"])
