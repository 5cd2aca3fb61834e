import hashlib
import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec, ids
from tidemark.model import INT_KEY, START, EventFilter, EventSchema, KeyCodec, ReadCursor, Registry, Scope, Tag


@given(st.text(st.characters(exclude_characters=":"), min_size=1), st.text())
def test_tag_round_trip(category, key):
    assert Tag.parse(str(Tag(category, key))) == Tag(category, key)


def test_tag_without_colon():
    assert Tag.parse("nothing") is None
    assert Tag.parse("a:b:c") == Tag("a", "b:c")


def test_scope_rules():
    s = Scope("book", INT_KEY)
    assert s.tag(7) == "book:7" and s.key("book:7") == 7 and s.key("member:7") is None
    with pytest.raises(ValueError):
        Scope("a:b")
    with pytest.raises(ValueError):
        Scope("a").tag("")
    with pytest.raises(TypeError):
        KeyCodec(str).decode("x")


def test_cursor_order():
    assert START < ReadCursor(0, 0) < ReadCursor(0, 9) < ReadCursor(1, 0)


def test_schema_and_registry():
    with pytest.raises(ValueError):
        EventSchema("x", "a int", 0)
    with pytest.raises(ValueError):
        Registry([EventSchema("x", "a int"), EventSchema("y", "a int", aliases=("x",))])
    assert Registry([EventSchema("x", "a int", aliases=("old",))]).find("old").name == "x"
    with pytest.raises(KeyError):
        Registry([]).find("z")
    assert EventFilter.of(tags=[Tag("a", "b")]).tags == {"a:b"}


@pytest.mark.parametrize(("name", "want"), [("bookId", "book_id"), ("displayTitle", "display_title"), ("HTTPStatus", "http_status"), ("id", "id"), ("a_b", "a_b"), ("address2Line", "address2_line")])
def test_snake_case(name, want):
    assert ids.snake_case(name) == want


def test_name_uuid_is_version_3(spark):
    names = [f"saga:{i}" for i in range(100)] + ["", "ünï"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.name_uuid(F.col("n")).alias("u"))
    for r in df.collect():
        digest = bytearray(hashlib.md5(r.n.encode()).digest())
        digest[6] = digest[6] & 0x0F | 0x30
        digest[8] = digest[8] & 0x3F | 0x80
        assert r.u == str(uuid.UUID(bytes=bytes(digest)))


def test_keys_of_scopes(spark):
    df = spark.createDataFrame([(["user:1", "user:2", "user:1", "day:x", "user:"],)], "tags array<string>")
    users, days = ids.scope_keys(F.col("tags"), "user"), ids.scope_keys(F.col("tags"), "day")
    r = df.select(users.alias("u"), ids.key_product(users, days).alias("p")).first()
    assert r.u == ["1", "2"] and [(x.left, x.right) for x in r.p] == [("1", "x"), ("2", "x")]


def test_idempotency_keys(spark):
    rows = [("i:1:2:a:b",), ("i:x:2:a",), ("i:1:2",), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(ids.parse_idempotency_key(F.col("t")).alias("k")).collect()]
    assert got[0].instance == "i" and got[0].round == 1 and got[0].ordinal == 2 and got[0].label == "a:b"
    assert got[1:] == [None, None, None]


def test_expiry(spark):
    rows = [(None, False), ("junk", True), ("2024-01-01 00:00:00", False), ("2023-12-31 23:59:59", True)]
    now = F.expr("timestamp'2024-01-01 00:00:00'")
    for r in spark.createDataFrame(rows, "d string, want boolean").select("want", ids.expired(F.col("d"), now).alias("got")).collect():
        assert r.got == r.want


def test_fingerprint_forms_agree(spark):
    types, scopes = [("b", 2), ("a", 1), ("b", 2)], ["y", "x"]
    one = spark.range(1).select(ids.fingerprint_column(F.array(*(F.lit(f"{t}@{v}") for t, v in types)), F.array(*map(F.lit, scopes))).alias("f")).first().f
    assert one == ids.fingerprint(types, scopes)
    assert ids.fingerprint([("a", 1)], ["x"]) != ids.fingerprint([("a", 2)], ["x"])


def test_upcast_chain_and_problems(spark):
    s = EventSchema("named", "value string", 3, ("old-named",))
    lost = EventSchema("lost", "value string", 2)
    c = codec.EventCodec(Registry([s, lost]), {"named": codec.Upcaster(s, {1: codec.rename_field("oldValue", "text"), 2: codec.rename_field("text", "value")})})
    rows = [("named", 1, '{"oldValue":"a"}'), ("old-named", 2, '{"text":"b"}'), ("named", 3, '{"value":"c"}'), ("named", 0, "{}"), ("named", 4, "{}"), ("named", 3, "no json"), ("lost", 1, "{}"), ("other", 1, "{}")]
    log = spark.createDataFrame(rows, "event_type string, event_version int, payload string")
    got = c.decoded(log, s).collect()
    assert [r.event.value if r.event else None for r in got] == ["a", "b", "c", None, None, None]
    assert [bool(r.decode_error) for r in got] == [False, False, False, True, True, True]
    errors = {(r.event_type, r.event_version): r.decode_error for r in c.checked(log).collect()}
    assert "no step" in errors["lost", 1] and "unknown" in errors["other", 1] and errors["named", 3] is None


def test_patches(spark):
    rows = [("{}", "keep", "now"), ('{"name":null}', "clear", None), ('{"name":"Alice"}', "set", "Alice")]
    df = spark.createDataFrame(rows, "p string, s string, v string")
    for r in df.select("s", "v", codec.patch_state(F.col("p"), "name").alias("a"), codec.patched(F.lit("now"), F.col("p"), "name", "string").alias("b")).collect():
        assert (r.a, r.b) == (r.s, r.v)


def test_encode(spark):
    assert spark.range(1).select(codec.EventCodec.encode(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))).alias("j")).first().j == '{"a":1}'
