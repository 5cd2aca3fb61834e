import pytest
from pyspark.sql import functions as F

from tidemark.operators.query import PaginationError, Query, paginated
from tidemark.operators.rows import Tables
from tidemark.operators.table import Table, columns_of, flattened, nested

ROWS = [("a", "n1", None, 1, True), ("b", "n2", "x", 2, True), ("c", "n3", "y", 3, False), ("d", "n4", "x", 4, True)]


@pytest.fixture
def table(spark):
    return Table(spark.createDataFrame(ROWS, "row_id string, display_name string, note string, revision int, active boolean"), ("row_id",), frozenset({"note"}))


def ids(df):
    return [r.row_id for r in df.collect()]


def test_filters(table):
    q = table.query()
    assert ids(q.where("note").equal_to("x").and_("active").equal_to(True).order_by("row_id").run()) == ["b", "d"]
    assert ids(q.where("note").equal_to(None).run()) == ["a"]
    assert len(ids(q.where("revision").equal_to(None).run())) == 4
    assert ids(q.where("note").not_equal_to("x").run()) == ["c"]
    assert ids(q.where("note").is_in(["y", None]).order_by("row_id").run()) == ["a", "c"]
    assert ids(q.where("note").is_in([]).run()) == []
    assert ids(q.where("revision").between(3, 2).run()) == []
    assert q.where("note").is_in([]).count().first().n == 0
    with pytest.raises(ValueError):
        q.where("revision").is_null()
    with pytest.raises(ValueError):
        q.where("nowhere")


def test_long_lists_join(table):
    assert ids(table.query().where("note").is_in([None, "x", *(str(i) for i in range(3000))]).order_by("row_id").run()) == ["a", "b", "d"]


def test_order_and_pages(table):
    q = table.query()
    assert ids(q.order_by("note").order_by("row_id").run()) == ["b", "d", "c", "a"]
    assert ids(q.order_by_descending("note").order_by("row_id").run()) == ["a", "c", "b", "d"]
    assert ids(q.order_by("row_id").with_limit(2).with_offset(1).run()) == ["b", "c"]
    assert ids(q.with_limit(0).run()) == []
    assert q.with_limit(500).limit == 200
    for bad in (q.with_limit(-1), q.with_offset(-1)):
        with pytest.raises(PaginationError):
            bad.run()
        with pytest.raises(PaginationError):
            bad.count()
        with pytest.raises(PaginationError):
            q.where("row_id").is_in(bad.select("row_id")).run()
    assert q.with_limit(1).with_offset(3).count().first().n == 4
    with pytest.raises(PaginationError):
        paginated(lambda n, o: None, -1)


def test_subquery_does_not_repeat_parents(spark, table):
    child = spark.createDataFrame([("b", 1), ("b", 2), ("c", 5)], "parent string, n int")
    assert ids(table.query().where("row_id").is_in(Query(child).where("n").greater_than(0).select("parent")).order_by("row_id").run()) == ["b", "c"]


def test_count_by(table):
    assert {(r.value, r.n) for r in table.query().count_by("note").collect()} == {(None, 1), ("x", 2), ("y", 1)}


def test_lookups(spark, table):
    keys = spark.createDataFrame([("b",), ("b",), ("z",)], "row_id string")
    assert {(r.row_id, r.found, r.revision) for r in table.find_many(keys).collect()} == {("b", True, 2), ("z", False, None)}
    assert ids(table.fetch(keys)) == ["b"]


def test_writes(spark, table):
    new = spark.createDataFrame([("b", "new", None, 9, False), ("e", "n5", None, 5, True)], table.rows.schema)
    after = table.upsert(new)
    assert {(r.row_id, r.display_name) for r in after.rows.collect()} == {("a", "n1"), ("b", "new"), ("c", "n3"), ("d", "n4"), ("e", "n5")}
    after, inserted = table.insert_missing(new)
    assert ids(inserted) == ["e"] and after.rows.where("row_id = 'b'").first().display_name == "n2"
    assert set(ids(table.delete_where(lambda q: q.where("note").equal_to("x")).rows)) == {"a", "c"}
    assert ids(table.delete_where(lambda q: q).rows) == []
    for bad in (lambda q: q.with_limit(1), lambda q: q.with_offset(1), lambda q: q.order_by("row_id")):
        with pytest.raises(ValueError):
            table.delete_where(bad)
    both = table.persist(new.where("row_id = 'b'"), spark.createDataFrame([("b",), ("a",)], "row_id string"))
    assert set(ids(both.rows)) == {"b", "c", "d"}


def test_keyed_upserts(spark, table):
    rows = table.rows.where("row_id = 'b'").withColumn("note", F.lit("new"))
    good = rows.withColumn("key", F.struct("row_id"))
    assert table.upsert_keyed(good).rows.where("row_id = 'b'").first().note == "new"
    with pytest.raises(Exception, match="does not have the key"):
        table.upsert_keyed(rows.withColumn("key", F.struct(F.lit("c").alias("row_id")))).rows.collect()


def test_updates(table):
    u = table.update({"row_id": "b"}).set("revision", 7).set_when_defined("note", None)
    after, changed = u.where_equal("revision", 2).run()
    assert changed and after.rows.where("row_id = 'b'").first().revision == 7 and after.rows.where("row_id = 'b'").first().note == "x"
    assert not u.where_less_than("revision", 2).run()[1]
    assert not table.update({"row_id": "zz"}).set("revision", 1).run()[1]
    for bad in (lambda: table.update({"row_id": "b"}).set("row_id", "x"), lambda: u.set("revision", 8), lambda: table.update({"row_id": "b"}).run(), lambda: table.update({"x": 1})):
        with pytest.raises(ValueError):
            bad()


def test_key_only_table(spark):
    t = Table(spark.createDataFrame([("a",)], "id string"), ("id",))
    assert {r.id for r in t.upsert(spark.createDataFrame([("a",), ("b",)], "id string")).rows.collect()} == {"a", "b"}


def test_nested_rows(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, None)], "id int, home_city string, home_zip string")
    deep = nested(rows, "home", ["city", "zip"])
    assert [(r.id, r.home and r.home.city) for r in deep.orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert deep.where("id = 2").first().home is None
    assert [tuple(r) for r in flattened(deep, "home").orderBy("id").collect()] == [(1, "x", None), (2, None, None)]
    assert spark.createDataFrame([(1, 2)], "bookId int, HTTPStatus int").select(*columns_of("bookId int, HTTPStatus int")).columns == ["book_id", "http_status"]


def test_test_tables(spark):
    t = Tables(spark)
    users = t.create("users", "name string, age int")
    users.insert(("ann", 3), ("bob", 5), ("cid", 5))
    with pytest.raises(ValueError):
        t.create("users", "x int")
    assert users.count() == 3 and users.count(F.col("age") == 5) == 2 and users.exists(F.col("name") == "ann")
    assert users.find(F.col("age") > 4).age == 5
    assert [r.name for r in users.page(1, 1, "name").collect()] == ["bob"]
    assert users.update(F.col("name") == "ann", age=F.lit(9)) == 1 and users.find(F.col("name") == "ann").age == 9
    assert users.delete(F.col("age") == 5) == 2 and users.count() == 1
    assert [r.name for r in users.sort_by("name").collect()] == ["ann"]
    users.truncate()
    assert users.count() == 0 and t.names == ["users"]
    t.drop("users")
    assert t.names == []
