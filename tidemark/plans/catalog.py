"""The registered queries over the test tables, each with the SQL it is held against.

`events` is read as a log (see sources.log.log_of_events); customer, orders, part and
supplier stand for read-model tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codec, ids
from tidemark.model import PENDING, EventFilter, EventSchema, ReadCursor, Registry, Scope
from tidemark.operators import fold
from tidemark.operators.commands import CommandHandler, Evolve
from tidemark.operators.query import Query, paginated
from tidemark.operators.table import Table, flattened, nested
from tidemark.sources.log import log_of_events
from tidemark.sources.scratch import new_folder
from tidemark.sources.store import Store
from tidemark.streaming import delivery, projector, saga

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: `log` and `tags` in DuckDB.
LOG = """
with log as (
  select event_id + 1 as sequence_number, event_type, user_id, value, cast(json_extract(props, '$.k') as bigint) as k,
         'user:' || user_id as user_tag, 'day:' || strftime(ts, '%Y-%m-%d') as day_tag, event_type = 'error' as is_external,
         xor(event_id // 10, 1) as commit_group, md5(cast(event_id as varchar)) as h from events),
tags as (select user_tag as tag, sequence_number from log union all select day_tag, sequence_number from log)
"""
SHOWN = "sequence_number, event_type, user_tag, day_tag, is_external, commit_group"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shown(log: DataFrame) -> DataFrame:
    return log.select("sequence_number", "event_type", F.col("tags")[0].alias("user_tag"), F.col("tags")[1].alias("day_tag"), "is_external", "commit_group")


def customers(spark: SparkSession, sf_dir: str) -> Table:
    """With a column that is null at times."""
    rows = read(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return Table(rows.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "segment"), ("c_custkey",), frozenset({"segment"}))


CUSTOMERS = "with c as (select c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as segment from customer)\n"
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, segment"


def orders(spark: SparkSession, sf_dir: str) -> Table:
    return Table(read(spark, sf_dir, "orders").drop("o_orderdate"), ("o_orderkey",))


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


# --- reads of the log ---------------------------------------------------------


@register("read_from_page", f"{LOG} select {SHOWN} from log where sequence_number > 500 order by sequence_number limit 200")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir).read_from(500, most=200))


@register("read_all", f"{LOG} select {SHOWN} from log")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir).read_from())


@register("read_by_types", f"{LOG} select {SHOWN} from log where event_type in ('signup', 'purchase')")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir).read_from(0, EventFilter.of(["signup", "purchase"])))


@register("read_by_tags", f"{LOG} select {SHOWN} from log l where exists (select 1 from tags t where t.sequence_number = l.sequence_number and t.tag in ('user:3', 'user:7', 'day:2024-01-02'))")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir).read_from(0, EventFilter.of(tags=["user:3", "user:7", "day:2024-01-02"])))


@register("read_by_both", f"{LOG} select {SHOWN} from log l where event_type = 'click' and exists (select 1 from tags t where t.sequence_number = l.sequence_number and t.tag in ('user:3', 'day:2024-01-02')) order by sequence_number limit 20")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir).read_from(0, EventFilter.of(["click"], ["user:3", "day:2024-01-02"]), 20))


@register("delivery_page", f"{LOG} select {SHOWN} from log where event_type in ('signup', 'view', 'error') and (commit_group > 12 or (commit_group = 12 and sequence_number > 135)) and commit_group < 80 order by commit_group, sequence_number limit 150")
def _(spark, sf_dir):
    return shown(log_of_events(spark, sf_dir, horizon=80).delivery(ReadCursor(12, 135), EventFilter.of(["signup", "view", "error"]), 150))


@register("delivery_held_back", f"{LOG} select z as horizon, (select count(*) from log where commit_group < z) as delivered, exists (select 1 from log where commit_group >= z and event_type = 'view') as held_back from (values (80), (100000000)) v(z)")
def _(spark, sf_dir):
    rows = []
    for h in (80, 100_000_000):
        log = log_of_events(spark, sf_dir, horizon=h)
        waits = log.held_back(EventFilter.of(["view"]))
        rows.append(log.delivery().agg(F.lit(h).alias("horizon"), F.count("*").alias("delivered"), F.lit(waits).alias("held_back")))
    return rows[0].unionByName(rows[1])


@register("horizon", f"{LOG} select max(commit_group) + 1 as horizon from log")
def _(spark, sf_dir):
    return spark.range(1).select(F.lit(log_of_events(spark, sf_dir).visible_below).cast("long").alias("horizon"))


@register("cursor_at", f"{LOG} select p as position, coalesce((select commit_group from log where sequence_number <= p order by sequence_number desc limit 1), 0) as commit_group, coalesce((select sequence_number from log where sequence_number <= p order by sequence_number desc limit 1), -1) as sequence_number from (values (0), (1), (777), (99999999)) v(p)")
def _(spark, sf_dir):
    log = log_of_events(spark, sf_dir)
    found = [(p, log.cursor_at(p)) for p in (0, 1, 777, 99_999_999)]
    return spark.createDataFrame([(p, c.commit_group, c.position) for p, c in found], "position int, commit_group long, sequence_number long")


@register(
    "revision",
    f"""{LOG} select 'all' as shape, coalesce(max(sequence_number), 0) as revision from log
    union all select 'types', coalesce(max(sequence_number), 0) from log where event_type in ('signup')
    union all select 'tags', coalesce(max(sequence_number), 0) from tags where tag in ('user:3', 'user:5')
    union all select 'both', coalesce(max(sequence_number), 0) from log where event_type = 'error' and user_tag in ('user:3', 'user:5')
    union all select 'none', coalesce(max(sequence_number), 0) from tags where tag = 'user:none'""",
)
def _(spark, sf_dir):
    log = log_of_events(spark, sf_dir)
    shapes = {"all": EventFilter(), "types": EventFilter.of(["signup"]), "tags": EventFilter.of(tags=["user:3", "user:5"]), "both": EventFilter.of(["error"], ["user:3", "user:5"]), "none": EventFilter.of(tags=["user:none"])}
    out = None
    for name, f in shapes.items():
        one = log.revision(f).select(F.lit(name).alias("shape"), "revision")
        out = one if out is None else out.unionByName(one)
    return out


@register("revision_by_tag", f"{LOG} select tag, max(sequence_number) as revision from tags where tag in ('user:1', 'user:2', 'user:3', 'day:2024-01-03') group by tag")
def _(spark, sf_dir):
    return log_of_events(spark, sf_dir).revision_per_tag(["user:1", "user:2", "user:3", "day:2024-01-03"])


@register("read_by_position", f"{LOG} select sequence_number, event_type, false as held_back from log where sequence_number > 900 and event_type = 'view' order by sequence_number limit 50")
def _(spark, sf_dir):
    r = log_of_events(spark, sf_dir).read_by_position(900, EventFilter.of(["view"]), 50)
    return r.events.select("sequence_number", "event_type", F.lit(r.held_back).alias("held_back"))


# --- read-model queries -------------------------------------------------------


@register("table_all_enriched", "select c_custkey, c_name, count(o_orderkey) as n_orders, coalesce(max(o_totalprice), 0) as largest from customer left join orders on c_custkey = o_custkey group by 1, 2")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    table = Table(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), ("c_custkey",), enrich=lambda rows: rows.join(o, "c_custkey", "left").fillna(0, ["n_orders", "largest"]))
    return table.all()


@register("find_many", "select k.c_custkey, c_name, c_name is not null as found from (select distinct case when o_orderstatus = 'P' then o_custkey + 100000000 else o_custkey end as c_custkey from orders) k left join customer c using (c_custkey)")
def _(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 100_000_000).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return customers(spark, sf_dir).find_many(keys).select("c_custkey", "c_name", "found")


@register("fetch", f"{CUSTOMERS} select {CUSTOMER} from c where c_custkey in (select o_custkey from orders)")
def _(spark, sf_dir):
    return customers(spark, sf_dir).fetch(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@register("composite_lookup", "select o_custkey, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where (o_custkey, o_orderstatus) in (select o_custkey, o_orderstatus from orders where o_orderpriority = '1-URGENT') group by 1, 2")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return Table(per, ("o_custkey", "o_orderstatus")).fetch(o.where("o_orderpriority = '1-URGENT'"))


@register("orders_filtered", f"select {ORDER} from orders where o_orderstatus = 'P' and o_totalprice between 1000 and 200000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def _(spark, sf_dir):
    q = orders(spark, sf_dir).query().where("o_orderstatus").equal_to("P").and_("o_totalprice").between(1000, 200000)
    return q.and_("o_orderpriority").is_in(["1-URGENT", "2-HIGH", "1-URGENT"]).run()


NULL_CASES = {
    "equal_none": ("segment is null", lambda q: q.where("segment").equal_to(None)),
    "equal_none_omits": ("true", lambda q: q.where("c_nationkey").equal_to(None)),
    "not_equal": ("segment <> 'MACHINERY'", lambda q: q.where("segment").not_equal_to("MACHINERY")),
    "not_equal_none": ("segment is not null", lambda q: q.where("segment").not_equal_to(None)),
    "in_with_none": ("(segment in ('MACHINERY') or segment is null)", lambda q: q.where("segment").is_in(["MACHINERY", None])),
    "in_empty": ("false", lambda q: q.where("segment").is_in([])),
    "in_omitted": ("true", lambda q: q.where("segment").is_in(None)),
    "is_null": ("segment is null and c_nationkey = 3", lambda q: q.where("segment").is_null().and_("c_nationkey").equal_to(3)),
    "is_not_null": ("segment is not null and c_nationkey > 20", lambda q: q.where("segment").is_not_null().and_("c_nationkey").greater_than(20)),
    "between_open": ("true", lambda q: q.where("c_acctbal").between(None, 5)),
    "between_reversed": ("false", lambda q: q.where("c_acctbal").between(10, 5)),
    "when_defined": ("c_nationkey = 7", lambda q: q.when_defined(7, lambda q, v: q.where("c_nationkey").equal_to(v)).when_defined(None, lambda q, v: q.where("c_nationkey").equal_to(v))),
}


@register("null_rules", CUSTOMERS + " union all ".join(f"select '{n}' as rule, count(*) as n, coalesce(sum(c_custkey), 0)::bigint as keys from c where {sql}" for n, (sql, _) in NULL_CASES.items()))
def _(spark, sf_dir):
    out = None
    for name, (_, plan) in NULL_CASES.items():
        one = plan(customers(spark, sf_dir).query()).run().agg(F.lit(name).alias("rule"), F.count("*").alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


@register("in_many", "select o_orderkey, o_custkey from orders where o_custkey in (select range from range(0, 6000, 4))")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query().where("o_custkey").is_in(range(0, 6000, 4)).run().select("o_orderkey", "o_custkey")


@register("keyset_page", f"select {ORDER} from orders where o_orderkey > 1000 order by o_orderkey limit 50")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query().where("o_orderkey").greater_than(1000).order_by("o_orderkey").with_limit(50).run()


@register("ordered_nulls", f"{CUSTOMERS} select * from (select 'ascending' as way, {CUSTOMER} from c order by segment asc nulls last, c_custkey limit 40) union all select * from (select 'descending', {CUSTOMER} from c order by segment desc nulls first, c_custkey limit 40 offset 5)")
def _(spark, sf_dir):
    q = customers(spark, sf_dir).query()
    up = q.order_by("segment").order_by("c_custkey").with_limit(40).run()
    down = q.order_by_descending("segment").order_by("c_custkey").with_limit(40).with_offset(5).run()
    return up.withColumn("way", F.lit("ascending")).unionByName(down.withColumn("way", F.lit("descending")))


@register("limit_cap", f"select {ORDER} from orders order by o_totalprice desc, o_orderkey limit 200")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query().order_by_descending("o_totalprice").order_by("o_orderkey").with_limit(5000).run()


@register("in_subquery", f"{CUSTOMERS} select {CUSTOMER} from c where c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 100000)")
def _(spark, sf_dir):
    own = orders(spark, sf_dir).query().where("o_orderstatus").equal_to("F").and_("o_totalprice").greater_than(100000)
    return customers(spark, sf_dir).query().where("c_custkey").is_in(own.select("o_custkey")).run()


@register("in_subquery_page", f"{CUSTOMERS} select {CUSTOMER} from c where c_custkey in (select o_custkey from orders order by o_totalprice desc, o_orderkey limit 30 offset 3)")
def _(spark, sf_dir):
    own = orders(spark, sf_dir).query().order_by_descending("o_totalprice").order_by("o_orderkey").with_limit(30).with_offset(3)
    return customers(spark, sf_dir).query().where("c_custkey").is_in(own.select("o_custkey")).run()


@register("count_matching", "select count(*) as n from orders where o_orderstatus = 'O' and o_totalprice > 1000")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query().where("o_orderstatus").equal_to("O").and_("o_totalprice").greater_than(1000).order_by("o_orderkey").with_limit(3).count()


@register("count_by_priority", "select o_orderpriority as value, count(*) as n from orders group by 1")
def _(spark, sf_dir):
    return orders(spark, sf_dir).query().count_by("o_orderpriority")


@register("count_by_nullable", f"{CUSTOMERS} select segment as value, count(*) as n from c where c_nationkey between 2 and 9 group by 1")
def _(spark, sf_dir):
    return customers(spark, sf_dir).query().where("c_nationkey").between(2, 9).count_by("segment")


@register("nested_fields", "select c_custkey, n_name as home_nation, r_name as home_region, c_acctbal > 0 as positive from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def _(spark, sf_dir):
    flat = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flat = flat.select("c_custkey", (F.col("c_acctbal") > 0).alias("positive"), F.col("n_name").alias("home_nation"), F.col("r_name").alias("home_region"))
    rows = nested(flat, "home", ["nation", "region"])
    return flattened(Query(rows, ("c_custkey",), frozenset({"home"})).where("home.region").equal_to("ASIA").run(), "home")


@register("custom_page", "select p_partkey, p_brand from part order by p_partkey limit 25 offset 10")
def _(spark, sf_dir):
    return paginated(lambda n, skip: read(spark, sf_dir, "part").select("p_partkey", "p_brand").orderBy("p_partkey").offset(skip).limit(n), 25, 10)


# --- writes -------------------------------------------------------------------

SUPPLIERS = "s_suppkey, s_name, s_nationkey, s_acctbal"


def suppliers(spark: SparkSession, sf_dir: str) -> Table:
    return Table(read(spark, sf_dir, "supplier").select(*SUPPLIERS.split(", ")), ("s_suppkey",))


@register("upsert", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, s_name || '!', s_nationkey, 0.0 from supplier where s_suppkey % 3 = 0 union all select s_suppkey + 1000000, s_name, s_nationkey, s_acctbal from supplier where s_suppkey % 5 = 0")
def _(spark, sf_dir):
    t = suppliers(spark, sf_dir)
    new = t.rows.where("s_suppkey % 3 = 0").withColumns({"s_name": F.concat("s_name", F.lit("!")), "s_acctbal": F.lit(0.0)})
    return t.upsert(new.unionByName(t.rows.where("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))).rows


@register("insert_missing", "select s_suppkey + 1000000 as s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_suppkey % 4 = 0")
def _(spark, sf_dir):
    t = suppliers(spark, sf_dir)
    both = t.rows.where("s_suppkey % 4 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000).unionByName(t.rows.where("s_suppkey % 2 = 0"))
    return t.insert_missing(both)[1]


@register("delete_keys", f"select {SUPPLIERS} from supplier where s_nationkey <> 4")
def _(spark, sf_dir):
    t = suppliers(spark, sf_dir)
    return t.delete(t.rows.where("s_nationkey = 4").select("s_suppkey")).rows


@register("delete_where", f"{CUSTOMERS} select {CUSTOMER} from c where not coalesce(segment = 'MACHINERY' and c_acctbal > 100, false)")
def _(spark, sf_dir):
    return customers(spark, sf_dir).delete_where(lambda q: q.where("segment").equal_to("MACHINERY").and_("c_acctbal").greater_than(100)).rows


@register("update_where", f"{CUSTOMERS} select c_custkey, case when c_custkey = 7 and c_acctbal < 100000 then 'renamed' else c_name end as c_name, c_nationkey, c_acctbal, segment from c")
def _(spark, sf_dir):
    u = customers(spark, sf_dir).update({"c_custkey": 7}).set("c_name", "renamed").set_when_defined("c_nationkey", None).where_less_than("c_acctbal", 100000)
    return u.run()[0].rows


@register("persist", "select s_suppkey, case when s_suppkey % 6 = 0 then 'again' else s_name end as s_name, s_nationkey, s_acctbal from supplier where s_suppkey % 2 <> 0 or s_suppkey % 6 = 0")
def _(spark, sf_dir):
    t = suppliers(spark, sf_dir)
    return t.persist(t.rows.where("s_suppkey % 6 = 0").withColumn("s_name", F.lit("again")), t.rows.where("s_suppkey % 2 = 0")).rows


# --- folds --------------------------------------------------------------------

#: Events of a key that are folded as one array; longer histories go by parts.
LONGEST = 100_000
EVENT = "struct<user_id:bigint,value:double,k:bigint>"
ACCOUNT = "struct<n:bigint,total:double>"
USER, DAY = Scope("user"), Scope("day")
SCHEMAS = {n: EventSchema(n, "user_id bigint, value double, k bigint", scopes=((USER, "user_id"),)) for n in ("signup", "purchase", "error", "click", "view")}


def account(name: str = "account") -> fold.Projection:
    """signup begins anew, purchase adds, error deletes."""
    on = fold.on
    new = lambda n, total: F.struct(F.lit(n).cast("long").alias("n"), total.alias("total"))
    zero = F.lit(0.0)
    add = lambda s, e: F.struct((F.coalesce(s["n"], F.lit(0)) + 1).alias("n"), (F.coalesce(s["total"], zero) + e["value"]).alias("total"))
    return fold.Projection(name, ACCOUNT, EVENT, [on(SCHEMAS["signup"]).set(lambda e: new(0, zero)), on(SCHEMAS["purchase"]).upsert(add), on(SCHEMAS["error"]).delete()], scopes=(USER,))


ACCOUNT_SQL = """
with l as (
  select *, coalesce(max(case when event_type in ('signup', 'error') then {place} end) over (partition by user_id), -1) as reset from (select *, {place} as place from events) e)
select cast(user_id as varchar) as key, count(*) filter (event_type = 'purchase') as n, round(coalesce(sum(value) filter (event_type = 'purchase'), 0), 2) as total
from l where place >= reset group by user_id
having bool_or(place = reset and event_type = 'signup') or count(*) filter (event_type = 'purchase') > 0
"""
PLACE = "(xor(event_id // 10, 1) * 100000000000 + event_id)"


@register("account_projection", ACCOUNT_SQL.format(place=PLACE))
def _(spark, sf_dir):
    log = log_of_events(spark, sf_dir).rows
    keyed = account().keyed(log).select("key", "commit_group", "sequence_number", "event_type", "event.value")
    sums = fold.Sums(("signup",), ("error",), ("purchase",), {"n": F.lit(1), "total": F.col("value")})
    return fold.fold_sums(sums, keyed).select("key", F.col("n").cast("long").alias("n"), F.round("total", 2).alias("total"))


@register("account_projection_columns", ACCOUNT_SQL.format(place=PLACE))
def _(spark, sf_dir):
    states = fold.fold_columns(account(), log_of_events(spark, sf_dir).rows, longest=LONGEST)
    return states.where("state is not null").select("key", "state.n", F.round("state.total", 2).alias("total"))


@register("account_projection_rows", ACCOUNT_SQL.format(place=PLACE))
def _(spark, sf_dir):
    def step(state, row):
        if row["event_type"] == "signup":
            return (0, 0.0)
        if row["event_type"] == "purchase":
            n, total = state or (0, 0.0)
            return (n + 1, total + row["value"])
        return None

    keyed = account().keyed(log_of_events(spark, sf_dir).rows).select("key", "commit_group", "sequence_number", "event_type", "event.value")
    out = lambda s: None if s is None else {"n": s[0], "total": round(s[1], 2)}
    return fold.fold_rows(keyed, None, step, out, "key string, n long, total double")


@register(
    "account_projection_resumed",
    ACCOUNT_SQL.format(place=PLACE),
)
def _(spark, sf_dir):
    """In two pages, the second on the states of the first."""
    log = log_of_events(spark, sf_dir)
    p, cut = account(), ReadCursor(100, 0)
    first = fold.fold_columns(p, log.rows.where(~log.after(cut)), longest=LONGEST).select("key", "state")
    second = fold.fold_columns(p, log.rows.where(log.after(cut)), first, longest=LONGEST).select("key", "state")
    states = Table(first, ("key",)).upsert(second).rows.where("state is not null")
    return states.select("key", "state.n", F.round("state.total", 2).alias("total"))


@register("pair_projection", f"{LOG} select cast(user_id as varchar) as user_id, substr(day_tag, 5) as day, count(*) as n, max(sequence_number) as last_position from log where event_type in ('click', 'view') group by 1, 2")
def _(spark, sf_dir):
    scoped = {n: EventSchema(n, "user_id bigint", scopes=((USER, "user_id"), (DAY, "day"))) for n in ("click", "view")}
    keys = "struct<left:string,right:string>"
    # Delivery order is not position order here: the largest position so far stays.
    count = lambda s, e, m: F.struct((F.coalesce(s["n"], F.lit(0)) + 1).alias("n"), F.greatest(s["last_position"], m["sequence_number"]).alias("last_position"))
    p = fold.Projection("pairs", "struct<n:bigint,last_position:bigint>", EVENT, [fold.on(*scoped.values(), envelope=True).upsert(count)], scopes=(USER, DAY), key_type=keys)
    states = fold.fold_columns(p, log_of_events(spark, sf_dir).rows, longest=LONGEST)
    return states.select(F.col("key.left").alias("user_id"), F.col("key.right").alias("day"), "state.n", "state.last_position")


@register("last_value_projection", f"select cast(user_id as varchar) as key, arg_max(value, {PLACE}) as value, arg_max(k, {PLACE}) as k from (select *, cast(json_extract(props, '$.k') as bigint) as k from events) where event_type = 'view' group by 1")
def _(spark, sf_dir):
    view = fold.on(SCHEMAS["view"]).set(lambda e: F.struct(e["value"].alias("value"), e["k"].alias("k")))
    p = fold.Projection("last", "struct<value:double,k:bigint>", EVENT, [view], scopes=(USER,))
    return fold.fold_columns(p, log_of_events(spark, sf_dir).rows, longest=LONGEST).select("key", "state.value", "state.k")


@register("last_value_sums", f"select cast(user_id as varchar) as key, arg_max(value, {PLACE}) as value, arg_max(event_id + 1, {PLACE}) as position from events where event_type = 'view' group by 1")
def _(spark, sf_dir):
    """The same by aggregations."""
    view = fold.on(SCHEMAS["view"]).set(lambda e: e["value"])
    keyed = fold.Projection("last", "double", EVENT, [view], scopes=(USER,)).keyed(log_of_events(spark, sf_dir).rows).select("key", "commit_group", "sequence_number", "event_type", "event.value")
    return fold.fold_sums(fold.Sums(("view",), (), (), {}, {"value": F.col("value"), "position": F.col("sequence_number")}), keyed)


@register("fanned_out_keys", "select b as key, count(*) as n from (select distinct event_id, unnest([k % 5, k % 7, 9]) as b from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_type = 'click')) group by 1")
def _(spark, sf_dir):
    k = F.get_json_object("payload", "$.k").cast("long")
    h = fold.on(SCHEMAS["click"], keys=lambda: F.array(k % 5, k % 7, F.lit(9).cast("long"))).upsert(lambda s, e: F.coalesce(s, F.lit(0)) + 1)
    p = fold.Projection("fan", "bigint", EVENT, [h], key_type="bigint")
    return fold.fold_columns(p, log_of_events(spark, sf_dir).rows, longest=LONGEST).select("key", F.col("state").alias("n"))


@register(
    "projection_errors",
    f"""with l as (select user_id, event_type, event_id + 1 as pos, {PLACE} as place from events where event_type in ('signup', 'purchase')),
    f as (select *, row_number() over (partition by user_id order by place) as r, sum((event_type = 'signup')::int) over (partition by user_id order by place) as signups from l),
    bad as (select user_id, pos, place, case when event_type = 'purchase' then 'state not found' else 'state already exists' end as error
            from f where (event_type = 'purchase' and signups = 0) or (event_type = 'signup' and signups > 1))
    select cast(user_id as varchar) as key, arg_min(error, place) as error, arg_min(pos, place) as position from bad group by 1""",
)
def _(spark, sf_dir):
    on, one = fold.on, F.lit(1).cast("long")
    p = fold.Projection("strict", "bigint", EVENT, [on(SCHEMAS["signup"]).create(lambda e: one), on(SCHEMAS["purchase"]).update(lambda s, e: s + 1)], scopes=(USER,))
    return fold.fold_columns(p, log_of_events(spark, sf_dir).rows, longest=LONGEST).where("error is not null").select("key", "error", "position")


# --- commands -----------------------------------------------------------------


def withdrawals() -> CommandHandler:
    """Spends an amount if the user's purchases since the last signup allow it."""
    evolves = [
        Evolve(SCHEMAS["signup"], lambda s, e, c: F.struct(F.lit(True).alias("known"), F.lit(0.0).alias("spent"))),
        Evolve(SCHEMAS["purchase"], lambda s, e, c: F.struct(s["known"].alias("known"), (s["spent"] + e["value"]).alias("spent"))),
        Evolve(SCHEMAS["error"], None),
    ]
    h = CommandHandler(
        "withdraw", "user_id bigint, amount double", "struct<known:boolean,spent:double>", EVENT,
        lambda c: F.struct(F.lit(False).alias("known"), F.lit(0.0).alias("spent")),
        [(USER, lambda c: F.array(c["user_id"]))], evolves,
        [(lambda s, c: ~s["known"], "unknown"), (lambda s, c: s["spent"] < c["amount"], "too-little")],
        lambda s, c: F.array().cast("array<struct<event_type:string,payload:string,tags:array<string>>>"),
    )
    h.decide = lambda s, c: F.array(h.emit(SCHEMAS["purchase"], F.struct(c["user_id"].alias("user_id"), (-c["amount"]).alias("value"))))
    return h


@register(
    "evaluate_commands",
    """with c as (select user_id, cast((user_id * 37) % 200 as double) as amount from (select distinct user_id from events union all select max(user_id) + 1 from events)),
    r as (select user_id, max(event_id) filter (event_type = 'signup') as s, max(event_id) + 1 as rev, count(*) as events from events group by 1),
    b as (select c.user_id, amount, r.s is not null as known, coalesce(rev, 0) as revision, coalesce(events, 0) as events,
          coalesce((select sum(value) from events e where e.user_id = c.user_id and event_type = 'purchase' and event_id > coalesce(r.s, -1)), 0.0) as spent from c left join r on c.user_id = r.user_id)
    select user_id, revision, events, round(spent, 2) as spent, case when not known then 'unknown' when spent < amount then 'too-little' end as rejection,
           case when known and spent >= amount then 1 else 0 end as emitted, case when known and spent >= amount then 'user:' || user_id end as emitted_tag from b""",
)
def _(spark, sf_dir):
    """A command of every user, and one of a user that no event names."""
    done = withdrawals().evaluate(log_of_events(spark, sf_dir), all_commands(spark, sf_dir), longest=LONGEST)
    tag = F.when(F.size("emitted") > 0, F.get(F.get("emitted", F.lit(0))["tags"], F.lit(0)))
    return done.select("command.user_id", "revision", "events", F.round("state.spent", 2).alias("spent"), "rejection", F.size("emitted").alias("emitted"), tag.alias("emitted_tag"))


def all_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    users = e.select("user_id").distinct().unionByName(e.agg((F.max("user_id") + 1).alias("user_id")))
    return users.select(F.col("user_id").alias("command_id"), F.struct("user_id", ((F.col("user_id") * 37) % 200).cast("double").alias("amount")).alias("command"))


# --- codecs and values ---------------------------------------------------------


@register("upcast_decode", "select event_id, case when v = 1 then value when v = 2 then value * 100 else value * 100 end as cents, v as version from (select event_id, value, 1 + event_id % 3 as v from events where event_type = 'view')")
def _(spark, sf_dir):
    """Version 1 had `amount`, version 2 renamed it to `value`; version 1 values are cents already."""
    e = read(spark, sf_dir, "events").where("event_type = 'view'").withColumn("v", (F.col("event_id") % 3 + 1).cast("int"))
    payload = F.when(F.col("v") == 1, F.to_json(F.struct(F.col("value").alias("amount")))).when(F.col("v") == 2, F.to_json(F.struct(F.col("value").alias("value")))).otherwise(F.to_json(F.struct((F.col("value") * 100).alias("cents"))))
    log = e.select("event_id", "v", F.when(F.col("event_id") % 2 == 0, "viewed").otherwise("old-viewed").alias("event_type"), F.col("v").alias("event_version"), payload.alias("payload"))
    schema = EventSchema("viewed", "cents double", 3, ("old-viewed",))
    one = lambda p: F.to_json(F.struct((F.get_json_object(p, "$.amount").cast("double") / 100).alias("value")))
    two = lambda p: F.to_json(F.struct((F.get_json_object(p, "$.value").cast("double") * 100).alias("cents")))
    c = codec.EventCodec(Registry([schema]), {"viewed": codec.Upcaster(schema, {1: one, 2: two})})
    return c.decoded(log, schema).select("event_id", F.round("event.cents", 2).alias("cents"), F.col("v").alias("version"))


ORACLE_SQL["upcast_decode"] = "select event_id, round(case when event_id % 3 = 0 then value else value * 100 end, 2) as cents, cast(1 + event_id % 3 as integer) as version from events where event_type = 'view'"


@register("patches", "select event_id, case event_id % 3 when 0 then 'keep' when 1 then 'clear' else 'set' end as state, case event_id % 3 when 0 then 'old' when 1 then null else event_type end as name from events")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    payload = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, '{"name":null}').otherwise(F.to_json(F.struct(F.col("event_type").alias("name"))))
    e = e.withColumn("payload", payload)
    return e.select("event_id", codec.patch_state(F.col("payload"), "name").alias("state"), codec.patched(F.lit("old"), F.col("payload"), "name", "string").alias("name"))


@register("tag_parts", f"{LOG} select tag, substr(tag, 1, instr(tag, ':') - 1) as category, substr(tag, instr(tag, ':') + 1) as id, count(*) as n from tags group by tag")
def _(spark, sf_dir):
    parsed = log_of_events(spark, sf_dir).index.groupBy("tag").agg(F.count("*").alias("n")).withColumn("p", ids.parse_tag(F.col("tag")))
    return parsed.select("tag", "p.category", "p.id", "n")


UUID3 = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '3' || substr(h, 14, 3), substr('89ab', (('0x' || substr(h, 17, 1))::int & 3) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12))"


@register("event_ids", f"{LOG} select sequence_number, {UUID3} as event_id from log")
def _(spark, sf_dir):
    return log_of_events(spark, sf_dir).rows.select("sequence_number", "event_id")


@register("saga_instance_ids", f"select o_orderkey, {UUID3} as saga_id, {UUID3.replace('h,', 'g,')} as event_id, {UUID3} || ':2:0:reserve' as idempotency_key, 'reserve' as label from (select *, md5({UUID3} || ':2:0') as g from (select o_orderkey, md5('order:' || o_orderkey) as h from orders))")
def _(spark, sf_dir):
    o = orders(spark, sf_dir).rows.withColumn("saga_id", ids.saga_id(F.lit("order"), F.col("o_orderkey").cast("string")))
    key = ids.idempotency_key(F.col("saga_id"), F.lit(2), F.lit(0), F.lit("reserve"))
    return o.select("o_orderkey", "saga_id", ids.saga_event_id(F.col("saga_id"), F.lit(2), F.lit(0)).alias("event_id"), key.alias("idempotency_key"), ids.parse_idempotency_key(key)["label"].alias("label"))


# --- delivery and sagas ---------------------------------------------------------


@register("outbox_pending", f"{LOG} select sequence_number, event_type, {UUID3} as message_key from log where not is_external and sequence_number > 400")
def _(spark, sf_dir):
    rows = log_of_events(spark, sf_dir).rows
    outbox = rows.where("not is_external and sequence_number > 400").select("sequence_number")
    sent = delivery.event_messages(rows.join(outbox, "sequence_number", "left_semi"), "events")
    h = delivery.header_map(F.col("headers"))
    return sent.select(h[delivery.POSITION].cast("long").alias("sequence_number"), h[delivery.EVENT_TYPE].alias("event_type"), F.col("key").alias("message_key"))


@register("received_events", f"{LOG} select {UUID3} as event_id, event_type, user_tag, true as is_external from log")
def _(spark, sf_dir):
    rows = log_of_events(spark, sf_dir).rows
    return delivery.received_events(delivery.event_messages(rows, "events")).select("event_id", "event_type", F.col("tags")[0].alias("user_tag"), "is_external")


def order_saga() -> saga.Saga:
    empty = lambda d: d
    data = lambda p: F.to_json(F.struct(F.get_json_object(p, "$.user_id").alias("user")))
    ask = lambda p: saga.decision(saga.PENDING, data(p), [saga.message("stock", p, "reserve")], deadline=30.0)
    ok = lambda r: F.get_json_object(r, "$.ok") == "true"
    reply = lambda d, r: F.when(ok(r), saga.decision(saga.COMPLETED, empty(d))).otherwise(saga.decision(saga.COMPENSATED, d, [saga.message("stock", d, "release")]))
    return saga.Saga("order", "purchase", lambda p: F.get_json_object(p, "$.user_id"), ask, reply, lambda d: saga.decision(saga.FAILED, d))


NOW = "timestamp'2024-06-01 00:00:00'"


@register("saga_started", f"select {UUID3} as id, cast(user_id as varchar) as saga_key, 'Pending' as status, {UUID3} || ':0:0:reserve' as idempotency_key from (select user_id, md5('order:' || user_id) as h from events where event_type = 'purchase' group by user_id)")
def _(spark, sf_dir):
    s = saga.started(order_saga(), log_of_events(spark, sf_dir).rows, spark.createDataFrame([], saga.SAGA), F.expr(NOW))
    sent = s.messages.select(F.col("headers")[saga.H_ID].alias("_id"), F.col("headers")[saga.H_KEY].alias("idempotency_key"))
    return s.instances.join(sent, F.col("id") == F.col("_id")).select("id", "saga_key", "status", "idempotency_key")


@register("saga_replied", f"select cast(user_id as varchar) as saga_key, case when user_id % 2 = 0 then 'Completed' else 'Compensated' end as status, 1 as step from (select distinct user_id from events where event_type = 'purchase')")
def _(spark, sf_dir):
    now = F.expr(NOW)
    s = order_saga()
    instances = saga.started(s, log_of_events(spark, sf_dir).rows, spark.createDataFrame([], saga.SAGA), now).instances
    answer = F.when(F.col("saga_key").cast("long") % 2 == 0, '{"ok":"true"}').otherwise('{"ok":"false"}')
    headers = F.create_map(F.lit(saga.H_SAGA), F.lit("order"), F.lit(saga.H_ID), F.col("id"), F.lit(saga.H_STEP), F.lit("0"))
    replies = instances.select(F.lit("replies").alias("topic"), F.col("id").alias("key"), answer.alias("payload"), headers.alias("headers"))
    return saga.replied(s, replies, instances, now).instances.select("saga_key", "status", "step")


@register("saga_due", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1996-01-01' order by o_orderdate, o_orderkey limit 64")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    i = o.select(F.format_string("%020d", "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", saga.PENDING).otherwise(saga.COMPLETED).alias("status"), F.col("o_orderdate").cast("timestamp").alias("deadline"))
    return saga.due(i, F.expr("timestamp'1996-01-01'")).select(F.col("id").cast("long").alias("o_orderkey"))


# --- the store and streams ------------------------------------------------------


def pending(spark: SparkSession, sf_dir: str, where: str = "true", ids: bool = True) -> DataFrame:
    """Events to append, by position; without ids the store gives them new ones."""
    rows = log_of_events(spark, sf_dir).rows.withColumn("ordinal", F.col("sequence_number"))
    rows = rows if ids else rows.withColumn("event_id", F.lit(None).cast("string"))
    return rows.where(where).select(*(f.name for f in T._parse_datatype_string(PENDING).fields), "ordinal")


def half(spark: SparkSession, sf_dir: str) -> int:
    """Half of the number of events; HALF in SQL."""
    return read(spark, sf_dir, "events").count() // 2


HALF = "(select count(*) // 2 from events)"


@register("store_append", f"select event_id + 1 as sequence_number, event_type, case when event_id < {HALF} then 1 else 2 end as commit_group, 'user:' || user_id as user_tag from events")
def _(spark, sf_dir):
    """The second append repeats the second half of the first one's ids; it checks the revision that the first one left."""
    store, n = Store(spark, new_folder(spark)), half(spark, sf_dir)
    store.append(pending(spark, sf_dir, f"sequence_number <= {n}"), EventFilter(), 0)
    last = store.snapshot().log.revision().first().revision
    store.append(pending(spark, sf_dir, f"sequence_number > {n // 2}"), EventFilter(), last)
    return store.snapshot().log.read_from().select("sequence_number", "event_type", "commit_group", F.col("tags")[0].alias("user_tag"))


@register("store_outbox", f"select event_id + 1 as sequence_number, event_type from events where event_type <> 'error' and event_id >= {HALF}")
def _(spark, sf_dir):
    store, n = Store(spark, new_folder(spark)), half(spark, sf_dir)
    store.append(pending(spark, sf_dir, ids=False))
    store.mark_published(store.snapshot().outbox().where(F.col("sequence_number") <= n).select("sequence_number"))
    return store.snapshot().outbox().select("sequence_number", "event_type")


@register("store_projection", ACCOUNT_SQL.format(place=f"(case when event_id >= {HALF} then event_id else event_id + 100000000000 end)"))
def _(spark, sf_dir):
    """Two commits, the later half of the events first, folded page by page; states and checkpoint read from one manifest."""
    store, n = Store(spark, new_folder(spark)), half(spark, sf_dir)
    p = projector.Projector(store, account(), page=n // 2 + 100)
    for part in (f"sequence_number > {n}", f"sequence_number <= {n}"):
        store.append(pending(spark, sf_dir, part, ids=False))
        p.catch_up()
    return p.read_with_cursor()[0].select("key", "state.n", F.round("state.total", 2).alias("total"))


@register("stream_fold", "select cast(user_id as varchar) as key, count(*) as n, round(sum(value), 2) as total from events where event_type = 'purchase' group by 1")
def _(spark, sf_dir):
    """Keyed state in a streaming query; what the last batches gave each key."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*t").where("event_type = 'purchase'")
    keyed = stream.select(F.col("user_id").cast("string").alias("key"), F.lit(0).cast("long").alias("commit_group"), F.col("event_id").alias("sequence_number"), "value")
    out = new_folder(spark)
    step = lambda s, r: ((s or (0, 0.0))[0] + 1, (s or (0, 0.0))[1] + r["value"])
    sink = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.parquet(f"{out}/rows/{batch}")
    projector.stream_fold(keyed, "n long, total double", step, f"{out}/checkpoint", sink).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return rows.groupBy("key").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 2).alias("total"))
