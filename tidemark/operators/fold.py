"""Projections: each key's events, folded in delivery order into a nullable state.

A handler gives one state operation for some stored event types and says which keys an
event belongs to. State functions are Column expressions, so a fold is planned and
compiled by Spark. Three ways give the same result:

* `fold_columns`: an array of a key's events, folded by the higher-order aggregate; for
  any Column functions. Keys with long histories are folded piece by piece with the state carried.
* `fold_sums`: for handlers that reset, delete or add; two aggregations with partial
  sums and a salted join, so a hot key is never gathered.
* `fold_rows`: Python functions over sorted partitions, one event at a time; a key of
  any length passes in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.model import EventSchema, ReadCursor, Scope
from tidemark.sources.scratch import written

BROKEN = "_corrupt_record"
EXISTS, MISSING = "state already exists", "state not found"
State = Callable[..., Column]
#: What an envelope shows of an event besides its payload; headers as an array of entries.
META = ("sequence_number", "event_id", "event_type", "event_version", "tags", "is_external", "recorded_at", "commit_group")


def header(meta: Column, name: str) -> Column:
    """A header of an envelope, or null."""
    return F.map_from_entries(meta["headers"])[name]


@dataclass(frozen=True)
class Handler:
    """op: create, set, update, upsert, delete or handle; f(state, event) → state; keys(event row) → array of keys.

    With envelope, f and the rejections get the event's metadata as a last argument.
    """

    schemas: tuple[EventSchema, ...]
    op: str
    f: State | None
    keys: Callable[[], Column] | None = None
    rejects: tuple[tuple[State, str], ...] = ()
    envelope: bool = False

    def reject(self, *rules: tuple[State, str]) -> Handler:
        """Rules (condition of state and event, error); the first that holds wins, before the operation."""
        return replace(self, rejects=self.rejects + rules)

    @property
    def names(self) -> list[str]:
        return [n for s in self.schemas for n in s.names]

    def error(self, state: Column, row: Column) -> Column:
        case = F.when(F.lit(False), F.lit(""))
        for condition, message in self.rejects:
            case = case.when(condition(state, *self._seen(row)), message)
        if self.op == "create":
            case = case.when(state.isNotNull(), EXISTS)
        elif self.op == "update":
            case = case.when(state.isNull(), MISSING)
        return case

    def next(self, state: Column, row: Column, kind: str) -> Column:
        if self.op == "delete":
            return F.lit(None).cast(kind)
        before = () if self.op in ("create", "set") else (state,)
        return self.f(*before, *self._seen(row)).cast(kind)

    def _seen(self, row: Column) -> tuple[Column, ...]:
        return (row["event"], row["meta"]) if self.envelope else (row["event"],)


@dataclass
class On:
    """Begins a handler: on(schema, keys).update(f), and so on."""

    schemas: tuple[EventSchema, ...]
    keys: Callable[[], Column] | None
    envelope: bool = False

    def _handler(self, op: str, f: State | None) -> Handler:
        return Handler(self.schemas, op, f, self.keys, envelope=self.envelope)

    def create(self, f: State) -> Handler:
        """f(event) gives the state of a key that has none."""
        return self._handler("create", f)

    def set(self, f: State) -> Handler:
        """f(event) gives the state, whatever it was."""
        return self._handler("set", f)

    def update(self, f: State) -> Handler:
        return self._handler("update", f)

    def upsert(self, f: State) -> Handler:
        return self._handler("upsert", f)

    def handle(self, f: State) -> Handler:
        return self._handler("handle", f)

    def delete(self) -> Handler:
        return self._handler("delete", None)


def on(*schemas: EventSchema, key: Callable[[], Column] | None = None, keys: Callable[[], Column] | None = None, envelope: bool = False) -> On:
    """key gives one key, keys an array of them; both see the log's columns, with metadata. Several schemas are a family. With envelope, state functions see the metadata, too."""
    if key is not None and keys is not None:
        raise ValueError("one of key and keys")
    return On(schemas, keys or (None if key is None else lambda: F.array(key())), envelope)


@dataclass
class Projection:
    """handlers over events; state is the DDL type of the state, event that of the decoded payload (all fields of all events)."""

    name: str
    state: str
    event: str
    handlers: list[Handler]
    scopes: tuple[Scope, ...] = ()
    key_type: str = "string"
    seen: list[str] = field(init=False)

    def __post_init__(self):
        if not self.handlers:
            raise ValueError(f"{self.name}: no handler")
        self.seen = [n for h in self.handlers for n in h.names]
        if twice := sorted({n for n in self.seen if self.seen.count(n) > 1}):
            raise ValueError(f"{self.name}: several handlers for {', '.join(twice)}")
        for h in self.handlers:
            if h.keys is None:
                if not self.scopes:
                    raise ValueError(f"{self.name}: a handler without a key needs a scope")
                for s in h.schemas:
                    if s.scopes and (lost := [x.name for x in self.scopes if x not in [y for y, _ in s.scopes]]):
                        raise ValueError(f"{self.name}: {s.name} does not declare scope {', '.join(lost)}")

    def _own_keys(self) -> Column:
        from tidemark.functions.ids import key_product, scope_keys

        if len(self.scopes) == 1:
            return scope_keys(F.col("tags"), self.scopes[0].name)
        return key_product(*(scope_keys(F.col("tags"), s.name) for s in self.scopes))

    def keyed(self, log: DataFrame) -> DataFrame:
        """One row for each event and key: key, commit_group, sequence_number, event_type, event, and meta if a handler sees envelopes. Events of other types drop out, and repeated keys of an event."""
        case = F.when(F.lit(False), F.array().cast(f"array<{self.key_type}>"))
        for h in self.handlers:
            keys = h.keys() if h.keys else self._own_keys()
            case = case.when(F.col("event_type").isin(*h.names), keys.cast(f"array<{self.key_type}>"))
        own = log.where(F.col("event_type").isin(*self.seen))
        # A payload that is no object, or whose fields have other types, gives no event.
        kind = T.StructType([*T._parse_datatype_string(self.event).fields, T.StructField(BROKEN, T.StringType())])
        own = own.withColumn("_parsed", F.from_json("payload", kind, {"columnNameOfCorruptRecord": BROKEN}))
        event = F.when(F.col(f"_parsed.{BROKEN}").isNull(), F.col("_parsed").dropFields(BROKEN))
        # Entries, because a map has no order and rows are sorted.
        meta = [F.struct(*META, F.map_entries("headers").alias("headers")).alias("meta")] if any(h.envelope for h in self.handlers) else []
        return own.select(F.explode(F.array_distinct(case)).alias("key"), "commit_group", "sequence_number", "event_type", event.alias("event"), *meta)

    def step(self, acc: Column, row: Column) -> Column:
        """acc: struct (state, error, failed at); once failed, it stays."""
        state, kind = acc["state"], row["event_type"]
        error, after = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(None).cast(self.state))
        for h in self.handlers:
            mine = kind.isin(*h.names)
            error = error.when(mine, h.error(state, row))
            after = after.when(mine, h.next(state, row, self.state))
        error = F.when(row["event"].isNull(), F.lit("payload does not fit")).otherwise(error)
        failed = F.struct(state.alias("state"), error.alias("error"), row["commit_group"].alias("group"), row["sequence_number"].alias("position"))
        moved = F.struct(after.otherwise(state).alias("state"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("position"))
        return F.when(acc["error"].isNotNull(), acc).when(error.isNotNull(), failed).otherwise(moved)


def fold_columns(p: Projection, log: DataFrame, states: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """key, state, error, group, position (of the first failing event) of every key that the log touches; states: key and state before.

    longest: keys are counted first, and those of more events are folded `longest` events at a time, so that no array is longer.
    Without it the caller says that histories are bounded, as those of a page are.
    """
    keyed = p.keyed(log)
    kind = T._parse_datatype_string(p.state).simpleString()
    acc = f"struct<state:{kind},error:string,group:bigint,position:bigint>"
    start = lambda s: F.struct(s.alias("state"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("position")).cast(acc)
    before = None if states is None else states.select("key", start(F.col("state")).alias("acc"))
    if longest is None:
        done = _folded(p, keyed, before, acc)
    else:
        done = _folded_by_parts(p, keyed, before, acc, longest)
    return done.select("key", "acc.state", "acc.error", "acc.group", "acc.position")


def _folded(p: Projection, keyed: DataFrame, before: DataFrame | None, acc: str) -> DataFrame:
    """key and acc of the keys in keyed; before: key and acc."""
    row = F.struct(*(c for c in keyed.columns if c != "key"))
    per_key = keyed.groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.lit(None).cast(acc)
    if before is not None:
        per_key = per_key.join(before.select(F.col("key").alias("_key"), F.col("acc").alias("_acc")), F.col("key") == F.col("_key"), "left")
        start = F.col("_acc")
    empty = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(acc).fields)).cast(acc)
    return per_key.select("key", F.aggregate("rows", F.coalesce(start, empty), lambda a, r: p.step(a, r).cast(acc)).alias("acc"))


def _folded_by_parts(p: Projection, keyed: DataFrame, before: DataFrame | None, acc: str, longest: int) -> DataFrame:
    long_keys = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > longest))
    most = long_keys.agg(F.max("n")).first()[0]
    if most is None:
        return _folded(p, keyed, before, acc)
    names = long_keys.select("key")
    short = _folded(p, keyed.join(names, "key", "left_anti"), before, acc)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("commit_group", "sequence_number"))
    parts = written(keyed.join(names, "key", "left_semi").withColumn("part", F.floor((nth - 1) / longest)))
    carried = names.join(before, "key") if before is not None else None
    for k in range(-(-most // longest)):
        now = _folded(p, parts.where(F.col("part") == k).drop("part"), carried, acc)
        if k:  # keys that have no event left keep what they had
            now = now.unionByName(carried.join(parts.where(F.col("part") == k).select("key").distinct(), "key", "left_anti"))
        carried = written(now)
    return short.unionByName(carried)


def fold_steps(p: Projection, log: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """key, commit_group, sequence_number, state: the state of a key after each of its events, up to the first that fails. For pages, whose histories are bounded."""
    keyed = p.keyed(log)
    kind = T._parse_datatype_string(p.state).simpleString()
    acc = f"struct<state:{kind},error:string,group:bigint,position:bigint>"
    both = f"struct<acc:{acc},steps:array<struct<commit_group:bigint,sequence_number:bigint,state:{kind}>>>"
    per_key = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*(c for c in keyed.columns if c != "key")))).alias("rows"))
    before = F.lit(None).cast(p.state)
    if states is not None:
        per_key = per_key.join(states.select(F.col("key").alias("_key"), F.col("state").alias("_state")), F.col("key") == F.col("_key"), "left")
        before = F.col("_state")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("error", "string"), ("group", "long"), ("position", "long"))]
    start = F.struct(F.struct(before.alias("state"), *none).alias("acc"), F.array().alias("steps")).cast(both)

    def step(a: Column, r: Column) -> Column:
        now = p.step(a["acc"], r).cast(acc)
        one = F.struct(r["commit_group"].alias("commit_group"), r["sequence_number"].alias("sequence_number"), now["state"].alias("state"))
        return F.struct(now.alias("acc"), F.when(now["error"].isNull(), F.array_append(a["steps"], one)).otherwise(a["steps"]).alias("steps")).cast(both)

    done = per_key.select("key", F.explode(F.aggregate("rows", start, step)["steps"]).alias("s"))
    return done.select("key", "s.*")


@dataclass
class FoldResult:
    """states: key and state (null: deleted) of the keys that were touched; cursor: up to where; error of the event that stopped it."""

    states: DataFrame
    cursor: ReadCursor | None
    error: str | None = None


def project(p: Projection, log: DataFrame, states: DataFrame | None = None, end: ReadCursor | None = None) -> FoldResult:
    """Folds a page of the log. An event fails for all of its keys: everything before the first failing event is kept, nothing from it on.

    end: the place of the page's last event, if it is known. The states are a table.
    """
    last = F.max(F.struct("commit_group", "sequence_number")).alias("x")
    folded = written(fold_columns(p, log, states))
    first = folded.where("error is not null").agg(F.min(F.struct("group", "position", "error")).alias("x")).first().x
    if first is None:
        if end is None and (x := log.agg(last).first().x):
            end = ReadCursor(*x)
        return FoldResult(folded.select("key", "state"), end)
    before = log.where((F.col("commit_group") < first.group) | ((F.col("commit_group") == first.group) & (F.col("sequence_number") < first.position)))
    x = before.agg(last).first().x
    return FoldResult(written(fold_columns(p, before, states)).select("key", "state"), ReadCursor(*x) if x else None, first.error)


# --- sums --------------------------------------------------------------------


@dataclass(frozen=True)
class Sums:
    """A state of sums and last values, for keys that events reset, add to or delete.

    sets: types that begin anew; deletes: types that remove; adds: types that count, and
    create a missing state. sums: name → value added by an adding event; lasts: name →
    value of the last setting or adding event.
    """

    sets: tuple[str, ...]
    deletes: tuple[str, ...]
    adds: tuple[str, ...]
    sums: dict[str, Column]
    lasts: dict[str, Column] = field(default_factory=dict)


def fold_sums(s: Sums, keyed: DataFrame, spread: int | None = None) -> DataFrame:
    """key and the state's fields, of the keys that are there at the end. keyed: key, commit_group, sequence_number, event_type and what sums and lasts read.

    The rows of a key are dealt over `spread` tasks (as many as a shuffle has, 64 at most, unless given), to each of which its last reset goes;
    partial sums meet afterwards. Of the columns the resets need only key, place and type.
    """
    spread = spread or max(1, min(64, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = F.struct("commit_group", "sequence_number")
    kind = F.col("event_type")
    resets = keyed.where(kind.isin(*s.sets, *s.deletes)).groupBy("key").agg(F.max(F.struct("commit_group", "sequence_number", "event_type")).alias("by"))
    resets = resets.select(F.col("key").alias("_key"), F.struct("by.commit_group", "by.sequence_number").alias("at"), F.col("by.event_type").isin(*s.sets).alias("anew"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_salt"))
    salted = keyed.where(kind.isin(*s.sets, *s.adds)).withColumn("salt", F.pmod(F.xxhash64("sequence_number"), F.lit(spread)).cast("int"))
    live = salted.join(resets, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    live = live.where(F.col("at").isNull() | (place > F.col("at")) | ((place == F.col("at")) & F.col("anew")))
    added = kind.isin(*s.adds)
    sums = [F.coalesce(F.sum(F.when(added, v)), F.lit(0)).alias(n) for n, v in s.sums.items()]
    return live.groupBy("key").agg(*sums, *(F.max_by(v, place).alias(n) for n, v in s.lasts.items()))


# --- Python functions --------------------------------------------------------


def fold_rows(keyed: DataFrame, initial: object, step: Callable[[object, dict], object], out: Callable[[object], dict | None], schema: str) -> DataFrame:
    """Folds each key's rows in delivery order by a Python function; out turns the last state into a row, or None.

    schema names key first. Partitions are sorted, so a key never stands in memory as a whole.
    """

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, began = None, initial, [], False

        def close() -> None:
            row = out(state)
            if row is not None:
                done.append({"key": now, **row})

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                row = dict(zip(batch.schema.names, values))
                if not began or row["key"] != now:
                    if began:
                        close()
                    began, now, state = True, row["key"], initial
                state = step(state, row)
            if len(done) > 1000:
                yield rows()
                done = []
        if began:
            close()
        if done:
            yield rows()

    return keyed.repartition("key").sortWithinPartitions("key", "commit_group", "sequence_number").mapInArrow(run, schema)


def widest(kinds: list[str]) -> str:
    """One DDL struct body with all fields of several."""
    fields: dict[str, str] = {}
    for body in kinds:
        for f in T._parse_datatype_string(body).fields:
            if fields.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ValueError(f"field {f.name} has two types")
    return reduce(lambda a, f: f"{a}, {f[0]} {f[1]}" if a else f"{f[0]} {f[1]}", fields.items(), "")
