"""Commands: fold the events of a command's scopes, reject or decide, append at the revision that was read.

`evaluate` does this for a whole table of commands at once, each over the log as it is;
`run` executes one command and appends, retrying when another writer was first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import fingerprint
from tidemark.model import PENDING, EventFilter, EventSchema, Scope
from tidemark.sources.log import EventLog
from tidemark.sources.scratch import written
from tidemark.sources.store import Conflict, Store

EMITTED = "array<struct<event_type:string,payload:string,tags:array<string>>>"


class Rejected(Exception):
    """What run_or_raise raises for a rejection."""


@dataclass(frozen=True)
class Evolve:
    """How an event moves the state; None ignores it. Only events that `when` accepts count; scoped: the event must carry a tag of the command in each of these scopes."""

    schema: EventSchema
    f: Callable[[Column, Column, Column], Column] | None
    when: Callable[[Column, Column], Column] | None = None
    within: tuple[Scope, ...] | None = None
    all_events: bool = False


@dataclass
class CommandHandler:
    """command: DDL of the command's fields; state: DDL type; initial: the state before any event.

    scopes: pairs of a scope and a function from the command to its keys (an array).
    rejects: (condition of state and command, code), in order. decide: state and command
    to an array of emit() structs.
    """

    name: str
    command: str
    state: str
    event: str
    initial: Callable[[Column], Column]
    scopes: list[tuple[Scope, Callable[[Column], Column]]]
    evolves: list[Evolve]
    rejects: list[tuple[Callable[[Column, Column], Column], str]]
    decide: Callable[[Column, Column], Column]
    all_event_types: bool = True
    snapshot_every: int | None = None
    snapshot_version: int = 1
    retries: int = 3
    emits: list[EventSchema] = field(default_factory=list)

    def __post_init__(self):
        names = [n for e in self.evolves for n in e.schema.names]
        if len(names) != len(set(names)):
            raise ValueError(f"{self.name}: an event type evolves twice")
        own = {s.name for s, _ in self.scopes}
        for e in self.evolves:
            declared = [s for s, _ in e.schema.scopes if s.name in own]
            if e.f is not None and e.when is None and e.within is None and not e.all_events and len(declared) != 1:
                raise ValueError(f"{self.name}: {e.schema.name} shares {len(declared)} scopes with the command; say within, when or all_events")
        for s in self.emits:
            if lost := [x.name for x, _ in s.scopes if x.name not in own]:
                raise ValueError(f"{self.name}: {s.name} needs scope {', '.join(lost)}")

    @property
    def types(self) -> list[str]:
        return [n for e in self.evolves for n in e.schema.names]

    @property
    def fingerprint(self) -> str:
        return fingerprint([(e.schema.name, e.schema.version) for e in self.evolves], [s.name for s, _ in self.scopes])

    def tags(self, command: Column) -> Column:
        def named(scope: Scope, keys: Column) -> Column:
            return F.transform(keys, lambda k: F.concat(F.lit(f"{scope.name}:"), k.cast("string")))

        parts = [named(s, keys(command)) for s, keys in self.scopes]
        return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")

    def emit(self, schema: EventSchema, event: Column, tags: Column | None = None) -> Column:
        """An event to append; its tags are those given, else those of its declared scopes, else all of the command's (null stands for them)."""
        if tags is None and schema.scopes:
            texts = [F.array(F.concat(F.lit(f"{s.name}:"), event[f].cast("string"))) for s, f in schema.scopes]
            tags = F.flatten(F.array(*texts))
        return F.struct(F.lit(schema.name).alias("event_type"), F.to_json(event).alias("payload"), (F.lit(None).cast("array<string>") if tags is None else tags).alias("tags"))

    def _accepts(self, e: Evolve, row: Column, command: Column, tags: Column) -> Column:
        if e.all_events:
            return F.lit(True)
        if e.when is not None:
            return F.coalesce(e.when(row["event"], command), F.lit(False))
        own = {s.name for s, _ in self.scopes}
        within = e.within if e.within is not None else tuple(s for s, _ in e.schema.scopes if s.name in own)

        def shared(scope: Scope) -> Column:
            return F.exists(row["tags"], lambda t: F.startswith(t, F.lit(f"{scope.name}:")) & F.array_contains(tags, t))

        return reduce(lambda a, s: a & shared(s), within, F.lit(True))

    def _step(self, state: Column, row: Column, command: Column, tags: Column) -> Column:
        case = F.when(F.lit(False), F.lit(None).cast(self.state))
        for e in self.evolves:
            if e.f is not None:
                hit = row["event_type"].isin(*e.schema.names) & self._accepts(e, row, command, tags)
                case = case.when(hit, e.f(state, row["event"], command).cast(self.state))
        return case.otherwise(state)

    @property
    def folds_by_command(self) -> bool:
        """Whether the first state or a step looks at the command itself, not only at its tags."""
        state, event, command = (F.col(n) for n in ("_state", "_event", "_command_"))
        seen = [self.initial(command)]
        for e in self.evolves:
            seen += [f(*args) for f, args in ((e.f, (state, event, command)), (e.when, (event, command))) if f is not None]
        return any("_command_" in str(c) for c in seen)

    @property
    def _moving(self) -> list[str]:
        """The types of events that move the state; of others only number and place count."""
        return [n for e in self.evolves if e.f is not None for n in e.schema.names]

    @property
    def _looked_at(self) -> list[str]:
        """The scopes whose tags an event is asked for."""
        own = [s.name for s, _ in self.scopes]
        asked = [e for e in self.evolves if e.f is not None and e.when is None and not e.all_events]
        return sorted({n for e in asked for n in (own if e.within is None else [s.name for s in e.within])})

    def _folded(self, units: DataFrame, hits: DataFrame, history: DataFrame, longest: int | None) -> DataFrame:
        """unit, folded, n, last (position) of units with events; histories longer than `longest` are folded by parts.

        hits: unit and sequence_number, at least of each row of history; history: the same and row, null for events that move nothing.
        """

        def fold(rows: DataFrame, state: Column) -> DataFrame:
            """rows: what gathered() gives, and what state reads."""
            out = F.aggregate("history", state, lambda acc, r: self._step(acc, r, F.col("command"), F.col("tags")))
            return rows.select("unit", out.alias("folded"), "n", "last")

        def gathered(rows: DataFrame) -> DataFrame:
            return rows.groupBy("unit").agg(F.sort_array(F.collect_list("row")).alias("history"), F.count("*").alias("n"), F.max("sequence_number").alias("last"))

        first = F.coalesce(F.col("s_state"), self.initial(F.col("command")).cast(self.state))
        one = units.hint("shuffle_hash")  # so that histories are not sorted to be joined
        if longest is None:
            return fold(gathered(history).join(one, "unit"), first)
        long_units = written(hits.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > longest))
        most = long_units.agg(F.max("n")).first()[0]
        if most is None:
            return fold(gathered(history).join(one, "unit"), first)
        short = fold(gathered(history.join(long_units, "unit", "left_anti")).join(one, "unit"), first)
        nth = F.row_number().over(Window.partitionBy("unit").orderBy("sequence_number"))
        parts = written(history.join(long_units.select("unit"), "unit", "left_semi").withColumn("part", F.floor((nth - 1) / longest)))
        units = written(units.join(long_units.select("unit"), "unit", "left_semi"))
        carried = units.select("unit", first.alias("folded"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
        for k in range(-(-most // longest)):
            own = gathered(parts.where(F.col("part") == k)).join(units, "unit").join(carried.select("unit", F.col("folded").alias("_folded"), F.col("n").alias("_n")), "unit")
            now = fold(own, F.col("_folded")).join(carried.select("unit", F.col("n").alias("_n")), "unit").select("unit", "folded", (F.col("n") + F.col("_n")).alias("n"), "last")
            carried = written(now.unionByName(carried.join(now.select("unit"), "unit", "left_anti")))
        return short.unionByName(carried.where("n > 0"))

    def evaluate(self, log: EventLog, commands: DataFrame, starts: DataFrame | None = None, longest: int | None = None) -> DataFrame:
        """commands (command_id, command struct) → command_id, command, tags, revision, events, state, rejection, emitted.

        starts: command_id, state, position and events folded so far, where a snapshot is known. longest: histories of more events are folded
        so many at a time.
        """
        asked = commands.select("command_id", "command").withColumn("tags", self.tags(F.col("command")))
        if starts is None:
            asked = asked.withColumns({"s_state": F.lit(None).cast(self.state), "s_position": F.lit(0).cast("long"), "s_events": F.lit(0).cast("long")})
        else:
            asked = asked.join(starts.select("command_id", F.col("state").alias("s_state"), F.col("position").alias("s_position"), F.col("events").alias("s_events")), "command_id", "left").fillna(0, ["s_position", "s_events"])
        # Commands that fold the same events the same way share one fold: those of one tag set and start, and if the fold looks at the command, of one content.
        by = ["tags", "s_state", "s_position"] + (["command"] if self.folds_by_command else [])
        # Written, because what commands and starts are computed from is read once then.
        asked = written(asked.withColumn("_by", F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256)))
        units = written(asked.groupBy("_by").agg(*(F.first(c).alias(c) for c in ("tags", "s_state", "s_position", "command"))).withColumn("unit", F.monotonically_increasing_id()))
        asked = asked.join(units.select("_by", "unit"), "_by").drop("_by")
        units = units.drop("_by")
        index = log.index.where(reduce(lambda a, s: a | F.startswith("tag", F.lit(f"{s.name}:")), [s for s, _ in self.scopes], F.lit(False)))
        hits = units.select("unit", "s_position", F.explode("tags").alias("tag")).join(index, "tag").where("sequence_number > s_position").select("unit", "sequence_number").distinct()
        hits = hits if longest is None else written(hits)
        moving = F.col("event_type").isin(*self._moving)
        looked_at = [f"{n}:" for n in self._looked_at]
        tags = F.filter("tags", lambda t: reduce(lambda a, p: a | F.startswith(t, F.lit(p)), looked_at, F.lit(False)))
        rows = log.rows if self.all_event_types else log.rows.where(F.col("event_type").isin(*self.types))
        rows = rows.select("sequence_number", "event_type", F.when(moving, tags).alias("event_tags"), F.when(moving, F.col("payload")).alias("payload"))
        row = F.when(moving, F.struct("sequence_number", "event_type", F.col("event_tags").alias("tags"), F.from_json("payload", self.event).alias("event")))
        history = hits.join(rows, "sequence_number").select("unit", "sequence_number", row.alias("row"))
        folded = self._folded(units, hits, history, longest)
        full = asked.join(folded, "unit", "left")
        start = F.coalesce(F.col("s_state"), self.initial(F.col("command")).cast(self.state))
        full = full.withColumn("state", F.when(F.col("n").isNull(), start).otherwise(F.col("folded")))
        full = full.withColumn("revision", F.greatest(F.col("s_position"), F.coalesce("last", F.lit(0).cast("long"))))
        full = full.withColumn("events", F.col("s_events") + F.coalesce("n", F.lit(0).cast("long")))
        case = F.when(F.lit(False), F.lit(""))
        for condition, code in self.rejects:
            case = case.when(condition(F.col("state"), F.col("command")), code)
        full = full.withColumn("rejection", case)
        emitted = F.transform(self.decide(F.col("state"), F.col("command")).cast(EMITTED), lambda e: F.struct(e["event_type"].alias("event_type"), e["payload"].alias("payload"), F.coalesce(e["tags"], F.col("tags")).alias("tags")))
        full = full.withColumn("emitted", F.when(F.col("rejection").isNull(), emitted).otherwise(F.array().cast(EMITTED)))
        return full.select("command_id", "command", "tags", "revision", "events", "state", "rejection", "emitted")

    # -- one command

    def run(self, store: Store, command: dict, messages: DataFrame | None = None) -> tuple[str | None, DataFrame | None]:
        """(rejection, None) or (None, the appended events). Conflicts of the append are retried; messages go with it."""
        spark = store.spark
        values = tuple(command.get(f.name) for f in T._parse_datatype_string(self.command).fields)
        one = spark.createDataFrame([("1", values)], f"command_id string, command struct<{_body(self.command)}>")
        for left in range(self.retries, -1, -1):
            now = store.snapshot()
            starts = self._start(store, one) if self.snapshot_every else None
            r = self.evaluate(now.log, one, starts).withColumn("state_json", F.to_json("state")).first()
            if r.rejection is not None:
                return r.rejection, None
            f = EventFilter.of(() if self.all_event_types else self.types, r.tags)
            expected = r.revision if self.all_event_types else now.log.revision(f).first().revision
            pending = spark.createDataFrame([(None, e.event_type, 1, e.tags, e.payload, False, None) for e in r.emitted], PENDING).withColumn("ordinal", F.monotonically_increasing_id())
            try:
                done = store.append(pending, f, expected, messages)
            except Conflict:
                if not left:
                    raise
                continue
            if self.snapshot_every and r.events // self.snapshot_every > (0 if starts is None else starts.agg(F.coalesce(F.max("events"), F.lit(0))).first()[0]) // self.snapshot_every:
                self._save(store, r)
            return None, done
        raise AssertionError

    def run_or_raise(self, store: Store, command: dict) -> DataFrame:
        rejection, events = self.run(store, command)
        if rejection is not None:
            raise Rejected(rejection)
        return events

    def _key(self, tags: list[str]) -> str:
        return "|".join(sorted(tags))

    def _start(self, store: Store, one: DataFrame) -> DataFrame:
        """The snapshot of the command, if it fits: same fingerprint and not ahead of the log."""
        tags = one.select(self.tags(F.col("command")).alias("t")).first().t
        revision = store.snapshot().log.revision(EventFilter.of((), tags)).first().revision
        s = store.load_snapshot(self.name, self._key(tags), self.snapshot_version)
        fits = s.where((F.col("filter_fingerprint") == self.fingerprint) & (F.col("global_position") <= revision))
        state = F.from_json("payload", self.state)
        return fits.select(F.lit("1").alias("command_id"), state.alias("state"), F.col("global_position").alias("position"), F.col("event_count").alias("events")).where("state is not null")

    def _save(self, store: Store, r) -> None:
        from tidemark.model import SNAPSHOT

        row = store.spark.createDataFrame([(self.name, self._key(r.tags), self.snapshot_version, r.revision, r.events, self.fingerprint, r.state_json, None)], SNAPSHOT)
        store.save_snapshot(row.withColumn("updated_at", F.current_timestamp()))


def _body(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)
