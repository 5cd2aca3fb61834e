"""JSON codecs of events: decoding by stored name, aliases, upcasting, and tri-state patches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import EventSchema, Registry

#: A step takes a payload of version k as a JSON text column and gives version k + 1.
Step = Callable[[Column], Column]


@dataclass
class Upcaster:
    """Steps from version 1 on; steps[k] leads from k to k + 1."""

    schema: EventSchema
    steps: dict[int, Step] = field(default_factory=dict)

    def problem(self, version: Column) -> Column:
        """Why a version can't be read, or null."""
        case = F.when(version < 1, F.format_string(f"{self.schema.name}: version %d is below 1", version))
        case = case.when(version > self.schema.version, F.format_string(f"{self.schema.name}: version %d is newer than {self.schema.version}", version))
        for k in range(1, self.schema.version):
            if k not in self.steps:
                case = case.when(version <= k, F.format_string(f"{self.schema.name}: no step from version {k}", *()))
        return case

    def upcast(self, payload: Column, version: Column) -> Column:
        for k in range(1, self.schema.version):
            if k in self.steps:
                payload = F.when(version <= k, self.steps[k](payload)).otherwise(payload)
        return payload


@dataclass
class EventCodec:
    registry: Registry
    upcasters: dict[str, Upcaster] = field(default_factory=dict)

    def decoded(self, log: DataFrame, schema: EventSchema) -> DataFrame:
        """The events stored under any name of a schema: the log's columns, event (a struct, null if it fails) and decode_error."""
        up = self.upcasters.get(schema.name, Upcaster(schema))
        own = log.where(F.col("event_type").isin(*schema.names))
        event = F.from_json(up.upcast(F.col("payload"), F.col("event_version")), schema.fields, {"mode": "PERMISSIVE"})
        version_problem = up.problem(F.col("event_version"))
        own = own.withColumn("event", event)
        broken = F.col("event").isNull() | F.try_parse_json("payload").isNull()
        error = F.coalesce(version_problem, F.when(broken, F.concat(F.lit(f"{schema.name}: payload can't be read: "), F.col("payload"))))
        return own.withColumn("decode_error", error).withColumn("event", F.when(F.col("decode_error").isNull(), F.col("event")))

    def checked(self, log: DataFrame) -> DataFrame:
        """The log with decode_error for every event: unknown type, version without a way, or null."""
        case = F.when(F.lit(False), F.lit(""))
        for s in self.registry.schemas:
            case = case.when(F.col("event_type").isin(*s.names), self.upcasters.get(s.name, Upcaster(s)).problem(F.col("event_version")))
        return log.withColumn("decode_error", case.otherwise(F.concat(F.lit("unknown event type "), F.col("event_type"))))

    @staticmethod
    def encode(event: Column) -> Column:
        """Compact JSON; absent fields are left out."""
        return F.to_json(event)


def rename_field(old: str, new: str) -> Step:
    """An upcast step that renames a field of a flat payload, whatever else it holds."""

    def step(payload: Column) -> Column:
        fields = F.from_json(payload, "map<string,variant>")
        moved = F.transform_keys(fields, lambda k, _: F.when(k == old, new).otherwise(k))
        return F.to_json(moved)

    return step


# --- patches: absent, null or a value ---------------------------------------


def patch_state(payload: Column, name: str) -> Column:
    """'keep' if the field is absent, 'clear' if it is null, 'set' if it has a value."""
    raw = F.from_json(payload, "map<string,variant>")
    return F.when(~F.map_contains_key(raw, name), "keep").when(F.is_variant_null(F.element_at(raw, name)), "clear").otherwise("set")


def patched(current: Column, payload: Column, name: str, kind: str) -> Column:
    """The field after the patch."""
    value = F.try_variant_get(F.element_at(F.from_json(payload, "map<string,variant>"), name), "$", kind)
    state = patch_state(payload, name)
    return F.when(state == "keep", current).when(state == "set", value)
