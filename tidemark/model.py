"""Values of the event log: tags, scopes, filters, cursors, event schemas and table layouts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import total_ordering

from pyspark.sql import types as T

#: One row of the log.
LOG = T.StructType(
    [
        T.StructField("sequence_number", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("payload", T.StringType()),
        T.StructField("is_external", T.BooleanType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("commit_group", T.LongType()),
    ]
)
TAG_INDEX = "tag string, sequence_number long"
#: What append() takes; id, version, headers and is_external may be null.
PENDING = "event_id string, event_type string, event_version int, tags array<string>, payload string, is_external boolean, headers map<string,string>"
MESSAGE = "topic string, key string, payload string, headers map<string,string>"
SAGA = "id string, saga_name string, saga_key string, status string, step int, data string, deadline timestamp, created_at timestamp, updated_at timestamp"
SNAPSHOT = "snapshot_id string, snapshot_key string, snapshot_version int, global_position long, event_count long, filter_fingerprint string, payload string, updated_at timestamp"


@dataclass(frozen=True)
class Tag:
    """`category:id`; the first colon parts them, so an id may hold more."""

    category: str
    id: str

    def __str__(self) -> str:
        return f"{self.category}:{self.id}"

    @staticmethod
    def parse(text: str) -> Tag | None:
        category, colon, rest = text.partition(":")
        return Tag(category, rest) if colon else None


@dataclass(frozen=True)
class KeyCodec:
    """Scope keys as text; a codec without `read` only writes."""

    write: Callable[[object], str] = str
    read: Callable[[str], object] | None = None

    def decode(self, text: str):
        if self.read is None:
            raise TypeError("this key codec only encodes")
        return self.read(text)


TEXT_KEY, INT_KEY, UUID_KEY = KeyCodec(str, str), KeyCodec(str, int), KeyCodec(lambda x: str(x).lower(), uuid.UUID)


@dataclass(frozen=True)
class Scope:
    """A named identity that events and commands refer to by key."""

    name: str
    codec: KeyCodec = TEXT_KEY

    def __post_init__(self):
        if not self.name or ":" in self.name:
            raise ValueError("a scope name is not empty and has no colon")

    def tag(self, key) -> str:
        text = self.codec.write(key)
        if not text:
            raise ValueError("a scope key is not empty")
        return f"{self.name}:{text}"

    def key(self, tag: str):
        """The key if the tag is of this scope, else None."""
        parsed = Tag.parse(tag)
        return self.codec.decode(parsed.id) if parsed and parsed.category == self.name and parsed.id else None


@dataclass(frozen=True)
class EventFilter:
    """Event types and tags; an empty set constrains nothing, tags match if any does."""

    event_types: frozenset[str] = frozenset()
    tags: frozenset[str] = frozenset()

    @staticmethod
    def of(event_types: Iterable[str] = (), tags: Iterable[str] = ()) -> EventFilter:
        return EventFilter(frozenset(event_types), frozenset(map(str, tags)))


@total_ordering
@dataclass(frozen=True)
class ReadCursor:
    """A place in delivery order: commit group first, position within it."""

    commit_group: int = 0
    position: int = -1

    def __lt__(self, other: ReadCursor) -> bool:
        return (self.commit_group, self.position) < (other.commit_group, other.position)


START = ReadCursor()


@dataclass(frozen=True)
class EventSchema:
    """Stored name, version, aliases, payload fields, and the scopes an event belongs to (scope, payload field; a list field gives several keys)."""

    name: str
    fields: str
    version: int = 1
    aliases: tuple[str, ...] = ()
    scopes: tuple[tuple[Scope, str], ...] = ()

    def __post_init__(self):
        if self.version < 1:
            raise ValueError(f"{self.name}: versions start at 1")

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


@dataclass
class Checkpoint:
    name: str
    cursor: ReadCursor = START
    running: bool = True
    error: str | None = None


@dataclass
class Registry:
    """Event schemas by every name they are stored under."""

    schemas: list[EventSchema] = field(default_factory=list)

    def __post_init__(self):
        names = [n for s in self.schemas for n in s.names]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"stored names used twice: {', '.join(twice)}")

    def find(self, name: str) -> EventSchema:
        for s in self.schemas:
            if name in s.names:
                return s
        raise KeyError(f"unknown event type {name!r}")
