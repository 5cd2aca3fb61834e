"""Delivery: events and messages leave through outboxes to topics, and arrive from them.

A topic is a table of rows as Kafka's source has them: topic, key, value, headers, and an
id that grows. Where no connector is at hand, `FileTopics` keeps topics as Parquet
folders that can be read as a batch or as a stream; with one, the same rows go to
`format("kafka")`.
"""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import PENDING
from tidemark.sources.store import Store

TOPIC = "topic string, key string, value string, headers array<struct<key:string,value:binary>>, timestamp timestamp"

# The headers that carry an event's envelope.
EVENT_ID, EVENT_TYPE, POSITION, RECORDED, TAGS, EXTERNAL = "event-id", "event-type", "global-position", "recorded-at", "tags", "is-external"


def _header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))


def headers_of(m: Column) -> Column:
    """A map as Kafka headers."""
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))


def header_map(headers: Column) -> Column:
    """Kafka headers as a map; of equal names the last counts."""
    names = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    last = lambda n: F.element_at(F.filter(headers, lambda h: h["key"] == n), -1)["value"].cast("string")
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.create_map().cast("map<string,string>"))


def event_messages(log: DataFrame, topic: str, key: Column | None = None) -> DataFrame:
    """Events as topic rows: payload as value, envelope in headers. The key is the event's id unless given."""
    envelope = F.array(_header(EVENT_ID, F.col("event_id")), _header(EVENT_TYPE, F.col("event_type")), _header(POSITION, F.col("sequence_number")), _header(RECORDED, F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")), _header(TAGS, F.to_json("tags")), _header(EXTERNAL, F.col("is_external")))
    return log.select(F.lit(topic).alias("topic"), (F.col("event_id") if key is None else key).cast("string").alias("key"), F.col("payload").alias("value"), envelope.alias("headers"), F.current_timestamp().alias("timestamp"))


def received_events(rows: DataFrame) -> DataFrame:
    """Topic rows as pending events: external, of the current version, with empty headers; what lacks an id or a type is left out."""
    h = header_map(F.col("headers"))
    events = rows.select(h.alias("h"), F.col("value").cast("string").alias("payload"))
    tags = F.coalesce(F.from_json(F.col("h")[TAGS], "array<string>"), F.array().cast("array<string>"))
    out = events.select(F.col("h")[EVENT_ID].alias("event_id"), F.col("h")[EVENT_TYPE].alias("event_type"), F.lit(1).alias("event_version"), F.filter(tags, lambda t: t.contains(":")).alias("tags"), "payload", F.lit(True).alias("is_external"), F.create_map().cast("map<string,string>").alias("headers"))
    return out.where("event_id is not null and event_type is not null").select(*(x.split()[0] for x in PENDING.replace("map<string,string>", "map").split(", ")))


def message_rows(messages: DataFrame) -> DataFrame:
    """Outbox messages as topic rows; a key may be null."""
    return messages.select("topic", "key", F.col("payload").alias("value"), headers_of(F.col("headers")).alias("headers"), F.current_timestamp().alias("timestamp"))


def received_messages(rows: DataFrame) -> DataFrame:
    """Topic rows as messages, with all headers."""
    return rows.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"), header_map(F.col("headers")).alias("headers"))


class FileTopics:
    """Topics as Parquet folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, rows: DataFrame) -> None:
        rows.select("topic", "key", "value", "headers", "timestamp").write.mode("append").parquet(f"{self.root}/{uuid.uuid4().hex}")

    def read(self, topic: str) -> DataFrame:
        if "://" not in self.root and not os.path.isdir(self.root):
            return self.spark.createDataFrame([], TOPIC)
        return self.spark.read.schema(TOPIC).option("recursiveFileLookup", "true").parquet(self.root).where(F.col("topic") == topic)

    def stream(self, topic: str) -> DataFrame:
        if "://" not in self.root:
            os.makedirs(self.root, exist_ok=True)
        return self.spark.readStream.schema(TOPIC).option("recursiveFileLookup", "true").parquet(self.root).where(F.col("topic") == topic)


class KafkaTopics:
    """The same over Spark's Kafka connector, which must be on the class path."""

    def __init__(self, spark: SparkSession, servers: str):
        self.spark, self.servers = spark, servers

    @property
    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "kafka.enable.idempotence": "true", "kafka.acks": "all", "includeHeaders": "true"}

    def read_options(self, topic: str) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "subscribe": topic, "includeHeaders": "true", "startingOffsets": "earliest"}

    def publish(self, rows: DataFrame) -> None:
        rows.select("topic", "key", "value", "headers").write.format("kafka").options(**self.write_options).save()

    def read(self, topic: str) -> DataFrame:
        """All that the topic holds now."""
        return self.spark.read.format("kafka").options(**self.read_options(topic)).load()

    def stream(self, topic: str) -> DataFrame:
        return self.spark.readStream.format("kafka").options(**self.read_options(topic)).load()


def relay_events(store: Store, publish: Callable[[DataFrame], None], topic: str, most: int = 10_000) -> int:
    """One page of the event outbox: publish, then mark. Returns how many; what fails stays. Each task writes its rows by position."""
    page, n = store.snapshot().event_page(most)
    if n:
        publish(event_messages(page.sortWithinPartitions("sequence_number"), topic))
        store.mark_published(page.select("sequence_number"))
    return n


def relay_messages(store: Store, publish: Callable[[DataFrame], None], most: int = 10_000) -> int:
    """The message outbox, page after page while they are full. Each task writes its rows by id."""
    total = 0
    while True:
        page, n = store.snapshot().message_page(most)
        if n:
            publish(message_rows(page.sortWithinPartitions("id")))
            store.mark_sent(page.select("id"))
        total += n
        if n < most:
            return total


def ingest_events(store: Store, rows: DataFrame) -> DataFrame:
    """Appends received events under the ids they came with, so a repeat changes nothing."""
    return store.append(received_events(rows))


def supervised(task: Callable[[], object], first: float = 0.5, most: float = 30.0, calm: float = 60.0, tries: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
    """Runs a task again when it fails, after pauses that double up to `most` and begin anew after a run of `calm` seconds."""
    pause, n = first, 0
    while True:
        began = clock()
        try:
            return task()
        except Exception:
            n += 1
            if tries is not None and n >= tries:
                raise
            if clock() - began >= calm:
                pause = first
            sleep(pause * (1 + 0.1 * random.random()))
            pause = min(2 * pause, most)
