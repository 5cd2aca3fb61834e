"""A store of Parquet files under numbered manifests.

A commit writes data files first and then creates manifest n + 1, which only one writer
can. The manifest names the live files of the log, its tag index, outboxes and state
tables, and holds all checkpoints: whatever one manifest says changed at once. A reader
picks one manifest and has a snapshot. The number of the manifest that brought an event is
its commit group, so groups become visible in order and nothing is ever held back.

State tables are kept in buckets of their key; a commit rewrites only the buckets it touches.

Appends and marks add folders; compact() makes one of many and drops from the outboxes what has been delivered, and vacuum()
deletes old manifests with the folders that no other one names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import LOG, MESSAGE, SNAPSHOT, TAG_INDEX, Checkpoint, EventFilter, ReadCursor
from tidemark.sources.log import SMALL_PAGE, EventLog, first_of

LOG_TABLES = {"log": LOG, "tags": TAG_INDEX, "event_outbox": "global_position long", "published": "global_position long", "message_outbox": f"id long, {MESSAGE}", "message_done": "id long"}
SNAPSHOT_KEY = ("snapshot_id", "snapshot_key", "snapshot_version")
BUCKETS = 64
#: File systems whose rename fails if the target is there, so that it is a create that one writer wins.
EXCLUSIVE_RENAME = ("hdfs", "abfs", "abfss", "ofs")
#: Asks a file system to create a file only if there is none; one that can't refuses to.
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: So many event ids at most are pushed to a scan as values, which is Spark's own limit.
FEW_IDS = 10
#: So many event types of a commit are named in its manifest.
FEW_TYPES = 1000
#: So many tags at most are looked up in the index by value.
FEW_TAGS = 1000
#: The bits of so many places at most (128 MB) go to all tasks at once.
FEW_BITS = 1 << 30


class Conflict(Exception):
    """The revision, or a checkpoint, is not the expected one."""


class Lost(Exception):
    """Another writer created the manifest first."""


@dataclass
class Manifest:
    version: int = 0
    next_position: int = 1
    next_message: int = 1
    tables: dict[str, list[str]] = field(default_factory=dict)
    states: dict[str, dict] = field(default_factory=dict)
    checkpoints: dict[str, dict] = field(default_factory=dict)
    leases: dict[str, dict] = field(default_factory=dict)
    #: Of this commit alone: types of the events it brought (null: too many to name), and checkpoints that were moved by hand.
    brought: list[str] | None = field(default_factory=list)
    moved: list[str] = field(default_factory=list)

    def next(self) -> Manifest:
        m = Manifest(**json.loads(json.dumps(self.__dict__)))
        m.version += 1
        m.brought, m.moved = [], []
        return m


class Files:
    """The few file operations a manifest needs, on local paths or any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        url = urlparse(root)
        self.scheme = url.scheme or "file"
        self.local = url.path.rstrip("/") if self.scheme == "file" else None

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        if self.local is not None:
            folder = f"{self.local}/manifests"
            names = os.listdir(folder) if os.path.isdir(folder) else []
        else:
            fs, p = self._fs(f"{self.root}/manifests")
            names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def load(self, version: int) -> dict:
        if self.local is not None:
            with open(f"{self.local}/manifests/{version:012d}.json") as f:
                return json.load(f)
        fs, p = self._fs(f"{self.root}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def create(self, version: int, value: dict) -> None:
        """Complete or not at all, and only if there is none yet."""
        name, temp, text = f"{version:012d}.json", f".{uuid.uuid4().hex}", json.dumps(value)
        if self.local is not None:
            folder = f"{self.local}/manifests"
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{temp}", "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{folder}/{temp}", f"{folder}/{name}")
            except FileExistsError:
                raise Lost(name) from None
            finally:
                os.unlink(f"{folder}/{temp}")
            return
        _, to = self._fs(f"{self.root}/manifests/{name}")
        if self.scheme not in EXCLUSIVE_RENAME:
            self._create_if_none(to, text)
            return
        fs, p = self._fs(f"{self.root}/manifests/{temp}")
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise Lost(name)

    def _create_if_none(self, to, text: str) -> None:
        """On object stores, where rename is a copy: by a conditional create, or not at all."""
        fs, _ = self._fs(str(to))
        try:
            out = fs.createFile(to).recursive().overwrite(False).must(CONDITIONAL, True).build()
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Lost(str(to)) from None
            raise NotImplementedError(f"{self.scheme} has no create that one of several writers wins: {e}") from e
        try:
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as e:
            raise Lost(str(to)) from e

    def children(self, path: str) -> list[tuple[str, float]]:
        """Name and time of change (seconds) of what a folder under the root holds."""
        fs, p = self._fs(f"{self.root}/{path}")
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        fs.delete(p, True)


def _cursor(c: dict) -> ReadCursor:
    return ReadCursor(c["group"], c["position"])


def _none(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows, without a Python worker."""
    fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


@dataclass(frozen=True)
class Snapshot:
    """The store as of one manifest."""

    store: Store
    manifest: Manifest

    def table(self, name: str) -> DataFrame:
        schema, dirs = LOG_TABLES[name], self.manifest.tables.get(name, [])
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*(f"{self.store.root}/{d}" for d in dirs)) if dirs else _none(spark, schema)

    @property
    def log(self) -> EventLog:
        return EventLog(self.table("log"), self.table("tags"), self.manifest.version + 1, self.manifest.next_position - 1)

    def state(self, name: str, schema: str) -> DataFrame:
        dirs = list(self.manifest.states.get(name, {}).get("buckets", {}).values())
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*(f"{self.store.root}/{d}" for d in dirs)) if dirs else _none(spark, schema)

    def checkpoint(self, name: str) -> Checkpoint:
        c = self.manifest.checkpoints.get(name)
        return Checkpoint(name, _cursor(c), c["running"], c["error"]) if c else Checkpoint(name)

    def checkpoints(self) -> DataFrame:
        rows = [(n, c["group"], c["position"], c["running"], c["error"]) for n, c in sorted(self.manifest.checkpoints.items())]
        return self.store.spark.createDataFrame(rows, "projection_name string, commit_group long, global_position long, running boolean, error string")

    def outbox(self, most: int | None = None) -> DataFrame:
        """Unpublished events; with `most` the first of them, by position if they are few."""
        if most is not None and most <= SMALL_PAGE:
            # A page looks for its positions in the outbox, and in the log only behind the first of them.
            waiting = self.waiting("event_outbox", "published", "global_position").orderBy("global_position").limit(most)
            first = waiting.agg(F.min("global_position")).first()[0]
            rows = self.table("log").where(F.col("sequence_number") >= F.lit(0 if first is None else first))
            return rows.join(waiting, F.col("sequence_number") == F.col("global_position"), "left_semi").orderBy("sequence_number")
        return self._first(self.table("log").where(~F.col("is_external")), "sequence_number", ("event_outbox", "published", "global_position"), most)[0]

    def messages(self, most: int | None = None) -> DataFrame:
        """Waiting messages; with `most` the first of them, by id if they are few."""
        if most is not None and most <= SMALL_PAGE:
            return self.waiting("message_outbox", "message_done", "id").orderBy("id").limit(most)
        return self._first(self.table("message_outbox"), "id", ("message_outbox", "message_done", "id"), most)[0]

    def event_page(self, most: int) -> tuple[DataFrame, int]:
        """The first unpublished events and how many; reading them again gives the same."""
        return self._first(self.table("log").where(~F.col("is_external")), "sequence_number", ("event_outbox", "published", "global_position"), most)

    def message_page(self, most: int) -> tuple[DataFrame, int]:
        """The first waiting messages and how many; reading them again gives the same."""
        return self._first(self.table("message_outbox"), "id", ("message_outbox", "message_done", "id"), most)

    def _first(self, rows: DataFrame, by: str, box: tuple[str, str, str], most: int | None) -> tuple[DataFrame, int]:
        """Of rows those that wait in an outbox, with `most` the first of them; and how many.

        rows are all that ever were in the outbox. So if between the first and the last waiting one there are as many rows as wait, they
        are the same, and no row is shuffled to find that out; else they are joined.
        """
        outbox, done, key = box
        if self.manifest.tables.get(done):
            waiting = self.store.staged(self.waiting(*box).select(key))
        else:
            waiting = self.table(outbox).select(key)
        waiting, n, low, high = first_of(waiting, key, (1 << 62) if most is None else most)
        if not n:
            return rows.where(F.lit(False)), 0
        there = rows.where(F.col(by).between(low, high))
        if there.count() != n:
            there = there.join(waiting.select(F.col(key).alias("_key")), F.col(by) == F.col("_key"), "left_semi")
        return there, n

    def waiting(self, outbox: str, done: str, by: str) -> DataFrame:
        """Rows of an outbox that are not done."""
        return self.table(outbox).join(self.table(done), by, "left_anti")


@dataclass(frozen=True)
class Batch:
    """Staged events: rows with `place`, their number from 1 in order; how many; and whether callers gave any ids."""

    rows: DataFrame
    n: int
    given: bool

    def isEmpty(self) -> bool:
        return not self.n


def _ascending(staged: DataFrame) -> bool:
    """Whether rows are in the order of `ordinal` within each part, as their marks count them. A row for each stretch that a task reads comes back."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batches:
            if b.num_rows:
                mono, ordinal = b.column(0), b.column(1)
                steps = pc.equal(pc.subtract(mono.slice(1), mono.slice(0, len(mono) - 1)), 1)
                rises = pc.greater_equal(ordinal.slice(1), ordinal.slice(0, len(ordinal) - 1))
                good = pc.all(pc.or_(pc.invert(steps), rises), min_count=0).as_py()
                # Where marks leave a gap another part begins, or rows that another task reads: cut there.
                cuts = [0, *(i + 1 for i in pc.indices_nonzero(pc.invert(steps)).to_pylist()), len(mono)]
                for lo, hi in zip(cuts, cuts[1:]):
                    one = (mono[lo].as_py(), mono[hi - 1].as_py(), ordinal[lo].as_py(), ordinal[hi - 1].as_py(), good)
                    if out and out[-1][1] + 1 == one[0]:
                        out[-1] = (out[-1][0], one[1], out[-1][2], one[3], out[-1][4] and good and out[-1][3] <= one[2])
                    else:
                        out.append(one)
        yield pa.RecordBatch.from_pylist([dict(zip(("m0", "m1", "o0", "o1", "good"), x)) for x in out], pa.schema([("m0", pa.int64()), ("m1", pa.int64()), ("o0", pa.int64()), ("o1", pa.int64()), ("good", pa.bool_())]))

    found = staged.select("mono", F.col("ordinal").cast("long").alias("ordinal")).mapInArrow(stretches, "m0 long, m1 long, o0 long, o1 long, good boolean").collect()
    found.sort(key=lambda r: r.m0)
    return all(r.good for r in found) and all(a.o1 <= b.o0 for a, b in zip(found, found[1:]) if a.m1 + 1 == b.m0)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def snapshot(self, version: int | None = None) -> Snapshot:
        if version is None:
            version = max(self.files.versions(), default=0)
        return Snapshot(self, Manifest(**self.files.load(version)) if version else Manifest())

    def commit(self, change: Callable[[Snapshot, Manifest], object], retries: int = 10):
        """Applies change(snapshot, next manifest) and creates that manifest, unless it changes nothing; begins anew if another writer was first."""
        for left in range(retries, -1, -1):
            now = self.snapshot()
            new = now.manifest.next()
            result = change(now, new)
            if new == now.manifest.next():
                return result
            try:
                self.files.create(new.version, new.__dict__)
                return result
            except Lost:
                if not left:
                    raise

    def _write(self, df: DataFrame, name: str, *by: str) -> str:
        path = f"data/{name}/{uuid.uuid4().hex}"
        writer = df.write.option("parquet.bloom.filter.enabled#event_id", "true") if name == "log" else df.write
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{path}")
        return path

    def _add(self, m: Manifest, name: str, df: DataFrame) -> None:
        m.tables.setdefault(name, []).append(self._write(df, name))

    def staged(self, df: DataFrame) -> DataFrame:
        """df as written: whatever in it was chosen at run time is fixed."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._write(df, 'staged')}")

    @staticmethod
    def _marked(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id())

    @staticmethod
    def _parts(marked: DataFrame, *more: Column) -> list[Row]:
        """A row a partition, in their order: how many rows, the first mark, and what more says."""
        return marked.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("m"), *more).orderBy("part").collect()

    @staticmethod
    def _dense(parts: list[Row], first: int = 0) -> tuple[Column, int]:
        """Numbers without gaps from `first` in the order of the partitions and their marks, and how many; from the count of each partition."""
        shifts, total = {}, 0
        for r in parts:
            shifts[r.part] = first + total - r.m
            total += r.n
        shift = F.element_at(F.create_map(*(F.lit(x).cast("long") if i % 2 else F.lit(x) for kv in shifts.items() for i, x in enumerate(kv))), F.col("part")) if shifts else F.lit(0)
        return (shift + F.col("mono")).cast("long"), total

    # -- appending

    def append(self, pending: DataFrame, f: EventFilter | None = None, expected: int | None = None, messages: DataFrame | None = None) -> DataFrame:
        """Appends events, with messages in the same commit; gives them back with their positions, in order.

        With a filter and an expected revision the append fails with Conflict if the
        revision is any other, unless there are no events. pending: see model.PENDING; a
        column `ordinal` gives the order, else it is that of the rows. An event whose id is
        in the log already keeps its row; of the same id in one batch the first counts.
        Tags are indexed for such an event, too.
        """
        staged = self.named(pending)
        empty, no_messages = staged.isEmpty(), messages is None or messages.isEmpty()
        if empty and no_messages:
            return _none(self.spark, LOG)

        def change(now: Snapshot, m: Manifest) -> DataFrame | None:
            if not no_messages:
                self.add_messages(m, messages)
            if empty:
                return None
            if expected is not None:
                revision = now.log.revision(f or EventFilter()).first().revision
                if revision != expected:
                    raise Conflict(f"revision {revision}, expected {expected}")
            return self.add_events(now, m, staged)

        done = self.commit(change)
        return done if done is not None else _none(self.spark, LOG)

    def named(self, pending: DataFrame) -> Batch:
        """Pending events with ids and order, fixed by writing them: whatever is retried reads the same.

        Rows that are in order within partitions, whose partitions don't overlap, stay where they are; others are sorted once.
        """
        given = "ordinal" in pending.columns
        rows = pending.withColumn("given", F.col("event_id").isNotNull()).withColumn("event_id", F.coalesce("event_id", F.expr("uuid()")))
        staged = self.staged(self._marked(rows))
        any_id = F.max("given").alias("given")
        if not given:
            parts = self._parts(staged, any_id)
        elif isinstance(staged.schema["ordinal"].dataType, T.IntegralType):
            o = F.col("ordinal").cast("long")
            ahead = F.try_subtract(o, F.col("mono"))
            parts = self._parts(staged, any_id, F.min(o).alias("lo"), F.max(o).alias("hi"), F.count(ahead).alias("known"), F.min(ahead).alias("least"), F.max(ahead).alias("most"))
            if all(r.known == r.n for r in parts):
                parts.sort(key=lambda r: (r.lo, r.hi))
                apart = all(a.hi <= b.lo for a, b in zip(parts, parts[1:]))
                if not apart or not (all(r.least == r.most for r in parts) or _ascending(staged)):
                    parts = None
            else:
                parts = None
        else:
            parts = None
        if parts is None:
            staged = self.staged(self._marked(staged.drop("part", "mono").repartitionByRange("ordinal").sortWithinPartitions("ordinal")))
            parts = self._parts(staged, any_id)
        place, n = self._dense(parts, 1)
        return Batch(staged.withColumn("place", place), n, any(r.given for r in parts))

    def add_events(self, now: Snapshot, m: Manifest, batch: Batch) -> DataFrame:
        """Within a commit: staged events (see named()) behind those that are there."""
        rows, first = batch.rows, m.next_position
        again = self._again(now, batch) if batch.given else None
        if again is None:
            position, total = F.col("place") + F.lit(first - 1), batch.n
            new = rows
        else:
            marks, total = self._skipped(again, batch.n)
            position = self._rank + F.lit(first - 1)
            rows = rows.withColumn("_bucket", F.bitmap_bucket_number("place")).join(marks, "_bucket", "left")
            new = rows.where(~self._skip)
        m.next_position += total
        names = [f.name for f in LOG.fields]
        at = F.timestamp_micros(F.lit(time.time_ns() // 1000))
        stored = lambda number, when: {
            "sequence_number": number,
            "event_version": F.coalesce("event_version", F.lit(1)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "is_external": F.coalesce("is_external", F.lit(False)),
            "headers": F.coalesce("headers", F.create_map().cast("map<string,string>")),
            "recorded_at": when,
            "commit_group": F.lit(m.version).cast("long"),
        }
        if total:
            self._add(m, "log", new.withColumns(stored(position, at)).select(*names))
        log = self.spark.read.schema(LOG).parquet(f"{self.root}/{m.tables['log'][-1]}") if total else _none(self.spark, LOG)
        types = [r[0] for r in log.select("event_type").distinct().limit(FEW_TYPES + 1).collect()]
        m.brought = None if len(types) > FEW_TYPES or m.brought is None else sorted({*m.brought, *types})
        # The index of new positions is new; only events that came again may have tags in it already.
        fresh = log.select(F.explode(F.array_distinct("tags")).alias("tag"), "sequence_number")
        if again is not None:
            own = again.select("old_position", "first", "extra", F.bitmap_bucket_number("first").alias("_bucket"), F.col("first").alias("place")).join(marks, "_bucket", "left")
            own = own.withColumn("sequence_number", F.coalesce("old_position", position))
            fresh = fresh.unionByName(self._unindexed(now, own.select(F.explode("extra").alias("tag"), "sequence_number")))
        self._add(m, "tags", fresh.sortWithinPartitions("tag", "sequence_number"))
        self._add(m, "event_outbox", log.where(~F.col("is_external")).select(F.col("sequence_number").alias("global_position")))
        if again is None:
            return log.orderBy("sequence_number")
        # Events that came again, under the position of the row that is kept.
        old = again.select("place", "old_position", "old_time", "first")
        kept = rows.where(self._skip).select(*(c for c in batch.rows.columns if c != "place"), F.col("place").alias("_own")).join(old.withColumnRenamed("place", "_own"), "_own")
        kept = kept.withColumns({"place": F.col("first"), "_bucket": F.bitmap_bucket_number("first")}).join(marks, "_bucket", "left")
        kept = kept.withColumns(stored(F.coalesce("old_position", position), F.coalesce("old_time", at))).select("_own", *names)
        both = new.withColumn("_own", F.col("place")).withColumns(stored(position, at)).select("_own", *names).unionByName(kept)
        return both.orderBy("_own").select(*names)

    def _again(self, now: Snapshot, batch: Batch) -> DataFrame | None:
        """Of a batch the rows that bring no event, as a table, or None: place, old_position and old_time of an event that is in the log already,
        first (the first place of its id in the batch), and extra, the tags that its row does not have.

        Only ids that callers gave can be. A few of them reach the scan, where the log
        files' Bloom filters decide; many are joined. Without a log ids are counted before anything wider is shuffled.
        """
        own = batch.rows.where("given").select("event_id", "place", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
        log = now.table("log").select("event_id", F.col("sequence_number").alias("old_position"), F.col("recorded_at").alias("old_time"), F.col("tags").alias("old_tags"))
        if not now.manifest.tables.get("log"):
            if own.select("event_id").repartition("event_id").groupBy("event_id").count().where("count > 1").isEmpty():
                return None
        elif batch.n <= FEW_IDS or own.limit(FEW_IDS + 1).count() <= FEW_IDS:
            few = [r.event_id for r in own.select("event_id").collect()]
            log = log.where(F.col("event_id").isin(*few))
        by = Window.partitionBy("event_id").orderBy("place")
        seen = own.join(log, "event_id", "left").select("place", "tags", "old_position", "old_time", "old_tags", F.first("place").over(by).alias("first"), F.first("tags").over(by).alias("first_tags"))
        late = seen.where("old_position is not null or place > first")
        again = self.staged(late.select("place", "old_position", "old_time", "first", F.array_except("tags", F.coalesce("old_tags", "first_tags")).alias("extra")))
        return None if again.isEmpty() else again

    def _skipped(self, again: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Of n places those that bring no event, as bits (null: none) of a row for each 32,768 of them, with how many are before; and how many places are left."""
        bits = self.staged(again.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")))
        counts = {r[0]: r[1] for r in bits.select("_bucket", F.bitmap_count("_bits")).collect()}
        before, skipped = [], 0
        for b in range(1, (n - 1) // 32_768 + 2):
            before.append((b, skipped))
            skipped += counts.get(b, 0)
        before = self.spark.createDataFrame(pa.table({"_bucket": [b for b, _ in before], "_before": [x for _, x in before]}))
        marks = self.staged(before.join(bits, "_bucket", "left"))
        return F.broadcast(marks) if n < FEW_BITS else marks, n - skipped

    @property
    def _bit(self) -> tuple[Column, Column, Column]:
        """Of a place: how many whole bytes of the bits are before it, its bit in the next one, and the value of that."""
        at = F.bitmap_bit_position("place")
        byte = F.shiftright(at, 3).cast("int")
        return byte, (at % 8).cast("int"), F.conv(F.hex(F.substring(F.col("_bits"), byte + 1, F.lit(1))), 16, 10).cast("long")

    @property
    def _skip(self) -> Column:
        _, bit, value = self._bit
        return F.coalesce(F.getbit(value, bit) == 1, F.lit(False))

    @property
    def _rank(self) -> Column:
        """The number of a place among those that bring an event."""
        byte, bit, value = self._bit
        within = F.bitmap_count(F.substring(F.col("_bits"), F.lit(1), byte)) + F.bit_count(value.bitwiseAND((F.pow(F.lit(2), bit) - 1).cast("long")))
        return F.col("place") - F.col("_before") - F.coalesce(within, F.lit(0))

    @staticmethod
    def _unindexed(now: Snapshot, tags: DataFrame) -> DataFrame:
        """Of tags and positions those that the index does not have. A few tags reach its scan."""
        tags, index = tags.distinct(), now.table("tags")
        few = [r[0] for r in tags.select("tag").distinct().limit(FEW_TAGS + 1).collect()]
        if len(few) <= FEW_TAGS:
            index = index.where(F.col("tag").isin(*(x for x in few if x is not None)))
        return tags.join(index, ["tag", "sequence_number"], "left_anti")

    # -- upkeep

    def compact(self, folders: int = 32) -> list[str]:
        """Rewrites log tables of more than so many folders as one folder each, in one commit; gives their names.

        Log and index are sorted, by position and by tag. Of outboxes only what waits is kept, and nothing
        of what was delivered, so that later pages don't look through it. Older manifests keep their folders until vacuum().
        """
        order = {"log": ("sequence_number",), "tags": ("tag", "sequence_number")}
        pairs = {"event_outbox": ("published", "global_position"), "message_outbox": ("message_done", "id")}

        def change(now: Snapshot, m: Manifest) -> list[str]:
            many = [n for n, dirs in m.tables.items() if len(dirs) > folders]
            done = []
            for name in many:
                if name in order:
                    rows = now.table(name)
                    m.tables[name] = [self._write(rows.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]), name)]
                    done.append(name)
            for name, (marks, by) in pairs.items():
                if name in many or marks in many:
                    m.tables[name], m.tables[marks] = [self._write(now.waiting(name, marks, by), name)], []
                    done += [name, marks]
            return done

        if not any(len(dirs) > folders for dirs in self.snapshot().manifest.tables.values()):
            return []
        return self.commit(change)

    def vacuum(self, seconds: float = 86_400.0) -> int:
        """Deletes manifests but the last, and folders of data that no manifest left names, once they are older than that; gives how many of both.

        A reader that holds a snapshot longer than `seconds` loses it, and so does a writer that takes longer to commit.
        """
        before = time.time() - seconds
        versions = self.files.versions()
        aged = dict(self.files.children("manifests"))
        old = [v for v in versions[:-1] if aged.get(f"{v:012d}.json", before + 1) <= before]
        named: set[str] = set()
        for v in versions:
            if v not in old:
                m = self.files.load(v)
                folders = [d for dirs in m["tables"].values() for d in dirs] + [d for x in m["states"].values() for d in x["buckets"].values()]
                named |= {"/".join(d.split("/")[:3]) for d in folders}
        for v in old:
            self.files.delete(f"manifests/{v:012d}.json")
        gone = len(old)
        for name, _ in self.files.children("data"):
            for folder, changed in self.files.children(f"data/{name}"):
                if changed <= before and f"data/{name}/{folder}" not in named:
                    self.files.delete(f"data/{name}/{folder}")
                    gone += 1
        return gone

    # -- messages

    def add_messages(self, m: Manifest, messages: DataFrame) -> None:
        """Within a commit: messages behind those that are there."""
        staged = self.staged(self._marked(messages.select(*(x.split()[0] for x in MESSAGE.split(", ")))))
        number, total = self._dense(self._parts(staged), m.next_message)
        self._add(m, "message_outbox", staged.select(number.alias("id"), "topic", "key", "payload", "headers"))
        m.next_message += total

    def enqueue(self, messages: DataFrame) -> None:
        if not messages.isEmpty():
            self.commit(lambda _, m: self.add_messages(m, messages))

    def mark_published(self, positions: DataFrame) -> None:
        self.commit(lambda _, m: self._add(m, "published", positions.select(F.col(positions.columns[0]).cast("long").alias("global_position"))))

    def mark_sent(self, ids: DataFrame) -> None:
        self.commit(lambda _, m: self._add(m, "message_done", ids.select(F.col(ids.columns[0]).cast("long").alias("id"))))

    # -- state tables and checkpoints

    def persist(self, name: str, schema: str, keys: tuple[str, ...], upserts: DataFrame | None = None, deletes: DataFrame | None = None, checkpoint: Checkpoint | None = None, expected: ReadCursor | None = None, unique: bool = False) -> None:
        """Deletes and then upserts rows of a state table, and moves a checkpoint, all or nothing.

        If the checkpoint stands elsewhere than expected, Conflict. Among rows with one
        key any may win; unique: the caller says that no key comes twice.
        """
        def change(now: Snapshot, m: Manifest) -> None:
            if checkpoint is not None:
                self.move(now, m, checkpoint, expected)
            self.put(now, m, name, schema, keys, upserts, deletes, unique)

        self.commit(change)

    @staticmethod
    def move(now: Snapshot, m: Manifest, checkpoint: Checkpoint, expected: ReadCursor | None = None) -> None:
        """Within a commit: moves a checkpoint; Conflict if it stands elsewhere than expected."""
        at = now.checkpoint(checkpoint.name).cursor
        if expected is not None and at != expected:
            raise Conflict(f"{checkpoint.name} is at {at}, expected {expected}")
        c = checkpoint.cursor
        m.checkpoints[checkpoint.name] = {"group": c.commit_group, "position": c.position, "running": checkpoint.running, "error": checkpoint.error}

    def put(self, now: Snapshot, m: Manifest, name: str, schema: str, keys: tuple[str, ...], upserts: DataFrame | None = None, deletes: DataFrame | None = None, unique: bool = False) -> None:
        """Within a commit: deletes and then upserts rows of a state table."""
        columns = [f.name for f in T._parse_datatype_string(schema).fields]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        touched = [d.select(*keys) for d in (upserts, deletes) if d is not None]
        if not touched:
            return
        keyed = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
        hit = [r[0] for r in keyed.select(bucket).distinct().collect()]  # at most BUCKETS
        if not hit:
            return
        state = m.states.setdefault(name, {"buckets": {}})["buckets"]
        dirs = [state[str(b)] for b in hit if str(b) in state]
        old = self.spark.read.schema(schema).parquet(*(f"{self.root}/{d}" for d in dirs)) if dirs else _none(self.spark, schema)
        rows = old.join(keyed if unique else keyed.distinct(), list(keys), "left_anti").select(*columns)
        if upserts is not None:
            new = upserts.select(*columns)
            rows = rows.unionByName(new if unique else new.dropDuplicates(list(keys)))
        # A number, because few rows would come to one task, which writes one bucket's file after the other.
        tasks = min(len(hit), max(1, self.spark.sparkContext.defaultParallelism))
        path = self._write(rows.withColumn("_bucket", bucket).repartition(tasks, "_bucket"), f"state_{name}", "_bucket")
        there = {int(n.partition("=")[2]) for n, _ in self.files.children(path) if n.startswith("_bucket=")}
        for b in hit:
            state.pop(str(b), None)
            if b in there:
                state[str(b)] = f"{path}/_bucket={b}"

    def save_checkpoint(self, c: Checkpoint) -> None:
        """Whatever stood there. Live projections of that name wake."""

        def change(now: Snapshot, m: Manifest) -> None:
            self.move(now, m, c)
            m.moved.append(c.name)

        self.commit(change)

    # -- start-up

    def check(self) -> DataFrame:
        """table and whether the files of the last manifest have all columns that are expected, for each table that has files."""
        now = self.snapshot()
        there, wanted = [], []
        for name, dirs in sorted(now.manifest.tables.items()):
            schema = LOG_TABLES[name] if isinstance(LOG_TABLES[name], T.StructType) else T._parse_datatype_string(LOG_TABLES[name])
            wanted += [(name, f.name, f.dataType.simpleString()) for f in schema.fields] if dirs else []
            for d in dirs:
                there += [(name, d, f.name, f.dataType.simpleString()) for f in self.spark.read.parquet(f"{self.root}/{d}").schema.fields]
        found = self.spark.createDataFrame(there, "name string, folder string, column string, kind string")
        want = self.spark.createDataFrame(wanted, "name string, column string, kind string")
        n = want.groupBy("name").agg(F.count("*").alias("columns"))
        per = found.join(want, ["name", "column", "kind"], "left_semi").groupBy("name", "folder").agg(F.count("*").alias("has")).join(n, "name")
        return n.join(per.groupBy("name").agg(F.min(F.col("has") == F.col("columns")).alias("whole")), "name", "left").select(F.col("name").alias("table"), F.coalesce("whole", F.lit(False)).alias("whole"))

    # -- leases

    def lease(self, name: str, holder: str, seconds: float = 30.0, now: float | None = None) -> bool:
        """Takes or renews the lease of a name; false while another holder has it."""
        now = time.time() if now is None else now

        def change(_: Snapshot, m: Manifest) -> bool:
            held = m.leases.get(name)
            if held and held["holder"] != holder and held["until"] > now:
                return False
            m.leases[name] = {"holder": holder, "until": now + seconds}
            return True

        held = self.snapshot().manifest.leases.get(name)
        if held and held["holder"] != holder and held["until"] > now:
            return False
        return self.commit(change)

    def release(self, name: str, holder: str) -> None:
        def change(_: Snapshot, m: Manifest) -> None:
            if m.leases.get(name, {}).get("holder") == holder:
                del m.leases[name]

        self.commit(change)

    # -- command snapshots

    def save_snapshot(self, rows: DataFrame) -> None:
        """Rows as model.SNAPSHOT; one that is behind what is stored changes nothing."""
        old = self.snapshot().state("command_snapshots", SNAPSHOT)
        ahead = old.select(*SNAPSHOT_KEY, F.col("global_position").alias("stored"))
        newer = rows.join(ahead, list(SNAPSHOT_KEY), "left").where("stored is null or global_position >= stored").drop("stored")
        best = newer.groupBy(*SNAPSHOT_KEY).agg(F.max_by(F.struct(*(c for c in newer.columns if c not in SNAPSHOT_KEY)), "global_position").alias("x"))
        self.persist("command_snapshots", SNAPSHOT, SNAPSHOT_KEY, best.select(*SNAPSHOT_KEY, "x.*"))

    def load_snapshot(self, snapshot_id: str, key: str, version: int) -> DataFrame:
        return self.snapshot().state("command_snapshots", SNAPSHOT).where((F.col("snapshot_id") == snapshot_id) & (F.col("snapshot_key") == key) & (F.col("snapshot_version") == version))

    def delete_snapshot(self, snapshot_id: str, key: str, version: int) -> None:
        keys = self.spark.createDataFrame([(snapshot_id, key, version)], "snapshot_id string, snapshot_key string, snapshot_version int")
        self.persist("command_snapshots", SNAPSHOT, SNAPSHOT_KEY, deletes=keys)
