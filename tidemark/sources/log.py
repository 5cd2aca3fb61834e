"""Reads of the event log in position order and in delivery order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import format_tag, name_uuid
from tidemark.model import START, EventFilter, ReadCursor


@dataclass
class ProjectionRead:
    events: DataFrame
    held_back: bool


@dataclass
class EventLog:
    """A snapshot of a log: its rows, its tag index, and the commit group from which on rows are withheld from projections.

    Tags are looked up in the index, not in the rows: an event that was appended
    again with other tags is found under those, too.
    """

    rows: DataFrame
    index: DataFrame
    horizon: int | None = None
    #: The last position, of a log whose commit groups grow with its positions, so that delivery order is theirs.
    last: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def matching(self, f: EventFilter) -> DataFrame:
        out = self.rows
        if f.event_types:
            out = out.where(F.col("event_type").isin(*sorted(f.event_types)))
        if f.tags:
            hits = self.index.where(F.col("tag").isin(*sorted(f.tags))).select("sequence_number")
            out = out.join(hits, "sequence_number", "left_semi")
        return out

    def read_from(self, position: int = 0, f: EventFilter = EventFilter(), most: int | None = None, ordered: bool = False) -> DataFrame:
        """Events after a position, nothing is withheld; by position if ordered or if few, and with `most` the first of them."""
        out = self.matching(f).where(F.col("sequence_number") > position)
        return _page(out, ["sequence_number"], most, ordered)

    def read_by_position(self, after: int, f: EventFilter, most: int | None = None) -> ProjectionRead:
        """For logs whose events become visible in order of position: read_from(), never held back."""
        return ProjectionRead(self.read_from(after, f, most), False)

    @cached_property
    def visible_below(self) -> int:
        """The first commit group that projections do not see yet."""
        if self.horizon is not None:
            return self.horizon
        return self.rows.agg(F.coalesce(F.max("commit_group"), F.lit(-1)) + 1).first()[0]

    @staticmethod
    def after(cursor: ReadCursor) -> Column:
        """Written out, so that it reaches the scan."""
        group = F.col("commit_group")
        return (group > cursor.commit_group) | ((group == cursor.commit_group) & (F.col("sequence_number") > cursor.position))

    def delivery(self, cursor: ReadCursor = START, f: EventFilter = EventFilter(), most: int | None = None, ordered: bool = False) -> DataFrame:
        """Events behind a cursor that are not withheld; in delivery order if ordered or if few, and with `most` the first of them."""
        out = self.matching(f).where(self.after(cursor) & (F.col("commit_group") < self.visible_below))
        return _page(out, ["commit_group", "sequence_number"], most, ordered)

    def page(self, cursor: ReadCursor, f: EventFilter, most: int, span: int | None = None) -> Page:
        """The first `most` events behind a cursor as a filter, with how many they are and where they end; span: how many positions a page took before.

        A log with groups that grow with its positions is looked through only as far as the page reaches.
        """
        out = self.matching(f).where(self.after(cursor) & (F.col("commit_group") < self.visible_below))
        if self.last is None:
            return _cut(out, ["commit_group", "sequence_number"], most)
        begin, reach = max(cursor.position, 0), max(2 * most, 1000) if span is None else max(span + span // 4, 1000)
        while True:
            near = out.where(F.col("sequence_number") <= begin + reach)
            whole = begin + reach >= self.last
            found = _reached(near, begin + 1, begin + reach, most, whole)
            if found is not None:
                return found
            reach *= 4

    def held_back(self, f: EventFilter = EventFilter()) -> bool:
        """Whether matching rows wait at or behind the horizon."""
        return not self.matching(f).where(F.col("commit_group") >= self.visible_below).isEmpty()

    def read_for_projection(self, cursor: ReadCursor = START, f: EventFilter = EventFilter(), most: int | None = None) -> ProjectionRead:
        return ProjectionRead(self.delivery(cursor, f, most), self.held_back(f))

    def cursor_at(self, position: int) -> ReadCursor:
        """The cursor of the nearest event at or before a position."""
        if position <= 0:
            return START
        last = self.rows.where(F.col("sequence_number") <= position).agg(F.max(F.struct("sequence_number", "commit_group")).alias("x")).first().x
        return ReadCursor(last.commit_group, last.sequence_number) if last else START

    def revision(self, f: EventFilter = EventFilter()) -> DataFrame:
        """One row: the last position that matches, or 0. Tags alone need only the index."""
        if f.tags and not f.event_types:
            found = self.index.where(F.col("tag").isin(*sorted(f.tags)))
        else:
            found = self.matching(f)
        return found.agg(F.coalesce(F.max("sequence_number"), F.lit(0)).alias("revision"))

    def revision_per_tag(self, tags: list[str]) -> DataFrame:
        return self.index.where(F.col("tag").isin(*tags)).groupBy("tag").agg(F.max("sequence_number").alias("revision"))


#: Pages of more rows are cut by a filter: taking the first of an order would bring them all to one task.
SMALL_PAGE = 1000
#: A value is looked for among so many ranges of values at a time.
RANGES = 1 << 14


@dataclass
class Page:
    """events (a filter over the log: reading it again gives the same), how many, and the place of the last one, if there is any."""

    events: DataFrame
    n: int
    cursor: ReadCursor | None


def nth(rows: DataFrame, by: str, n: int, low: int, high: int) -> tuple[int, int]:
    """The n-th smallest value (from 1) of a column of longs between low and high, and how many rows have lesser ones; from counts of ranges, round by round."""
    below = 0
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        counts = rows.where(F.col(by).between(low, high)).groupBy(F.expr(f"({by} - {low}L) div {width}L").alias("r")).count().collect()  # at most RANGES
        for r, count in sorted(map(tuple, counts)):
            if below + count >= n:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            below += count
        else:
            raise ValueError(f"fewer than {n} rows")
    return low, below


def first_of(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, int, int | None, int | None]:
    """The rows of the `most` smallest values of a column of unlike longs, as a filter; how many, the least and the greatest value."""
    n, low, high = rows.agg(F.count("*"), F.min(by), F.max(by)).first()
    if n > most:
        high, n = nth(rows, by, most, low, high)[0], most
    return (rows if high is None else rows.where(F.col(by) <= high)), n, low, high


def _reached(rows: DataFrame, low: int, high: int, most: int, whole: bool) -> Page | None:
    """The first rows by position between low and high, where groups grow with positions; None if rows are not the whole and fewer than `most`."""
    at, total, left = F.struct("commit_group", "sequence_number"), None, most
    own = rows
    while total is None or high - low >= SMALL_PAGE:
        width = -(-(high - low + 1) // RANGES)
        counts = own.groupBy(F.expr(f"(sequence_number - {low}L) div {width}L").alias("r")).agg(F.count("*"), F.max(at)).collect()  # at most RANGES
        if total is None:
            total = sum(n for _, n, _ in counts)
            if total < most and not whole:
                return None
            if total <= most:
                return Page(rows, total, max((ReadCursor(*x) for _, _, x in counts), default=None))
        for r, n, _ in sorted(map(tuple, counts)):
            if n >= left:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            left -= n
        own = rows.where(F.col("sequence_number").between(low, high))
    g, p = sorted(map(tuple, own.select("commit_group", "sequence_number").collect()))[left - 1]  # of a small range
    return Page(rows.where(F.col("sequence_number") <= p), most, ReadCursor(g, p))


def _cut(rows: DataFrame, order: list[str], most: int) -> Page:
    """The first rows by group and position."""
    group, position = order
    n, g0, g1, p0, p1, end = rows.agg(F.count("*"), F.min(group), F.max(group), F.min(position), F.max(position), F.max(F.struct(*order))).first()
    if n <= most:
        return Page(rows, n, None if end is None else ReadCursor(*end))
    g, below = nth(rows, group, most, g0, g1)
    own = rows.where(F.col(group) == g)
    if g0 < g1:
        p0, p1 = own.agg(F.min(position), F.max(position)).first()
    p, _ = nth(own, position, most - below, p0, p1)
    return Page(rows.where((F.col(group) < g) | ((F.col(group) == g) & (F.col(position) <= p))), most, ReadCursor(g, p))


def _page(rows: DataFrame, order: list[str], most: int | None, ordered: bool) -> DataFrame:
    """A whole read or a page of many rows is sorted only if asked to: sorting it is a shuffle of everything."""
    if most is not None and most <= SMALL_PAGE:
        return rows.orderBy(*order).limit(most)
    if most is not None:
        rows = first_of(rows, order[0], most)[0] if len(order) == 1 else _cut(rows, order, most).events
    return rows.orderBy(*order) if ordered else rows


def tag_index(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag"), "sequence_number").distinct()


def log_of_events(spark: SparkSession, sf_dir: str, horizon: int | None = None) -> EventLog:
    """The table `events` as a log.

    Positions start at 1. Neighbouring blocks of ten events swap commit groups, as if a
    later transaction had committed first. An error counts as an external event.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = [format_tag("user", F.col("user_id")), format_tag("day", F.date_format("ts", "yyyy-MM-dd"))]
    payload = F.to_json(F.struct("user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k")))
    rows = e.select(
        (F.col("event_id") + 1).alias("sequence_number"),
        name_uuid(F.col("event_id").cast("string")).alias("event_id"),
        "event_type",
        F.lit(1).alias("event_version"),
        F.array(*tags).alias("tags"),
        payload.alias("payload"),
        (F.col("event_type") == "error").alias("is_external"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        F.expr("event_id div 10").bitwiseXOR(F.lit(1).cast("long")).alias("commit_group"),
    )
    index = e.select(F.explode(F.array(*tags)).alias("tag"), (F.col("event_id") + 1).alias("sequence_number"))
    return EventLog(rows, index, horizon)
