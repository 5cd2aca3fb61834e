"""Running projections: page by page from a checkpoint, woken by a stream of manifests.

A page is read in delivery order behind the checkpoint, folded, and its states and the new
checkpoint are committed in one manifest. A failing event stops the projection there, with
everything before it kept. A checkpoint that moved meanwhile is read again.
"""

from __future__ import annotations

import os
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import START, Checkpoint, EventFilter, ReadCursor
from tidemark.operators.commands import CommandHandler
from tidemark.operators.fold import Projection, fold_steps, project
from tidemark.sources.store import Conflict, Store

PAGE, PAGES, ERROR_CHARS = 100_000, 10, 32_000


@dataclass
class Projector:
    """Folds a store's log into one of its state tables (columns: key, state).

    Once a page is committed, on_page gets the states of the keys it touched, and on_event the state of
    each key after each of its events (fold_steps). measured counts pages, events and seconds.
    """

    store: Store
    projection: Projection
    page: int = PAGE
    pages: int = PAGES
    on_page: Callable[[DataFrame], None] | None = None
    on_event: Callable[[DataFrame], None] | None = None
    measured: dict[str, float] = field(default_factory=lambda: {"pages": 0, "events": 0, "seconds": 0.0, "conflicts": 0, "failures": 0})
    _span: int | None = field(default=None, init=False, repr=False)

    @property
    def name(self) -> str:
        return self.projection.name

    @property
    def schema(self) -> str:
        body = self.projection.state
        kind = body if body.lower().startswith("struct<") or " " not in body.strip() else f"struct<{body}>"
        return f"key {self.projection.key_type}, state {kind}"

    def states(self) -> DataFrame:
        return self.store.snapshot().state(self.name, self.schema)

    def read_with_cursor(self) -> tuple[DataFrame, ReadCursor]:
        """The states and how far they go, as of one manifest."""
        now = self.store.snapshot()
        return now.state(self.name, self.schema), now.checkpoint(self.name).cursor

    def _page(self) -> bool:
        """Folds one page; whether there may be more."""
        now = self.store.snapshot()
        c = now.checkpoint(self.name)
        if not c.running:
            return False
        began = time.monotonic()
        try:
            page = now.log.page(c.cursor, EventFilter.of(self.projection.seen), self.page, self._span)
            if not page.n:
                return False
            self._span = page.cursor.position - max(c.cursor.position, 0) if page.n == self.page else None
            events = page.events
            try:
                out = project(self.projection, events, now.state(self.name, self.schema), page.cursor)
                nxt = Checkpoint(self.name, out.cursor or c.cursor, out.error is None, out.error)
                self.store.persist(self.name, self.schema, ("key",), out.states.where("state is not null"), out.states.where("state is null").select("key"), nxt, c.cursor, unique=True)
                if self.on_page:
                    self.on_page(out.states)
                if self.on_event:
                    up_to = F.struct("commit_group", "sequence_number") <= F.struct(F.lit(nxt.cursor.commit_group).alias("commit_group"), F.lit(nxt.cursor.position).alias("sequence_number"))
                    self.on_event(fold_steps(self.projection, events.where(up_to), now.state(self.name, self.schema)))
                self.measured["pages"] += 1
                self.measured["events"] += page.n
                self.measured["failures"] += out.error is not None
                return page.n == self.page and out.error is None
            except Conflict:
                self.measured["conflicts"] += 1
                return True
            except Exception:
                self.measured["failures"] += 1
                self.store.save_checkpoint(replace(c, running=False, error=traceback.format_exc()[-ERROR_CHARS:]))
                return False
        finally:
            self.measured["seconds"] += time.monotonic() - began

    def run_pass(self) -> bool:
        """Up to `pages` pages; whether there may be more."""
        return any(not self._page() for _ in range(self.pages)) is False

    def catch_up(self) -> None:
        while self.run_pass():
            pass

    def wait_for(self, cursor: ReadCursor, seconds: float = 30.0) -> bool:
        """Read-your-writes: true once the checkpoint has reached a cursor."""
        until = time.monotonic() + seconds
        while True:
            c = self.store.snapshot().checkpoint(self.name)
            if c.cursor >= cursor:
                return True
            if not c.running or time.monotonic() > until:
                return False
            time.sleep(0.2)

    # -- control

    def pause(self) -> None:
        self.store.save_checkpoint(replace(self.store.snapshot().checkpoint(self.name), running=False))

    def resume(self) -> None:
        self.store.save_checkpoint(replace(self.store.snapshot().checkpoint(self.name), running=True, error=None))

    def move_to(self, position: int) -> None:
        """To the event at or before a position; running stays as it is, an error goes."""
        now = self.store.snapshot()
        self.store.save_checkpoint(replace(now.checkpoint(self.name), cursor=now.log.cursor_at(position), error=None))

    def reindex(self) -> None:
        """From the start, without the states so far."""
        now = self.store.snapshot()
        c = replace(now.checkpoint(self.name), cursor=START, error=None)
        self.store.persist(self.name, self.schema, ("key",), deletes=now.state(self.name, self.schema).select("key"))
        self.store.save_checkpoint(c)


def run_sync(handler: CommandHandler, command: dict, projector: Projector, seconds: float = 30.0) -> tuple[str | None, DataFrame | None]:
    """Runs a command and waits until the projection has its events; TimeoutError if it has not in time."""
    rejection, events = handler.run(projector.store, command)
    if rejection is None and (last := events.agg(F.max(F.struct("commit_group", "sequence_number")).alias("x")).first().x):
        if not projector.wait_for(ReadCursor(*last), seconds):
            raise TimeoutError(f"{projector.name} has not reached {tuple(last)} in {seconds} s")
    return rejection, events


def leased(projector: Projector, holder: str, seconds: float = 30.0) -> bool:
    """Catches up if this holder has the projection's lease; false if another one has."""
    if not projector.store.lease(projector.name, holder, seconds):
        return False
    projector.catch_up()
    return True


def run_live(projectors: list[Projector], checkpoint: str, once: bool = False) -> StreamingQuery:
    """One streaming query that wakes projectors when manifests appear: all at first, then those that handle a type of event that was brought, or whose checkpoint was moved by hand.

    The stream only wakes: what is folded follows from manifests and checkpoints, so a
    repeated batch changes nothing.
    """
    names = [p.name for p in projectors]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"projection names used twice: {', '.join(twice)}")
    store = projectors[0].store
    if store.files.local is not None:
        os.makedirs(f"{store.files.local}/manifests", exist_ok=True)

    begun: set[str] = set()

    def wake(manifests: DataFrame, _: int) -> None:
        news = manifests.select(F.from_json("value", "brought array<string>, moved array<string>").alias("m"))
        known = news.where("m is not null and m.brought is not null")
        types = {r[0] for r in known.select(F.explode("m.brought")).distinct().collect()}
        moved = {r[0] for r in known.select(F.explode("m.moved")).distinct().collect()}
        unknown = not news.where("m is null or m.brought is null").isEmpty()
        for p in projectors:
            if unknown or p.name not in begun or p.name in moved or not types.isdisjoint(p.projection.seen):
                p.catch_up()
            begun.add(p.name)

    manifests = store.spark.readStream.option("wholetext", "true").text(f"{store.root}/manifests")
    writer = manifests.writeStream.foreachBatch(wake).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def stream_fold(keyed: DataFrame, state: str, step: Callable[[tuple | None, dict], tuple | None], checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Keyed state across micro-batches, for Python functions: sink gets the keys that changed, with their new state.

    keyed: a streaming frame with key, commit_group, sequence_number and what step reads.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    order = ["commit_group", "sequence_number"]

    key_type = keyed.schema["key"].dataType.simpleString()
    names = [f.split()[0] for f in state.split(", ")]

    def fold(key, parts, held):
        now = held.get if held.exists else None
        parts = list(parts)
        rows = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(order)
        columns = [rows[c].tolist() for c in rows.columns]
        for values in zip(*columns):
            now = step(now, dict(zip(rows.columns, values)))
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
        yield pd.DataFrame([{"key": key[0], **dict(zip(names, now or [None] * len(names)))}])

    out = keyed.groupBy("key").applyInPandasWithState(fold, f"key {key_type}, {state}", state, "update", GroupStateTimeout.NoTimeout)
    writer = out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_event(events: DataFrame, effect: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """A projection without state: a side effect for each batch, at least once."""
    writer = events.writeStream.foreachBatch(effect).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_order(group: Column | str = "commit_group") -> list[Column]:
    return [F.col(group) if isinstance(group, str) else group, F.col("sequence_number")]
