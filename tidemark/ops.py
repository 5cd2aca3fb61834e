"""Operations: how projections stand, as a table, JSON or a page; control; measured progress."""

from __future__ import annotations

import html
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.sources.store import Conflict, Store
from tidemark.streaming.projector import Projector


def checkpoints(store: Store) -> DataFrame:
    """By name: cursor, running, error."""
    return store.snapshot().checkpoints().orderBy("projection_name")


def as_json(store: Store) -> str:
    return json.dumps([r.asDict() for r in checkpoints(store).collect()])


def as_html(store: Store) -> str:
    cells = lambda *xs: "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in xs)
    rows = "".join(f"<tr>{cells(r.projection_name, r.commit_group, r.global_position, 'running' if r.running else 'paused', r.error)}</tr>" for r in checkpoints(store).collect())
    return f"<table><tr><th>projection</th><th>group</th><th>position</th><th>state</th><th>error</th></tr>{rows}</table>"


def control_text(action: str, name: str, position: int | None = None) -> str:
    """A control request as text: `action:position:name`; the position is empty but for move."""
    return f"{action}:{'' if position is None else position}:{name}"


def parse_control(text: str) -> tuple[str, str, int | None] | None:
    """(action, name, position), or None for a text that is no request."""
    action, _, rest = text.partition(":")
    position, colon, name = rest.partition(":")
    moves = action == "move"
    if not colon or not name or action not in ("pause", "resume", "reindex", "move") or moves != position.isdigit() or (position and not moves):
        return None
    return action, name, int(position) if moves else None


def control(projector: Projector, action: str, position: int | None = None) -> None:
    """pause, resume, reindex, or move to a position."""
    if action == "move":
        projector.move_to(int(position or 0))
    elif action in ("pause", "resume", "reindex"):
        getattr(projector, action)()
    else:
        raise ValueError(f"unknown action {action!r}")


@dataclass
class Measured:
    """A store's appends: how many, with how many events, how many conflicts and failures, and the seconds of each kind of end."""

    store: Store
    counts: dict[str, int] = field(default_factory=lambda: {"appends": 0, "events": 0, "conflicts": 0, "failures": 0})
    seconds: dict[str, float] = field(default_factory=lambda: {"appends": 0.0, "conflicts": 0.0, "failures": 0.0})

    def append(self, pending: DataFrame, *args, **kwargs) -> DataFrame:
        began, end = time.monotonic(), "failures"
        try:
            done = self.store.append(pending, *args, **kwargs)
            end = "appends"
            self.counts["events"] += done.count()
            return done
        except Conflict:
            end = "conflicts"
            raise
        finally:
            self.counts[end] += 1
            self.seconds[end] += time.monotonic() - began

    def __getattr__(self, name: str):
        return getattr(self.store, name)


class Progress(StreamingQueryListener):
    """Rows and milliseconds of each batch of each query."""

    def __init__(self):
        self.batches: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
