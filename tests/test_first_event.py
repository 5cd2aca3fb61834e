"""Queries over a log whose first event fails already: nothing is before it."""

import datetime
from pathlib import Path

import duckdb
import pandas as pd

import __spark_entry__

T = datetime.datetime(2024, 1, 1)


def both(spark, folder: Path, name: str, *kinds: str):
    """What a query gives and what its SQL gives, of events of these types by one user."""
    rows = pd.DataFrame([(k, T, 7, kind, 1.0, '{"k": 1}') for k, kind in enumerate(kinds)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    rows.to_parquet(folder / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    return sorted(tuple(r[n] for n in names) for r in got.collect()), sorted(want)


def test_replayed_page(spark, tmp_path):
    got, want = both(spark, tmp_path, "replayed_page", "purchase", "signup", "purchase")
    assert got == want == []


def test_projection_stopped(spark, tmp_path):
    got, want = both(spark, tmp_path, "projection_stopped", "purchase", "signup", "purchase")
    assert got == want == [(None, False, "state not found", 0, None)]
