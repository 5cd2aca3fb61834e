"""Keyed read-model tables: lookups, and writes as rewrites of a DataFrame.

A write takes the old table and gives the new one (and, where asked, what changed); who
holds the table decides when to commit it (see tidemark.sources.store).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import snake_case

from .query import Query


def _on(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k] == right[k])
    return cond


@dataclass(frozen=True)
class Table:
    """Rows with a key of one or more columns."""

    rows: DataFrame
    keys: tuple[str, ...]
    nullable: frozenset[str] = frozenset()
    enrich: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def _new(self, rows: DataFrame) -> Table:
        return Table(rows.select(*self.rows.columns), self.keys, self.nullable, self.enrich)

    # -- reads

    def query(self) -> Query:
        return Query(self.rows, self.keys, self.nullable, enrich=self.enrich)

    def all(self) -> DataFrame:
        return self.query().run()

    def find_many(self, keys: DataFrame) -> DataFrame:
        """One row for each distinct key; `found` is false, and other columns null, for missing ones."""
        wanted = keys.select(*self.keys).dropDuplicates()
        marked = self.rows.withColumn("found", F.lit(True))
        out = wanted.join(marked, list(self.keys), "left")
        return out.withColumn("found", F.coalesce("found", F.lit(False)))

    def fetch(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys that are there."""
        return self.rows.join(keys.select(*self.keys), list(self.keys), "left_semi").select(*self.rows.columns)

    # -- writes

    def upsert(self, rows: DataFrame) -> Table:
        """New rows replace those with their key. Of rows that share a key any may win; a table of keys alone keeps its own."""
        new = rows.select(*self.rows.columns).dropDuplicates(list(self.keys))
        if set(self.keys) == set(self.rows.columns):
            return self.insert_missing(rows)[0]
        kept = self.rows.join(new.select(*self.keys), list(self.keys), "left_anti")
        return self._new(kept.select(*self.rows.columns).unionByName(new))

    def upsert_keyed(self, keyed: DataFrame) -> Table:
        """Rows with a struct column `key` beside them; a row whose key columns differ from it fails the write."""
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"key.{k}"))
        checked = keyed.withColumn(self.keys[0], F.when(same, F.col(self.keys[0])).otherwise(F.raise_error(F.lit("a row does not have the key it is stored under"))))
        return self.upsert(checked)

    def insert_missing(self, rows: DataFrame) -> tuple[Table, DataFrame]:
        """Rows whose key is free; the second table is what was inserted."""
        fresh = rows.select(*self.rows.columns).dropDuplicates(list(self.keys)).join(self.rows.select(*self.keys), list(self.keys), "left_anti")
        fresh = fresh.select(*self.rows.columns)
        return self._new(self.rows.unionByName(fresh)), fresh

    def delete(self, keys: DataFrame) -> Table:
        return self._new(self.rows.join(keys.select(*self.keys), list(self.keys), "left_anti"))

    def delete_where(self, plan: Callable[[Query], Query]) -> Table:
        """Without a condition every row goes. Order, limit and offset are refused."""
        q = plan(self.query())
        if q.orders or q.limit is not None or q.offset is not None:
            raise ValueError("a delete has no order and no page")
        q.validate()
        gone = q._matching().select(*self.keys)
        return self.delete(gone)

    def persist(self, upserts: DataFrame, deletes: DataFrame) -> Table:
        """Deletes first, then upserts: a key in both is there afterwards."""
        return self.delete(deletes).upsert(upserts)

    def update(self, key: dict[str, object]) -> Update:
        if set(key) != set(self.keys):
            raise ValueError(f"the key is {', '.join(self.keys)}")
        return Update(self, key)


@dataclass(frozen=True)
class Update:
    """A conditional change of some columns of one row."""

    table: Table
    key: dict[str, object]
    sets: tuple[tuple[str, Column], ...] = ()
    conditions: tuple[Column, ...] = ()

    def set(self, name: str, value) -> Update:
        if name in self.table.keys:
            raise ValueError(f"{name} is part of the key")
        if name not in self.table.rows.columns:
            raise ValueError(f"no column {name!r}")
        if name in dict(self.sets):
            raise ValueError(f"{name} is set twice")
        return Update(self.table, self.key, (*self.sets, (name, F.lit(value))), self.conditions)

    def set_when_defined(self, name: str, value) -> Update:
        return self if value is None else self.set(name, value)

    def where_equal(self, name: str, value) -> Update:
        c = F.col(name).isNull() if value is None else F.col(name) == F.lit(value)
        return Update(self.table, self.key, self.sets, (*self.conditions, c))

    def where_less_than(self, name: str, value) -> Update:
        return Update(self.table, self.key, self.sets, (*self.conditions, F.col(name) < F.lit(value)))

    def _hit(self) -> Column:
        if not self.sets:
            raise ValueError("nothing is set")
        hit = F.lit(True)
        for k, v in self.key.items():
            hit = hit & (F.col(k) == F.lit(v))
        for c in self.conditions:
            hit = hit & c
        return F.coalesce(hit, F.lit(False))

    def run(self) -> tuple[Table, bool]:
        """The changed table, and whether a row was hit."""
        hit, rows = self._hit(), self.table.rows
        changed = not rows.where(hit).isEmpty()
        new = {n: F.when(hit, v.cast(rows.schema[n].dataType)).otherwise(F.col(n)) for n, v in self.sets}
        return self.table._new(rows.withColumns(new)), changed


def columns_of(fields: str, names: dict[str, str] | None = None) -> list[Column]:
    """Selects fields as snake_case columns, or under the names given."""
    return [F.col(f.name).alias((names or {}).get(f.name, snake_case(f.name))) for f in T._parse_datatype_string(fields).fields]


def flattened(rows: DataFrame, name: str) -> DataFrame:
    """A struct column as columns `name_field` in its place; a null struct gives nulls."""
    fields = rows.schema[name].dataType.fieldNames()
    return rows.select(*(F.col(c) for c in rows.columns if c != name), *(F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields))


def nested(rows: DataFrame, name: str, fields: list[str], optional: bool = True) -> DataFrame:
    """The way back; an optional struct is null exactly if all of its columns are."""
    whole = F.struct(*(F.col(f"{name}_{f}").alias(f) for f in fields))
    some = F.coalesce(*(F.when(F.col(f"{name}_{f}").isNotNull(), True) for f in fields), F.lit(False))
    out = F.when(some, whole) if optional else whole
    return rows.select(*(F.col(c) for c in rows.columns if c not in {f"{name}_{f}" for f in fields}), out.alias(name))
