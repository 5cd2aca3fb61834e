"""A typed query builder over read-model tables.

Conditions are joined by AND. None has a meaning for optional values: on a nullable
column `equal_to(None)` asks for null; on others it leaves the condition out. An empty
`is_in` matches nothing. Orders put nulls where PostgreSQL does. Pages are checked before
anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 200
#: Longer value lists are joined instead of written into the plan.
LITERALS = 1000


class PaginationError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    """An immutable plan; run() gives a lazy DataFrame."""

    table: DataFrame
    keys: tuple[str, ...] = ()
    nullable: frozenset[str] = frozenset()
    conditions: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    orders: tuple[Column, ...] = ()
    limit: int | None = None
    offset: int | None = None
    inner: tuple[Query, ...] = ()
    nothing: bool = False
    enrich: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    # -- conditions

    def where(self, name: str) -> Condition:
        """Name of a column; `a.b` reaches into a struct."""
        if name.split(".")[0] not in self.table.columns:
            raise ValueError(f"no column {name!r}")
        return Condition(self, name)

    and_ = where

    def when_defined(self, value, f: Callable[[Query, object], Query]) -> Query:
        return self if value is None else f(self, value)

    def _with(self, condition: Column) -> Query:
        return replace(self, conditions=(*self.conditions, lambda df: df.where(condition)))

    # -- order and pages

    def order_by(self, name: str) -> Query:
        return replace(self, orders=(*self.orders, F.col(name).asc_nulls_last()))

    def order_by_descending(self, name: str) -> Query:
        return replace(self, orders=(*self.orders, F.col(name).desc_nulls_first()))

    def with_limit(self, n: int, most: int = MAX_LIMIT) -> Query:
        return replace(self, limit=min(n, most))

    def with_offset(self, n: int) -> Query:
        return replace(self, offset=n)

    def validate(self) -> None:
        if self.limit is not None and self.limit < 0:
            raise PaginationError(f"limit {self.limit} is negative")
        if self.offset is not None and self.offset < 0:
            raise PaginationError(f"offset {self.offset} is negative")
        for q in self.inner:
            q.validate()

    # -- results

    def _matching(self) -> DataFrame:
        df = self.table.where(F.lit(False)) if self.nothing else self.table
        for c in self.conditions:
            df = c(df)
        return df

    def _page(self) -> DataFrame:
        df = self._matching()
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.offset:
            df = df.offset(self.offset)
        return df if self.limit is None else df.limit(self.limit)

    def run(self) -> DataFrame:
        self.validate()
        page = self._page()
        return self.enrich(page) if self.enrich else page

    def select(self, name: str) -> Selection:
        """One column, for is_in; filters, order and page stay."""
        return Selection(self, name)

    def count(self) -> DataFrame:
        """One row `n`; order and page do not matter, but must be valid."""
        self.validate()
        return self._matching().agg(F.count("*").alias("n"))

    def count_by(self, name: str) -> DataFrame:
        """value and n; null is a value of its own."""
        self.validate()
        return self._matching().groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Selection:
    query: Query
    name: str

    def values(self) -> DataFrame:
        return self.query._page().select(F.col(self.name).alias("_value"))


@dataclass(frozen=True)
class Condition:
    query: Query
    name: str

    @property
    def _col(self) -> Column:
        return F.col(self.name)

    @property
    def _optional(self) -> bool:
        return self.name in self.query.nullable

    def equal_to(self, value) -> Query:
        if value is None:
            return self.query._with(self._col.isNull()) if self._optional else self.query
        return self.query._with(self._col == F.lit(value))

    def not_equal_to(self, value) -> Query:
        """Rows with null drop out; None asks for rows that have a value."""
        if value is None:
            return self.query._with(self._col.isNotNull()) if self._optional else self.query
        return self.query._with(self._col != F.lit(value))

    def between(self, low, high) -> Query:
        """Both ends included; a missing end leaves the condition out."""
        return self.query if low is None or high is None else self.query._with(self._col.between(F.lit(low), F.lit(high)))

    def greater_than(self, value) -> Query:
        return self.query if value is None else self.query._with(self._col > F.lit(value))

    def is_null(self) -> Query:
        self._must_be_optional()
        return self.query._with(self._col.isNull())

    def is_not_null(self) -> Query:
        self._must_be_optional()
        return self.query._with(self._col.isNotNull())

    def _must_be_optional(self) -> None:
        if not self._optional:
            raise ValueError(f"{self.name} is never null")

    def is_in(self, values: Iterable | Selection | None) -> Query:
        """None leaves the condition out; a None member of a nullable column matches null; an empty list matches nothing."""
        if values is None:
            return self.query
        if isinstance(values, Selection):
            return self._in_selection(values)
        some = list(dict.fromkeys(values))
        nulls = None in some and self._optional
        some = [v for v in some if v is not None]
        if not some and not nulls:
            return replace(self.query, nothing=True)
        if len(some) > LITERALS:
            return self._in_many(some, nulls)
        c = self._col.isin(*some) if some else F.lit(False)
        return self.query._with(c | self._col.isNull() if nulls else c)

    def _in_many(self, values: list, nulls: bool) -> Query:
        kind = self.query.table.select(self._col).schema[0].dataType.simpleString()
        list_ = self.query.table.sparkSession.createDataFrame([(v,) for v in values], f"_value {kind}")
        name = self.name

        def condition(df: DataFrame) -> DataFrame:
            found = df.join(list_, df[name] == list_["_value"], "left_semi")
            return found.unionByName(df.where(F.col(name).isNull())) if nulls else found

        return replace(self.query, conditions=(*self.query.conditions, condition))

    def _in_selection(self, selection: Selection) -> Query:
        name = self.name

        def condition(df: DataFrame) -> DataFrame:
            return df.join(selection.values(), F.col(name) == F.col("_value"), "left_semi")

        return replace(self.query, conditions=(*self.query.conditions, condition), inner=(*self.query.inner, selection.query))


def paginated(source: Callable[[int | None, int | None], DataFrame], limit: int | None = None, offset: int | None = None, most: int = MAX_LIMIT) -> DataFrame:
    """A user's own query, called with a page that has passed the same checks."""
    limit = None if limit is None else min(limit, most)
    if (limit or 0) < 0 or (offset or 0) < 0:
        raise PaginationError("limit and offset are not negative")
    return source(limit, offset)
