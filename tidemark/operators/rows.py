"""Small named tables for tests: insert, filter, find, count, sort, page, update, delete."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Rows:
    """One table. Rows that were inserted first come first."""

    spark: SparkSession
    schema: str
    data: list[tuple] = field(default_factory=list)

    def insert(self, *row: tuple) -> None:
        self.data += row

    def all(self) -> DataFrame:
        return self.spark.createDataFrame(self.data, self.schema)

    def filter(self, where: Column) -> DataFrame:
        return self.all().where(where)

    def find(self, where: Column):
        return self.filter(where).first()

    def count(self, where: Column | None = None) -> int:
        return self.all().where(F.lit(True) if where is None else where).count()

    def exists(self, where: Column) -> bool:
        return not self.filter(where).isEmpty()

    def sort_by(self, *columns: str | Column) -> DataFrame:
        return self.all().orderBy(*columns)

    def page(self, limit: int, offset: int = 0, *order: str | Column) -> DataFrame:
        df = self.all()
        return (df.orderBy(*order) if order else df).offset(offset).limit(limit)

    def _rewrite(self, df: DataFrame) -> None:
        self.data = [tuple(r) for r in df.collect()]

    def update(self, where: Column, **sets: Column) -> int:
        n = self.count(where)
        hit = F.coalesce(where, F.lit(False))
        self._rewrite(self.all().withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in sets.items()}))
        return n

    def delete(self, where: Column) -> int:
        n = self.count(where)
        self._rewrite(self.all().where(~F.coalesce(where, F.lit(False))))
        return n

    def truncate(self) -> None:
        self.data = []


@dataclass
class Tables:
    """Tables by name."""

    spark: SparkSession
    tables: dict[str, Rows] = field(default_factory=dict)

    def create(self, name: str, schema: str) -> Rows:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = Rows(self.spark, schema)
        return self.tables[name]

    def __getitem__(self, name: str) -> Rows:
        return self.tables[name]

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)

    @property
    def names(self) -> list[str]:
        return sorted(self.tables)
