"""Names of tables, their primary keys, and where their rows come from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Catalog:
    """Base tables as DataFrames with the primary key of each.

    ``tables`` may be swapped per run (``with_tables``) to look at another state of the same tables.
    """

    spark: SparkSession
    keys: Mapping[str, tuple[str, ...]]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: Folder with a Parquet table for each key; else tables that ``tables`` lacks are the session's.
    folder: str | None = None

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, keys: Mapping[str, tuple[str, ...]]) -> Catalog:
        return cls(spark, keys, folder=folder)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            known = self.folder and name in self.keys
            self.tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet") if known else self.spark.table(f"`{name}`")
        return self.tables[name]

    def key(self, name: str) -> tuple[str, ...]:
        return tuple(self.keys[name])

    def with_tables(self, **other: DataFrame) -> Catalog:
        return Catalog(self.spark, self.keys, self.tables | other, self.folder)
