"""Keyset pages of a table's keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_start(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` keys in order, null parts first (a top-k, not a full sort)."""
    return df.select(*key).orderBy(*key).limit(limit)


def _beyond(df: DataFrame, key: Sequence[str], after: Sequence) -> Column:
    """Keys that come after one. A bound of the leading column, where it isn't null, also reaches the scan as a filter."""
    last = F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(key, after, strict=True)))
    beyond = F.struct(*key) > last
    return beyond if after[0] is None else (F.col(key[0]) >= F.lit(after[0])) & beyond


def scan_next(df: DataFrame, key: Sequence[str], after: Sequence, limit: int) -> DataFrame:
    """The next ``limit`` keys after a key, in order; null parts count as smaller than all others."""
    return df.where(_beyond(df, key, after)).select(*key).orderBy(*key).limit(limit)


def pages(df: DataFrame, key: Sequence[str], limit: int, after: Sequence | None = None) -> Iterator[DataFrame]:
    """Pages of keys in order until none is left, each with at most ``limit`` keys. Only the last key of a page comes to the driver.

    A page is found by a top-k over what is left, so this is for measured walks over keys; ``streaming.backfill``
    refreshes whole views.
    """
    while True:
        page = scan_start(df, key, limit) if after is None else scan_next(df, key, after, limit)
        last = page.agg(F.max(F.struct(*key)).alias("last"), F.count(F.lit(1)).alias("n")).first()
        if not last.n:
            return
        upto = F.struct(*key) <= F.struct(*(F.lit(last.last[c]).cast(df.schema[c].dataType).alias(c) for c in key))
        yield df.where(upto if after is None else upto & _beyond(df, key, after)).select(*key)
        after = [last.last[c] for c in key]
