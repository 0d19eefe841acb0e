"""Slowly changing lookup tables: a log of their changes, and refreshes from it.

The log takes the change messages of all lookup tables (``DictionaryLog.append``, run by a stream), a folder for each
table and micro-batch, so that a repeated batch replaces itself. A refresh reads the log from the position that
the view has reached, keeps the changes that touch a column the view uses, maps old and new rows to main keys,
refreshes only those, and saves the position once the refresh is stored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch
from millrace.operators.refresh import refresh_keys
from millrace.plans.catalog import Catalog
from millrace.plans.paths import affected_keys, path_to_main
from millrace.plans.view import View, quoted, semi_join, used_columns
from millrace.sources.positions import Positions

LOG = "key_val string, op string, fields array<string>, before string, seq long, src string, batch long"


def _moved(others: Sequence[str], old: str, new: str) -> Column:
    """Names of the columns that differ, in order. ``old`` and ``new`` are what names of both sides begin with."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.col(f"{old}`{c}`").eqNullSafe(F.col(f"{new}`{c}`")), F.lit(c)) for c in others))))


def diff(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key columns, op, fields): what differs between two states of a table, row by row.

    ``fields`` lists the changed columns in order; inserts and deletes list all columns but the key. Equal rows
    are left out. Both states are dealt by the key once and compared column by column.
    """
    others = [c for c in after.columns if c not in key]
    old = before.select(F.struct(*quoted(before.columns)).alias("o"))
    new = after.select(F.struct(*quoted(after.columns)).alias("n"))
    met = functools.reduce(lambda a, b: a & b, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in key])
    both = old.join(new, met, "full")
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("update")
    every = F.array_sort(F.array(*(F.lit(c) for c in others)).cast("array<string>"))
    out = both.select(*(F.coalesce(f"n.`{c}`", f"o.`{c}`").alias(c) for c in key), op.alias("op"), F.when(op == "update", _moved(others, "o.", "n.")).otherwise(every).alias("fields"))
    return out.where((F.size("fields") > 0) | (F.col("op") != "update"))


def relevant(changes: DataFrame, used: set[str]) -> DataFrame:
    """Changes that touch a used column; inserts and deletes always do."""
    return changes.where((F.col("op") != "update") | F.arrays_overlap("fields", F.array(*(F.lit(c) for c in sorted(used))).cast("array<string>")))


def message_diff(parsed: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Parsed change messages as log rows: key_val, op, fields, before.

    With both images ``fields`` are the columns that differ, else all of them, since nothing is known; a delete lists
    all. An update that changes nothing is left out.
    """
    others = [c for c in columns if c not in key]
    every = F.array_sort(F.array(*(F.lit(c) for c in others)).cast("array<string>"))
    known = (F.col("op") == "upsert") & F.col("before").isNotNull() & F.col("after").isNotNull()
    op = F.when(F.col("op") == "delete", "delete").when(known, "update").otherwise("insert")
    rows = parsed.select(F.to_json(F.struct(*quoted(key)), {"ignoreNullFields": "false"}).alias("key_val"), op.alias("op"), F.when(known, _moved(others, "before.", "after.")).otherwise(every).alias("fields"), F.to_json("before", {"ignoreNullFields": "false"}).alias("before"))
    return rows.where((F.size("fields") > 0) | (F.col("op") != "update"))


@dataclass
class DictionaryLog:
    """The common log of all lookup tables under ``path``."""

    spark: SparkSession
    path: str

    def append(self, src: str, rows: DataFrame, batch: int) -> None:
        """Add a batch of log rows of a table; adding it again replaces it."""
        numbered = rows.withColumn("seq", F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{self.path}/src={src}/batch={batch}")

    def read(self, src: str, after: int | None = None) -> DataFrame:
        """Rows of a table whose batch is later than ``after``; folders of others aren't opened."""
        if not scratch.exists(self.spark, f"{self.path}/src={src}"):
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).option("basePath", self.path).parquet(f"{self.path}/src={src}")
        return rows if after is None else rows.where(F.col("batch") > after)

    def last(self, src: str) -> int | None:
        return self.read(src).agg(F.max("batch")).first()[0]


def _rows_of(log: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows of logged changes, their bare keys (other columns null), and the rows as they are now."""
    schema = table.schema
    keys = log.select(F.from_json("key_val", "struct<{}>".format(", ".join(f"`{c}`: {schema[c].dataType.simpleString()}" for c in key))).alias("k")).select("k.*").distinct()
    bare = keys.select(*(F.col(f"`{c}`") if c in key else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names))
    old = log.where("before IS NOT NULL").select(F.from_json("before", schema).alias("b")).select("b.*")
    return bare.unionByName(old).unionByName(semi_join(table, keys, key))


def changed_main_keys(view: View, catalog: Catalog, changes: dict[str, DataFrame]) -> dict[str, DataFrame | None]:
    """By part, the main keys that logged changes of lookup tables affect; None for the whole part, no entry for none.

    ``changes`` has log rows by table. Old and new rows are both mapped. A table that no condition connects with the
    main one (a constant lookup) makes the whole part be refreshed, if it has a change that matters.
    """
    todo: dict[str, DataFrame | None] = {}
    for part in view.parts:
        found, whole = [], False
        for table, alias in part.sources[1:]:
            if table not in changes:
                continue
            matter = relevant(changes[table], used_columns(part, catalog, alias))
            if path_to_main(part, catalog, alias) is None:
                whole = whole or not matter.isEmpty()
            else:
                found.append(affected_keys(part, catalog, alias, _rows_of(matter, catalog.table(table), catalog.key(table))))
        if whole:
            todo[part.name] = None
        elif found:
            todo[part.name] = functools.reduce(DataFrame.unionByName, found).distinct()
    return todo


def log_of_states(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The difference of two states of a table as log rows."""
    changed = diff(before, after, key)
    key_val = F.to_json(F.struct(*quoted(key)), {"ignoreNullFields": "false"})
    old = before.select(key_val.alias("key_val"), F.to_json(F.struct(*quoted(before.columns)), {"ignoreNullFields": "false"}).alias("before"))
    return changed.select(key_val.alias("key_val"), "op", "fields").join(old, "key_val", "left")


def dictionary_refresh(view: View, before: Catalog, after: Catalog, stored: DataFrame, tables: list[str]) -> DataFrame:
    """The stored view after changes of lookup tables, told from two of their states: only main rows that meet a relevant change are refreshed.

    The states are compared once; what differs is kept as a log of its own.
    """
    log = DictionaryLog(after.spark, scratch.new_folder(after.spark, "changes"))
    for t in tables:
        log.append(t, log_of_states(before.table(t), after.table(t), after.key(t)), 0)
    return refresh_keys(view, after, stored, changed_main_keys(view, after, {t: log.read(t) for t in tables}))


def refresh_from_log(view: View, catalog: Catalog, store, log: DictionaryLog, positions: Positions, job: str, tables: Sequence[str]) -> dict[str, int]:
    """Take up the logged changes since the job's positions in the stored view, then save the new positions; returns them.

    The positions are those of the log at the begin, so what is logged meanwhile comes with the next call. A failure
    leaves the old positions, and applying changes again gives the same view.
    """
    last = {t: n for t in tables if (n := log.last(t)) is not None}
    seen = {t: positions.load(job, t) for t in last}
    fresh = {t: log.read(t, seen[t]).where(F.col("batch") <= n) for t, n in last.items() if seen[t] is None or seen[t] < n}
    if fresh:
        store.refresh(view, catalog, changed_main_keys(view, catalog, fresh))
        for t in fresh:
            positions.save(job, t, last[t])
    return last
