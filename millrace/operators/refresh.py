"""Full and keyed refresh of views, and change sets.

A refresh of keys replaces every stored row of these keys by what the view's select returns for them now: rows
that no longer match a filter or an inner join disappear, rows that are new appear. Applying a change twice
gives the same result as once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.plans.catalog import Catalog
from millrace.plans.paths import affected_keys
from millrace.plans.view import MAIN_KEY, PART, STORED, Part, View, by_keys, key_text, quoted, select, used_columns


@dataclass(frozen=True)
class Change:
    """Rows of one table before and after a change; either may be empty (inserts, deletes)."""

    table: str
    before: DataFrame
    after: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.before.unionByName(self.after)


def dedup_keys(keys: DataFrame) -> DataFrame:
    return keys.distinct()


def changed_keys(part: Part, catalog: Catalog, changes: list[Change]) -> DataFrame | None:
    """Main keys of a part that any of the changes affects, from old and new rows alike; None if all may be.

    A source that is used under several aliases counts under each of them.
    """
    found = []
    for change in changes:
        for table, alias in part.sources:
            if table == change.table:
                keys = affected_keys(part, catalog, alias, change.rows)
                if keys is None:
                    return None
                found.append(keys)
    if not found:
        return catalog.table(part.table).select(*quoted(catalog.key(part.table))).limit(0)
    return functools.reduce(DataFrame.unionByName, found).distinct()


def replace_keys(stored: DataFrame, fresh: DataFrame, part: str, keys: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Stored rows without those of the keys, and the fresh rows of the keys."""
    gone = keys.select(key_text(names).alias("__gone")).distinct()
    stays = stored.join(gone, (F.col(PART) == part) & (F.col(MAIN_KEY) == F.col("__gone")), "left_anti")
    return stays.unionByName(fresh)


def refresh_keys(view: View, catalog: Catalog, stored: DataFrame, keys: dict[str, DataFrame | None]) -> DataFrame:
    """The stored view after a refresh; ``keys`` has the affected main keys by part (None: the whole part)."""
    for part in view.parts:
        if part.name not in keys:
            continue
        own = keys[part.name]
        if own is None:
            stored = stored.where(F.col(PART) != part.name).unionByName(select(part, view, catalog))
        else:
            stored = replace_keys(stored, by_keys(part, view, catalog, own), part.name, own, catalog.key(part.table))
    return stored


def apply_changes(view: View, catalog: Catalog, stored: DataFrame, changes: list[Change]) -> DataFrame:
    """The stored view after the base tables (as ``catalog`` now has them) took up the changes."""
    return refresh_keys(view, catalog, stored, {p.name: changed_keys(p, catalog, changes) for p in view.parts})


def delete_keys(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Stored rows whose key is not among ``keys`` (null parts match null)."""
    gone = keys.select(*(F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(on))).distinct()
    met = functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(on)])
    return stored.join(gone, met, "left_anti")


def fit_to(rows: DataFrame, target: StructType) -> DataFrame:
    """``rows`` with the columns of a target in its order, cast to its types; columns that are missing become null, the stored form's columns stay."""
    here = {c.lower(): c for c in rows.columns}
    own = [(F.col(f"`{here[f.name.lower()]}`") if f.name.lower() in here else F.lit(None)).cast(f.dataType).alias(f.name) for f in target if f.name not in STORED]
    return rows.select(*own, *(c for c in STORED if c in rows.columns))


def upsert(stored: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Stored rows with ``rows`` in the place of those that have the same key; columns that ``rows`` lacks become null."""
    return delete_keys(stored, rows, on).unionByName(fit_to(rows, stored.schema))


def convert_keys(part: Part, view: View, catalog: Catalog, keys: DataFrame) -> DataFrame | None:
    """View keys of main keys, if every key column of the view follows from main key columns alone; else None."""
    names = catalog.key(part.table)
    only_keys = replace(part, columns={k: part.columns[k] for k in view.key}, joins=(), where=None)
    joins = replace(only_keys, joins=part.joins)
    if not used_columns(only_keys, catalog, part.alias) <= set(names) or any(used_columns(replace(joins, joins=[replace(j, on=()) for j in part.joins]), catalog, j.alias) - set(names) for j in part.joins):
        return None
    return keys.select(*quoted(names)).alias(part.alias).select(*(F.expr(part.columns[k]).alias(k) for k in view.key)).distinct()


def fan_out(rows: DataFrame, key: list[str]) -> DataFrame:
    """View keys with several rows (a join that isn't unique, or parts that clash), with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


class FanOutError(ValueError):
    """A refresh gave several rows for one key of the view."""


def refuse_fan_out(rows: DataFrame, view: View) -> None:
    """Raise if a key of the view has several of the (refreshed) rows; an example is named."""
    if found := fan_out(rows, list(view.key)).limit(1).collect():
        raise FanOutError(f"{view.name}: {found[0]['n_rows']} rows for key {[found[0][k] for k in view.key]}")
