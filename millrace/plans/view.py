"""A materialized view: selects, inner and left equi-joins, a filter, and UNION ALL of such parts.

Expressions are Spark SQL text over the aliases of the part (``functions.dialect`` translates text written in
the other dialect). A view's rows carry more columns in the stored form: the part they come from, the key of the
part's main row and, if the view asks for ``links``, the keys of the joined rows. They let a refresh find a row
again whatever the view's own key is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.catalog import Catalog

PART, MAIN_KEY, LINKS = "__part", "__main_key", "__links"
#: Columns of the stored form that the view itself doesn't have.
STORED = (PART, MAIN_KEY, LINKS)


@dataclass(frozen=True)
class Literal:
    """A constant side of a join condition."""

    value: object


@dataclass(frozen=True)
class Join:
    """``how`` is inner or left; ``on`` lists equalities of "alias.column" or Literal sides, joined by AND. Names with dots are quoted: "a.`b.c`"."""

    table: str
    alias: str
    on: Sequence[tuple[str | Literal, str | Literal]]
    how: str = "inner"


@dataclass(frozen=True)
class Part:
    table: str
    alias: str
    columns: Mapping[str, str]
    joins: Sequence[Join] = ()
    where: str | None = None
    name: str = "default"

    @property
    def sources(self) -> list[tuple[str, str]]:
        """(table, alias) of all sources, the main one first."""
        return [(self.table, self.alias), *((j.table, j.alias) for j in self.joins)]


@dataclass(frozen=True)
class View:
    name: str
    key: Sequence[str]
    parts: Sequence[Part]
    #: Output types by column; what a part selects is cast to them.
    types: Mapping[str, str] = field(default_factory=dict)
    #: Whether stored rows carry the keys of the joined rows, so that changes without old images can be mapped.
    links: bool = False


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def ref(x: str) -> tuple[str, str]:
    """(alias in lower case, column) of "alias.column"; either may be quoted."""
    alias, column = re.fullmatch(r"(`[^`]*`|[^.`]+)\.(.+)", x).groups()
    return alias.strip("`").lower(), column.strip("`")


def side(x: str | Literal) -> Column:
    return F.lit(x.value) if isinstance(x, Literal) else F.col("`{}`.`{}`".format(*ref(x)))


def condition(join: Join) -> Column:
    return functools.reduce(lambda a, b: a & b, [side(left) == side(right) for left, right in join.on])


def joined(part: Part, catalog: Catalog, main: DataFrame | None = None) -> DataFrame:
    """All sources of a part, joined as written; ``main`` stands in for the main table's rows."""
    df = (catalog.table(part.table) if main is None else main).alias(part.alias)
    for j in part.joins:
        df = df.join(catalog.table(j.table).alias(j.alias), condition(j), j.how)
    return df


def key_text(names: Sequence[str], of: str | None = None) -> Column:
    """The stored form of a key, of the rows at hand or of an alias."""
    column = lambda c: F.col(f"`{of}`.`{c}`" if of else f"`{c}`").alias(c)
    return F.to_json(F.struct(*(column(c) for c in names)), {"ignoreNullFields": "false"})


def link_text(alias: str, key: Column) -> Column:
    return F.concat(F.lit(f"{alias.lower()}="), key)


def select(part: Part, view: View, catalog: Catalog, main: DataFrame | None = None) -> DataFrame:
    """Rows of one part with the stored form's columns at the end."""
    df = joined(part, catalog, main)
    df = df.where(F.expr(part.where)) if part.where else df
    own = [F.expr(text).cast(view.types[name]).alias(name) if name in view.types else F.expr(text).alias(name) for name, text in part.columns.items()]
    more = [F.lit(part.name).alias(PART), key_text(catalog.key(part.table), part.alias).alias(MAIN_KEY)]
    if view.links:
        links = [link_text(j.alias, key_text(catalog.key(j.table), j.alias)) for j in part.joins]
        more.append((F.array(*links) if links else F.array().cast("array<string>")).alias(LINKS))
    return df.select(*own, *more)


def full(view: View, catalog: Catalog, bookkeeping: bool = False) -> DataFrame:
    """The whole view."""
    df = functools.reduce(DataFrame.unionByName, [select(p, view, catalog) for p in view.parts])
    return df if bookkeeping else df.drop(*STORED)


def semi_join(rows: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` whose key is among ``keys``; null parts of a key match null."""
    wanted = keys.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)))
    met = functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    return rows.join(wanted, met, "left_semi")


def by_keys(part: Part, view: View, catalog: Catalog, keys: DataFrame) -> DataFrame:
    """Rows of a part for the given main-table keys (null parts of a key match null)."""
    return select(part, view, catalog, semi_join(catalog.table(part.table), keys, catalog.key(part.table)))


_TEXT = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")
_NAME = re.compile(r"(?:(`[^`]*`|[A-Za-z_]\w*)\s*\.\s*)?(`[^`]*`|[A-Za-z_]\w*|\*)")


def used_columns(part: Part, catalog: Catalog, alias: str) -> set[str]:
    """Columns of a source that the part's joins, filter and outputs name, so nothing needs to be declared.

    A name without an alias counts for every source that has it: a column may be taken for used that isn't, but none
    that is used is left out.
    """
    alias = alias.lower()
    source = next(t for t, a in part.sources if a.lower() == alias)
    columns = {c.lower(): c for c in catalog.table(source).columns}
    texts = [*part.columns.values(), part.where or ""]
    names = {(a.strip("`").lower(), c.strip("`").lower()) for text in texts for a, c in _NAME.findall(_TEXT.sub("''", text))}
    names |= {(a, c.lower()) for j in part.joins for pair in j.on for x in pair if not isinstance(x, Literal) for a, c in [ref(x)]}
    if ("", "*") in names or (alias, "*") in names:
        return set(columns.values())
    return {columns[c] for a, c in names if a in ("", alias) and c in columns}
