"""From changed rows of any source of a part to the main-table keys that they affect."""

from __future__ import annotations

import functools
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.catalog import Catalog
from millrace.plans.view import Literal, Part, ref, semi_join, side


@dataclass(frozen=True)
class Path:
    """Sources from a changed one to the main table; ``direct`` maps main key columns to columns of the changed source."""

    steps: tuple[str, ...]
    direct: dict[str, str] | None = None


def path_to_main(part: Part, catalog: Catalog, alias: str) -> Path | None:
    """The shortest way over join conditions; None if no condition connects the source with the main table."""
    key, main, alias = catalog.key(part.table), part.alias.lower(), alias.lower()
    if alias == main:
        return Path((alias,), {c: c for c in key})
    same: dict[str, str] = {}
    links: dict[str, set[str]] = {}
    for j in part.joins:
        for left, right in j.on:
            if isinstance(left, Literal) or isinstance(right, Literal):
                continue
            (a, ca), (b, cb) = ref(left), ref(right)
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
            for (x, cx), (y, cy) in (((a, ca), (b, cb)), ((b, cb), (a, ca))):
                if x == main and y == alias and cx in key:
                    same[cx] = cy
    if set(same) == set(key):
        return Path((alias, main), same)
    seen, queue = {alias: (alias,)}, deque([alias])
    while queue:
        at = queue.popleft()
        if at == main:
            return Path(seen[at])
        for to in sorted(links.get(at, ())):
            if to not in seen:
                seen[to] = (*seen[at], to)
                queue.append(to)
    return None


def read_columns(part: Part, catalog: Catalog, alias: str) -> set[str] | None:
    """Columns (in lower case) of the source that its way to the main table reads; None if there is no way."""
    path = path_to_main(part, catalog, alias)
    if path is None:
        return None
    if path.direct is not None:
        return {c.lower() for c in path.direct.values()}
    pairs = [[ref(x) for x in pair] for j in part.joins for pair in j.on if not any(isinstance(x, Literal) for x in pair)]
    return {c.lower() for pair in pairs if {a for a, _ in pair} <= set(path.steps) for a, c in pair if a == path.steps[0]}


def affected_keys(part: Part, catalog: Catalog, alias: str, rows: DataFrame) -> DataFrame | None:
    """Distinct main keys that rows of the source ``alias`` are joined to; None means all (no path, so refresh fully).

    With a direct mapping nothing is joined. Otherwise the sources on the path are joined inwards, and only them;
    literal conditions of the sources on the way are kept. Rows that are alike in what the path reads are joined once.
    """
    path = path_to_main(part, catalog, alias)
    if path is None:
        return None
    key = catalog.key(part.table)
    if path.direct is not None:
        return rows.select(*(F.col(f"`{path.direct[c]}`").alias(c) for c in key)).distinct()
    tables = {a.lower(): t for t, a in part.sources}
    reads = read_columns(part, catalog, alias)
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() in reads)).distinct()
    df, have = rows.alias(path.steps[0]), {path.steps[0]}
    for step in path.steps[1:]:
        have = have | {step}
        conditions = [
            side(left) == side(right)
            for j in part.joins
            for left, right in j.on
            if (sides := {ref(x)[0] for x in (left, right) if not isinstance(x, Literal)}) <= have and step in sides
        ]
        df = df.join(catalog.table(tables[step]).alias(step), functools.reduce(lambda a, b: a & b, conditions), "inner")
    return df.select(*(F.col(f"`{part.alias.lower()}`.`{c}`").alias(c) for c in key)).distinct()


def dictionary_keys(part: Part, catalog: Catalog, changed: dict[str, DataFrame]) -> DataFrame | None:
    """Main keys whose rows meet a changed dictionary row, over several dictionaries at once.

    ``changed`` has, by alias, the keys of changed rows. Each dictionary is met by semi-joins through names, so
    the order of dictionaries and columns plays no part.
    """
    found = []
    for alias, keys in sorted(changed.items()):
        table = next(t for t, a in part.sources if a.lower() == alias.lower())
        one = affected_keys(part, catalog, alias, semi_join(catalog.table(table), keys, catalog.key(table)))
        if one is None:
            return None
        found.append(one)
    return functools.reduce(DataFrame.unionByName, found).distinct() if found else None
