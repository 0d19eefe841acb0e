"""Checks of views before they run: names, join conditions, outputs, targets, then each expression by Spark's analysis."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.refresh import convert_keys
from millrace.plans.catalog import Catalog
from millrace.plans.paths import path_to_main
from millrace.plans.view import Literal, Part, View, joined, quoted, ref, select

WRONG = (AnalysisException, ParseException)


@dataclass(frozen=True)
class Issue:
    kind: str
    where: str
    text: str
    error: bool = True


@dataclass(frozen=True)
class Handler:
    """Views that are refreshed together, and how changes of their tables arrive: "stream" (by message) or "batch" (by the lookup log)."""

    name: str
    views: Sequence[str]
    inputs: Mapping[str, str] = field(default_factory=dict)


def _known(catalog: Catalog, table: str) -> bool:
    try:
        return bool(catalog.table(table).columns)
    except WRONG:
        return False


def _first(e: Exception) -> str:
    return str(e).split("\n")[0]


def validate(view: View, catalog: Catalog, target: StructType | None = None) -> list[Issue]:
    """All issues of a view; it can run when none of them is an error. ``target`` is the schema it is stored with. Nothing is executed."""
    out: list[Issue] = []
    names = [p.name for p in view.parts]
    out += [Issue("DuplicateViewPart", view.name, n) for n in sorted({n for n in names if names.count(n) > 1})]
    for part in view.parts:
        found = _basic(part, view, catalog, target)
        out += found or _expressions(part, view, catalog, target)
    return out


def _basic(part: Part, view: View, catalog: Catalog, target: StructType | None) -> list[Issue]:
    out, known = [], {part.alias.lower(): part.table}
    at = f"{view.name}/{part.name}"
    columns = {}
    for table, alias in part.sources:
        if _known(catalog, table):
            columns[alias.lower()] = {c.lower() for c in catalog.table(table).columns}
        else:
            out.append(Issue("UnknownSourceTable", at, table))
    for j in part.joins:
        if j.alias.lower() in known:
            out.append(Issue("DuplicateAlias", at, j.alias))
        known[j.alias.lower()] = j.table
        if j.how not in ("inner", "left"):
            out.append(Issue("IllegalJoin", at, j.how))
        for left, right in j.on:
            sides = [x for x in (left, right) if not isinstance(x, Literal)]
            refs = [ref(x) for x in sides if re.fullmatch(r"(`[^`]*`|[^.`]+)\.(.+)", x)]
            if not sides or left == right or len(refs) < len(sides) or not any(a == j.alias.lower() for a, _ in refs):
                out.append(Issue("IllegalJoinCondition", at, f"{left} = {right}"))
            for alias, column in refs:
                if alias not in known:
                    out.append(Issue("UnknownAlias", at, f"{alias}.{column}"))
                elif alias in columns and column.lower() not in columns[alias]:
                    out.append(Issue("UnknownColumnInCondition", at, f"{alias}.{column}"))
        if not j.on:
            out.append(Issue("IllegalJoinCondition", at, f"{j.alias}: none"))
    for name, text in part.columns.items():  # plain references
        if m := re.fullmatch(r"\s*(`[^`]*`|[A-Za-z_]\w*)\.(`[^`]*`|[A-Za-z_]\w*)\s*", text):
            alias, column = m[1].strip("`").lower(), m[2].strip("`").lower()
            if alias in columns and column not in columns[alias]:
                out.append(Issue("UnknownColumn", f"{at}.{name}", text))
            elif alias not in known:
                out.append(Issue("UnknownAlias", f"{at}.{name}", text))
    out += [Issue("UnknownOutputColumn", at, k) for k in view.key if k not in part.columns]
    if target is not None:
        there = {f.name.lower() for f in target}
        out += [Issue("UnknownOutputColumn", at, f"{c}: not in the target") for c in part.columns if c.lower() not in there]
    return out


def _warnings(part: Part, view: View, catalog: Catalog) -> list[Issue]:
    at = f"{view.name}/{part.name}"
    out = [Issue("KeyExtractionImpossible", at, j.alias, error=False) for j in part.joins if path_to_main(part, catalog, j.alias) is None]
    if convert_keys(part, view, catalog, catalog.table(part.table).select(*quoted(catalog.key(part.table)))) is None:
        out.append(Issue("ComplexKeyGeneration", at, ", ".join(view.key), error=False))
    return out


def _expressions(part: Part, view: View, catalog: Catalog, target: StructType | None) -> list[Issue]:
    at = f"{view.name}/{part.name}"
    sources, out, failed = joined(part, catalog), [], None
    try:
        whole = select(part, view, catalog).schema
        if target is not None:
            kinds = {f.name.lower(): f.dataType for f in target}
            for f in whole:
                if f.name.lower() in kinds:
                    try:
                        catalog.spark.createDataFrame([], StructType([f])).select(F.col(f"`{f.name}`").cast(kinds[f.name.lower()])).schema  # noqa: B018
                    except WRONG:
                        out.append(Issue("MismatchedOutputType", f"{at}.{f.name}", f"{f.dataType.simpleString()} to {kinds[f.name.lower()].simpleString()}"))
    except WRONG as e:
        failed = e
    if part.where:
        try:
            sources.where(F.expr(part.where)).schema  # noqa: B018
        except WRONG as e:
            out.append(Issue("CustomFilterError", at, _first(e)))
    for name, text in part.columns.items():
        try:
            # window functions and aggregates would see only the refreshed keys
            sources.where(F.expr(f"({text}) IS NULL")).schema  # noqa: B018
        except WRONG as e:
            out.append(Issue("CustomColumnError", f"{at}.{name}", _first(e)))
            continue
        if name in view.types:
            try:
                sources.select(F.expr(text).cast(view.types[name])).schema  # noqa: B018
            except WRONG as e:
                out.append(Issue("MismatchedOutputType", f"{at}.{name}", _first(e)))
    if failed and not out:  # no single expression shows it
        out.append(Issue("UnexpectedError", at, _first(failed)))
    return out or _warnings(part, view, catalog)


def validate_all(views: Sequence[View], handlers: Sequence[Handler], catalog: Catalog, targets: Mapping[str, StructType] | None = None) -> list[Issue]:
    """Issues of views, of their targets (by view name, if given), and of the handlers that refresh them."""
    out: list[Issue] = []
    names = [v.name for v in views]
    out += [Issue("DuplicateView", n, n) for n in sorted({n for n in names if names.count(n) > 1})]
    out += [Issue("DuplicateHandler", h, h) for h in sorted({h.name for h in handlers if [x.name for x in handlers].count(h.name) > 1})]
    for view in views:
        if targets is not None and view.name not in targets:
            out.append(Issue("MissingTargetTable", view.name, view.name))
        out += validate(view, catalog, (targets or {}).get(view.name))
        users = [h.name for h in handlers if view.name in h.views]
        if len(users) > 1:
            out.append(Issue("ViewMultiHandlers", view.name, ", ".join(users)))
        if not users:
            out.append(Issue("UselessView", view.name, view.name, error=False))
    tables = {v.name: {t for p in v.parts for t, _ in p.sources} for v in views}
    for h in handlers:
        out += [Issue("EmptyHandler", h.name, what) for what, some in (("no views", h.views), ("no inputs", h.inputs)) if not some]
        out += [Issue("UnknownView", h.name, v) for v in h.views if v not in tables]
        needed = set().union(*(tables.get(v, set()) for v in h.views))
        for table, mode in h.inputs.items():
            if not _known(catalog, table):
                out.append(Issue("UnknownInputTable", h.name, table))
            elif table not in needed:
                out.append(Issue("UselessInput", h.name, table, error=False))
            if mode not in ("stream", "batch"):
                out.append(Issue("IllegalInput", h.name, f"{table}: {mode}"))
        out += [Issue("MissingInput", h.name, t, error=False) for t in sorted(needed - set(h.inputs))]
    return out
