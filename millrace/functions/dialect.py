"""Small rewrites of expression text, and type names, into Spark SQL."""

from __future__ import annotations

import re
from dataclasses import replace

from millrace.plans.view import View

# Type names and their Spark types.
TYPES = {
    "Bool": "BOOLEAN", "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT",
    "Uint8": "SMALLINT", "Uint16": "INT", "Uint32": "BIGINT", "Uint64": "DECIMAL(20,0)",
    "Float": "FLOAT", "Double": "DOUBLE", "Text": "STRING", "Utf8": "STRING", "Json": "STRING",
    "JsonDocument": "STRING", "Uuid": "STRING", "Bytes": "BINARY", "String": "BINARY", "Date": "DATE",
    "Date32": "DATE", "Datetime": "TIMESTAMP_NTZ", "Datetime64": "TIMESTAMP_NTZ", "Timestamp": "TIMESTAMP",
    "Timestamp64": "TIMESTAMP", "Interval": "INTERVAL DAY TO SECOND", "Interval64": "INTERVAL DAY TO SECOND",
}

_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)([us]\b)?")
_CAST = re.compile(r"\bCAST\s*\(((?:[^()]|\([^()]*\))*?)\s+AS\s+(\w+(?:\s*\(\s*\d+\s*,\s*\d+\s*\))?)(\?)?\s*\)", re.IGNORECASE)


def spark_type(name: str) -> str:
    """Spark type of a type name; Decimal(p,s) and unknown names stay. A trailing ? (nullable) is dropped."""
    bare = name.rstrip("?").strip()
    return TYPES.get(bare, bare)


def spark_sql(text: str) -> str:
    """Expression text in Spark SQL: string suffixes dropped, module prefixes dropped, casts with mapped types.

    ``CAST(x AS T?)`` becomes try_cast, since it gives NULL for what can't be cast. Quoted parts stay as they are.
    """
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[1])
        return f"\0{len(kept) - 1}\0"

    out = _QUOTED.sub(hide, text)
    out = re.sub(r"\b(?:Unicode|String|Math|DateTime)::(?=\w+\s*\()", "", out)
    out = re.sub(r"\bCurrentUtcTimestamp\s*\(\s*\)", "current_timestamp()", out)
    out = _CAST.sub(lambda m: f"{'try_cast' if m[3] else 'CAST'}({m[1]} AS {spark_type(m[2])})", out)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], out)


def translated(view: View) -> View:
    """The view with its expressions, filters and output types in Spark SQL."""
    parts = [replace(p, columns={c: spark_sql(e) for c, e in p.columns.items()}, where=spark_sql(p.where) if p.where else None) for p in view.parts]
    return replace(view, parts=parts, types={c: spark_type(t) for c, t in view.types.items()})
