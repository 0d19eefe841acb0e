"""Change messages as JSON text: {"key": [...], "newImage": {...}, "oldImage": {...}, "update": {...}, "erase": {}}."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _decoded(value: Column, kind: T.DataType) -> Column:
    """A JSON scalar (as text) as a column of ``kind``: base64 for bytes, seconds for intervals, ISO text for times."""
    if isinstance(kind, T.BinaryType):
        return F.try_to_binary(value, F.lit("base64"))
    if isinstance(kind, T.DayTimeIntervalType):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.try_cast("decimal(18,6)"))
    return value.try_cast(kind)


def parse(messages: DataFrame, schema: T.StructType, key: Sequence[str], column: str = "value") -> DataFrame:
    """One row per message: key columns, op (upsert or delete), before and after (null if not sent), bad.

    ``after`` is the new image, with the key's values laid over it, or the columns of a bare update. A message that
    is no JSON object, has no full key array, or a value in key or images that can't be decoded is ``bad``. ``erase``
    with null is not a delete. An old image that was not sent is null in ``before``.
    """
    top = T.StructType([T.StructField("key", T.ArrayType(T.StringType())), *(T.StructField(f, T.MapType(T.StringType(), T.StringType())) for f in ("oldImage", "newImage", "update", "erase"))])
    m = messages.withColumn("__m", F.from_json(F.col(column), top))
    part = {c: _decoded(F.get(F.col("__m.key"), F.lit(i)), schema[c].dataType) for i, c in enumerate(key)}
    has_keys = F.coalesce(F.size("__m.key") == len(key), F.lit(False))
    null_sent = [F.get(F.col("__m.key"), F.lit(i)).isNotNull() & part[c].isNull() for i, c in enumerate(key)]
    bad = ~has_keys
    for n in null_sent:
        bad = bad | F.coalesce(n, F.lit(False))

    for field in ("oldImage", "newImage", "update"):
        for f in schema:
            sent = F.try_element_at(F.col(f"__m.{field}"), F.lit(f.name))
            bad = bad | F.coalesce(sent.isNotNull() & _decoded(sent, f.dataType).isNull(), F.lit(False))

    def image(field: str, overlay: bool) -> Column:
        values = [(part[f.name] if overlay and f.name in part else _decoded(F.try_element_at(F.col(f"__m.{field}"), F.lit(f.name)), f.dataType)).alias(f.name) for f in schema]
        return F.when(F.col(f"__m.{field}").isNotNull(), F.struct(*values))

    return m.select(
        *(part[c].alias(c) for c in key),
        F.when(F.col("__m.erase").isNotNull(), "delete").otherwise("upsert").alias("op"),
        image("oldImage", True).alias("before"),
        F.coalesce(image("newImage", True), image("update", False)).alias("after"),
        bad.alias("bad"),
        F.col(column).alias("message"),
    )
