"""Shared plumbing of the text operators: durable stage tables, a skew-safe lookup, input tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from py4j.protocol import Py4JError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import new_folder, remove

#: ASCII white space as the contracts list it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that are worked on at once.
SLICE = 1024


def _trim() -> None:
    """What this process freed goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim_jvm(spark: SparkSession) -> str:
    """What the driver's JVM freed outside its heap goes back to the machine; its answer, empty if it knows no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:  # by reflection, as Py4J can't see the methods of the server's own class
        find = jvm.java.lang.Class.forName
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = find(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given))
    except Py4JError:
        return ""


#: Seconds that pass at least between two rounds of ``give_back``.
PAUSE = 5.0
_gave_at = float("-inf")


def give_back(spark: SparkSession) -> None:
    """Let the driver drop its garbage (plans and task results of finished steps) and shrink, before its heap grows."""
    global _gave_at
    if time.monotonic() - _gave_at < PAUSE:
        return
    _trim()
    spark._jvm.System.gc()
    trim_jvm(spark)
    _gave_at = time.monotonic()


def _lean(batches: Iterator[pa.RecordBatch], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
    finally:  # workers live on
        _trim()


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` over slices of its batches, so that copies of text columns stay small; memory is given back after each task."""
    return df.mapInArrow(lambda it: _lean(it, work), schema)


class Stage:
    """Stage tables of one operator run.

    ``keep`` writes a DataFrame as Parquet to the shared folder and reads it back, so a lost executor
    costs a reread and not the work behind it. ``drop`` deletes tables that later steps don't read. What an
    operator's result still reads stays until ``sweep``.
    """

    open: ClassVar[list[Stage]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_folder(spark, label)
        self._n = 0
        Stage.open.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        give_back(self.spark)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept._millrace_path = at
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            remove(self.spark, df._millrace_path)


def sweep(spark: SparkSession, before: list[Stage]) -> None:
    """Delete the stage tables of runs that began after ``before`` (a copy of ``Stage.open``), once their results have been written."""
    for stage in [s for s in Stage.open if s not in before]:
        remove(spark, stage.root)
        Stage.open.remove(stage)


def split_hot(rows: DataFrame, groups: DataFrame, key: str, total: int, share: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` on ``key`` (inner or left), without dealing a hot key to one task.

    ``groups`` has one row per key and a column ``group_size``. At most ``share`` keys can hold more
    than ``total / share`` rows each; those are broadcast (``share`` rows at the very most), all others
    are joined by a shuffle in which no key has more than ``total / share`` rows.
    """
    limit = max(1, total // share)
    hot = F.broadcast(groups.where(F.col("group_size") > limit))
    cold = groups.where(F.col("group_size") <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, share: int = 5000) -> DataFrame:
    """``rows`` inner-joined to ``keyed`` on ``key``, with a hot key's rows dealt to several tasks by a hash of ``by``.

    Keys with more than a ``share``-th of all rows (at most ``share`` keys, which are broadcast with their number
    of parts) have their rows of ``keyed`` copied once for each part. ``rows`` should be a stage table.
    """
    limit = max(1000, rows.count() // share)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("__parts"))).otherwise(F.lit(0)).cast("int")).drop("__parts")
    copied = keyed.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"]).drop("__part")


#: Bits of the fixed-size filter of ``maybe_in``: at most 2 ** 19 words of 64 bits, whatever the number of ids.
FILTER_BITS = 25


def _marked(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a column ``__maybe``: false only if the row's id is surely not among ``ids``."""
    spot = lambda c: F.xxhash64(c.cast("long")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (
        ids.select(spot(F.col(ids.columns[0])).alias("__spot"))
        .groupBy(F.shiftright("__spot", 6).alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__spot & 63 as int))")).alias("__bits"))
    )
    marked = rows.withColumn("__spot", spot(F.col(id_col))).withColumn("__at", F.shiftright("__spot", 6))
    met = marked.join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), F.expr("coalesce(shiftright(__bits, cast(__spot & 63 as int)) & 1 = 1, false)").alias("__maybe"))


def maybe_in(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` whose id may be among ``ids`` (one long column): all that are, and by chance some others.

    A bit filter of a fixed size is broadcast, so that rows with wide columns need not be shuffled to find the
    few that matter. With very many ids it lets more rows pass; an exact join must follow in any case.
    """
    return _marked(rows, ids, id_col).where("__maybe").drop("__maybe")


def without(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` whose id is not among ``ids`` (one long column, no nulls). Only rows that the bit filter can't clear are shuffled."""
    marked = _marked(rows, ids, id_col)
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    doubtful = marked.where("__maybe").join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    return marked.where("NOT __maybe").unionByName(doubtful).drop("__maybe")
