"""Exact deduplication through a log-structured merge index of text digests.

The index lives in a folder of *runs*. A run is a Parquet table with one row per digest (smallest identifier and
number of members), sorted by digest, with Parquet's Bloom filters and min/max statistics for point lookups.

* A batch of documents is a *memtable*: it is reduced to one row per digest and flushed as a run of level 0.
* A flush probes the older runs: their filter (one bit array of a fixed size, broadcast) clears most new digests,
  and only what it can't clear is joined with the runs. What is found there, or more than once in the memtable
  itself, is a *hit*.
* When ``FAN`` runs are on a level they are merged into one run of the next level that keeps the smallest
  identifiers. Every change of the set of runs is a row in the manifest, so an index can be opened again by its path.
* Hits are looked up in the compacted index; a hit only counts as a copy after its texts have been compared byte by byte.

Everything on the main path is DataFrame work. A digest that a third of all rows share is reduced to one row
per task before any shuffle (flush, merge, verification) or met through a broadcast of bounded size (membership).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import FILTER_BITS, Stage, maybe_in, split_hot, table
from millrace.scratch import exists, remove

#: Parquet settings of a run: a filter on the digest beside the statistics that sorting makes useful.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}
RUN = "digest binary, keep_id long, members long"
#: Memtables that a table is dealt into (by a hash of the id), and runs of a level that are merged.
MEMTABLES, FAN = 4, 2


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space. Plain replacements first: most texts then need no pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass(frozen=True)
class Run:
    level: int
    path: str


class DigestIndex:
    """Levels of runs under ``path``; opened again if it is there already. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.runs = 0, []
        if exists(spark, f"{self.path}/manifest"):
            log = spark.read.schema("version int, level int, run string").json(f"{self.path}/manifest")
            self.version = log.agg(F.max("version")).first()[0]
            # one row per run of the newest version: about FAN of each level
            self.runs = [Run(r.level, f"{self.path}/{r.run}") for r in log.where(F.col("version") == self.version).orderBy(F.desc("level"), "run").collect()]

    def _commit(self, runs: list[Run]) -> None:
        """The new set of runs counts once its manifest rows (one file) are there."""
        self.version += 1
        rows = [F.struct(F.lit(self.version).alias("version"), F.lit(r.level).alias("level"), F.lit(r.path.rsplit("/", 1)[1]).alias("run")) for r in runs]
        self.spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))).write.mode("append").json(f"{self.path}/manifest")
        self.runs = runs

    def _write(self, rows: DataFrame, level: int) -> Run:
        run = Run(level, f"{self.path}/run-{self.version:06d}-{level}")
        rows.sortWithinPartitions("digest").write.mode("overwrite").options(**RUN_OPTIONS).parquet(run.path)
        return run

    def read(self, *runs: Run) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(r.path for r in runs or self.runs))

    def filter(self, *runs: Run) -> DataFrame:
        """(word, bits): the bit filter of runs, at most 2 ** (FILTER_BITS - 6) rows."""
        spot = F.xxhash64("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        spots = self.read(*runs).select(spot.alias("spot")).select(F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
        return spots.groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def flush(self, memtable: DataFrame) -> DataFrame:
        """Write a memtable (digest, doc_id) as a run, merge levels that are full, and return its hits (digest).

        Hits are the digests that are several times in the memtable or that an older run has.
        """
        older = list(self.runs)
        run = self._write(memtable.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("members")), 0)
        rows = self.read(run)
        hits = rows.where("members > 1").select("digest")
        if older:
            spot = F.xxhash64("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
            met = rows.select("digest", spot.alias("spot")).join(F.broadcast(self.filter(*older)), F.shiftright("spot", 6) == F.col("word"))
            doubtful = met.where("shiftright(bits, cast(spot & 63 as int)) & 1 = 1").select("digest")
            hits = hits.unionByName(doubtful.join(self.read(*older), "digest", "left_semi").select("digest"))
        hits_at = f"{self.path}/hits-{self.version:06d}"
        hits.write.mode("overwrite").parquet(hits_at)
        self._commit([*older, run])
        self._merge_full_levels()
        return self.spark.read.schema("digest binary").parquet(hits_at)

    def merged(self, *runs: Run) -> DataFrame:
        return self.read(*runs).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("members").alias("members"))

    def _merge_full_levels(self) -> None:
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= FAN:
            self._replace(full, level + 1)
            level += 1

    def _replace(self, runs: list[Run], level: int) -> None:
        new = self._write(self.merged(*runs), level)
        self._commit([*(r for r in self.runs if r not in runs), new])
        for r in runs:
            remove(self.spark, r.path)

    def compact(self) -> DataFrame:
        """All runs as one, on a level above them all: one row per digest."""
        if len(self.runs) > 1:
            self._replace(list(self.runs), max(r.level for r in self.runs) + 1)
        return self.read()

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Rows of the given digests; statistics and Bloom filters skip the row groups without them."""
        return self.read().where(F.col("digest").isin([F.lit(d) for d in digests]))


def collided(docs: DataFrame, entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose members' normalised texts differ, by comparing the bytes of every member.

    ``docs`` is (doc_id, text). Members are reduced to (digest, text) before the shuffle, so a text with very many copies travels once per task.
    """
    ids = entries.join(hits, "digest", "left_semi").select("doc_id")
    bodies = maybe_in(docs, ids).select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("body")).distinct()
    return bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: list[DataFrame] | None = None, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they match after every run of ASCII white space becomes one space; null counts as
    empty, so null and empty texts are copies of each other; texts are compared whole, however long. Of equal texts
    the row with the smallest id is kept. Rows that repeat an id with an equal text all count in ``group_size`` and all carry ``kept`` (the id
    stays). A null id is never the smallest unless the whole group has null ids; then keep_id is null and
    ``kept`` true. An empty table gives an empty result. Other columns of ``docs`` are not read.

    ``batches`` are the memtables (for example one DataFrame per day); by default ``docs`` is dealt into
    ``MEMTABLES`` of them. The index is built under ``path``, which must be new (by default a stage folder).
    """
    spark = docs.sparkSession
    stage = Stage(spark, "exact-dedup")
    index = DigestIndex(spark, path or stage.path("index"))
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if batches is None:
        dealt = plain(docs).select("doc_id", digest(F.col("text")).alias("digest")).withColumn("memtable", F.pmod(F.xxhash64("doc_id"), F.lit(MEMTABLES)).cast("int"))
        at = stage.path("entries")
        dealt.write.partitionBy("memtable").parquet(at)
        entries = spark.read.schema("doc_id long, digest binary, memtable int").parquet(at)
        memtables = [entries.where(F.col("memtable") == k).select("digest", "doc_id") for k in range(MEMTABLES)]
    else:
        memtables = [stage.keep(plain(b).select(digest(F.col("text")).alias("digest"), "doc_id"), "entries") for b in batches]
        entries = functools.reduce(DataFrame.unionByName, memtables)
    hits = functools.reduce(DataFrame.unionByName, [index.flush(m) for m in memtables]).distinct()
    groups = stage.keep(index.compact().join(hits, "digest").select("digest", "keep_id", F.col("members").alias("group_size")), "groups")
    entries = entries.select("doc_id", "digest")
    wrong = stage.keep(collided(plain(docs), entries, groups.select("digest")), "collided")
    rows = split_hot(entries, groups, "digest", entries.count(), how="left")
    if not wrong.isEmpty():  # digests collide: these rows are grouped by their texts instead
        apart = plain(docs).select("doc_id", digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("body")).join(wrong, "digest", "left_semi")
        by_text = apart.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(by_text, ["digest", "body"]).select(*rows.columns)
        rows = rows.join(wrong, "digest", "left_anti").select(*rows.columns).unionByName(apart)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
