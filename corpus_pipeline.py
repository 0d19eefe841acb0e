"""From raw documents to sharded training text: five stages, each written as Parquet and read again.

Every stage is a function of (spark, docs, sf_dir) that works on all that its predecessor kept. All but the last
return the columns of ``documents``; the last adds the shard of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language_id, mixing, near_dedup, sharding
from millrace.llm.common import Stage, sweep, table

#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model rejects: no letters, or a score or evidence under the calibrated limits.

    The model is fitted on the stage's own rows. Null and empty texts go; without a row that has a language, all go.
    Repeated rows stay or go together, null ids don't matter, texts of any length are read whole. An empty table stays empty.
    """
    return language_id.drop_rejected(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Null ids, and null, empty and wordless texts stay; rows that repeat an id stay or go together; an empty table stays empty.
    """
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or a passage of a long one.

    Null and empty texts stay, ids don't matter, repeated rows stay or go together. With an empty benchmark, or empty
    or null items, nothing goes; an empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources reach their target weights.

    A null source is a source of its own; each row counts by itself, with a null or repeated id too; rows without
    words follow their source's whole rounds. Ties at a border are cut in the order of id and size. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add slot and shard of each row. Rows with equal ids, null included, share a shard; texts aren't read; an empty table stays empty."""
    return sharding.place(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The stages train models and hash in ways that SQL can't state; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        before = list(Stage.open)
        docs = stage.keep(step(spark, docs, sf_dir), name)
        sweep(spark, before)  # the step's own tables aren't read any more
    return docs
