"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table (an offset and a step from its name). Shards
take turns; in its turn a shard claims the first slot of its permutation that is still free. The full table
gives every shard nearly the same number of slots and changes little when a shard joins or leaves. A document's
key is hashed to a slot and the broadcast table names its shard, so placement needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Production parameters: prime table size (over 100 slots a shard) and shard names.
TABLE_SIZE = 8209
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest(), 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot. ``size`` must be prime and at least the number of shards."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table size must be prime: {size}")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and at most one for each slot")
    at = [_digest(f"offset:{s}") % size for s in shards]
    step = [_digest(f"step:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, size: int) -> Column:
    """Slot of a key: 48 bits of the md5 of its text, modulo the table size. Null counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` (int) and ``shard`` (name) at its end.

    Rows with equal keys, null included, share a shard; every row stays, repeated ones too. Input columns that
    have the names of the two new columns are replaced; other names do no harm. Empty and very long texts make no
    difference, as only the key is looked at. An empty table stays empty. The broadcast table has ``size`` rows of
    two values, whatever the data.
    """
    owners = df.sparkSession.createDataFrame([(s, shards[i]) for s, i in enumerate(lookup_table(shards, size))], "slot int, shard string")
    key = slot(F.col(key_col), size).alias("at")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    placed = df.select(F.struct(*kept).alias("row"), key).join(F.broadcast(owners), F.col("at") == F.col("slot"))
    return placed.select("row.*", F.col("at").alias(slot_col), F.col("shard").alias(shard_col))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, files: int = 1) -> None:
    """Write one folder per shard with about ``files`` files each, so that the number of files doesn't grow with the number of tasks.

    Rows are dealt by shard and a hash of their key; rows that share a key lie in one file. Empty tables write nothing.
    """
    placed = place(df, key_col, shards, size).drop("slot")
    part = F.pmod(F.xxhash64(F.col(key_col)), F.lit(files))
    placed.repartition(len(shards) * files, "shard", part).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op1_sql() -> str:
    owners = ", ".join(map(str, lookup_table(SHARDS)))
    return f"""
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(owners[slot + 1]::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, source, n_chars, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {TABLE_SIZE})::INT AS slot FROM documents),
     (SELECT [{owners}] AS owners)
"""
