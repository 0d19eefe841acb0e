"""Positions that jobs have reached, kept as an append-only table."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import scratch

SCHEMA = "job string, name string, version long, position string"


@dataclass
class Positions:
    """The last position of each (job, name) under ``path``. A row is added for every save; the newest counts.

    Rows are committed one file at a time, so a crash leaves the old position or the new one. One writer for a job.
    """

    spark: SparkSession
    path: str

    def _last(self, job: str, name: str):
        if not scratch.exists(self.spark, self.path):
            return None
        rows = self.spark.read.schema(SCHEMA).json(self.path).where((F.col("job") == job) & (F.col("name") == name))
        return rows.agg(F.max_by("position", "version").alias("position"), F.max("version").alias("version")).first()

    def load(self, job: str, name: str):
        """The position, or None if there is none (any more)."""
        last = self._last(job, name)
        return json.loads(last.position) if last and last.position else None

    def save(self, job: str, name: str, position) -> None:
        last = self._last(job, name)
        version = (last.version or 0) + 1 if last else 1
        text = F.lit(None if position is None else json.dumps(position)).cast("string")
        row = self.spark.range(1, numPartitions=1).select(F.lit(job).alias("job"), F.lit(name).alias("name"), F.lit(version).cast("long").alias("version"), text.alias("position"))
        row.write.mode("append").json(self.path, ignoreNullFields=False)

    def remove(self, job: str, name: str) -> None:
        """Forget it: ``position`` null is the newest row."""
        if self.load(job, name) is not None:
            row = self.spark.range(1, numPartitions=1).select(F.lit(job).alias("job"), F.lit(name).alias("name"), F.lit(self._last(job, name).version + 1).cast("long").alias("version"), F.lit("").alias("position"))
            row.write.mode("append").json(self.path)
