"""A stored view as a Parquet table in hash buckets, with versions."""

from __future__ import annotations

import functools
import json
import threading
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace import scratch
from millrace.operators.refresh import fit_to
from millrace.plans.catalog import Catalog
from millrace.plans.view import LINKS, MAIN_KEY, PART, View, by_keys, full, key_text, link_text, select

BUCKET = "__bucket"
MANIFEST = "version long, bucket int, folder string, buckets int, schema string"


@dataclass
class ViewStore:
    """Rows of a view under ``path`` in buckets by the main row's key.

    A refresh writes the buckets that hold affected keys anew, into a folder of its own, and then adds a version to the
    manifest (one file) that names the folder of every bucket. So its cost follows the number of touched buckets, readers
    see the old or the new version whole, and a crash leaves the old one. ``create`` makes a bucket for about
    ``rows_per_bucket`` rows, so a bucket stays small however large the view. Writers in one process take turns;
    several processes must not write one store.
    """

    spark: SparkSession
    path: str
    rows_per_bucket: int = 100_000
    #: Output types and columns of the destination, if there is one.
    target: StructType | None = None
    _locks: ClassVar[dict[str, threading.RLock]] = {}
    _lock: threading.RLock = field(init=False)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self._lock = self._locks.setdefault(self.path, threading.RLock())

    def _manifest(self) -> list:
        """Rows of the newest version, one for each bucket that has rows."""
        log = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        newest = log.agg(F.max("version")).first()[0]
        return log.where(F.col("version") == newest).orderBy("bucket").collect()

    def _commit(self, version: int, folders: dict[int, str], buckets: int, schema: str) -> None:
        rows = [(version, b, f, buckets, schema) for b, f in sorted(folders.items()) or [(-1, "")]]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64(PART, MAIN_KEY), F.lit(buckets)).cast("int")

    def _fitted(self, rows: DataFrame) -> DataFrame:
        return fit_to(rows, self.target) if self.target else rows

    def _write(self, rows: DataFrame, version: int, buckets: int) -> dict[int, str]:
        """Write rows by bucket; the buckets that got any, with their folder."""
        folder = f"v{version:09d}"
        rows = rows.withColumn(BUCKET, self._bucket(buckets))
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").select(BUCKET).distinct()
        return {r[0]: folder for r in there.collect()}

    def create(self, rows: DataFrame) -> None:
        """Store a view (with the stored form's columns) from scratch."""
        with self._lock:
            scratch.remove(self.spark, self.path)
            rows = self._fitted(rows)
            buckets = max(8, -(-rows.count() // self.rows_per_bucket))
            self._commit(0, self._write(rows, 0, buckets), buckets, rows.schema.json())

    def _read(self, manifest: list, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest[0].schema))
        paths = [f"{self.path}/{r.folder}/{BUCKET}={r.bucket}" for r in manifest if r.bucket >= 0 and (only is None or r.bucket in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read(self._manifest())

    def linked_keys(self, part: str, alias: str, keys: DataFrame) -> DataFrame:
        """(part, main key) of stored rows that carry a link to a row of the source ``alias`` by its key text (one column).

        Three columns of the stored rows are read, and only the source's own links are dealt out.
        """
        own = F.filter(LINKS, lambda link: link.startswith(link_text(alias, F.lit(""))))
        held = self.rows().where(F.col(PART) == part).select(MAIN_KEY, F.explode(own).alias("__link"))
        links = keys.select(link_text(alias, F.col(keys.columns[0])).alias("__link"))
        return held.join(links, "__link", "left_semi").select(F.lit(part).alias(PART), MAIN_KEY).distinct()

    def replace(self, gone: DataFrame, fresh: DataFrame, everywhere: bool = False) -> None:
        """Put ``fresh`` in the place of all stored rows of ``gone`` (part and main key). Doing it again changes nothing.

        All fresh rows must be of these keys, unless all buckets are written ``everywhere``.
        """
        with self._lock:
            manifest = self._manifest()
            buckets, version = manifest[0].buckets, manifest[0].version + 1
            at = f"{self.path}/keys-{version:09d}"
            gone.select(PART, MAIN_KEY).distinct().withColumn(BUCKET, self._bucket(buckets)).write.mode("overwrite").parquet(at)
            gone = self.spark.read.parquet(at)
            # a number for each bucket at most
            touched = list(range(buckets)) if everywhere else [r[0] for r in gone.select(BUCKET).distinct().collect()]
            if touched:
                old = self._read(manifest, touched)
                kept = old.join(gone.drop(BUCKET), [PART, MAIN_KEY], "left_anti").select(*old.columns)
                written = self._write(kept.unionByName(self._fitted(fresh).select(*old.columns)), version, buckets)
                folders = {r.bucket: r.folder for r in manifest if r.bucket >= 0 and r.bucket not in touched} | written
                self._commit(version, folders, buckets, manifest[0].schema)
            scratch.remove(self.spark, at)

    def refresh(self, view: View, catalog: Catalog, keys: dict[str, DataFrame | None], stored: DataFrame | None = None) -> None:
        """Refresh main keys by part (None: the whole part) and stored rows (part and main key), all as one version.

        Keys are found once and kept until the version is written: old rows are dropped and fresh ones read by them.
        """
        gone, fresh, kept = [] if stored is None else [stored.select(PART, MAIN_KEY)], [], []
        for part in view.parts:
            if part.name not in keys:
                continue
            own = keys[part.name]
            if own is not None:
                kept.append(own := own.persist())
            if own is None:
                gone.append(self.rows().where(F.col(PART) == part.name).select(PART, MAIN_KEY))
                fresh.append(select(part, view, catalog))
            else:
                gone.append(own.select(F.lit(part.name).alias(PART), key_text(catalog.key(part.table)).alias(MAIN_KEY)))
                fresh.append(by_keys(part, view, catalog, own))
        if not gone:
            return
        union = lambda dfs: functools.reduce(DataFrame.unionByName, dfs)
        new = union(fresh) if fresh else self.rows().limit(0)
        # rows of a part that is read again whole may lie in buckets that had none of it
        try:
            self.replace(union(gone), new, everywhere=None in keys.values())
        finally:
            for own in kept:
                own.unpersist()

    def page(self, view: View, catalog: Catalog, page: int, pages: int) -> None:
        """Write one page of the buckets anew from the base tables: the page-th of ``pages`` shares."""
        with self._lock:
            manifest = self._manifest()
            buckets, version = manifest[0].buckets, manifest[0].version + 1
            mine = [b for b in range(buckets) if b * pages // buckets == page]
            parts = []
            for part in view.parts:
                main = catalog.table(part.table)
                spot = F.pmod(F.xxhash64(F.lit(part.name), key_text(catalog.key(part.table))), F.lit(buckets)).cast("int")
                parts.append(select(part, view, catalog, main.where((spot * pages / buckets).cast("int") == page)))
            written = self._write(self._fitted(functools.reduce(DataFrame.unionByName, parts)), version, buckets)
            folders = {r.bucket: r.folder for r in manifest if r.bucket >= 0 and r.bucket not in mine} | written
            self._commit(version, folders, buckets, manifest[0].schema)

    def vacuum(self) -> None:
        """Delete folders that the newest version doesn't use; no reader may still be at an older one."""
        with self._lock:
            used = {r.folder for r in self._manifest()}
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            for f in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where):
                name = f.getPath().getName()
                if name.startswith("v") and name not in used:
                    scratch.remove(self.spark, f"{self.path}/{name}")


def refresh_all(view: View, catalog: Catalog, store: ViewStore) -> None:
    """The whole view from the base tables as a new store."""
    store.create(full(view, catalog, bookkeeping=True))
