"""Change streams applied to stored views, one micro-batch at a time, and lookup tables' changes to their log."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import scratch
from millrace.operators.dictionary import LOG, DictionaryLog, message_diff, refresh_from_log
from millrace.operators.refresh import Change, changed_keys
from millrace.plans.catalog import Catalog
from millrace.plans.paths import path_to_main, read_columns
from millrace.plans.view import MAIN_KEY, Part, View, key_text, quoted, semi_join
from millrace.sources import cdc
from millrace.sources.positions import Positions
from millrace.streaming.store import ViewStore


def together(streams: dict[str, DataFrame]) -> DataFrame:
    """(table, value) of the messages of several tables as one stream, so that one query writes a store."""
    return functools.reduce(DataFrame.unionByName, [s.select(F.lit(t).alias("table"), F.col("value").cast("string").alias("value")) for t, s in streams.items()])


def _run(messages: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@contextlib.contextmanager
def _parsed(batch: DataFrame, catalog: Catalog, tables: Sequence[str], dead_letter: str | None) -> Iterator[dict[str, DataFrame]]:
    """Good messages by table; others are added to the dead letters. Each message is decoded once while the block lasts."""
    parsed = {t: cdc.parse(batch.where(F.col("table") == t), catalog.table(t).schema, catalog.key(t)).persist() for t in tables}
    try:
        if dead_letter:
            bad = functools.reduce(DataFrame.unionByName, [p.where("bad").select(F.lit(t).alias("table"), "message") for t, p in parsed.items()])
            bad.write.mode("append").json(dead_letter)
        yield {t: p.where("NOT bad") for t, p in parsed.items()}
    finally:
        for p in parsed.values():
            p.unpersist()


@dataclass
class ViewStream:
    """Keeps stored views up to date from the change messages of their source tables.

    ``catalog`` gives the tables' current state (a refresh reads current rows by key, so late or repeated
    messages do no harm). Messages that can't be decoded go to ``dead_letter``. Delivery is at least once and
    applying a batch again gives the same view. Where a message has no old image, the main keys that its row was
    joined to are found in the links of the stored rows; without links the whole part is read again.
    """

    catalog: Callable[[], Catalog]
    views: dict[str, tuple[View, ViewStore]]
    dead_letter: str | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def apply(self, messages: DataFrame, tables: Sequence[str]) -> None:
        """Take up messages (table, value) of several tables at once."""
        catalog = self.catalog()
        messages, kept = messages.persist(), []
        try:
            with _parsed(messages, catalog, tables, self.dead_letter) as parsed:
                self._apply(catalog, parsed, tables, kept)
            for row in messages.groupBy("table").count().collect():
                self.counts[row["table"]] = self.counts.get(row["table"], 0) + row["count"]
        finally:
            for df in (*kept, messages):
                df.unpersist()

    def _apply(self, catalog: Catalog, parsed: dict[str, DataFrame], tables: Sequence[str], kept: list[DataFrame]) -> None:
        """Refresh the views; ``kept`` gets what may be given free afterwards."""
        changes, blind = [], {}
        for table, good in parsed.items():
            schema, key = catalog.table(table).schema, catalog.key(table)
            keys = good.select(*quoted(key)).distinct()
            bare = keys.select(*(F.col(f"`{c}`") if c in key else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names))
            if self._keys_tell(table, catalog):
                changes.append(Change(table, bare, bare.limit(0)))
            else:  # images of the messages, bare keys, and the rows as they are now
                seen = good.where("before IS NOT NULL").select("before.*").unionByName(good.where("after IS NOT NULL").select("after.*")).unionByName(bare)
                changes.append(Change(table, seen, semi_join(catalog.table(table), keys, key)))
            blind[table] = good.where("before IS NULL").select(*quoted(key)).distinct()
        for view, store in self.views.values():
            todo, stored = {}, []
            for part in view.parts:
                if not {t for t, _ in part.sources} & set(tables):
                    continue
                todo[part.name] = changed_keys(part, catalog, changes)
                if todo[part.name] is not None:
                    self._blind(view, store, part, catalog, blind, todo, stored)
            kept.extend(stored)
            store.refresh(view, catalog, todo, functools.reduce(DataFrame.unionByName, stored) if stored else None)

    def _keys_tell(self, table: str, catalog: Catalog) -> bool:
        """Whether the keys of the table's rows lead to the main tables of all views, whatever their other columns were."""
        reads = [read_columns(part, catalog, alias) for view, _ in self.views.values() for part in view.parts for t, alias in part.sources if t == table]
        return all(r is None or r <= {c.lower() for c in catalog.key(table)} for r in reads)

    @staticmethod
    def _blind(view: View, store: ViewStore, part: Part, catalog: Catalog, blind: dict[str, DataFrame], todo: dict, stored: list) -> None:
        """Add what changes without an old image were joined to before."""
        names = catalog.key(part.table)
        for table, alias in part.sources[1:]:
            if table not in blind:
                continue
            path = path_to_main(part, catalog, alias)
            if path and path.direct and set(path.direct.values()) <= set(catalog.key(table)):
                continue  # the key tells
            if not view.links:
                if not blind[table].isEmpty():
                    todo[part.name] = None
                    return
                continue
            held = store.linked_keys(part.name, alias, blind[table].select(key_text(catalog.key(table)))).persist()
            schema = catalog.table(part.table).schema
            kinds = "struct<{}>".format(", ".join(f"`{c}`: {schema[c].dataType.simpleString()}" for c in names))
            todo[part.name] = todo[part.name].unionByName(held.select(F.from_json(MAIN_KEY, kinds).alias("k")).select("k.*")).distinct()
            stored.append(held)

    def start(self, streams: dict[str, DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
        """Run on streaming DataFrames with a column ``value`` by table, as one query; the checkpoint remembers what has been applied."""
        tables = sorted(streams)
        return _run(together(streams), lambda batch, _: self.apply(batch, tables), checkpoint, trigger)


@dataclass
class LookupStream:
    """Writes the changes of lookup tables to their log, and refreshes a view from it from time to time."""

    catalog: Callable[[], Catalog]
    log: DictionaryLog
    dead_letter: str | None = None

    def append(self, messages: DataFrame, tables: Sequence[str], batch: int) -> None:
        catalog = self.catalog()
        with _parsed(messages, catalog, tables, self.dead_letter) as parsed:
            for table, good in parsed.items():
                self.log.append(table, message_diff(good, catalog.key(table), catalog.table(table).columns), batch)

    def start(self, streams: dict[str, DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
        tables = sorted(streams)
        return _run(together(streams), lambda batch, n: self.append(batch, tables, n), checkpoint, trigger)

    def watch(self, view: View, store: ViewStore, positions: Positions, job: str, tables: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
        """Refresh the stored view whenever the log has grown, at the trigger's pace (for example processingTime="8 hours")."""
        scratch.make(store.spark, self.log.path)
        grown = store.spark.readStream.schema(LOG).parquet(self.log.path)
        return _run(grown, lambda _, __: refresh_from_log(view, self.catalog(), store, self.log, positions, job, tables), checkpoint, trigger)
