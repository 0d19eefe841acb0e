"""Registered queries of the view engine, with the SQL that DuckDB runs on the same tables.

The incremental ones derive an earlier state of a base table from the given one (rows left out or altered by their
key), build the view on it, and then take up the difference: the result must equal the plain SELECT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch
from millrace.operators import dictionary, refresh
from millrace.plans import paths
from millrace.plans.catalog import Catalog
from millrace.functions.dialect import translated
from millrace.plans.view import STORED, Join, Literal, Part, View, by_keys, full
from millrace.sources import cdc, scan
from millrace.sources.positions import Positions
from millrace.streaming.apply import LookupStream, ViewStream
from millrace.streaming.backfill import backfill
from millrace.streaming.store import ViewStore, refresh_all

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",),
    "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}

ORDER_PART = Part(
    "orders", "o",
    {"o_orderkey": "o.o_orderkey", "c_name": "c.c_name", "n_name": "n.n_name", "r_name": "r.r_name", "price": "o.o_totalprice", "day": "CAST(o.o_orderdate AS DATE)"},
    [
        Join("customer", "c", [("o.o_custkey", "c.c_custkey")]),
        Join("nation", "n", [("c.c_nationkey", "n.n_nationkey")]),
        Join("region", "r", [("n.n_regionkey", "r.r_regionkey")], "left"),
    ],
    "o.o_totalprice > 1000 AND (r.r_name IS NULL OR r.r_name <> 'AFRICA')",
)
ORDER_VIEW = View("order_view", ["o_orderkey"], [ORDER_PART])
ORDER_SQL = """
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 1000 AND (r_name IS NULL OR r_name <> 'AFRICA')
"""
PARTY_VIEW = View("party", ["key"], [
    Part("customer", "c", {"key": "100000000L + c.c_custkey", "kind": "'customer'", "name": "c.c_name", "nation": "n.n_name", "balance": "c.c_acctbal"}, [Join("nation", "n", [("c.c_nationkey", "n.n_nationkey")], "left")], name="first"),
    Part("supplier", "s", {"key": "200000000L + s.s_suppkey", "kind": "'supplier'", "name": "s.s_name", "nation": "n.n_name", "balance": "s.s_acctbal"}, [Join("nation", "n", [("s.s_nationkey", "n.n_nationkey")], "left")], name="second"),
])
PARTY_SQL = """
SELECT 100000000 + c_custkey AS key, 'customer' AS kind, c_name AS name, n_name AS nation, c_acctbal AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 200000000 + s_suppkey, 'supplier', s_name, n_name, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
"""


UNION_VIEW = View("names", ["name"], [
    Part("customer", "c", {"name": "c.c_name", "nation": "c.c_nationkey"}, name="first"),
    Part("supplier", "s", {"name": "s.s_name", "nation": "s.s_nationkey"}, name="second"),
])


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.parquet(spark, sf_dir, KEYS)


def _one(part: Part) -> Callable[[SparkSession, str], DataFrame]:
    view = View("v", list(part.columns)[:1], [part])
    return lambda spark, d: full(view, catalog(spark, d))


def _select(table: str, alias: str, columns: dict[str, str], joins=(), where: str | None = None):
    return _one(Part(table, alias, columns, joins, where))


def _final(view: View, now: Catalog, then: Catalog, changes) -> DataFrame:
    return refresh.apply_changes(view, now, full(view, then, bookkeeping=True), changes).drop(*STORED)


def _refresh_keys(spark: SparkSession, d: str) -> DataFrame:
    """Changed and missing orders are taken up by their keys."""
    now = catalog(spark, d)
    orders = now.table("orders")
    then = now.with_tables(orders=orders.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 4, 5000.0).otherwise(F.col("o_totalprice"))))
    keys = orders.where("o_orderkey % 10 IN (3, 4)").select("o_orderkey")
    return refresh.refresh_keys(ORDER_VIEW, now, full(ORDER_VIEW, then, bookkeeping=True), {"default": keys}).drop(*STORED)


def _delete_topmost(spark: SparkSession, d: str) -> DataFrame:
    """Orders that exist only in the earlier state are deleted."""
    now = catalog(spark, d)
    orders = now.table("orders")
    extra = orders.where("o_orderkey % 7 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return _final(ORDER_VIEW, now, now.with_tables(orders=orders.unionByName(extra)), [refresh.Change("orders", extra, orders.limit(0))])


def _delete_inner(spark: SparkSession, d: str) -> DataFrame:
    """Customers are deleted: their orders leave the view (inner join)."""
    then = catalog(spark, d)
    customers = then.table("customer")
    gone = customers.where("c_custkey % 5 = 0")
    now = then.with_tables(customer=customers.where("c_custkey % 5 <> 0"))
    return _final(ORDER_VIEW, now, then, [refresh.Change("customer", gone, customers.limit(0))])


def _filter_exit(spark: SparkSession, d: str) -> DataFrame:
    """Orders' prices fall or rise past the filter."""
    now = catalog(spark, d)
    orders = now.table("orders")
    old = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 50000, 1.0).otherwise(F.lit(99999.0)))
    then = now.with_tables(orders=orders.where("o_orderkey % 3 <> 0").unionByName(old))
    return _final(ORDER_VIEW, now, then, [refresh.Change("orders", old, orders.where("o_orderkey % 3 = 0"))])


def _link_move(spark: SparkSession, d: str) -> DataFrame:
    """Customers move to another nation: orders are found from old and new rows."""
    now = catalog(spark, d)
    customers = now.table("customer")
    old = customers.where("c_custkey % 4 = 1").withColumn("c_nationkey", ((F.col("c_nationkey") + 7) % 25).cast("int"))
    then = now.with_tables(customer=customers.where("c_custkey % 4 <> 1").unionByName(old))
    return _final(ORDER_VIEW, now, then, [refresh.Change("customer", old, customers.where("c_custkey % 4 = 1"))])


def _union_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of a union change together."""
    now = catalog(spark, d)
    c, s = now.table("customer"), now.table("supplier")
    old_c, old_s = c.where("c_custkey % 6 = 2").withColumn("c_name", F.lit("old")), s.where("s_suppkey % 2 = 1").withColumn("s_acctbal", F.lit(0.0))
    then = now.with_tables(customer=c.where("c_custkey % 6 <> 2").unionByName(old_c), supplier=s.where("s_suppkey % 2 <> 1").unionByName(old_s))
    return _final(PARTY_VIEW, now, then, [refresh.Change("customer", old_c, c.where("c_custkey % 6 = 2")), refresh.Change("supplier", old_s, s.where("s_suppkey % 2 = 1"))])


def _older_nation(now: Catalog) -> DataFrame:
    return now.table("nation").withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("old "), F.col("n_name"))).otherwise(F.col("n_name")))


def _older_region(now: Catalog) -> DataFrame:
    return now.table("region").where("r_regionkey <> 2").withColumn("r_name", F.when(F.col("r_regionkey") == 1, "AFRICA").otherwise(F.col("r_name")))


def _dict_diff(spark: SparkSession, d: str) -> DataFrame:
    now = catalog(spark, d)
    customers = now.table("customer")
    old = customers.where("c_custkey % 9 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 9 == 2, "old").otherwise(F.col("c_name"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 <= 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    found = dictionary.diff(old, customers, ("c_custkey",))
    return found.select("c_custkey", "op", F.array_join("fields", ",").alias("fields"))


def _dict_filter(spark: SparkSession, d: str) -> DataFrame:
    now = catalog(spark, d)
    keys = {"c": now.table("customer").where("c_custkey % 50 = 7").select("c_custkey"), "n": now.table("nation").where("n_nationkey % 10 = 3").select("n_nationkey")}
    return paths.dictionary_keys(ORDER_PART, now, keys)


def _dict_refresh(*tables: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        now = catalog(spark, d)
        older = {"nation": _older_nation, "region": _older_region}
        then = now.with_tables(**{t: older[t](now) for t in tables})
        return dictionary.dictionary_refresh(ORDER_VIEW, then, now, full(ORDER_VIEW, then, bookkeeping=True), list(tables)).drop(*STORED)

    return run


def _grab(alias: str, table: str, where: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        now = catalog(spark, d)
        return paths.affected_keys(ORDER_PART, now, alias, now.table(table).where(where))

    return run


def _direct(spark: SparkSession, d: str) -> DataFrame:
    """Labels hold the documents' key: no join is needed."""
    now = catalog(spark, d)
    part = Part("documents", "d", {"doc_id": "d.doc_id", "toxic": "l.toxic"}, [Join("labels", "l", [("d.doc_id", "l.doc_id")], "left")])
    return paths.affected_keys(part, now, "l", now.table("labels").where("toxic = 1"))


def _cdc(spark: SparkSession, d: str) -> DataFrame:
    """Events as change messages, decoded again."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    text = F.to_json(F.struct(F.array(F.col("event_id").cast("string")).alias("key"), F.when(F.col("event_id") % 5 != 0, F.struct("user_id", "event_type", "value")).alias("newImage"), F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("x"), F.lit("y"))).alias("erase")))
    parsed = cdc.parse(events.select(text.alias("value")), events.schema, ("event_id",))
    return parsed.where("NOT bad").select("event_id", "op", F.col("after.user_id").alias("user_id"), F.col("after.event_type").alias("event_type"), F.col("after.value").alias("value"))


def _messages(rows: DataFrame, key: list[str], before: DataFrame | None = None) -> DataFrame:
    """Change messages of the rows of a table: their keys alone, or with the old images of ``before`` and the new ones."""
    text = F.array(*(F.col(c).cast("string") for c in key))
    if before is None:
        return rows.select(F.to_json(F.struct(text.alias("key"), F.create_map().cast("map<string,string>").alias("update"))).alias("value"))
    old = before.select(*(F.col(c).alias(f"k_{c}") for c in key), F.struct(*before.columns).alias("oldImage"))
    met = rows.join(old, [F.col(c) == F.col(f"k_{c}") for c in key], "left")
    return met.select(F.to_json(F.struct(text.alias("key"), "oldImage", F.struct(*rows.columns).alias("newImage"))).alias("value"))


def _inbox(spark: SparkSession, folder: str, table: str, messages: DataFrame) -> DataFrame:
    """The messages as a stream of text files."""
    messages.write.text(f"{folder}/in/{table}")
    return spark.readStream.text(f"{folder}/in/{table}")


def _stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """Messages with keys alone, of orders and customers that changed, moved or went away, in one stream into the stored view."""
    now, at = catalog(spark, d), scratch.new_folder(spark, "cdc")
    view = View("order_view", ["o_orderkey"], [ORDER_PART], links=True)
    orders, customers = now.table("orders"), now.table("customer")
    old_c = customers.withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 1, (F.col("c_nationkey") + 7) % 25).otherwise(F.col("c_nationkey")).cast("int"))
    gone_c = customers.where("c_custkey % 9 = 2").withColumn("c_custkey", -F.col("c_custkey"))
    old_o = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, -2).otherwise(F.col("o_custkey"))).where("o_orderkey % 7 <> 3")
    gone_o = orders.where("o_orderkey % 11 = 4").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    then = now.with_tables(orders=old_o.unionByName(gone_o), customer=old_c.unionByName(gone_c))
    store = ViewStore(spark, f"{at}/view")
    refresh_all(view, then, store)
    changed_o = orders.where("o_orderkey % 5 = 0 OR o_orderkey % 7 = 3").select("o_orderkey").unionByName(gone_o.select("o_orderkey"))
    changed_c = customers.where("c_custkey % 4 = 1").select("c_custkey").unionByName(gone_c.select("c_custkey"))
    run = ViewStream(lambda: now, {"v": (view, store)}, f"{at}/dead")
    streams = {"orders": _inbox(spark, at, "orders", _messages(changed_o, ["o_orderkey"])), "customer": _inbox(spark, at, "customer", _messages(changed_c, ["c_custkey"]))}
    run.start(streams, f"{at}/checkpoint").awaitTermination()
    return store.rows().drop(*STORED)


def _log_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Changes of nations and regions go through a stream into the log; the stored view takes them up from there."""
    now, at = catalog(spark, d), scratch.new_folder(spark, "log")
    then = now.with_tables(nation=_older_nation(now), region=_older_region(now))
    store = ViewStore(spark, f"{at}/view")
    refresh_all(ORDER_VIEW, then, store)
    log, positions = dictionary.DictionaryLog(spark, f"{at}/log"), Positions(spark, f"{at}/positions")
    streams = {t: _inbox(spark, at, t, _messages(now.table(t), list(KEYS[t]), then.table(t))) for t in ("nation", "region")}
    LookupStream(lambda: now, log).start(streams, f"{at}/checkpoint").awaitTermination()
    dictionary.refresh_from_log(ORDER_VIEW, now, store, log, positions, "orders", ["nation", "region"])
    return store.rows().drop(*STORED)


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """A full refresh in pages that stops after three of eight and goes on."""
    now, at = catalog(spark, d), scratch.new_folder(spark, "pages")
    store, positions = ViewStore(spark, f"{at}/view"), Positions(spark, f"{at}/positions")
    refresh_all(ORDER_VIEW, now.with_tables(nation=_older_nation(now)), store)
    backfill(ORDER_VIEW, now, store, positions, "job", most=3)
    backfill(ORDER_VIEW, now, store, positions, "job")
    return store.rows().drop(*STORED)


def _null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys with null parts come first and are walked past."""
    turns = catalog(spark, d).table("conversations").select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("conv_id"), F.when(F.col("turn") > 1, F.col("turn")).alias("turn"))
    return scan.scan_next(turns, ("conv_id", "turn"), (None, 2), 2000)


OTHER_DIALECT = View("v", ["o_orderkey"], [Part("orders", "o", {"o_orderkey": "o.o_orderkey", "head": "Unicode::Substring(o.o_orderpriority, 3, 5)", "day": "CAST(o.o_orderdate AS Date)", "note": "'x'u", "whole": "CAST(o.o_orderpriority AS Int32?)"}, (), "o.o_orderstatus <> 'F'u")], types={"o_orderkey": "Int64"})

ORDER_COLUMNS = {"o_orderkey": "o.o_orderkey", "o_custkey": "o.o_custkey", "price": "o.o_totalprice"}
CUSTOMER_JOIN = Join("customer", "c", [("o.o_custkey", "c.c_custkey")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "view_full": lambda s, d: full(ORDER_VIEW, catalog(s, d)),
        "project_columns": _select("orders", "o", ORDER_COLUMNS),
        "project_constant": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "source": "'first'", "five": "5"}),
        "project_computed": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "big": "100000000L + CAST(o.o_orderkey AS BIGINT)", "head": "substring(o.o_orderpriority, 3, 5)"}),
        "expr_string": _select("part", "p", {"p_partkey": "p.p_partkey", "up": "upper(p.p_name)", "n": "length(p.p_name)"}),
        "expr_date": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "y": "year(o.o_orderdate)", "m": "month(o.o_orderdate)"}),
        "expr_math": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "whole": "CAST(floor(o.o_totalprice) AS BIGINT)", "odd": "o.o_orderkey % 2"}),
        "expr_case": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "size": "CASE WHEN o.o_totalprice > 200000 THEN 'big' WHEN o.o_orderstatus IN ('F', 'O') THEN 'open' ELSE 'other' END"}),
        "filter_opaque": _select("documents", "d", {"doc_id": "d.doc_id", "quality": "l.quality"}, [Join("labels", "l", [("d.doc_id", "l.doc_id")], "left")], "l.quality = 1 OR l.quality IS NULL"),
        "join_inner": _select("orders", "o", {**ORDER_COLUMNS, "c_name": "c.c_name"}, [CUSTOMER_JOIN]),
        "join_left": _select("documents", "d", {"doc_id": "d.doc_id", "lang": "d.lang", "toxic": "l.toxic"}, [Join("labels", "l", [("d.doc_id", "l.doc_id")], "left")]),
        "join_left_literal": _select("orders", "o", {**ORDER_COLUMNS, "c_name": "c.c_name"}, [Join("customer", "c", [("o.o_custkey", "c.c_custkey"), ("c.c_mktsegment", Literal("BUILDING"))], "left")]),
        "join_literal_only": _select("orders", "o", {"o_orderkey": "o.o_orderkey", "r_name": "r.r_name"}, [Join("region", "r", [("r.r_regionkey", Literal(1))])]),
        "join_chain": _select("customer", "c", {"c_custkey": "c.c_custkey", "n_name": "n.n_name", "r_name": "r.r_name"}, [Join("nation", "n", [("c.c_nationkey", "n.n_nationkey")]), Join("region", "r", [("n.n_regionkey", "r.r_regionkey")])]),
        "union_all_computed_pk": lambda s, d: full(PARTY_VIEW, catalog(s, d)),
        "select_by_keys": lambda s, d: by_keys(ORDER_PART, ORDER_VIEW, (k := catalog(s, d)), k.table("orders").where("o_orderkey % 100 = 1").select("o_orderkey")).drop(*STORED),
        "scan_start": lambda s, d: scan.scan_start(catalog(s, d).table("conversations"), ("conv_id", "turn"), 1000),
        "scan_next": lambda s, d: scan.scan_next(catalog(s, d).table("conversations"), ("conv_id", "turn"), (20, 1), 1000),
        "dedup_keys": lambda s, d: refresh.dedup_keys(catalog(s, d).table("orders").select("o_custkey")),
        "delete_keys": lambda s, d: refresh.delete_keys((o := catalog(s, d).table("orders").select("o_orderkey", "o_custkey")), o.where("o_custkey % 3 = 0").select("o_orderkey"), ["o_orderkey"]),
        "upsert_keys": lambda s, d: refresh.upsert((c := catalog(s, d).table("customer").select("c_custkey", "c_name", "c_acctbal")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name")), ["c_custkey"]),
        "convert_key": lambda s, d: refresh.convert_keys(PARTY_VIEW.parts[0], PARTY_VIEW, (k := catalog(s, d)), k.table("customer").where("c_custkey % 2 = 0")),
        "fan_out": lambda s, d: refresh.fan_out(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]),
        "key_transform_direct": _direct,
        "key_grab_one_step": _grab("c", "customer", "c_custkey % 20 = 3"),
        "key_grab_two_step": _grab("n", "nation", "n_nationkey IN (3, 11)"),
        "key_grab_three_step": _grab("r", "region", "r_regionkey = 2"),
        "refresh_keys": _refresh_keys,
        "refresh_delete_topmost": _delete_topmost,
        "refresh_delete_inner": _delete_inner,
        "refresh_filter_exit": _filter_exit,
        "refresh_link_move": _link_move,
        "refresh_union": _union_refresh,
        "dict_diff": _dict_diff,
        "dict_filter": _dict_filter,
        "dict_refresh": _dict_refresh("nation"),
        "dict_refresh_two": _dict_refresh("nation", "region"),
        "cdc_parse": _cdc,
        "cdc_stream_apply": _stream_apply,
        "dict_log_refresh": _log_refresh,
        "scan_resume": _resumed,
        "scan_null_keys": _null_keys,
        "union_all": lambda s, d: full(UNION_VIEW, catalog(s, d)),
        "expr_json": _select("conversations", "c", {"conv_id": "c.conv_id", "turn": "c.turn", "role": "get_json_object(to_json(named_struct('r', c.role, 'n', c.turn)), '$.r')", "n": "CAST(from_json(concat('{\"n\": ', c.turn, '}'), 'n INT').n AS INT)"}),
        "expr_dialect": lambda s, d: full(translated(OTHER_DIALECT), catalog(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    order = "SELECT o_orderkey, o_custkey, o_totalprice AS price"
    return {
        "view_full": ORDER_SQL,
        "project_columns": f"{order} FROM orders",
        "project_constant": "SELECT o_orderkey, 'first' AS source, 5 AS five FROM orders",
        "project_computed": "SELECT o_orderkey, 100000000 + o_orderkey AS big, substring(o_orderpriority, 3, 5) AS head FROM orders",
        "expr_string": "SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INT) AS n FROM part",
        "expr_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders",
        "expr_math": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, o_orderkey % 2 AS odd FROM orders",
        "expr_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderstatus IN ('F', 'O') THEN 'open' ELSE 'other' END AS size FROM orders",
        "filter_opaque": "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 OR quality IS NULL",
        "join_inner": f"{order}, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
        "join_left": "SELECT d.doc_id, lang, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "join_left_literal": f"{order}, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'",
        "join_literal_only": "SELECT o_orderkey, r_name FROM orders, region WHERE r_regionkey = 1",
        "join_chain": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        "union_all_computed_pk": PARTY_SQL,
        "select_by_keys": ORDER_SQL + " AND o_orderkey % 100 = 1",
        "scan_start": "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 1000",
        "scan_next": "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (20, 1) ORDER BY conv_id, turn LIMIT 1000",
        "dedup_keys": "SELECT DISTINCT o_custkey FROM orders",
        "delete_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 0",
        "upsert_keys": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer",
        "convert_key": "SELECT 100000000 + c_custkey AS key FROM customer WHERE c_custkey % 2 = 0",
        "fan_out": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "key_transform_direct": "SELECT DISTINCT doc_id FROM labels WHERE toxic = 1",
        "key_grab_one_step": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 20 = 3)",
        "key_grab_two_step": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 11)",
        "key_grab_three_step": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
        "refresh_keys": ORDER_SQL,
        "refresh_delete_topmost": ORDER_SQL,
        "refresh_delete_inner": ORDER_SQL + " AND c_custkey % 5 <> 0",
        "refresh_filter_exit": ORDER_SQL,
        "refresh_link_move": ORDER_SQL,
        "refresh_union": PARTY_SQL,
        "dict_diff": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN 'insert' ELSE 'update' END AS op,
            CASE WHEN c_custkey % 9 = 1 THEN 'c_acctbal,c_mktsegment,c_name,c_nationkey' WHEN c_custkey % 9 = 2 THEN 'c_acctbal,c_name' ELSE 'c_acctbal' END AS fields
            FROM customer WHERE c_custkey % 9 <= 3""",
        "dict_filter": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 50 = 7 OR c_nationkey % 10 = 3",
        "dict_refresh": ORDER_SQL,
        "dict_refresh_two": ORDER_SQL,
        "cdc_parse": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id,
            CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events""",
        "cdc_stream_apply": ORDER_SQL,
        "dict_log_refresh": ORDER_SQL,
        "scan_resume": ORDER_SQL,
        "scan_null_keys": """WITH k AS (SELECT CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS conv_id, CASE WHEN turn > 1 THEN turn END AS turn FROM conversations)
            SELECT conv_id, turn FROM k WHERE conv_id IS NOT NULL OR turn > 2 ORDER BY conv_id NULLS FIRST, turn NULLS FIRST LIMIT 2000""",
        "union_all": "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
        "expr_json": "SELECT conv_id, turn, role, turn AS n FROM conversations",
        "expr_dialect": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, substring(o_orderpriority, 3, 5) AS head, CAST(o_orderdate AS DATE) AS day, 'x' AS note, TRY_CAST(o_orderpriority AS INT) AS whole FROM orders WHERE o_orderstatus <> 'F'",
    }
