"""Change messages through Structured Streaming into a stored view."""

import json

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.operators import dictionary, refresh
from millrace.plans.catalog import Catalog
from millrace.plans.view import Join, Literal, Part, View, full
from millrace.sources import cdc, scan
from millrace.sources.positions import Positions
from millrace.streaming.apply import LookupStream, ViewStream
from millrace.streaming.backfill import backfill
from millrace.streaming.store import ViewStore, refresh_all

VIEW = View("v", ["id"], [Part("main", "m", {"id": "m.id", "name": "s.name"}, [Join("sub", "s", [("m.ref", "s.id")])], "m.keep")])
MAIN, SUB = "id int, ref int, keep boolean", "id int, name string"


def _catalog(spark, main, sub):
    return Catalog(spark, {"main": ("id",), "sub": ("id",)}, {"main": spark.createDataFrame(main, MAIN), "sub": spark.createDataFrame(sub, SUB)})


def _feeder(spark, tmp_path, run):
    inbox = tmp_path / "in"

    def feed(name, **messages):
        """Messages by table, through one query."""
        for table in ("main", "sub"):
            (inbox / table).mkdir(parents=True, exist_ok=True)
            (inbox / table / name).write_text("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages.get(table, [])))
        run.start({t: spark.readStream.text(str(inbox / t)) for t in ("main", "sub")}, str(tmp_path / "check")).awaitTermination()
        return sorted(tuple(r) for r in run.views["v"][1].rows().select("id", "name").collect())

    return feed


@pytest.mark.parametrize("links", [False, True])
def test_stream_follows_changes_and_restarts(spark, tmp_path, links):
    view = replace(VIEW, links=links)
    state = {"now": _catalog(spark, [(1, 1, True), (2, 2, True), (3, 1, True)], [(1, "a"), (2, "b")])}
    store = ViewStore(spark, str(tmp_path / "view"))
    refresh_all(view, state["now"], store)
    run = ViewStream(lambda: state["now"], {"v": (view, store)}, str(tmp_path / "dead"))
    feed = _feeder(spark, tmp_path, run)

    # a row leaves the filter, one moves its link, one is new, one message is no message, one can't be decoded
    state["now"] = _catalog(spark, [(1, 1, False), (2, 1, True), (3, 1, True), (4, 2, True)], [(1, "a"), (2, "b")])
    assert feed("1", main=[{"key": [1], "newImage": {"ref": 1, "keep": False}}, {"key": [2]}, {"key": [4], "update": {}}, "junk", {"key": [3], "newImage": {"ref": "many"}}]) == [(2, "a"), (3, "a"), (4, "b")]
    assert sorted(r.message for r in spark.read.json(str(tmp_path / "dead")).collect()) == sorted(["junk", json.dumps({"key": [3], "newImage": {"ref": "many"}})])
    # both tables at once: a secondary row changes, another is deleted, and nothing but their keys is told
    state["now"] = _catalog(spark, [(1, 1, False), (2, 1, True), (3, 1, True), (4, 2, True), (5, 1, True)], [(1, "new")])
    assert feed("2", sub=[{"key": [1]}, {"key": [2], "erase": {}}], main=[{"key": [5]}]) == [(2, "new"), (3, "new"), (5, "new")]
    # a restart only takes the new files; a repeated message changes nothing
    assert feed("3", sub=[{"key": [1], "newImage": {"name": "new"}}]) == [(2, "new"), (3, "new"), (5, "new")]
    assert run.counts == {"sub": 3, "main": 6}


@pytest.mark.parametrize("links", [False, True])
def test_keys_alone_of_a_source_that_is_joined_by_another_column(spark, tmp_path, links):
    view = View("v", ["id"], [Part("main", "m", {"id": "m.id", "name": "s.name"}, [Join("sub", "s", [("m.k", "s.link")])])], links=links)
    make = lambda sub: Catalog(spark, {"main": ("id",), "sub": ("id",)}, {"main": spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string"), "sub": spark.createDataFrame(sub, "id int, link string, name string")})
    state = {"now": make([(7, "x", "a"), (8, "y", "b")])}
    store = ViewStore(spark, str(tmp_path / "view"))
    refresh_all(view, state["now"], store)
    feed = _feeder(spark, tmp_path, ViewStream(lambda: state["now"], {"v": (view, store)}))
    state["now"] = make([(8, "x", "b")])  # one is deleted, the other moves
    assert feed("1", sub=[{"key": [7], "erase": {}}, {"key": [8]}]) == [(1, "b")]


def test_store_keeps_the_old_version_until_the_new_one_counts(spark, tmp_path):
    cat = _catalog(spark, [(i, i % 2, True) for i in range(40)], [(0, "a"), (1, "b")])
    store = ViewStore(spark, str(tmp_path / "view"), rows_per_bucket=4)
    refresh_all(VIEW, cat, store)
    before = sorted(tuple(r) for r in store.rows().select("id", "name").collect())
    assert len(before) == 40 and len(store._manifest()) > 6
    later = cat.with_tables(sub=spark.createDataFrame([(0, "new")], SUB))
    keys = {"default": later.table("main").where("id < 4").select("id")}

    def stop(*_):
        raise RuntimeError("killed")

    crashing = ViewStore(spark, str(tmp_path / "view"))
    crashing._commit = stop
    with pytest.raises(RuntimeError):
        crashing.refresh(VIEW, later, keys)
    assert sorted(tuple(r) for r in store.rows().select("id", "name").collect()) == before
    old = store.rows().select("id", "name")
    store.refresh(VIEW, later, keys)
    assert sorted(tuple(r) for r in old.collect()) == before  # a reader goes on with what it began with
    want = [r for r in before if r[0] >= 4] + [(0, "new"), (2, "new")]
    assert sorted(tuple(r) for r in store.rows().select("id", "name").collect()) == sorted(want)
    store.vacuum()
    assert sorted(tuple(r) for r in store.rows().select("id", "name").collect()) == sorted(want)
    store.refresh(VIEW, cat.with_tables(main=cat.table("main").limit(0)), {"default": None})
    assert store.rows().count() == 0


def test_two_writers_take_turns(spark, tmp_path):
    cat = _catalog(spark, [(i, i % 2, True) for i in range(20)], [(0, "a"), (1, "b")])
    refresh_all(VIEW, cat.with_tables(sub=spark.createDataFrame([(0, "x"), (1, "x")], SUB)), ViewStore(spark, str(tmp_path / "view")))
    part = lambda k: ViewStore(spark, str(tmp_path / "view")).refresh(VIEW, cat, {"default": cat.table("main").where(F.col("id") % 3 == k).select("id")})
    threads = [threading.Thread(target=part, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(tuple(r) for r in ViewStore(spark, str(tmp_path / "view")).rows().select("id", "name").collect()) == [(i, "ab"[i % 2]) for i in range(20)]


def test_target_fills_and_casts(spark, tmp_path):
    cat = _catalog(spark, [(1, 1, True)], [(1, "5")])
    target = spark.createDataFrame([], "id bigint, name int, more string").schema
    store = ViewStore(spark, str(tmp_path / "view"), target=target)
    refresh_all(VIEW, cat, store)
    store.refresh(VIEW, cat, {"default": cat.table("main").select("id")})
    assert [tuple(r) for r in store.rows().select("id", "name", "more").collect()] == [(1, 5, None)]
    assert dict(store.rows().dtypes)["id"] == "bigint"


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    cat = _catalog(spark, [(i, i % 2, True) for i in range(50)], [(0, "a"), (1, "b")])
    store, positions = ViewStore(spark, str(tmp_path / "view"), rows_per_bucket=5), Positions(spark, str(tmp_path / "positions"))
    refresh_all(VIEW, cat.with_tables(sub=spark.createDataFrame([(0, "x"), (1, "x")], SUB)), store)
    assert not backfill(VIEW, cat, store, positions, "job", pages=4, most=2)
    assert positions.load("job", "v") == 2 and 0 < store.rows().where("name = 'x'").count() < 50
    assert backfill(VIEW, cat, store, positions, "job", pages=4) and positions.load("job", "v") is None
    assert sorted(tuple(r) for r in store.rows().select("id", "name").collect()) == [(i, "ab"[i % 2]) for i in range(50)]


def test_lookup_log_from_stream_to_view(spark, tmp_path):
    part = Part("main", "m", {"id": "m.id", "name": "s.name", "v": "c.v"}, [Join("sub", "s", [("m.ref", "s.id")], "left"), Join("konst", "c", [("c.id", Literal(1))], "left")])
    view = View("v", ["id"], [part])
    konst = "id int, v string"
    make = lambda sub, k: Catalog(spark, {t: ("id",) for t in ("main", "sub", "konst")}, {"main": spark.createDataFrame([(1, 1, True), (2, 2, True)], MAIN), "sub": spark.createDataFrame(sub, SUB), "konst": spark.createDataFrame(k, konst)})
    state = {"now": make([(1, "a"), (2, "b")], [(1, "k")])}
    store, log, positions = ViewStore(spark, str(tmp_path / "view")), dictionary.DictionaryLog(spark, str(tmp_path / "log")), Positions(spark, str(tmp_path / "positions"))
    refresh_all(view, state["now"], store)
    stream = LookupStream(lambda: state["now"], log)
    rows = lambda: sorted(tuple(r) for r in store.rows().select("id", "name", "v").collect())

    def feed(name, table, *messages):
        for t in ("sub", "konst"):
            (tmp_path / t).mkdir(exist_ok=True)
        (tmp_path / table / name).write_text("\n".join(map(json.dumps, messages)))
        stream.start({t: spark.readStream.text(str(tmp_path / t)) for t in ("sub", "konst")}, str(tmp_path / "check")).awaitTermination()

    # a deleted row, a changed one, and one that only changes back and forth
    state["now"] = make([(2, "new")], [(1, "k")])
    feed("1", "sub", {"key": [1], "erase": {}, "oldImage": {"name": "a"}}, {"key": [2], "oldImage": {"name": "b"}, "newImage": {"name": "new"}}, {"key": [9], "oldImage": {"name": "c"}, "newImage": {"name": "c"}})
    assert {(r.key_val, r.op, tuple(r.fields)) for r in log.read("sub").collect()} == {('{"id":1}', "delete", ("name",)), ('{"id":2}', "update", ("name",))}
    stream.watch(view, store, positions, "job", ["sub", "konst"], str(tmp_path / "watch")).awaitTermination()
    assert rows() == [(1, None, "k"), (2, "new", "k")] and positions.load("job", "sub") == 0
    # a constant lookup
    state["now"] = make([(2, "new")], [(1, "z")])
    feed("2", "konst", {"key": [1], "oldImage": {"v": "k"}, "newImage": {"v": "z"}})
    dictionary.refresh_from_log(view, state["now"], store, log, positions, "job", ["sub", "konst"])
    assert rows() == [(1, None, "z"), (2, "new", "z")] and positions.load("job", "konst") == 1
    # nothing new: the stored version stays
    version = store._manifest()[0].version
    dictionary.refresh_from_log(view, state["now"], store, log, positions, "job", ["sub", "konst"])
    assert store._manifest()[0].version == version


def test_constant_lookup_without_a_change_reads_nothing_again(spark):
    part = Part("main", "m", {"id": "m.id", "v": "c.v"}, [Join("sub", "c", [("c.id", Literal(1))], "left")])
    cat = _catalog(spark, [(1, 1, True)], [(1, "a")])
    assert dictionary.changed_main_keys(View("v", ["id"], [part]), cat, {"sub": dictionary.log_of_states(cat.table("sub"), cat.table("sub"), ("id",))}) == {}


def test_fan_out_is_refused(spark):
    view = View("v", ["id"], [Part("main", "m", {"id": "m.id", "name": "s.name"}, [Join("sub", "s", [("m.ref", "s.id")])])])
    cat = _catalog(spark, [(1, 1, True)], [(1, "a"), (1, "b")])
    with pytest.raises(refresh.FanOutError):
        refresh.refuse_fan_out(full(view, cat), view)


def test_parse_edge_cases(spark):
    lines = ['{"key":["7"],"newImage":{"name":"x"}}', '{"key":[7],"erase":null}', '{"key":[]}', "[]", "", '{"key":["z"]}', '{"key":[null],"erase":{}}', None]
    schema = spark.createDataFrame([], SUB).schema
    rows = cdc.parse(spark.createDataFrame([(x,) for x in lines], "value string"), schema, ("id",)).collect()
    assert [(r.id, r.op, r.bad) for r in rows] == [(7, "upsert", False), (7, "upsert", False), (None, "upsert", True), (None, "upsert", True), (None, "upsert", True), (None, "upsert", True), (None, "delete", False), (None, "upsert", True)]
    assert rows[0].after.id == 7 and rows[0].after.name == "x"


def test_typed_images(spark):
    schema = spark.createDataFrame([], "k bigint, b binary, t timestamp, d decimal(22,9), i interval day to second, f boolean").schema
    line = json.dumps({"key": [1], "newImage": {"b": "aGk=", "t": "2024-01-02T03:04:05Z", "d": "1.5", "i": 90, "f": True}})
    after = cdc.parse(spark.createDataFrame([(line,)], "value string"), schema, ("k",)).collect()[0].after
    assert bytes(after.b) == b"hi" and str(after.d) == "1.500000000" and after.i.total_seconds() == 90 and after.f is True and after.t.year == 2024


def test_pages(spark):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(10)], "a int, b int")
    got = [sorted(tuple(r) for r in p.collect()) for p in scan.pages(df, ("a", "b"), 4)]
    assert [len(g) for g in got] == [4, 4, 2] and sum(got, []) == sorted((i // 3, i % 3) for i in range(10))


def test_pages_with_null_keys(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "a int")
    assert [[r.a for r in p.collect()] for p in scan.pages(df, ("a",), 1)] == [[None], [1], [2], [3]]
    rows = [(None, None), (None, 1), (None, 2), (1, None), (1, 1), (2, None)]
    two = spark.createDataFrame(rows, "a int, b int")
    assert [tuple(r) for p in scan.pages(two, ("a", "b"), 2) for r in p.orderBy("a", "b").collect()] == rows
    assert list(scan.pages(df.limit(0), ("a",), 1)) == []


def test_positions(spark, tmp_path):
    at = Positions(spark, str(tmp_path / "p"))
    assert at.load("j", "t") is None
    at.save("j", "t", [1, None, "x"])
    at.save("j", "u", {"batch": 3})
    at.save("j", "t", 5)
    assert at.load("j", "t") == 5 and at.load("j", "u") == {"batch": 3} and at.load("k", "t") is None
    at.remove("j", "t")
    at.remove("j", "t")
    assert at.load("j", "t") is None


def test_large_batches_decode_and_map_once(spark, tmp_path, monkeypatch):
    """What a batch takes: each message is decoded once, and rows alike in what a path reads are joined once."""
    decoded, seen = spark.sparkContext.accumulator(0), []
    view = replace(VIEW, links=True)
    now = _catalog(spark, [(i, 1 + i % 2, True) for i in range(20)], [(1, "a"), (2, "b")])
    store = ViewStore(spark, str(tmp_path / "view"))
    refresh_all(view, now, store)
    real = cdc.parse

    def counting(messages, schema, key, column="value"):
        def each(batches):
            for b in batches:
                decoded.add(b.num_rows)
                yield b

        return real(messages.mapInArrow(each, messages.schema), schema, key, column)

    monkeypatch.setattr(cdc, "parse", counting)
    monkeypatch.setattr("millrace.streaming.apply.changed_keys", lambda part, catalog, changes: seen.extend(changes) or refresh.changed_keys(part, catalog, changes))
    run = ViewStream(lambda: now, {"v": (view, store)}, str(tmp_path / "dead"))
    messages = spark.createDataFrame([("main", f'{{"key": [{i}]}}') for i in range(20)] + [("sub", '{"key": [1], "newImage": {"name": "a"}}')], "table string, value string")
    run.apply(messages, ["main", "sub"])
    assert decoded.value == 21
    # keys alone lead to the main rows here: neither images nor current rows are read for them
    assert {c.table: c.rows.count() for c in seen} == {"main": 20, "sub": 1}
    assert sorted(tuple(r) for r in store.rows().select("id", "name").collect()) == [(i, "ab"[i % 2]) for i in range(20)]
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
