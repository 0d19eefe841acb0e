"""Every registered query of the view engine against DuckDB, and what SQL can't show."""

import os

import duckdb
import pytest

from millrace import queries
from millrace.functions.dialect import spark_sql, spark_type, translated
from millrace.operators import refresh
from millrace.plans.catalog import Catalog
from millrace.plans.paths import affected_keys, path_to_main
from millrace.plans.validate import Handler, validate, validate_all
from millrace.plans.view import Join, Literal, Part, View, full, used_columns

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        at = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{at}')")
    return con


def _rows(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(str(r[i]) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.collect(), df.columns, sorted(columns)) == _rows(got.fetchall(), columns, sorted(columns))


def small(spark, **rows):
    schemas = {"main": "id int, ref int, k string", "sub": "id int, link int, name string", "far": "id int, what string", "konst": "id int, v string"}
    keys = {t: ("id",) for t in schemas}
    return Catalog(spark, keys, {t: spark.createDataFrame(rows.get(t, []), s) for t, s in schemas.items()})


VIEW = View("v", ["id"], [Part(
    "main", "m", {"id": "m.id", "name": "s.name", "what": "f.what", "v": "c.v"},
    [Join("sub", "s", [("m.ref", "s.id")]), Join("far", "f", [("s.link", "f.id")], "left"), Join("konst", "c", [("c.id", Literal(1))], "left")],
    "m.k IS NOT NULL",
)])


def test_paths(spark):
    cat = small(spark)
    part = VIEW.parts[0]
    assert path_to_main(part, cat, "m").steps == ("m",)
    assert path_to_main(part, cat, "s").steps == ("s", "m")
    assert path_to_main(part, cat, "f").steps == ("f", "s", "m")
    assert path_to_main(part, cat, "c") is None
    assert affected_keys(part, cat, "c", cat.table("konst")) is None


def test_null_keys_are_refreshed(spark):
    before = small(spark, main=[(None, 1, "a"), (2, 1, "b")], sub=[(1, 5, "old")], far=[(5, "w")])
    after = before.with_tables(sub=spark.createDataFrame([(1, 5, "new")], "id int, link int, name string"))
    stored = full(VIEW, before, bookkeeping=True)
    got = refresh.apply_changes(VIEW, after, stored, [refresh.Change("sub", before.table("sub"), after.table("sub"))])
    assert sorted((r.id is None, r.name) for r in got.collect()) == [(False, "new"), (True, "new")]


def test_constant_lookup_refreshes_the_part(spark):
    before = small(spark, main=[(1, 1, "a")], sub=[(1, 5, "n")], konst=[(1, "x")])
    after = before.with_tables(konst=spark.createDataFrame([(1, "y")], "id int, v string"))
    got = refresh.apply_changes(VIEW, after, full(VIEW, before, bookkeeping=True), [refresh.Change("konst", before.table("konst"), after.table("konst"))])
    assert [r.v for r in got.collect()] == ["y"]


def test_empty_changes_leave_the_view(spark):
    cat = small(spark, main=[(1, 1, "a")], sub=[(1, 5, "n")])
    stored = full(VIEW, cat, bookkeeping=True)
    none = cat.table("sub").limit(0)
    assert refresh.apply_changes(VIEW, cat, stored, [refresh.Change("sub", none, none)]).count() == 1


def test_validation(spark):
    cat = small(spark)
    assert [i for i in validate(VIEW, cat) if i.error] == []
    assert {i.kind for i in validate(VIEW, cat)} == {"KeyExtractionImpossible"}
    kinds = lambda **change: {i.kind for i in validate(View("v", ["id"], [Part(**({"table": "main", "alias": "m", "columns": {"id": "m.id"}} | change))]), cat) if i.error}
    assert kinds(columns={"x": "m.id"}) == {"UnknownOutputColumn"}
    assert kinds(columns={"id": "m.id", "y": "m.nope"}) == {"UnknownColumn"}
    assert kinds(columns={"id": "m.id", "y": "q.id"}) == {"UnknownAlias"}
    assert kinds(columns={"id": "m.id", "y": "1 + m.nope"}) == {"CustomColumnError"}
    assert kinds(columns={"id": "m.id", "y": "row_number() over (order by m.id)"}) == {"CustomColumnError"}
    assert kinds(where="sum(m.id) > 1") == {"CustomFilterError"}
    assert kinds(joins=[Join("sub", "s", [("m.ref", "q.id")])]) >= {"UnknownAlias"}
    assert kinds(joins=[Join("sub", "s", [("m.ref", "s.nope")])]) == {"UnknownColumnInCondition"}
    assert kinds(joins=[Join("sub", "s", [("s.id", "s.id")])]) == {"IllegalJoinCondition"}
    assert kinds(joins=[Join("sub", "s", [("m.ref", "s.id")], "right")]) == {"IllegalJoin"}
    assert kinds(joins=[Join("none", "s", [("m.ref", "s.id")])]) == {"UnknownSourceTable"}


def test_validation_of_types_and_targets(spark):
    cat = small(spark)
    issues = lambda view, target=None: {i.kind for i in validate(view, cat, target) if i.error}
    one = lambda **more: View("v", ["id"], [Part("main", "m", {"id": "m.id", "k": "m.k"})], **more)
    assert issues(one()) == set()
    assert issues(one(types={"id": "nonsense"})) and issues(one(types={"id": "array<int>"})) == {"MismatchedOutputType"}
    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    assert issues(one(), schema("id bigint, k string, more string")) == set()
    assert issues(one(), schema("id bigint")) == {"UnknownOutputColumn"}
    assert issues(one(), schema("id map<int,int>, k string")) == {"MismatchedOutputType"}
    computed = View("v", ["id"], [Part("main", "m", {"id": "m.ref + 1"})])
    assert {i.kind for i in validate(computed, cat)} == {"ComplexKeyGeneration"}
    part = Part("main", "m", {"id": "m.id", "a": "m.id", "b": "m.none1", "c": "m.none2", "d": "m.none3"})
    assert [i.kind for i in validate(View("v", ["id"], [part]), cat)] == ["UnknownColumn"] * 3


def test_validation_of_handlers(spark):
    cat = small(spark)
    views = [VIEW, View("w", ["id"], [Part("main", "m", {"id": "m.id"})])]
    inputs = {"main": "stream", "sub": "stream", "far": "batch", "konst": "batch"}
    kinds = lambda *handlers, vs=views, targets=None: {(i.kind, i.error) for i in validate_all(vs, handlers, cat, targets)} - {("KeyExtractionImpossible", False)}
    assert kinds(Handler("h", ["v", "w"], inputs)) == set()
    assert kinds(Handler("h", ["v"], inputs)) == {("UselessView", False)}
    assert kinds(Handler("h", ["v", "w"], inputs), Handler("i", ["w"], {"main": "stream"})) == {("ViewMultiHandlers", True)}
    assert kinds(Handler("h", ["w"], {"main": "stream", "sub": "stream"}), vs=views[1:]) == {("UselessInput", False)}
    assert kinds(Handler("h", ["v", "w"], {"main": "stream", "sub": "stream", "far": "batch"})) == {("MissingInput", False)}
    assert kinds(Handler("h", ["w", "x"], {"main": "other", "none": "batch"}), vs=views[1:]) == {("UnknownView", True), ("IllegalInput", True), ("UnknownInputTable", True)}
    assert kinds(Handler("h", []), vs=[]) == {("EmptyHandler", True)}
    assert kinds(Handler("h", ["w"], {"main": "stream"}), Handler("h", ["w"], {"main": "stream"}), vs=views[1:]) >= {("DuplicateHandler", True)}
    assert kinds(Handler("h", ["w"], {"main": "stream"}), vs=[views[1]] * 2) == {("DuplicateView", True)}
    assert kinds(Handler("h", ["w"], {"main": "stream"}), vs=views[1:], targets={}) == {("MissingTargetTable", True)}


def test_used_columns(spark):
    cat = small(spark)
    part = VIEW.parts[0]
    assert used_columns(part, cat, "s") == {"id", "link", "name"} and used_columns(part, cat, "c") == {"id", "v"}
    plain = Part("main", "m", {"id": "m.id", "x": "concat(name, 'link', `k`)"}, [Join("sub", "s", [("m.ref", "s.id")])], "upper(S.`link`) = 'id'")
    assert used_columns(plain, cat, "s") == {"id", "name", "link"} and used_columns(plain, cat, "m") == {"id", "ref", "k"}
    assert used_columns(Part("main", "m", {"id": "m.id", "x": "to_json(struct(m.*))"}), cat, "m") == {"id", "ref", "k"}


def test_names_with_dots_and_aliases_in_any_case(spark):
    cat = Catalog(spark, {"main": ("i.d",), "sub": ("id",)}, {"main": spark.createDataFrame([(1, 5), (2, 6)], "`i.d` int, `re.f` int"), "sub": spark.createDataFrame([(5, "a"), (6, "b")], "id int, name string")})
    view = View("v", ["id"], [Part("main", "M", {"id": "m.`i.d`", "name": "S.name"}, [Join("sub", "s", [("m.`re.f`", "S.id")])])])
    assert [i for i in validate(view, cat) if i.error] == []
    after = cat.with_tables(sub=spark.createDataFrame([(5, "new"), (6, "b")], "id int, name string"))
    got = refresh.apply_changes(view, after, full(view, cat, bookkeeping=True), [refresh.Change("sub", cat.table("sub").where("id = 5"), after.table("sub").where("id = 5"))])
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "new"), (2, "b")]


def test_translated_view():
    view = translated(View("v", ["id"], [Part("t", "t", {"id": "CAST(t.a AS Int64)"}, (), "t.b = 'x'u")], types={"id": "Int32?"}))
    assert view.parts[0].columns == {"id": "CAST(t.a AS BIGINT)"} and view.parts[0].where == "t.b = 'x'" and view.types == {"id": "INT"}


def test_dialect():
    assert spark_sql("CAST(a.b AS Int32?)") == "try_cast(a.b AS INT)"
    assert spark_sql("CAST(substring(a.b, 1, 2) AS Int64)") == "CAST(substring(a.b, 1, 2) AS BIGINT)"
    assert spark_sql("Unicode::Substring(x, 3, 5) = 'Unicode::y'u") == "Substring(x, 3, 5) = 'Unicode::y'"
    assert spark_sql("'it''s' || 'a\\'s's") == "'it''s' || 'a\\'s'"
    assert spark_type("Uint64?") == "DECIMAL(20,0)" and spark_type("Decimal(22,9)") == "Decimal(22,9)"
