"""The declarative engine: parsing, refusals and lifecycles; results against SQL are in test_queries."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.catalog import PlanError, predicate
from marlstone.operators.tables import SnapshotTable
from marlstone.plans.lineage import Lineage
from marlstone.plans.pipeline import Pipeline, inject, join, parse_filter, run_rules
from marlstone.quality.checks import drift, parity
from marlstone.quality.publication import breaking, contract_hash, publish
from marlstone.queries import _catalog
from marlstone.semantic.model import Query


def test_filters():
    assert parse_filter("a:equals:x:y") == ("a", "equals", "x:y")
    assert parse_filter({"a": None}) == ("a", "is_null", None)
    assert parse_filter({"a": {"gt": 3}}) == ("a", "gt", 3)
    assert inject("x {{ a }}{{b}}", {"a": 1, "b": None}) == "x 1"
    with pytest.raises(PlanError, match="unresolved parameters: z"):
        inject("{{ z }}", {})


def test_hints(spark):
    with pytest.raises(PlanError, match="did you mean equals"):
        predicate(F.lit(1), "equalz", 1)
    with pytest.raises(PlanError, match="did you mean"):
        Pipeline(spark, {"tabels": []})


def test_casts_give_null(spark):
    df = spark.createDataFrame([("x", "2020-99-01", "a"), ("7", "2020-01-02", "a,b")], "a string, d string, s string")
    out = Pipeline(spark, {"tables": [{"name": "t"}], "select_final": [["a", "n", ["cast:int"]], ["d", "d", ["to_date:yyyy-MM-dd"]], ["s", "s", ["split:,,1"]]]}, {"t": df}).run().collect()
    assert [out[0].n, out[0].d, out[0].s] == [None, None, None] and out[1].n == 7 and out[1].s == "b"


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "j int, w string")
    full = join(a, b, {"table_from": ["a", "k"], "table_to": ["b", "j"], "type": "outer"})
    assert {r.k for r in full.collect()} == {1, 2, None} and full.columns == ["k", "v", "w"]
    with pytest.raises(PlanError, match="both sides have v"):
        join(a, a.withColumnRenamed("k", "j"), {"table_from": ["a", "k"], "table_to": ["b", "j"]})


def test_rules_see_overwrites(spark):
    df = spark.createDataFrame([(10,)], "a int")
    out = run_rules(df, [("o", "projection", lambda d: {"a": F.col("a") + 1}), ("r", "projection", lambda d: {"b": F.col("a") * 2})])
    assert out.first().b == 22


def test_semantic_refusals(spark):
    catalog = _catalog()
    t = {n: spark.createDataFrame([], s) for n, s in {"orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date", "customer": "c_custkey long, c_mktsegment string, c_nationkey long", "nation": "n_nationkey long, n_name string, n_regionkey long", "region": "r_regionkey long, r_name string"}.items()}
    for q, message in [(Query("orders", ["top"], ["segment"]), "needs status"), (Query("private", ["n_own"]), "needs the consumer"), (Query("orders", ["revenu"]), "did you mean revenue"), (Query("customer", ["n_customers"], date_from="2020-01-01"), "no date dimension"), (Query("orders", ["revenue"], period="y1995", date_to="2020-01-01"), "excludes"), (Query("customer", ["n_customers"], ["status"]), "no join paths")]:
        with pytest.raises(PlanError, match=message):
            catalog.query(q, t)


def test_tables_and_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, s int")
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.upsert(df, ["k"], "1", "s")
    table.upsert(df.withColumn("v", F.lit("z")), ["k"], "1", "s")
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "b"), (2, None)}
    target, bad = SnapshotTable(spark, f"file://{tmp_path}/p"), SnapshotTable(spark, f"file://{tmp_path}/q")
    results = publish(df, target, bad, ["v"], {"small": F.col("s") < 2}, "r1", "1")
    assert {r.status for r in results} == {"FAIL"} and not target.exists() and bad.read().count() == 2
    publish(df.where("s < 2 AND v IS NOT NULL"), target, bad, ["v"], {"small": F.col("s") < 2}, "r2", "1")
    assert target.read().count() == 1


def test_contracts_lineage_parity(spark):
    old = {"id": "x", "output": {"a": {"type": "int", "required": True}}, "owner": "me"}
    assert contract_hash(old) == contract_hash(old | {"owner": "you"})
    assert breaking(old, {"id": "x", "output": {"a": {"type": "long"}}}) == ["a retyped", "a no longer required"]
    line = Lineage.of({"tables": [{"name": "src", "alias": "s", "fields": ["a", ["b", "c"]]}], "select_final": [["c", "out"]]}, "gold")
    assert line.closure(("gold", "out"), True) == {("s", "c"): 1, ("src", "b"): 2}
    assert line.classify({("src", "b"): "pii"})[("gold", "out")] == "pii"
    a = spark.createDataFrame([(1, 2), (3, None)], "k int, v int")
    assert parity(a, a, ["k"]).count() == 0 and drift(a, ["k", "z"]) == {"missing": ["z"], "extra": ["v"]}
