"""SQL drafts, views, monitors, registries, model governance and candidates: refusals and lifecycles."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.functions.catalog import PlanError
from marlstone.operators import candidates, usage
from marlstone.operators.tables import SnapshotTable
from marlstone.plans import analyzer, views
from marlstone.quality import monitor, registry
from marlstone.quality.checks import Result
from marlstone.queries import _catalog
from marlstone.semantic import governance as g
from marlstone.semantic.model import Dimension, Metric, Model

NOW = datetime(2026, 1, 1)
SCRIPTS = {
    "a": "CREATE TABLE x AS SELECT k, v * 2 + 1 AS f FROM t; -- a; comment\n",
    "b": "INSERT INTO y SELECT max(k) AS m, 1 + 2 * x.v AS f FROM x",
    "c": "WITH q AS (SELECT * FROM y) SELECT ';' AS s, 1 + v * 2 AS f FROM q JOIN q AS r ON q.k = r.k",
}


def test_split_script():
    assert analyzer.split_script("SELECT ';' -- no; end\n; /* ; */ ; SELECT 2") == ["SELECT ';' -- no; end", "SELECT 2"]


def test_scripts(spark):
    names, layers = analyzer.order(spark, SCRIPTS)
    assert names == ["a", "b", "c"] and layers == {"a": "bronze", "b": "gold", "c": "gold"}
    with pytest.raises(PlanError, match="depend on each other: p, q"):
        analyzer.order(spark, {"p": "INSERT INTO u SELECT * FROM w", "q": "INSERT INTO w SELECT * FROM u"})
    (f,) = [p for p in analyzer.patterns(spark, SCRIPTS) if p["alias"] == "f"]
    assert (f["uses"], f["state"]) == (3, "shared")
    assert analyzer.cte_plan(spark, SCRIPTS) == {"q": "partial"}
    assert analyzer.fingerprint(spark, "o.a * 2 + b", True) == analyzer.fingerprint(spark, "b + 3 * a", True)


def test_draft_places_conditions(spark):
    d = analyzer.draft(spark, "SELECT o.id, r.x FROM o LEFT JOIN r ON o.id = r.oid WHERE o.a = 1 AND r.x > 2 AND o.b IN (SELECT b FROM z) ORDER BY 1 LIMIT 3")
    assert d.spec["tables"][0]["filter"] == ["sql:(a = 1)"] and d.spec["where"] == ["sql:(x > 2)"]
    assert [r.split()[0] for r in d.residues] == ["limit", "order", "subquery"]
    with pytest.raises(PlanError, match="Union has no pipeline form"):
        analyzer.draft(spark, "SELECT a FROM t UNION ALL SELECT a FROM u")


def test_views(spark, tmp_path):
    table, df = SnapshotTable(spark, f"file://{tmp_path}/v"), spark.range(2)
    done = [views.materialize(df, s, table, r) for s, r in [({"a": 1}, "always"), ({"a": 1}, "always"), ({"a": 1}, "never"), ({"a": 2}, "never")]]
    assert done == ["create", "refresh", "skip", "replace"]
    with pytest.raises(PlanError, match="relationships"):
        views.metric_view(_catalog().models["orders"])


def test_append_after_overwrite(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    for k in (1, 2):
        table.append(spark.range(k), str(k))
        table.append(spark.range(k), str(k))
    copy = table.clone(f"file://{tmp_path}/c")
    table.optimize(["id"], 2)
    table.append(spark.range(1))
    assert sorted(r.id for r in table.read().collect()) == [0, 0, 0, 1] and copy.read().count() == 3


def test_monitor(spark):
    spec = {"tables": [{"name": "t", "fields": [["a", "k"], "b"], "filter": ["b:gt:0", "z:gt:1"], "quality_checks": {"drop_nulls_in": ["a"]}}], "select_final": [["k", "key"], ["b", "b"], ["b", "n", ["cast:long"]]]}
    found = monitor.derive(spec)
    assert [c.name for c in found] == ["null_key", "filter_b_gt", "type_n", "schema"]
    df = spark.createDataFrame([(None, 1, 1), (2, -1, 2)], "key int, b int, n bigint")
    results = monitor.run(df, found, NOW)
    assert [r.status for r in results] == ["FAIL", "FAIL", "PASS", "PASS"]
    with pytest.raises(monitor.CheckFailed, match="null_key: FAIL$"):
        monitor.require(results)
    empty = monitor.run(df.limit(0).withColumn("at", F.lit(None).cast("timestamp")), [monitor.Check("freshness", "f", ("at", timedelta(1))), monitor.Check("volume", "v", (1, 2))], NOW)
    assert [r.status for r in empty] == ["FAIL", "FAIL"]


def test_stores(spark, tmp_path):
    runs = registry.RunStore(SnapshotTable(spark, f"file://{tmp_path}/r"))
    assert runs.record("r", "p", "1", "STARTED", NOW) < runs.record("r", "p", "1", "PROMOTED", NOW)
    incidents = registry.Incidents(SnapshotTable(spark, f"file://{tmp_path}/i"))
    (one,) = incidents.open("p", "r", [Result("x", "ERROR", None), Result("y", "FAIL", 1, critical=False)], NOW)
    incidents.move(one, "RESOLVED", "a", NOW + timedelta(1))
    with pytest.raises(PlanError, match="from RESOLVED to ACK"):
        incidents.move(one, "ACK", "a", NOW + timedelta(2))
    assets = registry.Registry(SnapshotTable(spark, f"file://{tmp_path}/a"))
    given = [{"name": "t", "columns": ["b"], "upstream": [("s.a", "t.b")]}, {"name": "u", "columns": ["c"], "upstream": [("t.b", "u.c")]}]
    assert (assets.upsert(given), assets.upsert(given)) == (2, 0)
    assert assets.impact("s.a") == ({"t.b": 1, "u.c": 2}, False) and assets.impact("s.a", 1) == ({"t.b": 1}, True)


def test_gate():
    assert g.gate("enforce", "m", "c", None, NOW) == "DENY" and g.gate("enforce", "m", "c", NOW - timedelta(1), NOW) == "ALLOW"
    assert g.gate("supervised", "m", "c", NOW - timedelta(3), NOW, timedelta(2)) == "REQUIRE_HUMAN"
    over = g.Override("m", "c", NOW, NOW + timedelta(hours=4))
    assert g.gate("enforce", "m", "c", None, NOW, None, [over]) == "WARN" and g.gate("enforce", "m", "d", None, NOW, None, [over]) == "DENY"
    assert g.lifecycle({"effective_to": NOW}, NOW) == "DENY" and g.lifecycle({"deprecated": True}, NOW) == "WARN"
    assert g.evidence("q", ["b", "a"], [], [("x", "eq", "secret")], "ok", 1.0)["filters"] == ["x eq ?"]


def test_models():
    bad = Model("m", "t", {"d": Dimension("d", "d")}, {"s": Metric("s", "sum(x)", "sum"), "p": Metric("p", "x", "median"), "a": Metric("a", "x", "sum", (), "semi_additive")})
    assert len(g.problems(bad)) == 3 and g.problems(_catalog().models["orders"]) == []
    base = {"grain": "id", "metrics": {"a": 1, "b": 2}}
    assert g.merge(base, {"grain": "id", "metrics": {"a": 9, "b": 2}}, {"grain": "id", "metrics": {"a": 1, "c": 2}}) == ({"grain": "id", "metrics": {"a": 9, "c": 2}}, [], ["metrics.b may be c now"])
    curated = {"grain": "id", "metrics": {"a": 9, "b": 2}}
    assert g.merge(base, curated, {"grain": "id", "metrics": {"a": 8, "b": 2}})[:2] == (curated, ["metrics.a"])


def test_candidates(spark):
    a, b = {"metrics": ["x", "y"], "filters": [("d", "eq", 1)]}, {"metrics": ["y", "x"], "filters": [("d", "eq", 2)]}
    assert candidates.normal_form(a) == candidates.normal_form(b)
    assert candidates.rollup(a, {"x": "sum", "y": "count"}) == {"group_by": ["d"], "metrics": {"x": "sum", "y": "sum"}}
    with pytest.raises(ValueError, match="y can't"):
        candidates.rollup(a, {"x": "sum", "y": "avg"})
    assert usage.refusals(True, True, False, None, ["one_to_many"]) == ["raw SQL", "unknown grain", "join may repeat rows"]
    row = spark.sql("SELECT array('a', 'b') AS x, array('b', 'c', 'd') AS y").select(candidates.similarity(F.col("x"), F.col("y")).alias("s")).first()
    assert row.s == 0.25
