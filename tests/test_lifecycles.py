"""Sources, joins, drafts, tables, access, publication, lineage, exports and search: lifecycles and refusals."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.functions.catalog import PlanError, predicate
from marlstone.operators import candidates, search, tables
from marlstone.operators.tables import Conflict, SnapshotTable
from marlstone.plans import analyzer, describe
from marlstone.plans.lineage import Lineage, columns_of
from marlstone.plans.pipeline import Pipeline, join, limited, parse_filter
from marlstone.quality import exports, registry
from marlstone.quality.checks import Result, parity, parity_report
from marlstone.quality.publication import Publication
from marlstone.semantic.governance import Access, Override
from marlstone.semantic.model import Catalog, Dimension, Metric, Model, Query
from marlstone.sources.readers import Sandbox, explode_union, find_file, union_partitions
from marlstone.streaming import streams

NOW = datetime(2026, 1, 1)


def test_literals(spark):
    df = spark.createDataFrame([(1, "1", True, None), (3, "3", False, None), (4, "x", None, None)], "k int, s string, b boolean, d date").withColumn("d", F.to_date(F.concat(F.lit("2024-01-0"), "k")))
    keep = lambda c, op, v: [r.k for r in df.where(predicate(F.col(c), op, v, df.schema[c].dataType)).collect()]
    assert keep("k", "lt", "3.5") == [1, 3] and keep("k", "equals", "3.0") == [3] and keep("k", "in", "1;4.0") == [1, 4] and keep("k", "gt", "-1e0") == [1, 3, 4]
    assert keep("k", "lt", str(10**30)) == [1, 3, 4] and keep("s", "equals", "3") == [3] and keep("b", "equals", "true") == [1]
    assert keep("d", "gte", "2024-01-03") == [3, 4] and keep("d", "lte", "2024-01-03 00:00:00") == [1, 3]
    for c, v in (("k", "abc"), ("k", ""), ("b", "yes"), ("d", "2024-99-01")):
        with pytest.raises(PlanError):
            keep(c, "equals", v)
    assert parse_filter("a:equals:") == ("a", "equals", "") and parse_filter({"a": "is_not_null"}) == ("a", "is_not_null", None) and parse_filter({"a": "like"}) == ("a", "equals", "like")


def test_arity_before_reading(spark):
    for ops in (["substring:1"], ["split:-"], "cast"):
        with pytest.raises(PlanError, match="needs"):
            Pipeline(spark, {"tables": [{"name": "no_such_table"}], "select_final": [["a", "b", ops]]})


def test_join_forms(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (3, 30)], "j int, m int")
    c = spark.createDataFrame([(10, "p"), (30, "q")], "m2 int, w string")
    spec = {"tables": [{"name": n} for n in "abc"], "join": [{"table_from": ["a", "k"], "table_to": ["b", "j"], "type": "full_outer"}, {"table_from": ["b", "j"], "table_to": ["c", "m2"], "type": "left"}]}
    out = Pipeline(spark, spec, {"a": a, "b": b, "c": c.withColumn("m2", F.col("m2") / 10)}).run()
    assert out.columns == ["k", "v", "m", "w"] and {(r.k, r.w) for r in out.collect()} == {(1, "p"), (2, None), (3, "q")}
    for how, n in (("left anti", 1), ("leftanti", 1), ("left-anti", 1), ("left semi", 1), ("LEFT_SEMI", 1)):
        assert join(a, b, {"table_from": ["a", "k"], "table_to": ["b", "j"], "type": how}).count() == n
    with pytest.raises(PlanError, match="goes from a table that is there"):
        Pipeline(spark, {**spec, "join": [spec["join"][0], {"table_from": ["c", "m2"], "table_to": ["b", "j"]}]}, {"a": a, "b": b, "c": c}).run()
    rate = spark.readStream.format("rate").load()
    for how in ("right", "full", "left_anti"):
        with pytest.raises(PlanError, match="stream"):
            join(rate, a, {"table_from": ["r", "value"], "table_to": ["a", "k"], "type": how})


def test_partials(spark, tmp_path):
    one, two = tmp_path / "one.yaml", tmp_path / "two.yaml"
    one.write_text(f"partials: [{{alias: two, path: '{two}'}}]")
    two.write_text(f"partials: [{{alias: one, path: '{one}'}}]")
    with pytest.raises(PlanError, match="contain themselves"):
        Pipeline(spark, {"partials": [{"alias": "x", "path": str(one)}]}).run()
    child = {"tables": [{"name": "t"}]}
    for mode in ("table", "temp_view"):
        Pipeline(spark, {"partials": [{"alias": f"kept_{mode}", "spec": child, "mode": mode}]}, {"t": spark.range(3)}).run()
        assert spark.table(f"kept_{mode}").count() == 3
    spark.sql("DROP TABLE kept_table")
    assert limited(spark.range(5), 3)[1] and not limited(spark.range(3), 3)[1]


def test_sources(spark, tmp_path):
    for k in ("x", "y"):
        spark.range(2).createOrReplaceTempView(f"base_{k}")
    df, missing = union_partitions(spark, ["base", "other"], ["x", "y"])
    assert df.count() == 4 and missing == ["other_x", "other_y"] and union_partitions(spark, ["base"], ["x", "y"], True)[0].count() == 2
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "f.yaml").write_text("x")
    assert find_file("f.yaml", str(tmp_path / "a" / "b")) == str(tmp_path / "f.yaml")
    with pytest.warns(UserWarning, match="is taken"):
        assert find_file("gone/f.yaml", str(tmp_path / "a")) == str(tmp_path / "f.yaml")
    with pytest.raises(PlanError, match="is not there"):
        find_file("no.yaml", str(tmp_path))
    rows = explode_union(spark.createDataFrame([(1, [(2,)])], "id int, a array<struct<v:int>>"), ["id"], [{"array": "a", "item": "x", "columns": {"v": "x.v"}, "literals": {"none": [None, "double"], "kind": "k"}}])
    assert rows.first().asDict() == {"id": 1, "v": 2, "none": None, "kind": "k"} and rows.schema["none"].dataType.simpleString() == "double"
    spark.sql("CREATE SCHEMA IF NOT EXISTS plain")
    spark.range(4).write.mode("overwrite").saveAsTable("plain.t")
    try:
        with pytest.raises(PlanError, match="plain_own.t is not there"):
            Sandbox(spark, "_own", "error").resolve("plain", "t")
        box = Sandbox(spark, "_own")
        assert spark.table(box.resolve("plain", "t")).count() == 4 and box.resolve("plain", "t") == "plain_own.t"
        look = describe.CatalogInspector(spark)
        assert look.validate("PLAIN", "T", ["ID"]) == ["plain", "t", "id"]
        with pytest.raises(PlanError, match="did you mean plain"):
            look.validate("plian")
    finally:
        spark.sql("DROP SCHEMA plain CASCADE")
        spark.sql("DROP SCHEMA IF EXISTS plain_own CASCADE")


def test_drafts(spark):
    d = analyzer.draft(spark, "SELECT o.a FROM o WHERE o.a = 'o.b' AND o.c = 1")
    assert d.spec["tables"][0]["filter"] == ["sql:(a = 'o.b')", "sql:(c = 1)"]
    spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 1, 7)], "k int, t int, v int").createOrReplaceTempView("rows_of")
    for sql in [
        "SELECT k, t, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS n FROM rows_of) x WHERE n = 1 AND v > 5",
        "WITH a AS (SELECT k, v FROM rows_of WHERE v > 5), b AS (SELECT k, sum(v) AS s FROM a GROUP BY k) SELECT k, s FROM b",
        "SELECT k FROM rows_of UNION SELECT v FROM rows_of", "SELECT DISTINCT k, t FROM rows_of", "SELECT k, v / (SELECT sum(v) FROM rows_of) AS share FROM rows_of",
        "SELECT k, count(*) AS n, max(v) AS top FROM rows_of WHERE t < 3 GROUP BY k HAVING max(v) > 6 AND count(*) > 1",
    ]:
        assert analyzer.round_trip(spark, sql) == {"equal": True, "residues": []}, sql
    assert analyzer.round_trip(spark, "SELECT k FROM rows_of WHERE v IN (SELECT v FROM rows_of)")["residues"]
    assert analyzer.draft(spark, "SELECT DISTINCT a + 1 AS b FROM t").residues == ["distinct"]
    for sql, message in (("SELECT k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM r) x WHERE n = 2", "isn't filtered on 1"), ("SELECT a FROM (SELECT a FROM t) x", "make it a CTE")):
        with pytest.raises(PlanError, match=message):
            analyzer.draft(spark, sql)
    with pytest.raises(PlanError, match="leaves out"):
        analyzer.run_draft(spark, analyzer.draft(spark, "SELECT k FROM rows_of ORDER BY 1"))


def test_emission(spark, tmp_path):
    sql, path = "SELECT a FROM t WHERE b = 1", str(tmp_path / "d.yaml")
    found = analyzer.draft(spark, sql)
    assert analyzer.emit(found, sql) and not os.path.exists(path)
    analyzer.emit(found, sql, False, path)
    analyzer.emit(found, sql, False, path)
    with open(path, "a") as f:
        f.write("more: 1\n")
    with pytest.raises(PlanError, match="changed by hand"):
        analyzer.emit(found, sql, False, path)


def test_two_writers(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.overwrite(spark.range(1), "any/text ~ with 'signs'")
    log = table.log()
    table.overwrite(spark.range(2), "", log)
    with pytest.raises(Conflict):
        table.overwrite(spark.range(3), "", log)
    assert table.read().count() == 2 and log[0][2] == "any/text ~ with 'signs'"
    table.append(spark.range(1))
    assert table.vacuum() == 2 and table.read().count() == 3  # the first snapshot and the one that lost
    open(f"{tmp_path}/t/_log/3.json", "w").close()  # claimed by a writer that broke off
    with pytest.raises(Conflict):
        table.append(spark.range(1))
    table.repair()
    table.append(spark.range(1))
    assert table.read().count() == 4


def test_null_keys_and_streams(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 4)], "k int, v int")
    table.upsert(rows, ["k"], "a", "v")
    table.upsert(rows, ["k"], "b", "v")
    assert sorted((r.k, r.v) for r in table.read().collect() if r.k) == [(1, 4)] and table.read().where("k IS NULL").count() == 4
    source, out, cp = f"{tmp_path}/in", SnapshotTable(spark, f"file://{tmp_path}/out"), f"{tmp_path}/cp"
    spark.range(2).write.parquet(source)
    stream = lambda: spark.readStream.schema("id bigint").parquet(source)
    streams.stream_into(stream(), out, cp)
    spark.range(2, 3).write.mode("append").parquet(source)
    streams.stream_into(stream(), out, cp)
    assert sorted(r.id for r in out.read().collect()) == [0, 1, 2]
    streams.full_refresh(out, f"file://{cp}")
    assert not out.exists()
    streams.stream_into(stream(), out, cp)
    assert out.read().count() == 3
    query = streams.stream_into(stream(), out, f"{tmp_path}/cp2", when="interval:1 s")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert out.read().count() == 6
    assert streams.trigger("interval:5 m") == {"processingTime": "5 minutes"}
    with pytest.raises(PlanError, match="trigger"):
        streams.trigger("interval:soon")
    assert streams.checkpoint_of(spark, "s", "t", "/r/") == "/r/s/t"
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(PlanError, match="checkpoint root"):
            streams.checkpoint_of(spark, "s", "t")
    with pytest.raises(PlanError, match="can't be split"):
        tables.split(stream(), "id", f"{tmp_path}/split")


def test_jdbc(spark):
    url = "jdbc:derby:memory:marlstone;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for mode, n in (("overwrite", 3), ("append", 6), ("ignore", 6), ("overwrite", 3)):
        tables.to_jdbc(spark.range(3), url, "numbers", mode, driver=driver)
        assert spark.read.format("jdbc").options(url=url, dbtable="numbers", driver=driver).load().count() == n
    with pytest.raises(ValueError, match="unknown mode"):
        tables.to_jdbc(spark.range(1), url, "numbers", "merge")


def test_access(spark):
    model = Model("m", "t", {"d": Dimension("d", "d")}, {"n": Metric("n", "*", "count"), "big": Metric("big", "v", "sum", ("v > 1",))}, base_filter="v > 0 OR d = 'x'")
    data = {"t": spark.createDataFrame([("a", 1), ("a", 2), ("x", -1), ("y", -1)], "d string, v int")}
    asked = Query("m", ["n", "big"], ["d"], [("d", "neq", "it's")])
    deny = Access("enforce", {}, clock=lambda: NOW)
    with pytest.raises(PlanError, match="DENY"):
        Catalog([model], deny).query(asked, data, {"id": "ann"})
    assert [(e["status"], e["decision"], e["consumer"]) for e in deny.trace] == [("refused", "DENY", "ann")] and "it's" not in str(deny.trace)
    over = Override("m", "ann", NOW, NOW + timedelta(hours=1), "outage", "bob")
    allowed = Access("enforce", {}, overrides=[over], clock=lambda: NOW)
    with pytest.raises(PlanError, match="DENY"):
        Catalog([model], allowed).query(asked, data, {"id": "ann"})  # lacks the scope
    rows, more = Catalog([model], allowed).read(asked, data, {"id": "ann", "scopes": ["certification_override"]}, 1)
    assert len(rows) == 1 and more and allowed.trace[-1]["decision"] == "WARN" and allowed.trace[-1]["sources"] == ["m"]
    old = Access("supervised", {"m": NOW - timedelta(5)}, oldest=timedelta(3), clock=lambda: NOW)
    with pytest.raises(PlanError, match="REQUIRE_HUMAN"):
        Catalog([model], old).query(asked, data)
    ended = Access("off", {}, {"m": {"effective_to": NOW}}, clock=lambda: NOW)
    with pytest.raises(PlanError, match="DENY"):
        Catalog([model], ended).query(asked, data)
    with pytest.raises(PlanError, match="no reason or actor"):
        Access("warn", {}, overrides=[Override("m", "a", NOW, NOW)])
    plain = Catalog([model])
    with pytest.raises(PlanError, match="more than 50 filters"):
        plain.query(Query("m", ["n"], [], [("d", "eq", "x")] * 51), data)
    with pytest.raises(PlanError, match="longer than"):
        plain.query(Query("m", ["n"], [], [("d", "eq", "x" * 2000)]), data)
    data["t"].createOrReplaceTempView("t")
    assert sorted(spark.sql(plain.sql(asked)).collect()) == sorted(plain.view("asked_view", asked, data).collect()) == sorted(spark.table("asked_view").collect())


def test_publication(spark, tmp_path):
    target, bad = SnapshotTable(spark, f"file://{tmp_path}/p"), SnapshotTable(spark, f"file://{tmp_path}/q")
    df = spark.createDataFrame([(1, 5), (2, 50)], "k int, v int")
    run = lambda run_id: Publication(target, bad, run_id, "1")
    first = run("r1")
    assert [r.status for r in first.run(df, ["k"], {"small": F.col("v") < 10}, {"small"})] == ["PASS", "FAIL"] and first.history[-2:] == ["PROMOTING", "PROMOTED"]
    again = run("r1")
    assert again.run(df.limit(0), ["k"], {}) == [] and again.state == "PROMOTED" and target.read().count() == 2
    held = run("r2")
    held.run(df, ["k"], {"small": F.col("v") < 10})
    assert held.state == "QUARANTINED" and bad.read().count() == 1
    broken = run("r3")
    assert [r.status for r in broken.run(df, ["gone"], {"odd": F.col("nope") > 1})] == ["ERROR", "ERROR"] and broken.state == "CHECK_ERROR" and target.read().count() == 2
    runs = registry.RunStore(SnapshotTable(spark, f"file://{tmp_path}/r"))
    at = runs.record("r", "p", "1", "STARTED", NOW)
    assert registry.RunStore(runs.table).record("r", "p", "1", "PROMOTED", NOW) > at  # another process


def test_parity(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    assert parity(a, a, ["k"]).count() == 0
    b = spark.createDataFrame([(None, 1, "x"), (2, 2, None)], "k int, v bigint, more string")
    assert [(r.k, r.state, r.columns) for r in parity(a, b, ["k"]).collect()] == [(None, "differs", "more")]
    report = parity_report(a, b, ["k"])
    assert report["rows"] == [2, 2] and report["only_b"] == ["more"] and report["types"] == {"v": ("int", "bigint")} and report["states"] == {"differs": 1} and not report["equal_rows"]
    assert parity_report(a, a, ["k"])["equal_rows"]


def test_rules(spark):
    rules = [("b", "projection", lambda df: {"b": F.col("a") * 2}), ("a", "projection", lambda df: {"a": df.x + 1}), ("c", "projection", lambda df: {"c": F.col("a") * 2})]
    assert [r[0] for r in describe.ordered(rules)] == ["a", "b", "c"]
    from marlstone.plans.pipeline import run_rules

    row = run_rules(spark.createDataFrame([(1,)], "x int"), rules).first()
    assert (row.a, row.b, row.c) == (2, 4, 4)
    report = describe.explain_rules(rules)
    assert ("DUPLICATE_EXPR", "c.c") in report["warnings"] and ("SHARED_READ", "a") in report["warnings"] and report["stages"] == [("projection", ["a", "b", "c"])]
    with pytest.raises(PlanError, match="need each other: p, q"):
        describe.ordered([("p", "projection", lambda df: {"p": F.col("q")}), ("q", "projection", lambda df: {"q": F.col("p")})])

    def failing(df):
        raise KeyError("own error")

    with pytest.raises(KeyError, match="own error"):
        run_rules(spark.range(1), [("a", "projection", lambda df: {"a": F.lit(1)}), ("f", "projection", failing)])
    spec = {"tables": [{"name": "t", "filter": ["a:gt:1"]}], "join": [], "select_final": [["a", "b"]], "where": ["b:gt:1"]}
    told = describe.describe_schema(spec)
    assert told["outputs"] == ["b"] and told["steps"] == ["where", "select_final"] and told["tables"][0]["filters"] == [("a", "gt")]
    assert describe.infer_output_schema(Pipeline(spark, {"tables": [{"name": "t"}]}, {"t": spark.range(1)})).simpleString() == "struct<id:bigint>"


def test_lineage():
    assert columns_of("CASE WHEN t.a > 1 THEN upper(b) ELSE 'c' END + cast(`d e` AS INT)") == ["a", "b", "d e"]
    line = Lineage.of({"tables": [{"name": "s", "fields": ["a", "b"]}, {"name": "u"}], "join": [{"table_from": ["s", "a"], "table_to": ["u", "k"]}], "select_final": [[None, "x", ["expr:a + b"]], ["b", "y"]]}, "gold")
    assert {*line.closure(("gold", "x"), True)} == {("s", "a"), ("s", "b")} and line.joins == [(("s", "a"), ("u", "k"))]
    line.metrics(Model("m", "gold", {"d": Dimension("d", "y")}, {"t": Metric("t", "x", "sum", ("y > 1",))}))
    assert line.closure(("s", "b"))[("m", "t")] == 2
    assert line.classify({("s", "a"): "pii", ("gold", "x"): "public"})[("m", "t")] == "pii" and line.lowered == [(("gold", "x"), "pii", "public")]
    told = {(e["table"], e["column"]): e for e in line.dictionary({("s", "b"): "the b"})}
    assert told[("gold", "y")]["description"] == "the b" and told[("gold", "y")]["inherited"] and told[("gold", "x")]["sources"] == ["s.a", "s.b"]
    assert "s.a -> gold.x" in line.render() and line.render("mermaid").startswith("graph LR") and '"s.b" -> "gold.y";' in line.render("dot")
    loop = Lineage()
    for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
        loop.add(("t", a), ("t", b))
    assert len(loop.cycle()) == 4 and Lineage().cycle() is None


def test_exports():
    contract = {"id": "orders", "version": "1.2.0", "status": "active", "output": {"k": {"type": "bigint", "required": True, "unique": True}, "mail": {"type": "string", "classification": "pii"}}, "sla": {"freshness": "1d"}, "owner": "ann"}
    document = exports.to_odcs(contract)
    assert document["schema"][0]["properties"][0]["logicalType"] == "integer" and exports.from_odcs(document) == contract
    event = exports.lineage_event("PROMOTED", "r", "j", NOW, ["b", "a"], {"o": [("x", "a", "y")]})
    assert event["eventType"] == "COMPLETE" and event["outputs"][0]["facets"]["columnLineage"]["fields"]["x"]["inputFields"][0]["field"] == "y"
    sent = []
    assert exports.alert("p", "r", [Result("a", "FAIL", 1), Result("b", "PASS", 0), Result("c", "FAIL", 1, False)], sent.append) == 1 and '"check": "a"' in sent[0]


def test_search(spark):
    rows = [(1, "totalRevenue2024", "chiffre d'affaires", None), (2, "customers", "Client élevé revenue", "revenue"), (3, None, None, "the of"), (4, "elephants", "x", "y")]
    docs = spark.createDataFrame(rows, "id int, name string, label string, text string")
    assert docs.select(search.tokens(F.col("name")).alias("w")).first().w == ["total", "revenue", "2024"]
    assert docs.where("id = 2").select(search.tokens(F.col("label")).alias("w")).first().w == ["client", "eleve", "revenue"]
    got = {r.id: r.score for r in search.bm25f(docs, "id", {"name": 3.0, "label": 2.0, "text": 1.0}, "Revenue ÉLEVÉ the").collect()}
    import math

    words = {i: [[w.lower() for w in x] for x in f] for i, f in {1: (["total", "revenue", "2024"], ["chiffre", "affaires"], []), 2: (["customers"], ["client", "eleve", "revenue"], ["revenue"]), 3: ([], [], []), 4: (["elephants"], ["x"], ["y"])}.items()}
    words[1][1] = ["chiffre", "d", "affaires"]
    mean = [sum(len(w[i]) for w in words.values()) / 4 for i in range(3)]
    for i, fields in words.items():
        score = 0.0
        for term, df in (("revenue", 2), ("eleve", 1)):
            x = sum(wt * f.count(term) / (0.25 + 0.75 * len(f) / m) for wt, f, m in zip((3, 2, 1), fields, mean, strict=True))
            score += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * x / (1.2 + x)
        assert score == pytest.approx(got.get(i, 0.0))
    assert {*got} == {1, 2}


def test_candidate_states(spark):
    assert candidates.move("candidate", "validated") == "validated" and candidates.move("demoted", "candidate") == "candidate"
    with pytest.raises(PlanError, match="can't go"):
        candidates.move("rejected", "promoted")
    asked = spark.createDataFrame([("q1", "CA net by region"), ("q2", "weather")], "id string, text string")
    names = spark.createDataFrame([("m", "chiffre affaires net by region"), ("n", "orders by day")], "name string, text string")
    assert [(r.id, r.name, r.score) for r in candidates.rephrasings(asked, names, {"CA": "chiffre affaires"}).collect()] == [("q1", "m", 1.0)]
    side = lambda family, right, n: [(family, k < right) for k in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "family string, right boolean")
    got = {r.family: (r.verdict, r.reason) for r in candidates.degraded(make(side("A", 9, 10) + side("B", 2, 2)), make(side("A", 5, 10) + side("C", 9, 9))).collect()}
    assert got == {"A": ("degraded", None), "B": ("inconclusive", "few before"), "C": ("inconclusive", "few before")}
