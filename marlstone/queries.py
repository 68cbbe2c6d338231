"""Registered queries of the declarative engine over the test tables, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.catalog import PlanError
from .operators import candidates, search, usage
from .operators.tables import SnapshotTable, split
from .plans import analyzer, views
from .plans.pipeline import Pipeline
from .quality import checks, monitor, registry
from .semantic import governance
from .semantic.model import Catalog, Dimension, Metric, Model, Query, Relationship
from .sources.readers import explode_union, read_source, union, union_tables
from .streaming.streams import stream_into

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _t(d_name: str, **more) -> dict:
    return {"name": d_name, "source": d_name, **more}


def _pipeline(key: str, sql: str | None, *tables: dict, rules: dict | None = None, dev: bool = False, **spec) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = [t | {"source": {"type": "parquet", "path": f"{d}/{t['source']}.parquet"}} for t in tables]
        return Pipeline(spark, {"tables": made, **spec}, rules=rules, dev=dev).run()

    QUERIES[key] = run
    if sql:
        ORACLES[key] = sql


_pipeline(
    "pipeline_flagship",
    "SELECT c_mktsegment, year(o_orderdate)::INT AS order_year, round(sum(o_totalprice), 2) AS total_price, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_acctbal > 0 GROUP BY ALL HAVING count(*) > 1",
    _t("orders", filter=["o_orderstatus:not_equals:P"], fields=["o_orderkey", "o_custkey", "o_totalprice", ["o_orderdate", "order_year", ["expr:year(o_orderdate)"]]]),
    _t("customer", filter=["c_acctbal:greater_than:0"], fields=["c_custkey", "c_mktsegment"]),
    join=[{"table_from": ["orders", "o_custkey"], "table_to": ["customer", "c_custkey"], "type": "inner"}],
    aggregate={"group_by": ["c_mktsegment", "order_year"], "measures": [["o_totalprice", "total_raw", "sum"], ["*", "n_orders", "count"]], "having": ["n_orders:gt:1"]},
)
_flagship = QUERIES["pipeline_flagship"]
QUERIES["pipeline_flagship"] = lambda spark, d: _flagship(spark, d).select("c_mktsegment", "order_year", F.round("total_raw", 2).alias("total_price"), "n_orders")

L = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
for _op, _spec, _where in [
    ("is_null", "o_orderpriority:is_null", "o_orderpriority IS NULL"), ("is_not_null", "o_orderpriority:is_not_null", "o_orderpriority IS NOT NULL"), ("equals", "o_orderpriority:equals:1-URGENT", "o_orderpriority = '1-URGENT'"),
    ("not_equals", "o_orderpriority:not_equals:1-URGENT", "o_orderpriority <> '1-URGENT'"), ("greater_than", "o_custkey:gt:1000", "o_custkey > 1000"), ("less_than", "o_custkey:lt:5", "o_custkey < 5"),
    ("greater_than_equal", "o_custkey:gte:1000", "o_custkey >= 1000"), ("less_than_equal", "o_custkey:lte:5", "o_custkey <= 5"), ("in", "o_orderpriority:in:1-URGENT,5-LOW", "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("not_in", "o_orderpriority:not_in:1-URGENT;5-LOW", "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"), ("between", "o_custkey:between:10,12", "o_custkey BETWEEN 10 AND 12"), ("not_between", "o_custkey:not_between:3,48", "o_custkey NOT BETWEEN 3 AND 48"),
    ("contains", "o_orderpriority:contains:UR", "contains(o_orderpriority, 'UR')"), ("not_contains", "o_orderpriority:not_contains:UR", "NOT contains(o_orderpriority, 'UR')"), ("starts_with", "o_orderpriority:starts_with:2", "starts_with(o_orderpriority, '2')"),
    ("ends_with", "o_orderpriority:ends_with:M", "ends_with(o_orderpriority, 'M')"), ("like", "o_orderpriority:like:%U_", "o_orderpriority LIKE '%U_'"), ("not_like", "o_orderpriority:not_like:%A%", "o_orderpriority NOT LIKE '%A%'"),
    ("sql", "sql:o_custkey % 7 = 0", "o_custkey % 7 = 0"),
]:
    _pipeline(f"filter_{_op}", f"SELECT {', '.join(L)} FROM orders WHERE {_where}", _t("orders", filter=[_spec], fields=L))

_pipeline("filter_groups", f"SELECT {', '.join(L)} FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_custkey > 40) OR (o_orderpriority = '5-LOW' AND o_custkey < 5)", _t("orders", filter_groups=[["o_orderpriority:equals:1-URGENT", "o_custkey:gt:40"], [], [{"o_orderpriority": "5-LOW"}, {"o_custkey": {"lt": 5}}]], fields=L))
_OC = [_t("orders", fields=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]), _t("customer", fields=["c_custkey", "c_name", "c_acctbal"])]
_ON = [{"table_from": ["orders", "o_custkey"], "table_to": ["customer", "c_custkey"], "type": "left"}]
_pipeline("where_post_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000", *_OC, join=_ON, where=["c_acctbal:gt:9000"], select_final=[["o_orderkey", "o_orderkey"], ["c_name", "c_name"]])
_pipeline("where_groups", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9500 OR (o_orderstatus = 'F' AND c_acctbal < -900)", *_OC, join=_ON, where_groups=[["c_acctbal:gt:9500"], ["o_orderstatus:equals:F", "c_acctbal:lt:-900"]], select_final=[["o_orderkey", "o_orderkey"], ["c_name", "c_name"]])

for _op, _col, _ops, _sql in [
    ("cast", "o_totalprice", ["cast:decimal(20,1)", "cast:string"], "CAST(CAST(o_totalprice AS DECIMAL(20, 1)) AS VARCHAR)"), ("upper", "o_orderpriority", ["upper"], "upper(o_orderpriority)"), ("lower", "o_orderpriority", ["lower"], "lower(o_orderpriority)"),
    ("trim", "o_orderpriority", ["trim"], "trim(o_orderpriority)"), ("length", "o_orderpriority", ["length"], "length(o_orderpriority)"), ("split", "o_orderpriority", ["split:-,0"], "split_part(o_orderpriority, '-', 1)"),
    ("substring", "o_orderpriority", ["substring:3,4"], "substring(o_orderpriority, 3, 4)"), ("round", "o_totalprice", ["round:0"], "round(o_totalprice, 0)"), ("abs", "o_totalprice", ["abs"], "abs(o_totalprice)"),
    ("ceil", "o_totalprice", ["ceil"], "CAST(ceil(o_totalprice) AS BIGINT)"), ("to_date", "o_orderdate", ["cast:string", "substring:1,10", "to_date:yyyy-MM-dd"], "CAST(o_orderdate AS DATE)"), ("nvl", "o_orderpriority", ["nvl:none"], "coalesce(o_orderpriority, 'none')"),
    ("coalesce", "o_totalprice", ["coalesce:0"], "coalesce(o_totalprice, 0)"), ("lit", "o_orderkey", ["lit:erp"], "'erp'"), ("expr", "o_orderkey", ["expr:o_orderkey * 2"], "o_orderkey * 2"), ("col", "o_orderkey", ["col:o_custkey"], "o_custkey"),
    ("case_compact", "o_totalprice", ["when:gt:100000", "then:lit:big", "else:lit:small"], "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END"),
    ("case_chain", "o_totalprice", [{"when": "gt:200000", "then": "lit:a"}, {"when": "gt:100000", "then": "lit:b"}, {"else": "lit:c"}], "CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END"),
]:
    _pipeline(f"op_{_op}", f"SELECT o_orderkey, {_sql} AS v FROM orders", _t("orders"), select_final=[["o_orderkey", "o_orderkey"], [_col, "v", _ops]])

_small = [_t("orders", fields=["o_orderkey", "o_custkey"]), _t("customer", filter=["c_nationkey:lt:12"], fields=["c_custkey", "c_name"])]
for _how, _sql in [
    ("inner", "SELECT o_orderkey, o_custkey, c_name FROM o JOIN c ON o_custkey = c_custkey"), ("left", "SELECT o_orderkey, o_custkey, c_name FROM o LEFT JOIN c ON o_custkey = c_custkey"),
    ("right", "SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM o RIGHT JOIN c ON o_custkey = c_custkey"), ("full", "SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM o FULL JOIN c ON o_custkey = c_custkey"),
    ("semi", "SELECT o_orderkey, o_custkey FROM o WHERE o_custkey IN (SELECT c_custkey FROM c)"), ("anti", "SELECT o_orderkey, o_custkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)"),
]:
    _pipeline(f"join_{_how}", f"WITH o AS (SELECT o_orderkey, o_custkey FROM orders), c AS (SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 12) {_sql}", *_small, join=[{"table_from": ["orders", "o_custkey"], "table_to": ["customer", "c_custkey"], "type": _how}])
_pipeline("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", _t("nation", fields=["n_name"]), _t("region", fields=["r_name"]), join=[{"table_from": ["nation", None], "table_to": ["region", None], "type": "cross"}])
_pipeline("join_same_keys", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)", _t("nation", fields=[["n_regionkey", "k"], "n_name"]), _t("region", fields=[["r_regionkey", "k"], "r_name"]), join=[{"table_from": ["nation", "k"], "table_to": ["region", "k"], "type": "inner"}])
_pipeline("join_composite", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 48", _t("lineitem", alias="a", filter=["l_quantity:gt:48"], fields=["l_orderkey", "l_linenumber", "l_quantity"]), _t("lineitem", alias="b", fields=["l_orderkey", "l_linenumber", "l_tax"]), join=[{"table_from": ["a", ["l_orderkey", "l_linenumber"]], "table_to": ["b", ["l_orderkey", "l_linenumber"]], "type": "inner"}])

for _f, _sql, _cast in [
    ("sum", "sum(l_quantity)", "double"), ("avg", "avg(l_quantity)", "double"), ("min", "min(l_quantity)", "double"), ("max", "max(l_quantity)", "double"), ("count", "count(l_quantity)", "bigint"), ("count_distinct", "count(DISTINCT l_suppkey)", "bigint"),
    ("sum_distinct", "sum(DISTINCT l_quantity)", "double"), ("stddev", "stddev(l_quantity)", "double"), ("variance", "variance(l_quantity)", "double"), ("first", "min(l_returnflag)", "string"), ("last", "max(l_returnflag)", "string"), ("approx_count_distinct", None, "bigint"),
]:
    _src = {"count_distinct": "l_suppkey", "approx_count_distinct": "l_suppkey", "first": "l_returnflag", "last": "l_returnflag"}.get(_f, "l_quantity")
    _pipeline(f"agg_{_f}", _sql and f"SELECT l_returnflag, l_linestatus, " + (f"round(CAST({_sql} AS DOUBLE), 4)" if _cast == "double" else _sql) + " AS v FROM lineitem GROUP BY ALL", _t("lineitem"), aggregate={"group_by": ["l_returnflag", "l_linestatus"], "measures": [[_src, "v", _f]]})
    if _cast == "double":
        QUERIES[f"agg_{_f}"] = lambda spark, d, q=QUERIES[f"agg_{_f}"]: q(spark, d).withColumn("v", F.round(F.col("v").cast("double"), 4))
_pipeline("agg_having", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 100", _t("lineitem"), aggregate={"group_by": ["l_returnflag"], "measures": [["*", "n", "count"]], "having": ["n:gt:100"]})
_pipeline("agg_derived_key", "SELECT substring(CAST(o_orderdate AS VARCHAR), 1, 7) AS order_month, count(*) AS n FROM orders GROUP BY 1", _t("orders"), add_columns=[["o_orderdate", "order_month", ["cast:string", "substring:1,7"]]], aggregate={"group_by": ["order_month"], "measures": [["*", "n", "count"]]})

_pipeline("qualify_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1", _t("orders", preprocess={"qualify": {"partition_by": ["o_custkey"], "order_by": [{"field": "o_orderdate", "order": "desc"}, {"field": "o_orderkey"}]}}, fields=["o_custkey", "o_orderkey", "o_totalprice"]))
_pipeline("drop_nulls", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL", _t("orders", quality_checks={"drop_nulls_in": ["o_orderpriority", "o_custkey"]}, fields=["o_orderkey"]))
_pipeline("drop_duplicates", "SELECT DISTINCT o_custkey FROM orders", _t("orders", quality_checks={"drop_duplicates_on": ["o_custkey"]}, fields=["o_custkey"]))
_pipeline("dev_limit", "SELECT 7::BIGINT AS one, 5::BIGINT AS n", _t("orders", dev_limit=5), dev=True, add_columns=[["o_orderkey", "one", ["expr:7L"]]], aggregate={"group_by": ["one"], "measures": [["*", "n", "count"]]})
_pipeline("rule_projection_fused", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice, upper(o_orderstatus) AS status, round(o_totalprice * 4, 2) AS four FROM orders", _t("orders", fields=["o_orderkey", "o_totalprice", "o_orderstatus"]), business_rules=["twice", "status", "four", "final"], rules={"twice": ("projection", lambda df: {"twice": F.round(df.o_totalprice * 2, 2)}), "status": ("projection", lambda df: {"status": F.upper(df.o_orderstatus)}), "four": ("projection", lambda df: {"four": F.round(F.col("o_totalprice") * 4, 2)}), "final": ("transform", lambda df: df.select("o_orderkey", "twice", "status", "four"))})
_pipeline("rule_aggregation_fused", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1", _t("orders"), business_rules=["n", "top"], rules={"n": ("aggregation", lambda df: {"n": F.count(F.lit(1))}, ["o_orderstatus"]), "top": ("aggregation", lambda df: {"top": F.max("o_totalprice")}, ["o_orderstatus"])})
_pipeline("rule_transform", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0", _t("orders", fields=["o_orderkey"]), business_rules=["fifth"], rules={"fifth": ("transform", lambda df: df.filter("o_orderkey % 5 = 0"))})


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_by_name(spark, d):
    return union([_read(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name"), _read(spark, d, "region").selectExpr("r_regionkey AS k", "r_name AS name", "'region' AS note")])


@query("SELECT DISTINCT o_orderstatus FROM orders")
def union_dedup(spark, d):
    o = _read(spark, d, "orders").select("o_orderstatus")
    return union([o, o]).dropDuplicates()


@query("SELECT id, unnest(string_split(n_name || ' ' || n_name, ' ')) AS word, 'n' AS origin FROM (SELECT n_nationkey AS id, n_name FROM nation)")
def explode_union_words(spark, d):
    df = _read(spark, d, "nation").selectExpr("n_nationkey AS id", "split(concat(n_name, ' ', n_name), ' ') AS words")
    return explode_union(df, ["id"], [{"array": "words", "columns": {"word": "item"}, "literals": {"origin": "n"}}])


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def partial_inline(spark, d):
    child = {"tables": [{"name": "customer", "source": {"type": "parquet", "path": f"{d}/customer.parquet"}, "filter": ["c_acctbal:gt:0"]}]}
    return Pipeline(spark, {"partials": [{"alias": "rich", "spec": child}], "aggregate": {"group_by": ["c_nationkey"], "measures": [["*", "n", "count"]]}}).run()


_own: list[str] = []


def _folder(spark, tag):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise PlanError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="marlstone-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = "file://" + _own[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def split_fanout(spark, d):
    path = _folder(spark, "split")
    split(_read(spark, d, "lineitem"), "l_returnflag", path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def snapshot_upsert(spark, d):
    table, n = SnapshotTable(spark, _folder(spark, "snap")), _read(spark, d, "nation").select("n_nationkey", "n_name")
    table.overwrite(n.withColumn("n_name", F.lower("n_name")))
    table.upsert(n, ["n_nationkey"], "1")
    table.upsert(n.withColumn("n_name", F.lit("again")), ["n_nationkey"], "1")
    return table.read()


def _stream(spark, d):
    base = _folder(spark, "stream")
    _read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.parquet(f"{base}/in")
    return base, spark.readStream.schema("n_nationkey bigint, n_name string, n_regionkey bigint").parquet(f"{base}/in")


@query("SELECT n_nationkey, n_name FROM nation")
def stream_append(spark, d):
    base, s = _stream(spark, d)
    table = SnapshotTable(spark, f"{base}/out")
    stream_into(s.select(F.col("n_nationkey").cast("bigint"), "n_name"), table, f"{base}/cp")
    return table.read()


@query("SELECT n_regionkey, max(n_nationkey) AS n_nationkey FROM nation GROUP BY 1")
def stream_upsert(spark, d):
    base, s = _stream(spark, d)
    table = SnapshotTable(spark, f"{base}/out")
    stream_into(s.select("n_regionkey", "n_nationkey"), table, f"{base}/cp", ["n_regionkey"], "n_nationkey")
    return table.read()


def _catalog() -> Catalog:
    return Catalog([
        Model("orders", "orders", {"status": Dimension("status", "o_orderstatus"), "order_date": Dimension("order_date", "o_orderdate", "date")}, {"revenue": Metric("revenue", "o_totalprice", "sum"), "n_orders": Metric("n_orders", "*", "count"), "open_orders": Metric("open_orders", "o_orderkey", "count", ("o_orderstatus = 'O'",)), "top": Metric("top", "o_totalprice", "max", (), "semi_additive", ("status",))}, [Relationship("customer", (("o_custkey", "c_custkey"),))], calendar={"y1995": ("1995-01-01", "1995-12-31")}),
        Model("customer", "customer", {"segment": Dimension("segment", "c_mktsegment")}, {"n_customers": Metric("n_customers", "*", "count")}, [Relationship("nation", (("c_nationkey", "n_nationkey"),))]),
        Model("nation", "nation", {"nation": Dimension("nation", "n_name")}, {}, [Relationship("region", (("n_regionkey", "r_regionkey"),))]),
        Model("region", "region", {"region": Dimension("region", "r_name")}),
        Model("private", "customer", {"own_segment": Dimension("own_segment", "c_mktsegment")}, {"n_own": Metric("n_own", "*", "count")}, row_policy=("nation", "c_nationkey")),
    ])


def _ask(spark, d, q, consumer=None):
    return _catalog().query(q, {t: _read(spark, d, t) for t in ("orders", "customer", "nation", "region")}, consumer)


@query("SELECT o_orderstatus AS status, count(*) AS n_orders FROM orders GROUP BY 1")
def sem_single(spark, d):
    return _ask(spark, d, Query("orders", ["n_orders"], ["status"]))


@query("SELECT r_name AS region, count(*) AS n_orders, round(sum(o_totalprice), 1) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def sem_join(spark, d):
    return _ask(spark, d, Query("orders", ["n_orders", "revenue"], ["region"], [("segment", "eq", "BUILDING")])).withColumn("revenue", F.round("revenue", 1))


@query("SELECT o_orderstatus AS status, count(*) AS n_orders FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' GROUP BY 1")
def sem_period(spark, d):
    return _ask(spark, d, Query("orders", ["n_orders"], ["status"], period="y1995"))


@query("SELECT c_mktsegment AS segment, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def sem_filtered_metric(spark, d):
    return _ask(spark, d, Query("orders", ["open_orders"], ["segment"]))


@query("SELECT c_mktsegment AS own_segment, count(*) AS n_own FROM customer WHERE c_nationkey = 3 GROUP BY 1")
def sem_row_policy(spark, d):
    return _ask(spark, d, Query("private", ["n_own"], ["own_segment"]), {"nation": 3})


@query("SELECT o_orderstatus AS status, max(o_totalprice) AS top FROM orders GROUP BY 1")
def sem_semi_additive(spark, d):
    return _ask(spark, d, Query("orders", ["top"], ["status"]))


@query("SELECT count_if(l_returnflag IS NULL)::BIGINT AS null_l_returnflag, count_if(NOT l_quantity <= 45)::BIGINT AS broken_small, count(*) AS n_rows FROM lineitem")
def dq_fused(spark, d):
    return checks.fused(_read(spark, d, "lineitem"), ["l_returnflag"], {"small": F.col("l_quantity") <= 45})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_unique(spark, d):
    return checks.duplicates(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice < 200000 THEN 'cheap' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'done' END) AS _violations, 'r' AS _run_id, '1' AS _contract_version FROM orders")
def dq_quarantine_tag(spark, d):
    return checks.tagged(_read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"cheap": F.col("o_totalprice") < 200000, "done": F.col("o_orderstatus") != "P"}, "r", "1").drop("o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'only_a' ELSE 'differs' END AS state, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'o_custkey' END AS columns FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def parity_diff(spark, d):
    a = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = a.where("o_orderkey % 7 != 0").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END"))
    return checks.parity(a, b, ["o_orderkey"])


@query("SELECT d AS days, o_orderpriority, count(*) AS n_events, CASE WHEN count(o_totalprice) >= 5 THEN quantile_disc(o_totalprice, 0.95) END AS p95 FROM orders, (SELECT unnest([90, 365]) AS d) WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate > TIMESTAMP '1998-01-01' - to_days(d) GROUP BY ALL")
def usage_p95(spark, d):
    return usage.patterns(_read(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", "1998-01-01 00:00:00", (90, 365)).withColumn("days", F.col("days").cast("int"))


WORDS = ["the", "thion", "license"]


def _ranked(spark, d):
    return search.bm25(_read(spark, d, "documents"), "doc_id", "text", WORDS)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT doc_id, len(w) AS len, unnest(list_filter(w, lambda x: x IN ('the', 'thion', 'license'))) AS term FROM w),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY 1""")
def bm25_search(spark, d):
    return _ranked(spark, d).withColumn("score", F.round("score", 6))


def _near(spark, d):
    e = _read(spark, d, "embeddings")
    key, vec = [c for c, t in e.dtypes if t in ("bigint", "int")][0], [c for c, t in e.dtypes if t.startswith("array")][0]
    q = e.where(F.col(key) == 0).select(F.col(vec).alias("q"))
    return search.top(e.crossJoin(F.broadcast(q.limit(1))).select(F.col(key).alias("doc_id"), search.cosine(F.col(vec), F.col("q")).alias("score")), "doc_id", "score", 20)


_COSINE = """c AS (SELECT e.vec_id AS doc_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    near AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM c QUALIFY rank <= 20)"""


@query(f"WITH {_COSINE} SELECT doc_id, round(score, 6) AS score, rank FROM near")
def cosine_topk(spark, d):
    return _near(spark, d).withColumn("score", F.round("score", 6))


@query("WITH scored AS (" + ORACLES["bm25_search"].replace("round(sum(", "sum(").replace("), 6) AS score", ") AS score") + f"""),
    best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= 20), {_COSINE},
    fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM best UNION ALL SELECT doc_id, rank FROM near) GROUP BY 1)
    SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM fused QUALIFY rank <= 10""")
def rrf_hybrid(spark, d):
    return search.top(search.fuse([search.top(_ranked(spark, d), "doc_id", "score", 20), _near(spark, d)], "doc_id"), "doc_id", "score", 10).withColumn("score", F.round("score", 9))


@query("WITH e AS (SELECT o_custkey AS a, -o_orderkey AS b FROM orders WHERE o_totalprice >= 50000), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d1 AS (SELECT DISTINCT b AS n FROM b WHERE a = 1), d2 AS (SELECT DISTINCT b.b AS n FROM b JOIN d1 ON b.a = d1.n) SELECT node, min(distance)::INT AS distance FROM (SELECT 1 AS node, 0 AS distance UNION ALL SELECT n, 1 FROM d1 UNION ALL SELECT n, 2 FROM d2) GROUP BY 1")
def graph_neighbors(spark, d):
    e = _read(spark, d, "orders").selectExpr("o_custkey AS src", "-o_orderkey AS dst", "o_totalprice / 100000 AS weight")
    return search.neighbours(e, spark.range(1, 2).select(F.col("id").alias("node")))


def _sources(d, *names):
    return {n: {"type": "parquet", "path": f"{d}/{n}.parquet"} for n in names or ("orders", "customer", "nation", "region", "lineitem")}


def _drafted(spark, d, sql):
    return analyzer.run_draft(spark, analyzer.draft(spark, sql), _sources(d))


_AGGREGATED = "SELECT c.c_mktsegment AS segment, count(*) AS n, max(o.o_totalprice) AS top FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P' AND c.c_acctbal > 0 GROUP BY c.c_mktsegment HAVING count(*) > 2"
_OUTER = "SELECT o.o_orderkey, upper(c.c_name) AS name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000 AND c.c_acctbal > 5000"


@query(_AGGREGATED)
def sql_draft_aggregate(spark, d):
    return _drafted(spark, d, _AGGREGATED)


@query(_OUTER)
def sql_draft_outer_join(spark, d):
    return _drafted(spark, d, _OUTER)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def mv_select(spark, d):
    table, spec = SnapshotTable(spark, _folder(spark, "view")), {"aggregate": {"group_by": ["o_orderstatus"], "measures": [["*", "n", "count"]]}}
    views.materialize(Pipeline(spark, {**spec, "tables": [{"name": "orders"}]}, {"orders": _read(spark, d, "orders").limit(0)}).run(), {"old": True}, table)
    views.materialize(Pipeline(spark, {**spec, "tables": [{"name": "orders"}]}, {"orders": _read(spark, d, "orders")}).run(), spec, table)
    return table.read()


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN c_custkey END) AS n_rich FROM customer WHERE c_nationkey < 20 GROUP BY 1")
def metric_view(spark, d):
    model = Model("v", "{t}", {"segment": Dimension("segment", "c_mktsegment")}, {"n": Metric("n", "*", "count"), "n_rich": Metric("n_rich", "c_custkey", "count", ("c_acctbal > 0",))}, base_filter="c_nationkey < 20")
    return spark.sql(views.metric_view(model)[1], t=_read(spark, d, "customer"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def snapshot_append(spark, d):
    table = SnapshotTable(spark, _folder(spark, "append"))
    table.append(_read(spark, d, "nation").select("n_nationkey", "n_name"), "1")
    for _ in range(2):
        table.append(_read(spark, d, "region").selectExpr("r_regionkey AS n_nationkey", "r_name AS n_name"), "2")
    return table.read()


@query("""SELECT * FROM (VALUES ('null', 'PASS'), ('small', 'FAIL'), ('rows', 'PASS'), ('more', 'FAIL'), ('fresh', 'FAIL'), ('loaded', 'SKIPPED'), ('kind', 'PASS'), ('gone', 'ERROR'), ('keys', 'FAIL'), ('custom', 'PASS')) t(name, status)""")
def dq_monitor(spark, d):
    c = monitor.Check
    found = monitor.run(_read(spark, d, "lineitem"), [
        c("null", "null", ("l_returnflag",)), c("invariant", "small", ("l_quantity", "lte", 45)), c("volume", "rows", (1, None)), c("variation", "more", (0.1,)),
        c("freshness", "fresh", ("l_shipdate", timedelta(days=1))), c("load_freshness", "loaded", (timedelta(days=1),)), c("type", "kind", ("l_orderkey", "long")),
        c("null", "gone", ("no_such",)), c("unique", "keys", ("l_orderkey", "l_linenumber")), c("custom", "custom", ("SELECT count(*) FROM {table} WHERE l_quantity < 0", 0)),
    ], datetime(2030, 1, 1), previous_rows=1)
    return spark.createDataFrame([(r.name, r.status) for r in found], "name string, status string")


@query("SELECT 'nation' AS product, '2' AS version, 'r2' AS run_id")
def certification_latest(spark, d):
    store, at = registry.RunStore(SnapshotTable(spark, _folder(spark, "runs"))), datetime(2026, 1, 1)
    for run, version, state, results in [("r1", "1", "PROMOTED", []), ("r2", "2", "PROMOTED", []), ("r3", "3", "PROMOTED", [checks.Result("x", "FAIL", 1)]), ("r4", "4", "QUARANTINED", [])]:
        at = store.record(run, "nation", version, state, at + timedelta(hours=1), results)
    return store.certified().drop("at")


@query("SELECT 'nation:r1:x' AS incident_id, 'ASSIGNED' AS state, 'ann' AS who")
def incident_state(spark, d):
    kept, at = registry.Incidents(SnapshotTable(spark, _folder(spark, "incidents"))), datetime(2026, 1, 1)
    (one,) = kept.open("nation", "r1", [checks.Result("x", "FAIL", 1), checks.Result("y", "PASS", 0)], at)
    kept.move(one, "ACK", "ann", at + timedelta(hours=1))
    kept.move(one, "ASSIGNED", "ann", at + timedelta(hours=2))
    return kept.current().select("incident_id", "state", "who")


@query("SELECT 'customer' AS name, 'c_nationkey' AS \"column\" UNION ALL SELECT 'nation', 'n_nationkey'")
def registry_search(spark, d):
    kept = registry.Registry(SnapshotTable(spark, _folder(spark, "registry")))
    kept.upsert([{"name": t, "columns": _read(spark, d, t).columns} for t in ("nation", "customer", "region")])
    kept.upsert([{"name": t, "columns": _read(spark, d, t).columns} for t in ("nation", "region")])
    return kept.search("NATIONKEY")


@query("SELECT c_mktsegment, round(sum(c_acctbal), 1) AS total_c_acctbal FROM customer GROUP BY 1")
def model_draft(spark, d):
    df = _read(spark, d, "customer")
    model = governance.draft_model("customer", "customer", df)
    return Catalog([model]).query(Query("customer", ["total_c_acctbal"], ["c_mktsegment"]), {"customer": df}, None).withColumn("total_c_acctbal", F.round("total_c_acctbal", 1))


@query("SELECT 'many_to_one' AS cardinality")
def draft_cardinality(spark, d):
    return spark.createDataFrame([(governance.cardinality(_read(spark, d, "nation"), _read(spark, d, "region"), [("n_regionkey", "r_regionkey")]),)], "cardinality string")


@query("SELECT 'join' AS kind, o_orderpriority AS subject, count(*) AS n_events, 'prejoin' AS action FROM orders GROUP BY 2 HAVING count(*) >= 5 AND quantile_disc(o_totalprice, 0.95) >= 1500")
def usage_recommend(spark, d):
    found = _read(spark, d, "orders").groupBy(F.lit("join").alias("kind"), F.col("o_orderpriority").alias("subject")).agg(F.count(F.lit(1)).alias("n_events"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice)").alias("p95"))
    return usage.recommend(found)


@query("SELECT c_nationkey AS name, count(*) AS n_seen, sum(q)::BIGINT AS n_queries FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS q FROM customer) GROUP BY 1 HAVING count(*) >= 3 AND sum(q) <= 1")
def usage_unused(spark, d):
    seen = _read(spark, d, "customer").selectExpr("c_nationkey AS name", "CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS queries")
    return usage.unused(seen.select("name").distinct(), seen)


@query("""WITH x AS (SELECT user_id, value, event_type = 'purchase' AS f, ts >= TIMESTAMP '2024-01-15' AS a FROM events),
    g AS (SELECT user_id, count(*) FILTER (NOT a) AS n_before, count(*) FILTER (a) AS n_after, count(value) FILTER (NOT a AND NOT f) AS v_before, count(value) FILTER (a AND NOT f) AS v_after,
        quantile_disc(value, 0.95) FILTER (NOT a AND NOT f) AS p95_before, quantile_disc(value, 0.95) FILTER (a AND NOT f) AS p95_after, avg(f::INT) FILTER (NOT a) AS fb, avg(f::INT) FILTER (a) AS fa FROM x GROUP BY 1),
    v AS (SELECT *, n_before >= 5 AND n_after >= 5 AND v_before >= 5 AND v_after >= 5 AND p95_before <> 0 AS ok, p95_after >= 1.1 * p95_before OR fa - fb >= 0.1 AS worse, p95_after <= 0.9 * p95_before OR fb - fa >= 0.1 AS better FROM g)
    SELECT user_id, n_before, n_after, p95_before, p95_after, CASE WHEN NOT ok THEN 'inconclusive' WHEN worse AND NOT better THEN 'regressed' WHEN better AND NOT worse THEN 'improved' ELSE 'inconclusive' END AS verdict FROM v""")
def usage_outcome(spark, d):
    return usage.outcome(_read(spark, d, "events").withColumn("failed", F.expr("event_type = 'purchase'")), ["user_id"], "ts", "value", "failed", "2024-01-15 00:00:00")


@query("SELECT user_id, count(*) AS n_requests, count(DISTINCT event_type) AS n_requesters, count(DISTINCT ts::DATE) AS n_days, count(*) >= 5 AND count(DISTINCT event_type) >= 2 AND count(DISTINCT ts::DATE) >= 2 AS frequent FROM events GROUP BY 1")
def candidate_frequency(spark, d):
    return candidates.frequency(_read(spark, d, "events"), "user_id", "event_type", "ts")


@query("WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS c FROM orders GROUP BY ALL) SELECT o_custkey, sum(c)::BIGINT AS n_runs, max(c) / sum(c) AS mode_share, sum(c) >= 3 AND max(c) = sum(c) AS stable FROM c GROUP BY 1")
def candidate_stability(spark, d):
    return candidates.stability(_read(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH i AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12')
    SELECT 'fallback_rate' AS signal, count(*) AS n, avg((value > 50)::INT) AS value FROM i UNION ALL SELECT 'orphan_certified_metrics', 1 + count(*) FILTER (event_type NOT IN (SELECT event_type FROM i)), 1 + count(*) FILTER (event_type NOT IN (SELECT event_type FROM i)) FROM (SELECT DISTINCT event_type FROM events)""")
def candidate_drift(spark, d):
    e = _read(spark, d, "events").selectExpr("event_type AS metric", "ts", "value > 50 AS fell_back")
    names = e.select("metric").distinct().withColumn("certified", F.lit(True)).unionByName(spark.createDataFrame([("idle", True), ("open", False)], "metric string, certified boolean"))
    return candidates.drift(e, names, "ts", "2024-01-10", "2024-01-12")


_NUMBERED = "SELECT x.o_custkey, x.o_orderkey, x.o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') x WHERE x.rn = 1 AND x.o_totalprice > 1000"
_CTE = "WITH rich AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'o.x') SELECT o.o_orderkey, r.c_name FROM orders o JOIN rich r ON o.o_custkey = r.c_custkey WHERE o.o_totalprice > 100000"
_UNION = "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_name <> 'ASIA'"
_DISTINCT = "SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 50000"
_SHARE = "SELECT c_custkey, round(c_acctbal / (SELECT sum(c_acctbal) FROM customer), 12) AS share, (SELECT max(c_acctbal) FROM customer) AS top, (SELECT sum(c_acctbal) FROM customer) > 0 AS positive FROM customer"


@query(_NUMBERED)
def sql_draft_row_number(spark, d):
    return _drafted(spark, d, _NUMBERED)


@query(_CTE)
def sql_draft_cte(spark, d):
    return _drafted(spark, d, _CTE)


@query(_UNION)
def sql_draft_union(spark, d):
    return analyzer.run_draft(spark, analyzer.branches(spark, _UNION), _sources(d))


@query(_DISTINCT)
def sql_draft_distinct(spark, d):
    return _drafted(spark, d, _DISTINCT)


@query(_SHARE)
def sql_draft_totals(spark, d):
    return _drafted(spark, d, _SHARE)


#: Customers with nulls, blanks, tabs and negative numbers in every third, fifth and seventh row.
_GAPS = "SELECT c_custkey, {null3} AS name, {null5} AS balance, {pad} AS padded FROM customer"
_GAPS_SPARK = _GAPS.format(null3="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END", null5="CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal - 3000 END", pad="CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('  ', c_mktsegment, ' ') END")


def _gaps(spec_sql: str, table: dict | None = None, **spec):
    def run(spark, d):
        df = _read(spark, d, "customer")
        df.createOrReplaceTempView("customer_rows")
        rows = spark.sql(_GAPS_SPARK.replace("FROM customer", "FROM customer_rows"))
        path = _folder(spark, "gaps")
        rows.write.parquet(path)
        return Pipeline(spark, {"tables": [{"name": "g", "source": {"type": "parquet", "path": path}, **(table or {})}], **spec}).run()

    return run, f"WITH g AS ({_GAPS_SPARK}) {spec_sql}"


for _key, _sql_text, _table, _spec in [
    ("gaps_is_null", "SELECT * FROM g WHERE name IS NULL", {"filter": ["name:is_null"]}, {}),
    ("gaps_is_not_null", "SELECT * FROM g WHERE name IS NOT NULL", {"filter": [{"name": "is_not_null"}]}, {}),
    ("gaps_not_like", "SELECT * FROM g WHERE name NOT LIKE '%1%'", {"filter": ["name:not_like:%1%"]}, {}),
    ("gaps_not_in", "SELECT * FROM g WHERE name NOT IN ('Customer#000000001', 'x')", {"filter": ["name:not_in:Customer#000000001,x"]}, {}),
    ("gaps_empty_text", "SELECT * FROM g WHERE padded = ''", {"filter": ["padded:equals:"]}, {}),
    ("gaps_decimal_literal", "SELECT * FROM g WHERE c_custkey < 3.5 OR c_custkey BETWEEN 10.5 AND 12.5", {"filter_groups": [["c_custkey:lt:3.5"], ["c_custkey:between:10.5,12.5"]]}, {}),
    ("gaps_drop_nulls", "SELECT * FROM g WHERE name IS NOT NULL AND balance IS NOT NULL", {"quality_checks": {"drop_nulls_in": ["name", "balance"]}}, {}),
    ("gaps_ops", "SELECT c_custkey, coalesce(name, 'none') AS name, coalesce(CAST(CAST(balance AS BIGINT) AS VARCHAR), '5') AS text, coalesce(balance, 0) AS balance, abs(balance) AS size, trim(padded) AS trimmed FROM g", {}, {"select_final": [["c_custkey", "c_custkey"], ["name", "name", ["nvl:none"]], ["balance", "text", ["round:0", "cast:bigint", "cast:string", "nvl:5"]], ["balance", "balance", ["coalesce:0"]], ["balance", "size", ["abs"]], ["padded", "trimmed", ["trim"]]]}),
]:
    if _key == "gaps_ops":
        _sql_text = _sql_text.replace("CAST(CAST(balance AS BIGINT) AS VARCHAR)", "CAST(CAST(round(balance, 0) AS BIGINT) AS VARCHAR)")
    QUERIES[_key], ORACLES[_key] = _gaps(_sql_text, _table, **_spec)


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name, o AS origin FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS o) UNION ALL SELECT NULL, n_name, 'text' FROM nation")
def file_sources(spark, d):
    n, base = _read(spark, d, "nation").selectExpr("cast(n_nationkey AS string) AS k", "n_name AS name"), _folder(spark, "files")
    parts = []
    for kind, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {})):
        n.write.format(kind).options(**options).save(f"{base}/{kind}")
        parts.append(read_source(spark, {"type": kind, "path": f"{base}/{kind}", "options": options}).selectExpr("cast(k AS string) AS k", "name", f"'{kind}' AS origin"))
    n.select("name").write.text(f"{base}/text")
    return union([*parts, read_source(spark, {"type": "text", "path": f"{base}/text"}).selectExpr("value AS name", "'text' AS origin")])


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, count(*) FROM nation GROUP BY 1")
def loader_and_union(spark, d):
    df = _read(spark, d, "nation")
    for k in (1, 2):
        df.createOrReplaceTempView(f"nation_{k}")

    def load(spark, names):
        found, missing = union_tables(spark, names)
        return found.groupBy("n_regionkey").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n"))

    spec = {"tables": [{"name": "nations", "source_type": "loader", "function_name": "both", "arguments": {"names": ["nation_1", "nation_2", "no_such_table"]}}]}
    once = Pipeline(spark, spec, loaders={"both": load}).run()
    return once.unionByName(once)


@query("SELECT n_name, r_name, c_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE r_regionkey < 3")
def join_chained(spark, d):
    """The second join starts from the base's key, which the first one keeps; the right keys are gone at the end."""
    src = lambda n: {"type": "parquet", "path": f"{d}/{n}.parquet"}
    tables = [{"name": "nation", "source": src("nation"), "fields": ["n_nationkey", "n_regionkey", "n_name"]}, {"name": "region", "source": src("region"), "filter": ["r_regionkey:lt:3"]}, {"name": "customer", "source": src("customer"), "fields": ["c_nationkey", "c_name"]}]
    join = [{"table_from": ["region", "r_regionkey"], "table_to": ["nation", "n_regionkey"], "type": "left-outer"}, {"table_from": ["nation", "n_nationkey"], "table_to": ["customer", "c_nationkey"], "type": "inner"}]
    return Pipeline(spark, {"tables": tables, "join": join}).run().select("n_name", "r_name", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'only_a' ELSE 'differs' END AS state, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'extra' END AS columns FROM (SELECT o_orderkey FROM orders UNION ALL SELECT NULL) WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def parity_null_keys(spark, d):
    a = _read(spark, d, "orders").select("o_orderkey", "o_custkey").unionByName(spark.createDataFrame([(None, 1)], "o_orderkey bigint, o_custkey bigint"))
    b = a.where("o_orderkey IS NULL OR o_orderkey % 7 != 0").withColumn("extra", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 1 END"))
    return checks.parity(a, b, ["o_orderkey"])


@query("SELECT l_returnflag, l_linestatus, true AS near FROM lineitem GROUP BY ALL")
def approx_within_bounds(spark, d):
    """The estimate against the exact count, within three of its standard deviations of 5 %."""
    made = QUERIES["agg_approx_count_distinct"](spark, d)
    exact = _read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_suppkey").alias("n"))
    return made.join(exact, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", (F.abs(F.col("v") - F.col("n")) <= 0.15 * F.col("n")).alias("near"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT n_regionkey, n_nationkey + 100, n_name FROM nation")
def stream_two_sources(spark, d):
    """Two streams into one table: batch 0 of the second is no repeat of the first one's."""
    base, s = _stream(spark, d)
    table = SnapshotTable(spark, f"{base}/out")
    rows = s.select(F.col("n_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint"), "n_name")
    stream_into(rows, table, f"{base}/cp1")
    stream_into(rows.withColumn("n_nationkey", F.col("n_nationkey") + 100), table, f"{base}/cp2")
    stream_into(rows, table, f"{base}/cp1")
    return table.read()
