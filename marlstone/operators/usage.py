"""Usage patterns of a log of events: windows, counts and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patterns(events: DataFrame, keys: list[str], at: str, value: str, now: str, days: tuple[int, ...] = (7, 30), least: int = 1) -> DataFrame:
    """For each window of days before `now` and key: count and nearest-rank p95 of value (null under 5 values)."""
    spans = F.explode(F.array(*[F.lit(d) for d in days]))
    rows = events.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"), spans.alias("days"))
    rows = rows.filter(F.expr(f"_at <= timestamp'{now}' AND _at > timestamp'{now}' - make_dt_interval(days)"))
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _v)")
    out = rows.groupBy("days", *keys).agg(F.count(F.lit(1)).alias("n_events"), F.when(F.count("_v") >= 5, p95).alias("p95"))
    return out.filter(F.col("n_events") >= least)


def recommend(found: DataFrame) -> DataFrame:
    """kind, subject and n for patterns (kind, subject, n_events, p95): slow frequent aggregates, slow repeated joins, missing dimensions."""
    rules = [("aggregate", 10, 1000, "materialize"), ("join", 5, 1500, "prejoin"), ("missing_dimension", 5, None, "add_dimension")]
    verdict = F.lit(None).cast("string")
    for kind, least, slow, action in rules:
        hit = (F.col("kind") == kind) & (F.col("n_events") >= least) & (F.lit(True) if slow is None else F.col("p95") >= slow)
        verdict = F.when(hit, F.lit(action)).otherwise(verdict)
    return found.withColumn("action", verdict).where("action IS NOT NULL").select("kind", "subject", "n_events", "action")


def unused(assets: DataFrame, observations: DataFrame, least: int = 3, most: int = 1) -> DataFrame:
    """Assets (name) that were observed (name, queries) at least so often with at most so many queries together."""
    seen = observations.groupBy("name").agg(F.count(F.lit(1)).alias("n_seen"), F.coalesce(F.sum("queries"), F.lit(0)).alias("n_queries"))
    return assets.join(seen, "name").where((F.col("n_seen") >= least) & (F.col("n_queries") <= most)).select("name", "n_seen", "n_queries")


def refusals(sources_certified: bool, raw_sql: bool, python_rule: bool, grain: str | None, cardinalities: list[str]) -> list[str]:
    """Why a recommendation must not be proposed; empty where it may."""
    checks = {"source not certified": not sources_certified, "raw SQL": raw_sql, "Python rule": python_rule, "unknown grain": not grain, "join may repeat rows": any(c not in ("many_to_one", "one_to_one") for c in cardinalities)}
    return [k for k, bad in checks.items() if bad]


def outcome(events: DataFrame, keys: list[str], at: str, value: str, failed: str, changed: str, days: int = 30, least: int = 5) -> DataFrame:
    """For each key, what a change did: p95 and share of failures before and after, and improved, regressed or inconclusive.

    A tenth of p95 or 0.10 of failures counts. Few events or values on a side, no movement, opposite movements and a p95 of zero before are inconclusive.
    """
    rows = events.filter(F.expr(f"{at} >= timestamp'{changed}' - make_dt_interval({days}) AND {at} < timestamp'{changed}' + make_dt_interval({days})"))
    after = f"{at} >= timestamp'{changed}'"
    cols = []
    for side, when in (("before", f"NOT ({after})"), ("after", after)):
        v = f"CASE WHEN {when} AND NOT {failed} THEN {value} END"
        cols += [F.expr(f"count_if({when})").alias(f"n_{side}"), F.expr(f"count({v})").alias(f"v_{side}"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {v})").alias(f"p95_{side}"), F.expr(f"avg(CASE WHEN {when} THEN CAST({failed} AS INT) END)").alias(f"fail_{side}")]
    x = rows.groupBy(*keys).agg(*cols)
    enough = " AND ".join(f"{c} >= {least}" for c in ("n_before", "n_after", "v_before", "v_after"))
    worse, better = "p95_after >= 1.1 * p95_before OR fail_after - fail_before >= 0.1", "p95_after <= 0.9 * p95_before OR fail_before - fail_after >= 0.1"
    verdict = f"CASE WHEN NOT ({enough}) OR p95_before = 0 THEN 'inconclusive' WHEN ({worse}) AND NOT ({better}) THEN 'regressed' WHEN ({better}) AND NOT ({worse}) THEN 'improved' ELSE 'inconclusive' END"
    return x.withColumn("verdict", F.expr(verdict)).select(*keys, "n_before", "n_after", "p95_before", "p95_after", "verdict")
