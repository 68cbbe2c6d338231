"""Metric candidates: normal forms, validation by use, rephrasings and drift."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import PlanError, known

#: The states of a candidate and where each may go.
STATES = {
    "candidate": {"validated", "needs_review", "rejected"},
    "validated": {"promoted", "needs_review", "rejected"},
    "needs_review": {"promoted", "rejected"},
    "promoted": {"under_review", "demoted"},
    "under_review": {"promoted", "demoted"},
    "demoted": {"candidate"},
    "rejected": set(),
}
#: Aggregates of aggregates, where there is one.
AGAIN = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


def normal_form(request: dict) -> str:
    """The same for requests that differ in order and filter values."""
    return json.dumps({"metrics": sorted(request["metrics"]), "group_by": sorted(request.get("group_by", [])), "filters": sorted(f"{f[0]} {f[1]} ?" for f in request.get("filters", []))}, sort_keys=True)


def rollup(request: dict, types: dict[str, str]) -> dict:
    """A table that serves the request with any filter value: filtered columns become keys. Other metrics than sums, counts and extremes are refused."""
    bad = [m for m in request["metrics"] if types[m] not in AGAIN]
    if bad:
        raise ValueError(f"{', '.join(sorted(bad))} can't be aggregated again")
    return {"group_by": sorted({*request.get("group_by", []), *(f[0] for f in request.get("filters", []))}), "metrics": {m: AGAIN[types[m]] for m in sorted(request["metrics"])}}


def frequency(requests: DataFrame, key: str, who: str, at: str, least: int = 5, requesters: int = 2, days: int = 2) -> DataFrame:
    """key, counts, and whether it is asked often enough by enough people on enough days."""
    n = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n_requests"), F.count_distinct(who).alias("n_requesters"), F.count_distinct(F.to_date(at)).alias("n_days"))
    return n.withColumn("frequent", F.expr(f"n_requests >= {least} AND n_requesters >= {requesters} AND n_days >= {days}"))


def stability(runs: DataFrame, key: str, result: str, least_runs: int = 3, share: float = 1.0) -> DataFrame:
    """key and the share of its most frequent result, over results first and then over keys; fewer runs than needed are not stable."""
    per = runs.groupBy(key, result).agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(key).agg(F.sum("c").alias("n_runs"), (F.max("c") / F.sum("c")).alias("mode_share"))
    return out.withColumn("stable", (F.col("n_runs") >= least_runs) & (F.col("mode_share") >= share))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two word arrays; two empty ones have 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def fingerprint(request: dict) -> str:
    """Hash of the normal form."""
    return hashlib.sha256(normal_form(request).encode()).hexdigest()


def move(state: str, to: str) -> str:
    """The new state; a step that isn't allowed is refused."""
    if to not in STATES[known("candidate state", state, STATES)]:
        raise PlanError(f"a candidate can't go from {state} to {known('candidate state', to, STATES)}")
    return to


def rephrasings(asked: DataFrame, names: DataFrame, acronyms: dict[str, str] | None = None, least: float = 0.6) -> DataFrame:
    """question (id, text) and the candidate (name, text) that it most resembles, by words with acronyms written out; pairs meet by a shared word."""

    def words(column: str) -> Column:
        text = F.lower(F.coalesce(column, F.lit("")))
        for short, long in (acronyms or {}).items():
            text = F.regexp_replace(text, rf"\b{re.escape(short.lower())}\b", long.lower())
        return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != ""))

    q, n = asked.select("id", words("text").alias("qw")), names.select("name", words("text").alias("nw"))
    pairs = q.withColumn("w", F.explode("qw")).join(n.withColumn("w", F.explode("nw")), "w").groupBy("id", "name").agg(F.any_value("qw").alias("qw"), F.any_value("nw").alias("nw"))
    scored = pairs.select("id", "name", similarity(F.col("qw"), F.col("nw")).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("id").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("x")).select("id", "x.*")


def degraded(before: DataFrame, after: DataFrame, least: int = 5, fall: float = 0.1) -> DataFrame:
    """family, shares of right answers (family, right) before and after, and whether they fell; too few on a side is inconclusive, with its reason."""
    side = lambda df, s: df.groupBy("family").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(F.col("right").cast("int")).alias(f"share_{s}"))
    both = side(before, "before").join(side(after, "after"), "family", "full").fillna(0, ["n_before", "n_after"])
    reason = F.when(F.col("n_before") < least, "few before").when(F.col("n_after") < least, "few after")
    verdict = F.when(reason.isNotNull(), "inconclusive").when(F.col("share_before") - F.col("share_after") >= fall, "degraded").otherwise("steady")
    return both.select("family", "n_before", "n_after", "share_before", "share_after", verdict.alias("verdict"), reason.alias("reason"))


def drift(requests: DataFrame, metrics: DataFrame, at: str, start: str, end: str, least: int = 1) -> DataFrame:
    """signal, n, value over [start, end): share of requests that fell back, and certified metrics that nobody asked for."""
    inside = requests.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))
    fallback = inside.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("fell_back").cast("int")).alias("value")).withColumn("signal", F.lit("fallback_rate"))
    idle = metrics.where("certified").join(inside.select("metric").distinct(), "metric", "left_anti")
    orphans = idle.agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("value")).withColumn("signal", F.lit("orphan_certified_metrics"))
    return fallback.unionByName(orphans).select("signal", "n", F.when((F.col("signal") != "fallback_rate") | (F.col("n") >= least), F.col("value")).alias("value"))
