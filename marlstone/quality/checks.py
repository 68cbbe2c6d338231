"""Data checks, fused into one aggregate where they read rows, and tags of violating rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Result:
    name: str
    status: str  # PASS, FAIL, ERROR
    value: object
    critical: bool = True


def fused(df: DataFrame, nulls: list[str] = (), invariants: dict[str, Column] | None = None, volume: bool = True, newest: str | None = None) -> DataFrame:
    """One row: null counts, counts of rows that break each invariant (a null verdict is none), row count, newest time."""
    cols = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls]
    cols += [F.count_if(~p).alias(f"broken_{n}") for n, p in (invariants or {}).items()]
    cols += [F.count(F.lit(1)).alias("n_rows")] if volume else []
    cols += [F.max(newest).alias("newest")] if newest else []
    return df.agg(*cols)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows hold; null is a value like others."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def drift(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    return {"missing": sorted({*expected} - {*df.columns}), "extra": sorted({*df.columns} - {*expected})}


def tagged(df: DataFrame, rules: dict[str, Column], run_id: str, version: str) -> DataFrame:
    """Adds _violations (names of broken rules), _run_id and _contract_version."""
    taken = {"_violations", "_run_id", "_contract_version"} & {*df.columns}
    if taken:
        raise ValueError(f"reserved columns: {', '.join(sorted(taken))}")
    names = F.concat_ws(",", *[F.when(~F.coalesce(p, F.lit(True)), F.lit(n)) for n, p in rules.items()])
    return df.withColumns({"_violations": names, "_run_id": F.lit(run_id), "_contract_version": F.lit(version)})


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed comparison: one row for each key that differs, with the side that lacks it and the columns that differ.

    Keys and values are compared null-safe. Columns of one side only differ where they hold a value. A key of several
    rows is one row for each pair of them.
    """
    rest = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in keys]
    a, b = (df.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in rest if c not in df.columns}) for df, other in ((a, b), (b, a)))
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest], F.lit(True).alias("in_b"))
    x, y = x.select(F.struct(*keys).alias("_k"), *[c for c in x.columns if c not in keys]), y.select(F.struct(*keys).alias("_k"), *[c for c in y.columns if c not in keys])
    both = x.join(y.withColumnRenamed("_k", "_j"), F.col("_k").eqNullSafe(F.col("_j")), "full").withColumn("_k", F.coalesce("_k", "_j"))
    both = both.select("_k.*", *[c for c in both.columns if c not in ("_k", "_j")])
    differ = F.concat_ws(",", *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in rest])
    state = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("differs")
    return both.select(*keys, state.alias("state"), F.when(state == "differs", differ).otherwise("").alias("columns")).filter("state != 'differs' OR columns != ''")


def multiset_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of all rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash"))


def parity_report(a: DataFrame, b: DataFrame, keys: list[str]) -> dict:
    """Row counts, columns of one side, types that differ, and the number of keys in each state."""
    types = [dict(df.dtypes) for df in (a, b)]
    states = {r.state: r["count"] for r in parity(a, b, keys).groupBy("state").count().collect()}
    hashes = [multiset_hash(df.select(sorted(df.columns))).first() for df in (a, b)]
    return {
        "rows": [h.n_rows for h in hashes], "only_a": sorted({*types[0]} - {*types[1]}), "only_b": sorted({*types[1]} - {*types[0]}),
        "types": {c: (t, types[1][c]) for c, t in types[0].items() if c in types[1] and types[1][c] != t}, "states": states, "equal_rows": types[0] == types[1] and hashes[0] == hashes[1],
    }
