"""Checks derived from a declaration, run together: what reads rows is one aggregate, the rest reads schema, history or clock."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.pipeline import parse_filter
from .checks import Result, duplicates


@dataclass(frozen=True)
class Check:
    """kind: null, invariant, volume, variation, freshness, load_freshness, type, schema, unique or custom."""

    kind: str
    name: str
    args: tuple = ()
    critical: bool = True


class CheckFailed(RuntimeError):
    def __init__(self, failed: list[Result]):
        super().__init__(", ".join(f"{r.name}: {r.status}" for r in failed))
        self.failed = failed


def derive(spec: dict) -> list[Check]:
    """Checks that a pipeline's declaration implies, on the names under which columns are published."""
    out, names = [], {}
    for t in spec.get("tables") or []:
        for f in t.get("fields") or []:
            source, target = (f, f) if isinstance(f, str) else (f[0], f[1])
            plain = isinstance(f, str) or len(f) < 3
            names[source] = (target, plain)
    final = spec.get("select_final") or []
    published = {e[0]: e[1] for e in final if e[0] and len(e) < 3} if final else None
    columns = [e[1] for e in final] or (spec.get("aggregate") or {}).get("group_by", []) + [m[1] for m in (spec.get("aggregate") or {}).get("measures", [])]

    def public(source: str) -> str | None:
        target, plain = names.get(source, (source, True))
        return None if not plain else target if published is None else published.get(target)

    if not spec.get("aggregate"):
        for t in spec.get("tables") or []:
            qc = t.get("quality_checks") or {}
            out += [Check("null", f"null_{p}", (p,)) for c in qc.get("drop_nulls_in", []) if (p := public(c))]
            keys = [public(c) for c in qc.get("drop_duplicates_on", [])]
            out += [Check("unique", f"unique_{'_'.join(keys)}", tuple(keys))] if keys and all(keys) and not (spec.get("join") or spec.get("joins")) else []
            for f in t.get("filter") or []:
                column, op, value = parse_filter(f)
                if op != "sql" and (p := public(column)):
                    out.append(Check("invariant", f"filter_{p}_{op}", (p, op, value), critical=False))
    for e in final:
        out += [Check("type", f"type_{e[1]}", (e[1], op[5:])) for op in (e[2] if len(e) > 2 else [])[-1:] if isinstance(op, str) and op.startswith("cast:")]
    return out + ([Check("schema", "schema", tuple(columns))] if columns else [])


def run(df: DataFrame, checks: list[Check], now: datetime, previous_rows: int | None = None, last_load: datetime | None = None) -> list[Result]:
    """Results in the order of the checks; one scan serves all null, invariant, volume, variation and freshness checks."""
    cols = {}
    for c in checks:
        try:
            if c.kind == "null":
                cols[c.name] = F.count_if(F.col(c.args[0]).isNull())
            elif c.kind == "invariant":
                cols[c.name] = F.count_if(~_predicate(df, *c.args))
            elif c.kind in ("volume", "variation"):
                cols[c.name] = F.count(F.lit(1))
            elif c.kind == "freshness":
                cols[c.name] = F.max(F.col(c.args[0]).cast("timestamp").cast("double"))
            if c.name in cols:
                df.select(cols[c.name])  # analysis only: an unknown column is this check's error
        except Exception as e:
            cols.pop(c.name, None)
            cols[f"!{c.name}"] = F.lit(str(e).splitlines()[0])
    errors = {k[1:]: v for k, v in cols.items() if k.startswith("!")}
    good = {k: v for k, v in cols.items() if not k.startswith("!")}
    row = df.agg(*[v.alias(k) for k, v in good.items()]).first().asDict() if good else {}
    out = []
    for c in checks:
        if c.name in errors:
            out.append(Result(c.name, "ERROR", None, c.critical))
            continue
        try:
            status, value = _judge(df, c, row.get(c.name), now, previous_rows, last_load)
        except Exception as e:
            status, value = "ERROR", str(e).splitlines()[0]
        out.append(Result(c.name, status, value, c.critical))
    return out


def require(results: list[Result]) -> list[Result]:
    """Raises on critical failures and errors."""
    failed = [r for r in results if r.critical and r.status in ("FAIL", "ERROR")]
    if failed:
        raise CheckFailed(failed)
    return results


def _predicate(df: DataFrame, column: str, op: str, value):
    from ..functions.catalog import predicate

    return predicate(F.col(column), op, value, df.select(column).schema[0].dataType)


def _judge(df: DataFrame, c: Check, got, now: datetime, previous_rows: int | None, last_load: datetime | None) -> tuple[str, object]:
    ok: Callable[[bool], str] = lambda x: "PASS" if x else "FAIL"
    if c.kind in ("null", "invariant"):
        return ok(got == 0), got
    if c.kind == "volume":
        low, high = c.args
        return ok((low is None or got >= low) and (high is None or got <= high)), got
    if c.kind == "variation":
        if previous_rows is None:
            return "PASS", got
        share = abs(got - previous_rows) / previous_rows if previous_rows else float(got > 0)
        return ok(share <= c.args[0]), share
    if c.kind in ("freshness", "load_freshness"):
        if c.kind == "load_freshness" and last_load is None:
            return "SKIPPED", None
        if c.kind == "freshness" and got is None:
            return "FAIL", None
        age = now.timestamp() - (got if c.kind == "freshness" else last_load.timestamp())
        return ("ERROR" if age < 0 else ok(timedelta(seconds=age) <= c.args[-1])), age
    if c.kind == "type":
        want = StructType.fromDDL(f"c {'timestamp' if c.args[1] == 'datetime' else c.args[1]}")[0].dataType
        return ok(df.schema[c.args[0]].dataType == want), df.schema[c.args[0]].dataType.simpleString()
    if c.kind == "schema":
        gone, more = sorted({*c.args} - {*df.columns}), sorted({*df.columns} - {*c.args})
        return ok(not gone and not more), (gone, more)
    if c.kind == "unique":
        return ok(duplicates(df, list(c.args)).isEmpty()), None
    if c.kind == "custom":
        value = df.sparkSession.sql(c.args[0], table=df).first()[0]
        return ok(value == c.args[1]), value
    raise ValueError(f"unknown check {c.kind}")
