"""Who may ask: certification gate, contract lifecycle, evidence; and model drafts, checks and three-way merges."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import PlanError, known
from .model import METRICS, Dimension, Metric, Model, Query

#: Decisions of each mode on an asset that isn't certified.
GATE = {"off": "ALLOW", "warn": "WARN", "enforce": "DENY", "supervised": "REQUIRE_HUMAN"}
STRICT = ["ALLOW", "WARN", "REQUIRE_HUMAN", "DENY"]
SCOPE = "certification_override"
LONGEST_OVERRIDE = timedelta(hours=4)


@dataclass(frozen=True)
class Override:
    """Who (actor) lets whom (consumer) read a model without certification, when and why; the consumer's scopes must hold SCOPE."""

    model: str
    consumer: str
    start: datetime
    end: datetime
    reason: str = ""
    actor: str = ""


def gate(mode: str, model: str, consumer: str, certified_at: datetime | None, now: datetime, oldest: timedelta | None = None, overrides: list[Override] = ()) -> str:
    """ALLOW where certified (and young enough) or overridden for this model and consumer, else what the mode says."""
    if certified_at is not None and certified_at <= now and (oldest is None or now - certified_at <= oldest):
        return "ALLOW"
    for o in overrides:
        if o.end - o.start > LONGEST_OVERRIDE:
            raise ValueError(f"override of {o.model} is longer than {LONGEST_OVERRIDE}")
        if (o.model, o.consumer) == (model, consumer) and o.start <= now < o.end:
            return "WARN"
    return GATE[mode]


def lifecycle(contract: dict, now: datetime) -> str:
    """ALLOW, WARN (deprecated) or DENY (outside its window)."""
    start, end = contract.get("effective_from"), contract.get("effective_to")
    if (start and now < start) or (end and now >= end):
        return "DENY"
    return "WARN" if contract.get("deprecated") else "ALLOW"


class Access:
    """Decides on each model of a query by certification and contract, and keeps evidence of what was asked.

    certified: model to the time of its last certification; contracts: model to its contract. DENY and REQUIRE_HUMAN
    refuse the query; the decision is the strictest of all models.
    """

    def __init__(self, mode: str, certified: dict[str, datetime], contracts: dict[str, dict] | None = None, overrides: list[Override] = (), oldest: timedelta | None = None, clock: Callable[[], datetime] = datetime.now):
        self.mode, self.certified, self.contracts, self.oldest, self.clock = known("gate mode", mode, GATE), certified, contracts or {}, oldest, clock
        self.overrides = list(overrides)
        for o in self.overrides:
            if not (o.reason and o.actor):
                raise PlanError(f"the override of {o.model} tells no reason or actor")
        self.trace: list[dict] = []

    def decide(self, models: list[str], consumer: dict | None) -> str:
        who, now = (consumer or {}).get("id", ""), self.clock()
        scoped = self.overrides if SCOPE in (consumer or {}).get("scopes", ()) else []
        found = [gate(self.mode, m, who, self.certified.get(m), now, self.oldest, scoped) for m in models]
        found += [lifecycle(self.contracts[m], now) for m in models if m in self.contracts]
        return max(found, key=STRICT.index)

    def asked(self, q: Query, consumer: dict | None, plan: Callable) -> DataFrame:
        began, seen = time.perf_counter(), {"decision": None, "models": []}

        def check(models: list[str]) -> None:
            seen.update(decision=self.decide(models, consumer), models=models)
            if seen["decision"] in ("DENY", "REQUIRE_HUMAN"):
                raise PlanError(f"{', '.join(models)}: {seen['decision']}")

        status, text = "refused", ""
        try:
            df, _ = plan(check)
            status, text = "planned", df._jdf.queryExecution().analyzed().canonicalized().toString()
            return df
        finally:
            told = evidence(text, seen["models"], q.metrics, q.filters, status, time.perf_counter() - began)
            self.trace.append(told | {"decision": seen["decision"], "consumer": (consumer or {}).get("id")})


def evidence(sql: str, sources: list[str], metrics: list[str], filters: list[tuple], status: str, seconds: float) -> dict:
    """What a query did, without the values of its filters."""
    return {"sql_hash": hashlib.sha256(sql.encode()).hexdigest(), "sources": sorted(sources), "metrics": sorted(metrics), "filters": [f"{f[0]} {f[1]} ?" for f in filters], "status": status, "seconds": seconds}


def problems(model: Model) -> list[str]:
    """Why a model can't be used; empty for a good one."""
    out = [f"{n} is no identifier" for n in [model.name, *model.dimensions, *model.metrics] if not re.fullmatch(r"[A-Za-z_]\w*", n)]
    out += [f"{n} is a dimension and a metric" for n in {*model.dimensions} & {*model.metrics}]
    for m in model.metrics.values():
        out += [f"{m.name}: unknown type {m.type}"] if m.type not in METRICS else []
        out += [f"{m.name} aggregates twice"] if re.search(r"\b(sum|avg|min|max|count)\s*\(", m.sql, re.I) else []
        out += [f"{m.name} names no dimension"] if m.additivity == "semi_additive" and not m.non_additive_dimensions else []
        out += [f"{m.name}: unknown dimension {d}" for d in m.non_additive_dimensions if d not in model.dimensions]
    for name, (start, end) in model.calendar.items():
        out += [f"period {name} ends before it starts"] if end < start else []
    out += ["periods need a date dimension"] if model.calendar and not any(d.type == "date" for d in model.dimensions.values()) else []
    return out


def draft_model(name: str, table: str, df: DataFrame) -> Model:
    """Text and dates become dimensions, measures become sums; without a measure there is a count. Reads the schema alone."""
    dims, metrics = {}, {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            dims[f.name] = Dimension(f.name, f.name, "date")
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            dims[f.name] = Dimension(f.name, f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            metrics[f"total_{f.name}"] = Metric(f"total_{f.name}", f.name, "sum")
    return Model(name, table, dims, metrics or {"n_rows": Metric("n_rows", "*", "count")})


def cardinality(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> str:
    """The relationship of two tables, from whether keys repeat on either side; keys with nulls don't count."""
    once = []
    for df, names in ((left, [a for a, _ in keys]), (right, [b for _, b in keys])):
        once.append(df.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty())
    return f"{'one' if once[0] else 'many'}_to_{'one' if once[1] else 'many'}"


def merge(base: dict | None, curated: dict, generated: dict) -> tuple[dict, list[str], list[str]]:
    """Three-way merge of models as mappings (section -> name -> definition): merged, conflicts, rename hints.

    What only one side changed is taken from it. Different changes, a missing base and a changed grain are conflicts;
    with conflicts the curated model comes back as it is.
    """
    if base is None:
        return curated, ["no base"] if curated != generated else [], []
    if base == generated:
        return curated, [], []
    merged, conflicts, hints = {}, [], []
    if base.get("grain") != generated.get("grain"):
        conflicts.append("grain changed")
    for section in sorted({*base, *curated, *generated}):
        b, c, g = base.get(section), curated.get(section), generated.get(section)
        if not all(isinstance(x, (dict, type(None))) for x in (b, c, g)):
            merged[section] = c if c != b else g
            continue
        b, c, g, out = b or {}, c or {}, g or {}, {}
        for name in sorted({*b, *c, *g}):
            x, y, z = b.get(name), c.get(name), g.get(name)
            if y != x and z != x and y != z:
                conflicts.append(f"{section}.{name}")
            picked = z if y == x else y
            if picked is not None:
                out[name] = picked
        gone, new = [n for n in b if n not in g], [n for n in g if n not in b]
        hints += [f"{section}.{o} may be {n} now" for o in gone for n in new if json.dumps(b[o], sort_keys=True) == json.dumps(g[n], sort_keys=True)]
        merged[section] = out
    return (curated if conflicts else merged), conflicts, hints
