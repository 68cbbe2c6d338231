"""Compiled views: a declared pipeline with the hash of its definition, and definitions of metric views."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from ..functions.catalog import PlanError
from ..operators.tables import SnapshotTable
from ..semantic.model import Model


def definition_hash(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def materialize(df: DataFrame, spec: dict, table: SnapshotTable, refresh: str = "always") -> str:
    """Creates the table, refreshes it where the definition is the same (not with refresh='never'), or replaces it. Returns what was done."""
    found, log = definition_hash(spec), table.log()
    action = "create" if not log else "replace" if log[-1][2] != found else "skip" if refresh == "never" else "refresh"
    if action != "skip":
        table.overwrite(df, found)
    return action


def metric_view(model: Model) -> tuple[str, str]:
    """The definition's text and an equal SELECT over all dimensions."""
    if model.relationships or any(m.additivity != "additive" for m in model.metrics.values()):
        raise PlanError(f"{model.name} has relationships or metrics that don't add up")
    inner = lambda m: f"CASE WHEN {' AND '.join(m.filters)} THEN {'1' if m.sql == '*' else m.sql} END" if m.filters else m.sql
    call = lambda m: f"count(DISTINCT {inner(m)})" if m.type == "count_distinct" else f"{m.type}({inner(m)})"
    text = {"source": model.table, "filter": model.base_filter, "dimensions": [{"name": d.name, "expr": d.sql} for d in model.dimensions.values()], "measures": [{"name": m.name, "expr": call(m)} for m in model.metrics.values()]}
    keys = ", ".join(f"{d.sql} AS {d.name}" for d in model.dimensions.values())
    picked = ", ".join(x for x in (keys, ", ".join(f"{call(m)} AS {m.name}" for m in model.metrics.values())) if x)
    where = f" WHERE {model.base_filter}" if model.base_filter else ""
    return json.dumps({k: v for k, v in text.items() if v}, indent=1), f"SELECT {picked} FROM {model.table}{where}" + (f" GROUP BY {', '.join(d.sql for d in model.dimensions.values())}" if model.dimensions else "")
