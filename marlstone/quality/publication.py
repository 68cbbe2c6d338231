"""Stage, check, then promote or quarantine; contracts, their hash and breaking changes."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import PlanError
from ..operators.tables import SnapshotTable
from .checks import Result, fused, tagged


def contract_hash(contract: dict) -> str:
    """Over what binds consumers: owner and descriptions don't count."""
    kept = {k: contract[k] for k in ("id", "version", "grain", "output", "sla", "security") if k in contract}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def breaking(old: dict, new: dict) -> list[str]:
    """What a consumer of the old contract would notice."""
    out = []
    for name, f in old.get("output", {}).items():
        g = new.get("output", {}).get(name)
        if g is None:
            out.append(f"{name} removed")
            continue
        if f.get("type") != g.get("type"):
            out.append(f"{name} retyped")
        out += [f"{name} no longer {k}" for k in ("required", "unique") if f.get(k) and not g.get(k)]
        if f.get("classification") != g.get("classification"):
            out.append(f"{name} reclassified")
    out += [f"{k} changed" for k in ("grain", "sla", "security") if old.get(k) != new.get(k)]
    return out


#: The states of a publication and where each may go.
STATES = {
    "STARTED": {"STAGING"},
    "STAGING": {"STAGED", "CHECK_ERROR"},
    "STAGED": {"PROMOTING", "QUARANTINED", "CHECK_ERROR"},
    "PROMOTING": {"PROMOTED"},
    "PROMOTED": set(),
    "QUARANTINED": set(),
    "CHECK_ERROR": set(),
}


class Publication:
    """One run: stage once, check, then promote whole or quarantine the violations. A run that was promoted is not promoted again."""

    def __init__(self, target: SnapshotTable, quarantine: SnapshotTable, run_id: str, version: str):
        self.target, self.quarantine, self.run_id, self.version = target, quarantine, run_id, version
        self.state, self.history = "STARTED", ["STARTED"]

    def _to(self, state: str) -> None:
        if state not in STATES[self.state]:
            raise PlanError(f"run {self.run_id} can't go from {self.state} to {state}")
        self.state = state
        self.history.append(state)

    def _promoted(self) -> bool:
        return any(batch == self.run_id for _, _, batch in self.target.log())

    def run(self, df: DataFrame, required: list[str], rules: dict[str, Column], advisory: set[str] = frozenset()) -> list[Result]:
        """advisory: rules whose violations are told and don't hold the run back. A rule that can't be evaluated ends in CHECK_ERROR."""
        if self._promoted():
            self.state, self.history = "PROMOTED", ["PROMOTED"]
            return []
        self._to("STAGING")
        staging = SnapshotTable(df.sparkSession, f"{self.target.path}_staging")
        staging.overwrite(df, self.run_id)
        staged = staging.read()
        self._to("STAGED")
        errors = []
        for name, rule in [*((f"null_{c}", F.col(f"`{c}`")) for c in required), *rules.items()]:
            try:
                staged.select(rule)  # analysis only
            except AnalysisException as e:
                errors.append(Result(name, "ERROR", str(e).splitlines()[0], name not in advisory))
        if errors:
            self._to("CHECK_ERROR")
            return errors
        try:
            row = fused(staged, required, rules).first().asDict()
        except PySparkException as e:
            self._to("CHECK_ERROR")
            return [Result("checks", "ERROR", str(e).splitlines()[0])]
        results = [Result(k, "PASS" if not v else "FAIL", v, k.removeprefix("broken_") not in advisory) for k, v in row.items() if k != "n_rows"]
        if any(r.critical and r.status != "PASS" for r in results):
            every = {f"null_{c}": staged[c].isNotNull() for c in required} | {k: v for k, v in rules.items() if k not in advisory}
            self.quarantine.append(tagged(staged, every, self.run_id, self.version).where("_violations != ''"), self.run_id)
            self._to("QUARANTINED")
        else:
            self._to("PROMOTING")
            self.target.overwrite(staged, self.run_id)
            self._to("PROMOTED")
        return results


def publish(df: DataFrame, target: SnapshotTable, quarantine: SnapshotTable, required: list[str], rules: dict[str, Column], run_id: str, version: str, advisory: set[str] = frozenset()) -> list[Result]:
    """A whole publication in one call."""
    return Publication(target, quarantine, run_id, version).run(df, required, rules, advisory)
