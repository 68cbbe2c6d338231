"""Append-only stores: runs and certification, incidents, and the registry of assets with impact along lineage."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import PlanError
from ..operators.tables import SnapshotTable
from .checks import Result

RUNS = "run_id string, product string, version string, state string, at timestamp, failed array<string>"
INCIDENTS = "incident_id string, product string, check string, state string, who string, at timestamp"
#: The states an incident may go to.
MOVES = {None: {"NEW"}, "NEW": {"ACK", "ASSIGNED", "RESOLVED"}, "ACK": {"ASSIGNED", "RESOLVED"}, "ASSIGNED": {"ASSIGNED", "RESOLVED"}, "RESOLVED": set()}


class RunStore:
    """Events of runs; the clock of a run never stands still, whoever recorded its last event."""

    def __init__(self, table: SnapshotTable):
        self.table = table

    def record(self, run_id: str, product: str, version: str, state: str, at: datetime, results: list[Result] = ()) -> datetime:
        last = self.table.read().where(F.col("run_id") == run_id).agg(F.max("at").alias("at")).first().at if self.table.exists() else None
        at = at if last is None else max(at, last + timedelta(microseconds=1))
        failed = [r.name for r in results if r.critical and r.status in ("FAIL", "ERROR")]
        self.table.append(self.table.spark.createDataFrame([(run_id, product, version, state, at, failed)], RUNS))
        return at

    def certified(self) -> DataFrame:
        """product, version, run_id, at: the last promoted run of each product without critical failure."""
        good = self.table.read().where("state = 'PROMOTED' AND size(failed) = 0")
        return good.groupBy("product").agg(F.max_by(F.struct("version", "run_id", "at"), F.struct("at", "run_id")).alias("x")).select("product", "x.*")


class Incidents:
    """One for each critical check that fails; the newest row of an id is its state, and of equal times the one furthest on."""

    def __init__(self, table: SnapshotTable):
        self.table = table

    def current(self) -> DataFrame:
        steps = F.create_map(*[F.lit(x) for k, s in enumerate(("NEW", "ACK", "ASSIGNED", "RESOLVED")) for x in (s, k)])
        w = Window.partitionBy("incident_id").orderBy(F.col("at").desc(), steps[F.col("state")].desc(), F.col("who").desc())
        return self.table.read().withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def open(self, product: str, run_id: str, results: list[Result], at: datetime) -> list[str]:
        bad = [r for r in results if r.critical and r.status in ("FAIL", "ERROR")]
        rows = [(f"{product}:{run_id}:{r.name}", product, r.name, "NEW", None, at) for r in bad]
        if rows:
            self.table.append(self.table.spark.createDataFrame(rows, INCIDENTS))
        return [r[0] for r in rows]

    def move(self, incident_id: str, state: str, who: str, at: datetime) -> None:
        row = self.current().where(F.col("incident_id") == incident_id).first()
        if state not in MOVES[row.state if row else None]:
            raise PlanError(f"{incident_id} can't go from {row.state if row else None} to {state}")
        self.table.append(self.table.spark.createDataFrame([(incident_id, row.product, row.check, state, who, at)], INCIDENTS))


class Registry:
    """Assets and their columns, by content: an unchanged asset is not written again."""

    def __init__(self, table: SnapshotTable):
        self.table = table

    def upsert(self, assets: list[dict]) -> int:
        """Each has name, columns and upstream ('table.column' pairs). Returns how many changed."""
        sha = lambda a: hashlib.sha256(json.dumps(a, sort_keys=True).encode()).hexdigest()
        rows = [(a["name"], sha(a), sorted(a["columns"]), [tuple(u) for u in a.get("upstream", [])]) for a in assets]
        new = self.table.spark.createDataFrame(rows, "name string, hash string, columns array<string>, upstream array<struct<source:string,target:string>>")
        if self.table.exists():
            new = new.join(self.table.read().select("name", "hash"), ["name", "hash"], "left_anti")
        n = new.count()
        if n:
            self.table.upsert(new, ["name"])
        return n

    def search(self, column: str) -> DataFrame:
        return self.table.read().select("name", F.explode("columns").alias("column")).where(F.lower("column").contains(column.lower()))

    def impact(self, column: str, depth: int = 20) -> tuple[dict[str, int], bool]:
        """Columns downstream of one with their distance, and whether the depth cut the walk. The graph is of declared columns, not of rows."""
        down: dict[str, set[str]] = {}
        for r in self.table.read().select(F.explode("upstream").alias("u")).select("u.*").collect():
            down.setdefault(r.source, set()).add(r.target)
        found, queue, cut = {}, deque([(column, 0)]), False
        while queue:
            at, d = queue.popleft()
            for to in sorted(down.get(at, ())):
                if to == column:
                    raise PlanError(f"{column} depends on itself")
                if to not in found and d < depth:
                    found[to] = d + 1
                    queue.append((to, d + 1))
                cut |= d >= depth and to not in found
        return found, cut
