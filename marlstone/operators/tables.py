"""Sinks: snapshot tables with a log, upsert, split fan-out and databases."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import PlanError


class Conflict(RuntimeError):
    """Another writer committed first."""


class SnapshotTable:
    """A Parquet table as immutable snapshots; the newest entry of the log is the table. A batch id is applied once.

    An entry of the log is a file named by its version alone, which only one writer can create: of two that read the same
    log the later one fails with Conflict, and its data stays outside the table. The entry holds the snapshot's name and
    the batch id as JSON, so that a batch id may hold any text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def log(self) -> list[tuple[int, str, str]]:
        """Version, snapshot and batch of each entry, oldest first."""
        fs, at = self._fs(f"{self.path}/_log")
        if not fs.exists(at):
            return []
        rows = self.spark.read.format("text").option("wholetext", True).load(f"{self.path}/_log/*.json").selectExpr("value", "_metadata.file_name AS name").collect()
        found = [(int(r.name.removesuffix(".json")), json.loads(r.value)) for r in rows if r.value]
        return sorted((version, e["snapshot"], e["batch"]) for version, e in found)

    def _commit(self, snapshot: str, batch: str, version: int) -> None:
        text = json.dumps({"snapshot": snapshot, "batch": batch}).encode()
        fs, at = self._fs(f"{self.path}/_log/{version}.json")
        try:
            out = fs.create(at, False)  # succeeds for one writer alone
        except Py4JJavaError as e:
            raise Conflict(f"version {version} of {self.path} is there already") from e
        out.write(bytearray(text))
        out.close()

    def exists(self) -> bool:
        return bool(self.log())

    def read(self) -> DataFrame:
        """The newest whole snapshot and what was appended since."""
        parts: list[str] = []
        for _, name, _ in self.log():
            parts = [*parts, name] if name.startswith("a") else [name]
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in parts])

    def _next(self, log: list) -> int:
        return log[-1][0] + 1 if log else 0

    def overwrite(self, df: DataFrame, batch: str = "", log: list | None = None) -> None:
        """An empty result replaces the table too. log: what the caller read before; a commit since then is a conflict."""
        log, name = self.log() if log is None else log, f"s{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._commit(name, batch, self._next(log))

    def append(self, df: DataFrame, batch: str = "") -> None:
        log = self.log()
        if batch and any(b == batch for _, _, b in log):
            return
        if log:
            name = f"a{uuid.uuid4().hex}"
            have = self.read()
            df.select(*[df[c].cast(t).alias(c) for c, t in have.dtypes]).write.parquet(f"{self.path}/{name}")
            self._commit(name, batch, self._next(log))
        else:
            self.overwrite(df, batch, log)

    def optimize(self, columns: list[str], files: int) -> None:
        """Rewrites the table as one snapshot, ranged and sorted by columns, for scans that skip row groups."""
        self.overwrite(self.read().repartitionByRange(files, *columns).sortWithinPartitions(*columns))

    def clone(self, path: str) -> SnapshotTable:
        """A copy that later changes don't reach."""
        out = SnapshotTable(self.spark, path)
        out.overwrite(self.read())
        return out

    def upsert(self, df: DataFrame, keys: list[str], batch: str = "", sequence_by: str | None = None) -> None:
        """Rows replace those of equal keys; of equal keys in a batch the last by sequence_by (any, without it) stays. A null in a key equals nothing, so that such rows are all kept."""
        log = self.log()
        if batch and any(b == batch for _, _, b in log):
            return
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        odd, df = df.where(~whole), df.where(whole)
        if sequence_by:
            df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(sequence_by).desc()))).filter("_rn = 1").drop("_rn")
        else:
            df = df.dropDuplicates(keys)
        new = df.unionByName(odd)
        self.overwrite(self.read().join(df, keys, "left_anti").unionByName(new) if log else new, batch, log)

    def vacuum(self) -> int:
        """Deletes snapshots that the table no longer needs; readers of older versions must be done. Returns how many."""
        fs, at = self._fs(self.path)
        needed: list[str] = []
        for _, name, _ in self.log():
            needed = [*needed, name] if name.startswith("a") else [name]
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[:1] in "as" and s.getPath().getName() not in needed]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def repair(self) -> None:
        """Removes an entry that a writer claimed and never wrote, which makes all later commits conflicts."""
        fs, at = self._fs(f"{self.path}/_log")
        for s in fs.listStatus(at):
            if s.getLen() == 0:
                fs.delete(s.getPath(), False)

    def drop(self) -> None:
        fs, at = self._fs(self.path)
        fs.delete(at, True)


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options: str) -> None:
    """Write to a database; mode is overwrite, append, ignore or error."""
    if mode not in ("overwrite", "append", "ignore", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def split(df: DataFrame, column: str, path: str, values: list | None = None) -> None:
    """One folder for each value (of `values`, where given), in one job."""
    if df.isStreaming:
        raise PlanError("a stream can't be split")
    df = df if values is None else df.where(F.col(column).isin(*values))
    df.write.partitionBy(column).mode("overwrite").parquet(path)
