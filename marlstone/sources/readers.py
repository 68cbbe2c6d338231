"""Sources: files of seven types, unions of tables, and exploded unions."""

from __future__ import annotations

import os
import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import PlanError, known

TYPES = dict.fromkeys(("csv", "parquet", "json", "avro", "orc", "delta", "text"))


def read_source(spark: SparkSession, source: dict, streaming: bool = False) -> DataFrame:
    kind = known("source type", source.get("type", ""), TYPES)
    reader = (spark.readStream if streaming else spark.read).format(kind).options(**source.get("options") or {})
    return (reader.schema(source["schema"]) if source.get("schema") else reader).load(source["path"])


def union_tables(spark: SparkSession, names: list[str], dedup: bool = False) -> tuple[DataFrame, list[str]]:
    """Tables by name, and the ones that aren't there."""
    found, missing = [], []
    for n in names:
        try:
            found.append(spark.table(n))
        except AnalysisException:
            missing.append(n)
    if not found:
        raise PlanError(f"none of {', '.join(names)} can be read")
    out = union(found)
    return (out.dropDuplicates() if dedup else out), missing


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_union(df: DataFrame, common: list[str], branches: list[dict]) -> DataFrame:
    """Each branch explodes one array under its `item` name and maps paths of its items; columns that a branch lacks are null.

    literals: a value, or [value, type] for a typed one.
    """
    parts = []
    for b in branches:
        rows = df.select("*", F.explode(b["array"]).alias(b.get("item", "item")))
        rows = rows.filter(b["filter"]) if b.get("filter") else rows
        typed = {n: F.lit(v[0]).cast(v[1]) if isinstance(v, (list, tuple)) else F.lit(v) for n, v in (b.get("literals") or {}).items()}
        parts.append(rows.select(*common, *[F.col(path).alias(n) for n, path in (b.get("columns") or {}).items()], *[c.alias(n) for n, c in typed.items()]))
    return union(parts) if parts else df.select(*common).limit(0)


def union_partitions(spark: SparkSession, bases: list[str], labels: list[str], dedup: bool = False) -> tuple[DataFrame, list[str]]:
    """Tables <base>_<label> of all bases and labels as one, and the ones that aren't there."""
    return union_tables(spark, [f"{base}_{label}" for base in bases for label in labels], dedup)


def find_file(path: str, start: str) -> str:
    """A declared file: as it stands, else in `start` or a folder above it by its path, and then by its bare name, with a warning."""
    if os.path.isabs(path):
        if os.path.isfile(path):
            return path
    else:
        above = [os.path.abspath(start)]
        while os.path.dirname(above[-1]) != above[-1]:
            above.append(os.path.dirname(above[-1]))
        for folder in above:
            if os.path.isfile(found := os.path.join(folder, path)):
                return found
        for folder in above:
            if os.path.isfile(found := os.path.join(folder, os.path.basename(path))):
                warnings.warn(f"{path} is not there; {found} is taken", stacklevel=2)
                return found
    raise PlanError(f"{path} is not there")


class Sandbox:
    """Tables of a schema as their copies in <schema><suffix>: made from the originals when first asked for, or refused."""

    def __init__(self, spark: SparkSession, suffix: str, missing: str = "copy"):
        self.spark, self.suffix, self.missing = spark, suffix, known("sandbox mode", missing, {"copy": 0, "error": 0})
        self.known: dict[str, str] = {}

    def resolve(self, schema: str, name: str) -> str:
        full = f"{schema}.{name}"
        if full not in self.known:
            own = f"{schema}{self.suffix}"
            if not self.spark.catalog.tableExists(f"{own}.{name}"):
                if self.missing == "error":
                    raise PlanError(f"{own}.{name} is not there")
                self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{own}`")
                self.spark.table(full).write.saveAsTable(f"{own}.{name}")
            self.known[full] = f"{own}.{name}"
        return self.known[full]
