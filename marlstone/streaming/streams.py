"""Streams into snapshot tables: triggers, checkpoints, full refresh, append and upsert."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.catalog import PlanError
from ..operators.tables import SnapshotTable


def trigger(text: str) -> dict:
    """`available_now`, or `interval:<duration>` such as `interval:30 seconds`."""
    if text == "available_now":
        return {"availableNow": True}
    name, _, span = text.partition(":")
    if name != "interval" or not re.fullmatch(r"\s*\d+\s*(ms|milliseconds?|s|seconds?|m|minutes?|h|hours?)\s*", span):
        raise PlanError(f"a trigger is available_now or interval:<duration>, not {text!r}")
    number, unit = re.fullmatch(r"\s*(\d+)\s*(\w+)\s*", span).groups()
    return {"processingTime": f"{number} {({'ms': 'milliseconds', 's': 'seconds', 'm': 'minutes', 'h': 'hours'}).get(unit, unit)}"}


def checkpoint_of(spark: SparkSession, schema: str, name: str, root: str | None = None) -> str:
    """{root}/{schema}/{table}; without a root (given, or spark.checkpoint.dir) it's an error before anything starts."""
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise PlanError(f"a stream into {schema}.{name} needs a checkpoint root")
    return f"{root.rstrip('/')}/{schema}/{name}"


def full_refresh(table: SnapshotTable, checkpoint: str) -> None:
    """Forgets what a stream has read and what it has written."""
    fs, at = table._fs(checkpoint)
    fs.delete(at, True)
    table.drop()


def stream_into(stream: DataFrame, table: SnapshotTable, checkpoint: str, keys: list[str] | None = None, sequence_by: str | None = None, when: str = "available_now") -> StreamingQuery | None:
    """Append, or upsert where keys are given. A repeated batch changes nothing: batches count by the stream's own id, which lies
    in its checkpoint, so that another stream, or the same after a reset, is not taken for a repeat. With an interval the running query is returned."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/{number}"
        if keys:
            table.upsert(batch, keys, name, sequence_by)
        else:
            table.append(batch, name)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger(when)).start()
    if when != "available_now":
        return query
    query.awaitTermination()
    return None
