"""What has landed in part, kept between batches as a table.

Batch ``n`` reads what batch ``n - 1`` left under ``folder``, adds its own rows and writes every key with the
kind that it has become, once. What is still held is what the next batch reads. A retry overwrites its own
batch only. Time is the newest landing of all, so a replay comes to the same kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import drop_folder

#: Column of the stored tables that says what has become of a key; a folder each.
KIND = "kind"


def _at(folder: str, name: str, batch_id: int) -> str:
    return f"{folder}/{name}/batch_id={batch_id}"


def _newest(batch: DataFrame, folder: str, batch_id: int) -> tuple[int | None, int | None]:
    """The newest landing before this batch, and with it, in microseconds."""
    before = None
    if batch_id:
        before = batch.sparkSession.read.schema("newest bigint").parquet(_at(folder, "newest", batch_id - 1)).head()[0]
    landed = batch.agg(F.max(F.unix_micros("landed_at"))).head()[0]
    newest = max((t for t in (before, landed) if t is not None), default=None)
    table = batch.sparkSession.createDataFrame([(newest,)], "newest bigint").coalesce(1)
    table.write.mode("overwrite").parquet(_at(folder, "newest", batch_id))
    return before, newest


def _earlier(newest: int | None, seconds: int) -> Column:
    return F.timestamp_micros(F.lit(newest).cast("bigint") - 1_000_000 * seconds)


def take_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    schema: str,
    timeout_seconds: int,
    late_seconds: int,
    step: Callable[[DataFrame, DataFrame, Column], DataFrame],
) -> DataFrame:
    """The stored table of this batch: ``schema``, with ``last`` and ``kind`` among its columns.

    ``step(left, fresh, before)`` makes it from what the last batch stored, the rows of this one and the time
    before which a key's last landing is too long ago. Rows that land over ``late_seconds`` after newer ones of
    earlier batches are left out.
    """
    spark = batch.sparkSession
    before, newest = _newest(batch, folder, batch_id)
    late = F.col("landed_at") < _earlier(before, late_seconds)
    batch = batch.filter(~F.coalesce(late, F.lit(False)))
    if batch_id:
        left = spark.read.schema(schema).parquet(_at(folder, "held", batch_id - 1))
    else:
        left = spark.createDataFrame([], schema)
    limit = _earlier(newest, timeout_seconds + late_seconds)
    path = _at(folder, "held", batch_id)
    step(left, batch, limit).write.mode("overwrite").partitionBy(KIND).parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Delete what no retry can need: what the batch before the last one left."""
    if batch_id > 1:
        for name in ("held", "newest"):
            drop_folder(batch.sparkSession, _at(folder, name, batch_id - 2))
