"""Joins that survive a key holding a large share of all rows.

A frequent-items sketch (``approx_top_k``) finds the hot keys in one narrow pass
that shuffles only sketches. It returns at most ``MAX_HOT`` keys, whatever the
data holds, so its result may be broadcast. Rows of a hot key on the many side
get a salt; the single row on the other side is repeated once per salt. A key the
sketch misses or names by mistake changes the speed of the join, not its result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_HOT = 1000
TRACKED = 10_000
MIN_HOT_ROWS = 1_000_000
ROWS_PER_SALT = 250_000
MAX_SALTS = 4096
#: Sketches of tasks are merged in so many tasks, and these in one.
MERGES = 512


def key_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def hot_keys(
    hashes: DataFrame,
    min_rows: int = MIN_HOT_ROWS,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``hash, salts`` of the frequent values of the single column ``hash``.

    At most ``MAX_HOT`` rows: every key above about 0.1 % of all rows is tracked,
    and there cannot be more than a thousand of those. No rows give no keys.
    """
    parts = hashes.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    sketches = parts.groupBy("part").agg(
        F.expr(f"approx_top_k_accumulate(hash, {TRACKED})").alias("sketch")
    )
    # Grouped by a constant: an aggregate without keys also runs on partitions without rows, and the
    # empty sketch it makes there cannot be merged.
    merged = sketches.groupBy(F.lit(0).alias("one")).agg(
        F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")
    )
    top = merged.select(F.expr(f"approx_top_k_estimate(sketch, {MAX_HOT})").alias("top"))
    return (
        top.select(F.explode("top").alias("t"))
        .filter(F.col("t.count") >= min_rows)
        .select(
            F.col("t.item").alias("hash"),
            F.least(F.ceil(F.col("t.count") / rows_per_salt), F.lit(MAX_SALTS)).alias("salts"),
        )
    )


def slot_many(
    df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], hot: DataFrame | None = None
) -> DataFrame:
    """Add ``slot`` to the side that may repeat a key.

    The slot is the key's hash with the salt folded in by exclusive or, so one key
    never shares a slot between two salts. It leads the join and grouping keys: sorts
    then compare one long instead of two texts. Rows whose last key is null match
    nothing; they get a slot of their own, or all of them would meet in one task.
    """
    own = F.xxhash64(*spread_by)
    idle = F.col(keys[-1]).isNull()
    if hot is None:
        return df.withColumn("slot", F.when(idle, own).otherwise(key_hash(*keys)))
    salt = F.coalesce(F.pmod(own, F.col("salts")), F.lit(0).cast("bigint"))
    return (
        df.withColumn("hash", key_hash(*keys))
        .join(F.broadcast(hot), "hash", "left")
        .withColumn("slot", F.when(idle, own).otherwise(F.col("hash").bitwiseXOR(salt)))
        .drop("hash", "salts")
    )


def slot_one(df: DataFrame, keys: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Add ``slot``, repeating the rows of hot keys once per salt."""
    if hot is None:
        return df.withColumn("slot", key_hash(*keys))
    salts = F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)
    slots = F.when(
        F.col("salts").isNull(), F.array("hash")
    ).otherwise(F.transform(salts, lambda s: F.col("hash").bitwiseXOR(s)))
    return (
        df.withColumn("hash", key_hash(*keys))
        .join(F.broadcast(hot), "hash", "left")
        .withColumn("slot", F.explode(slots))
        .drop("hash", "salts")
    )


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot: DataFrame | None,
) -> DataFrame:
    """Equi-join on ``on`` where ``one`` holds a key once and ``many`` any number of times."""
    left = slot_many(many, on, spread_by, hot)
    right = slot_one(one, on, hot)
    return left.join(right, ["slot", *on], how).drop("slot")


_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def partitions_kept(spark: SparkSession) -> Iterator[None]:
    """While a job runs in here, joins keep a partitioning by a part of their keys.

    The setting is read when a plan is made ready to run and put back afterwards.
    """
    before = spark.conf.get(_CO_PARTITION)
    spark.conf.set(_CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_PARTITION, before)
