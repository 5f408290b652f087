"""Landing keys and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.json import record_json
from ..functions.text import basename, stamp

# Landing prefixes, fixed values.
FORM_PREFIX = "uploads/"
IMAGE_PREFIX = "uploads/images/"


def with_landing_key(
    df: DataFrame,
    prefix: str = FORM_PREFIX,
    ts_col: str = "modificationTime",
    path_col: str = "path",
    unique: bool = False,
) -> DataFrame:
    """Add ``landing_key``: prefix, second-resolution stamp and file name.

    Two files of one name landing in the same second share a key; ``unique`` puts a
    hash of the full path in front of the name.
    """
    path = F.col(path_col)
    parts = [F.lit(prefix), stamp(F.col(ts_col)), F.lit("_")]
    if unique:
        parts += [F.substring(F.sha2(path, 256), 1, 12), F.lit("_")]
    return df.withColumn("landing_key", F.concat(*parts, basename(path)))


def write_records(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Typed records as Parquet, or as JSON with every declared field and all key columns."""
    if fmt == "json":
        keys = [c for c in df.columns if c not in ("record", "record_json")]
        df.select(*keys, record_json(F.col("record")).alias("record_json")).write.mode(mode).json(
            path
        )
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_kv(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error"
) -> None:
    """Typed key/value table; percent strings are a view over it."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_rejects(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("stage").parquet(path)


COMMITS = "commits"


def commit_batch(spark: SparkSession, out_dir: str, batch_id: int) -> None:
    """Say that all tables of a batch under ``out_dir`` are written."""
    spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(
        f"{out_dir}/{COMMITS}/batch_id={batch_id}"
    )


def read_committed(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Rows of the table ``name`` of all batches whose commit is there.

    The table's folders are pruned by the batches at run time, so those of half-written batches are
    not read.
    """
    commits = spark.read.parquet(f"{out_dir}/{COMMITS}").select("batch_id").distinct()
    return spark.read.parquet(f"{out_dir}/{name}").join(commits, "batch_id", "left_semi")


def reject_rows(docs: DataFrame, stage: str, reason: str, detail: str | None = None) -> DataFrame:
    """``doc_id, stage, reason, detail`` rows."""
    return docs.select(
        "doc_id",
        F.lit(stage).alias("stage"),
        F.lit(reason).alias("reason"),
        (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"),
    )


def split_ok_rejects(df: DataFrame, status_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one."""
    bad = F.col(status_col).isNotNull()
    return df.filter(~bad).drop(status_col), df.filter(bad)
