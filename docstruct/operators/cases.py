"""Cases: a vehicle image and a driving licence that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def single_inputs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of cases that hold exactly one, and the ids of cases that hold more.

    A case has one image and one licence. Joining a case with many of both would
    multiply them, so such cases are set apart. ``df`` may hold any columns.
    """
    columns = [c for c in df.columns if c != "case_id"]
    grouped = df.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")
    )
    single = grouped.filter("n = 1").select("case_id", "r.*")
    return single, grouped.filter("n > 1").select("case_id", "n")


def ambiguous_rejects(crowded: DataFrame, what: str) -> DataFrame:
    """Rejects of cases that hold more than one input of a kind."""
    return crowded.select(
        "case_id",
        F.lit("cases").alias("stage"),
        F.lit("ambiguous_case").alias("reason"),
        F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"),
    )


def pair_cases(vehicles: DataFrame, licences: DataFrame) -> DataFrame:
    """Cases with both inputs. Both sides hold a case once."""
    return vehicles.join(licences, "case_id", "inner")
