"""Status rows for inputs that gave no table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .jobs import FAILED, UNKNOWN_ERROR, job_choice

# Texts shown to the reader, fixed values.
NO_DATA = "No data extracted"
NO_VEHICLE = "No vehicle image uploaded"
NO_LICENCE = "No license image uploaded"
NO_FILE = "No file uploaded."
UPLOAD_ERROR = "S3 upload error: "
IMAGE_ERROR = "Rekognition analysis error: "
LICENCE_ERROR = "Textract analysis error: "
NO_STRUCTURED = "No structured output generated. One or both images were missing."


def status_rows(cases: DataFrame, inputs: DataFrame, report: DataFrame, missing: str) -> DataFrame:
    """``case_id, kind, text`` for every case that has no report row.

    ``inputs`` holds one row per landed input, with an optional ``error`` text that
    already names its step. Errors win over ``No data extracted``; a case without an
    input gets the ``missing`` text.
    """
    if "error" not in inputs.columns:
        inputs = inputs.withColumn("error", F.lit(None).cast("string"))
    landed = inputs.groupBy("case_id").agg(
        F.max("error").alias("error"), F.lit(True).alias("landed")
    )
    shown = report.select("case_id").distinct().withColumn("shown", F.lit(True))
    joined = (
        cases.select("case_id")
        .distinct()
        .join(landed, "case_id", "left")
        .join(shown, "case_id", "left")
    )
    text = (
        F.when(F.col("landed").isNull(), F.lit(missing))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("shown").isNull(), F.lit(NO_DATA))
    )
    return joined.select(
        "case_id",
        F.when(F.col("error").isNotNull(), "Error").otherwise("Message").alias("kind"),
        text.alias("text"),
    ).filter(F.col("text").isNotNull())


def form_status(
    expected: DataFrame, landed: DataFrame, states: DataFrame, docs: DataFrame
) -> DataFrame:
    """Where every expected form stands: ``doc_id, state, kind, text``.

    ``expected`` lists the documents, ``landed`` is the manifest of landed files with an optional ``error`` of
    the upload, ``states`` are ``jobs.job_states`` and ``docs`` the documents that passed. States are
    ``missing``, ``upload_error``, ``waiting`` (landed, no job), ``running``, ``failed``, ``rejected`` and ``done``.
    A missing file is a message, an upload or job that failed an error; the other states have no
    text, and a form without pairs is done and has an empty table. A document counts once in each input,
    whatever its rows; null ids are left out.
    """
    if "error" not in landed.columns:
        landed = landed.withColumn("error", F.lit(None).cast("string"))
    files = landed.groupBy("doc_id").agg(F.max("error").alias("error"), F.lit(True).alias("landed"))
    jobs = job_choice(states).select(
        "doc_id",
        F.col("chosen").isNotNull().alias("succeeded"),
        F.col("latest.job_status").alias("status"),
        F.coalesce("latest.status_message", F.lit(UNKNOWN_ERROR)).alias("message"),
    )
    passed = docs.select("doc_id").distinct().withColumn("passed", F.lit(True))
    joined = expected.select("doc_id").distinct().filter(F.col("doc_id").isNotNull())
    for other in (files, jobs, passed):
        joined = joined.join(other, "doc_id", "left")
    state = (
        F.when(F.col("landed").isNull(), "missing")
        .when(F.col("error").isNotNull(), "upload_error")
        .when(F.col("succeeded").isNull(), "waiting")
        .when(F.col("succeeded") & F.col("passed").isNotNull(), "done")
        .when(F.col("succeeded"), "rejected")
        .when(F.col("status") == FAILED, "failed")
        .otherwise("running")
    )
    text = (
        F.when(F.col("state") == "missing", NO_FILE)
        .when(F.col("state") == "upload_error", F.concat(F.lit(UPLOAD_ERROR), F.col("error")))
        .when(F.col("state") == "failed", F.col("message"))
    )
    kind = F.when(F.col("state") == "missing", "Message").when(
        F.col("state").isin("upload_error", "failed"), "Error"
    )
    return joined.withColumn("state", state).select("doc_id", "state", kind.alias("kind"), text.alias("text"))


def with_status(cases: DataFrame, inputs: DataFrame, report: DataFrame, missing: str) -> DataFrame:
    """Report rows and status rows together; status rows have null report columns."""
    status = status_rows(cases, inputs, report, missing)
    return report.unionByName(status, allowMissingColumns=True)
