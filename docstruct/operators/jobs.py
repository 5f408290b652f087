"""Job-status gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import reject_rows

SUCCEEDED, FAILED = "SUCCEEDED", "FAILED"
UNKNOWN_ERROR = "Unknown error"


def job_states(pages: DataFrame) -> DataFrame:
    """Latest known status and message of every job, its last page and attempt; reads no blocks.

    A null ``job_id`` is a job like any other. ``attempt`` is the largest in the optional column of that
    name: a number or a time that grows from one job of a document to the next.
    """
    attempt = F.max("attempt") if "attempt" in pages.columns else F.lit(None).cast("bigint")
    return (
        pages.groupBy("doc_id", "job_id")
        .agg(
            F.max_by(
                F.struct("job_status", "status_message"),
                F.when(F.col("job_status").isNotNull(), F.col("page_seq")),
            ).alias("s"),
            F.max("page_seq").alias("last_page"),
            attempt.alias("attempt"),
        )
        .select("doc_id", "job_id", "s.job_status", "s.status_message", "last_page", "attempt")
    )


def failed_jobs(states: DataFrame) -> DataFrame:
    failed = states.filter(F.col("job_status") == FAILED).withColumn(
        "message", F.coalesce("status_message", F.lit(UNKNOWN_ERROR))
    )
    return reject_rows(failed, "job", "job_failed", "message")


def job_choice(states: DataFrame) -> DataFrame:
    """One row a document: ``chosen`` (``attempt, last_page, job_id`` of its latest job that succeeded, null
    without one) and ``latest`` (the same and the status and message of its latest job of any state).

    Jobs follow one another by ``attempt``; where pages carry none, the job that got further counts
    as the later one, and ``job_id`` settles the rest.
    """
    place = F.struct("attempt", "last_page", "job_id")
    good = F.col("job_status") == SUCCEEDED
    return states.groupBy("doc_id").agg(
        F.max(F.when(good, place)).alias("chosen"),
        F.max(F.struct("attempt", "last_page", "job_id", "job_status", "status_message")).alias("latest"),
    )


def gate_jobs(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of finished jobs, the documents to keep out, and the rejects.

    A document is read from its latest job that succeeded (see ``job_choice``), and from all pages of
    that job, whatever status each was handed out with; jobs that failed or run beside it do not
    matter. Documents without such a job are ``blocked``, and rejected if their latest job failed. Pages
    meet the job of their document by ``doc_id`` alone and are not sorted, so pages that are dealt by
    ``doc_id`` stay where they are. Null documents and jobs are compared like any others; the pages
    without a document are one, whose job is a single row.
    """
    states = job_states(pages)
    chosen = job_choice(states)
    good = chosen.filter(F.col("chosen").isNotNull())
    named = good.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_doc"), F.struct("chosen.job_id").alias("_job")
    )
    nameless = good.filter(F.col("doc_id").isNull()).select(
        F.lit(True).alias("_none"), F.struct("chosen.job_id").alias("_none_job")
    )
    job = F.coalesce("_job", "_none_job")
    ready = (
        pages.join(named.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left")
        .join(F.broadcast(nameless), F.col("doc_id").isNull() == F.col("_none"), "left")
        .filter(job.isNotNull() & F.col("job_id").eqNullSafe(job["job_id"]))
        .select(*pages.columns)
    )
    without = chosen.filter(F.col("chosen").isNull())
    failed = failed_jobs(without.select("doc_id", "latest.job_status", "latest.status_message"))
    return ready, without.select("doc_id"), failed
