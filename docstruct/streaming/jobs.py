"""Jobs whose pages land in several batches, put together in a table of open jobs.

Pages of a job are held until the job has ended: it failed, or all of its pages are there. A job that
gets no page for too long is given up and becomes a reject, so the table does not grow with jobs that never
end. What leaves the table is whole jobs only, and batch operators take it from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import types
from ..operators.jobs import FAILED, SUCCEEDED
from ..sources.sinks import reject_rows
from .held import KIND, take_batch

JOB_TIMEOUT = "job_timeout"

_PAGE = (
    "page_seq: bigint, job_status: string, status_message: string, page_count: bigint, "
    f"blocks: array<{types.BLOCK}>"
)
_SCHEMA = f"doc_id string, job_id string, pages array<struct<{_PAGE}>>, last timestamp, {KIND} string"
_COLUMNS = ["page_seq", "job_status", "status_message", "page_count", "blocks"]


def _some(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def _open_jobs(left: DataFrame, fresh: DataFrame, before: Column) -> DataFrame:
    """Every open job with all of its pages, and its kind: ``page`` if it has ended, ``timeout`` or ``held``."""
    pages = fresh.select(
        "doc_id", "job_id",
        F.struct(
            F.col("page_seq").cast("bigint").alias("page_seq"), "job_status", "status_message",
            F.col("page_count").cast("bigint").alias("page_count"), "blocks",
        ).alias("page"),
        F.col("landed_at").alias("last"),
    )
    held = left.filter(F.col(KIND) == "held").select("doc_id", "job_id", F.explode("pages").alias("page"), "last")
    jobs = held.unionByName(pages).groupBy("doc_id", "job_id").agg(
        F.collect_list("page").alias("pages"),
        F.max("last").alias("last"),
        _some(F.col("page.job_status") == FAILED).alias("failed"),
        _some(F.col("page.job_status") == SUCCEEDED).alias("done"),
        F.max("page.page_count").alias("total"),
    )
    different = F.size(F.array_distinct(F.array_compact(F.col("pages")["page_seq"])))
    # A failed page ends a job; else the number of different pages that some page names as the total.
    ended = F.col("failed") | (F.col("done") & (different >= F.col("total")))
    kind = F.when(ended, "page").when(F.col("last") <= before, "timeout").otherwise("held")
    return jobs.select("doc_id", "job_id", "pages", "last", kind.alias(KIND))


def whole_jobs(
    batch: DataFrame, batch_id: int, folder: str, timeout_seconds: int = 24 * 3600, late_seconds: int = 3600
) -> DataFrame:
    """``kind`` and the columns of a form page: pages of jobs that have ended, and a row for each given up.

    ``batch`` holds form pages with ``landed_at`` and with ``page_count``, the number of pages of the job, on
    one of its pages at least; ``folder``, which all executors share, holds the open jobs. Kind ``page`` rows
    come out once a job has all of its pages or has failed; a job whose last page landed ``timeout_seconds`` and
    ``late_seconds`` before the newest page of all gives one row of kind ``timeout``. Pages that land over
    ``late_seconds`` after newer ones are left out. A file source takes files by the time they were written,
    so with that time as ``landed_at`` there are none. Repeated pages are kept, as in a batch.
    """
    found = take_batch(batch, batch_id, folder, _SCHEMA, timeout_seconds, late_seconds, _open_jobs)
    whole = found.filter(F.col(KIND) == "page").select("doc_id", "job_id", KIND, F.inline("pages"))
    first = F.get("pages", F.lit(0))
    given_up = found.filter(F.col(KIND) == "timeout").select(
        "doc_id", "job_id", KIND,
        *[first[c].alias(c) for c in ("page_seq", "job_status")],
        F.concat(F.size("pages").cast("string"), F.lit(" pages")).alias("status_message"),
        first["page_count"].alias("page_count"),
        F.lit(None).cast(f"array<{types.BLOCK}>").alias("blocks"),
    )
    return whole.unionByName(given_up)


def timeout_rejects(found: DataFrame) -> DataFrame:
    """Rejects of the jobs that ``whole_jobs`` gave up; the detail is how many pages they had."""
    given_up = found.filter(F.col("kind") == "timeout")
    return reject_rows(given_up, "job", JOB_TIMEOUT, "status_message")
