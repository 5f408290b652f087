"""Incremental runs over landed files.

Whole jobs and whole image records need no state. Jobs and images that land in parts are put together
by a table of what is open first, see ``held``, ``jobs`` and ``feeds``. It lies in the checkpoint's folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.images import image_report, image_results
from ..plans.documents import extract_forms
from ..sources.sinks import commit_batch
from ..sources.staging import drop_folder, shared_dir
from .feeds import gathered_feeds, gathered_records, gathered_rejects, landed_feeds
from .held import forget
from .jobs import timeout_rejects, whole_jobs


def write_batch(out_dir: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a batch and, after the last one, the batch's commit.

    A batch overwrites its own folders, so a retry doubles nothing. Readers that take committed batches
    only (``sinks.read_committed``) see all tables of a batch or none.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
    commit_batch(next(iter(tables.values())).sparkSession, out_dir, batch_id)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint_dir: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def _staged(df: DataFrame, name: str) -> Iterator[str]:
    """A shared folder that is deleted afterwards."""
    folder = shared_dir(df.sparkSession, name)
    try:
        yield folder
    finally:
        drop_folder(df.sparkSession, folder)


def ingest_forms(
    stream: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    dealt_pages: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Extract every batch of form pages to ``out_dir/kv`` and ``out_dir/rejects``.

    For landings that write a job once it is complete, so that all pages of a job are in one batch; see
    ``ingest_jobs`` for others. Pairs are stored once while both outputs are written, and deleted afterwards.
    ``dealt_pages`` makes the pages of a batch, dealt by ``doc_id``; a batch forgets how its stream was dealt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with _staged(batch, "form-pairs") as folder:
            pages = dealt_pages(batch) if dealt_pages else batch
            found = extract_forms(pages, folder=folder, dealt=dealt_pages is not None)
            write_batch(out_dir, batch_id, {"kv": found.kv, "rejects": found.rejects})

    return _start(stream, write, checkpoint_dir)


def ingest_jobs(
    stream: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    timeout_seconds: int = 24 * 3600,
    late_seconds: int = 3600,
) -> StreamingQuery:
    """``ingest_forms`` for pages of a job that land in several batches (see ``jobs.whole_jobs``).

    A job is extracted in the batch its last page lands in. Jobs given up are rejects as well.
    """
    held = f"{checkpoint_dir}/held"

    def write(batch: DataFrame, batch_id: int) -> None:
        with _staged(batch, "form-pairs") as folder:
            jobs = whole_jobs(batch, batch_id, held, timeout_seconds, late_seconds)
            found = extract_forms(jobs.filter("kind = 'page'").drop("kind"), folder=folder)
            rejects = found.rejects.unionByName(timeout_rejects(jobs))
            write_batch(out_dir, batch_id, {"kv": found.kv, "rejects": rejects})
        forget(batch, batch_id, held)

    return _start(stream, write, checkpoint_dir)


def gather_jobs(
    stream: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    timeout_seconds: int = 24 * 3600,
    late_seconds: int = 3600,
) -> StreamingQuery:
    """The rows of ``jobs.whole_jobs`` to ``out_dir/jobs``, nothing extracted."""
    held = f"{checkpoint_dir}/held"

    def write(batch: DataFrame, batch_id: int) -> None:
        jobs = whole_jobs(batch, batch_id, held, timeout_seconds, late_seconds)
        write_batch(out_dir, batch_id, {"jobs": jobs})
        forget(batch, batch_id, held)

    return _start(stream, write, checkpoint_dir)


def ingest_feeds(
    labels: DataFrame,
    text: DataFrame,
    faces: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    timeout_seconds: int = 24 * 3600,
    late_seconds: int = 3600,
) -> StreamingQuery:
    """Report rows and rejects of images whose feeds land apart, to ``out_dir/report`` and ``out_dir/rejects``."""
    held = f"{checkpoint_dir}/held"

    def write(batch: DataFrame, batch_id: int) -> None:
        images = gathered_feeds(batch, batch_id, held, timeout_seconds, late_seconds)
        report = image_report(image_results(gathered_records(images)))
        write_batch(out_dir, batch_id, {"report": report, "rejects": gathered_rejects(images)})
        forget(batch, batch_id, held)

    return _start(landed_feeds(labels, text, faces), write, checkpoint_dir)


def stream_images(stream: DataFrame) -> DataFrame:
    """Report rows of landed image records; row-local, append mode."""
    return image_report(image_results(stream))


def write_stream(df: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
