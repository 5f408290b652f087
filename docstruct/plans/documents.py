"""Form and licence extraction over whole corpora."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import Mode, untyped_documents
from ..operators.jobs import gate_jobs, job_choice, job_states
from ..operators.kv import (
    PAIR_COLUMNS,
    by_size,
    first_seen_order,
    giant_documents,
    kv_payload,
    kv_report,
    nonempty_keys,
    pair_pages,
    size_classes,
)
from ..operators.membership import without_members
from ..operators.skew import MIN_HOT_ROWS, partitions_kept
from ..sources.sinks import reject_rows
from ..sources.staging import shared_dir, stage, stage_at


class Extracted(NamedTuple):
    kv: DataFrame
    rejects: DataFrame
    #: ``doc_id`` of every document that passed, with pairs or without.
    docs: DataFrame


def stored_by_document(
    pages: DataFrame, work: Callable[[DataFrame, DataFrame | None], DataFrame], name: str
) -> DataFrame:
    """``work(pages, hot)`` of pages dealt by ``doc_id``, stored once and read back.

    No row leaves its document's task but those of giant documents, for which ``work`` gets hot targets.
    """
    with partitions_kept(pages.sparkSession):
        return stage(by_size(pages, giant_documents(pages), lambda p: work(p, None), work), name)


def stored_pairs(
    pages: DataFrame,
    mode: Mode,
    min_hot_rows: int = MIN_HOT_ROWS,
    folder: str | None = None,
    sized: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """The pairs of ``pages``, written once to ``folder`` (a new one by default) and read back.

    Pairing runs here, with the partitioning by document kept through all of its joins. Giant documents are
    looked for in ``sized``, pages of which ``pages`` may be a part.
    """
    spark = pages.sparkSession
    giants, large = size_classes(pages if sized is None else sized, min_hot_rows)
    with partitions_kept(spark):
        pairs = pair_pages(pages, mode, giants, min_hot_rows, dealt, large)
        return stage_at(pairs, folder or shared_dir(spark, "pairs"))


def extract_forms(
    pages: DataFrame,
    min_hot_rows: int = MIN_HOT_ROWS,
    folder: str | None = None,
    dealt: bool = False,
) -> Extracted:
    """Key/value pairs of all finished form jobs, and the documents left out.

    The rejected documents and the pairs that remain are both read from the pairs, which are stored
    in between: in ``folder``, a path that all executors share, or in a folder of their own. Few
    documents are rejected, so they are stored beside the pairs, which leave them out through a bit map of
    fixed size. Pages are dealt by ``doc_id`` once for each set of columns, before they meet their jobs;
    ``dealt`` says that they are already.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "forms")
    placed = pages if dealt else pages.repartition("doc_id")
    ready, blocked, job_rejects = gate_jobs(placed)
    pairs = stored_pairs(ready, "form", min_hot_rows, f"{folder}/pairs", pages, dealt=True)
    # Blocked documents have no pairs: their pages were not read.
    lost = reject_rows(untyped_documents(ready), "blocks", "missing_entity_types").unionByName(
        reject_rows(pairs.filter("dangling").select("doc_id").distinct(), "pairing", "dangling_child")
    )
    lost = stage_at(lost, f"{folder}/rejects")
    spoilt = lost.select("doc_id").distinct()
    kv = without_members(pairs, spoilt, ["doc_id"], ["page_seq", "pos"], min_hot_rows)
    finished = job_choice(job_states(placed)).filter(F.col("chosen").isNotNull())
    docs = finished.select("doc_id").join(spoilt, "doc_id", "left_anti")
    return Extracted(kv.select(PAIR_COLUMNS), job_rejects.unionByName(lost), docs)


def form_outputs(kv: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Payload per document and display table of stored form pairs.

    ``docs`` (``doc_id``, see ``Extracted.docs``) lists the documents that passed: one without
    pairs then has an empty payload and is still asked about. Without it only documents with pairs
    have a payload.
    """
    return kv_payload(first_seen_order(kv), docs), kv_report(kv)


def extract_ids(
    results: DataFrame,
    min_hot_rows: int = MIN_HOT_ROWS,
    folder: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Key/value pairs of licences, pairs with an empty key included; stored as in ``extract_forms``."""
    return stored_pairs(results, "id", min_hot_rows, folder, dealt=dealt).select(PAIR_COLUMNS)


def id_report(pairs: DataFrame) -> DataFrame:
    return kv_report(nonempty_keys(pairs))


def id_payload(pairs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """JSON list of a licence's pairs in block order."""
    placed = pairs.withColumn("first_page_seq", F.col("page_seq")).withColumn(
        "first_pos", F.col("pos")
    )
    return kv_payload(placed, docs)
