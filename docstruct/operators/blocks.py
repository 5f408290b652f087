"""Analysis blocks: explode, classify, relate and de-duplicate."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import selection_mark
from .skew import spread_join

Mode = Literal["form", "id"]


# Output column and block field, fixed by the response format.
FIELDS = {
    "block_id": "Id",
    "block_type": "BlockType",
    "entity_types": "EntityTypes",
    "confidence": "Confidence",
    "text": "Text",
    "selection_status": "SelectionStatus",
    "relationships": "Relationships",
}


def explode_blocks(pages: DataFrame, *columns: str, deal: bool = False) -> DataFrame:
    """One row per block; ``(page_seq, pos)`` is its place in the document.

    ``columns`` names the block columns wanted. They are zipped field by field,
    because a scan leaves out unused fields of an array only in that form. ``deal`` deals the
    pages by ``doc_id`` first, with these columns only.
    """
    columns = columns or tuple(FIELDS)
    if "page_seq" not in pages.columns:
        pages = pages.withColumn("page_seq", F.lit(0).cast("bigint"))
    wanted = F.arrays_zip(*[F.col("blocks")[FIELDS[c]].alias(c) for c in columns])
    rows = pages.select("doc_id", F.col("page_seq").cast("bigint").alias("page_seq"), wanted.alias("wanted"))
    if deal:
        rows = rows.repartition("doc_id")
    # For an inner generator Catalyst asks for arrays with elements at the scan, and so makes them twice.
    rows = rows.select("doc_id", "page_seq", F.posexplode_outer("wanted")).filter(F.col("pos").isNotNull())
    return rows.select("doc_id", "page_seq", "pos", *[F.col(f"col.{c}").alias(c) for c in columns])


#: Gives the column of a block's field, by the names of ``FIELDS``.
Field = Callable[[str], Column]


def fields_of(block: Column) -> Field:
    """Fields of a block that is an element of an array."""
    return lambda name: block[FIELDS[name]]


def _entity(name: str, field: Field) -> Column:
    return F.coalesce(F.array_contains(field("entity_types"), name), F.lit(False))


def is_key(field: Field = F.col) -> Column:
    return (field("block_type") == "KEY_VALUE_SET") & _entity("KEY", field)


def is_value(mode: Mode, field: Field = F.col) -> Column:
    """``form``: every key/value block that is no key. ``id``: only marked values."""
    wanted = (field("block_type") == "KEY_VALUE_SET") & ~_entity("KEY", field)
    return wanted & _entity("VALUE", field) if mode == "id" else wanted


def key_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(is_key())


def value_blocks(blocks: DataFrame, mode: Mode) -> DataFrame:
    return blocks.filter(is_value(mode))


def untyped_documents(pages: DataFrame) -> DataFrame:
    """Documents with a key/value block that lacks its entity types."""
    blocks = F.arrays_zip(
        F.col("blocks")["BlockType"].alias("kind"), F.col("blocks")["EntityTypes"].alias("types")
    )
    untyped = F.exists(blocks, lambda b: (b["kind"] == "KEY_VALUE_SET") & b["types"].isNull())
    return pages.filter(untyped).select("doc_id").distinct()


def edges(blocks: DataFrame) -> DataFrame:
    """One row per related id, with the ordinals of relationship and id."""
    return (
        blocks.select("doc_id", "block_id", F.posexplode("relationships").alias("rel_pos", "rel"))
        .select(
            "doc_id",
            "block_id",
            F.col("rel.Type").alias("rel_type"),
            "rel_pos",
            F.posexplode("rel.Ids").alias("child_pos", "child_id"),
        )
    )


def related_ids(rel_type: str, relationships: Column | str = "relationships") -> Column:
    """All ids of one relationship type as an array, in order.

    The array comes out of the block's own cell: no join and no grouping.
    """
    col = F.col(relationships) if isinstance(relationships, str) else relationships
    wanted = F.filter(col, lambda r: (r["Type"] == rel_type) & r["Ids"].isNotNull())
    return F.coalesce(F.flatten(wanted["Ids"]), F.expr("cast(array() as array<string>)"))


def value_ids(mode: Mode, field: Field = F.col) -> Column:
    """Ids of the value blocks a key points at: the first one (``form``) or all (``id``)."""
    every = related_ids("VALUE", field("relationships"))
    return F.slice(every, 1, 1) if mode == "form" else every


def token(mode: Mode, field: Field = F.col) -> Column:
    """What a child adds to a text: its word, or ``X`` for a selected mark in forms."""
    word = F.when(field("block_type") == "WORD", field("text"))
    if mode == "id":
        return word
    return F.coalesce(word, selection_mark(field("block_type"), field("selection_status")))


def dedupe_blocks(blocks: DataFrame, *columns: str, place: bool = False) -> DataFrame:
    """One row per block id (and ``slot``): the last content, and with ``place`` the
    first position.

    Both aggregates combine on the map side, so an id repeated any number of times
    costs one row per task in the shuffle.
    """
    at = F.struct("page_seq", "pos")
    last = F.max(F.struct("page_seq", "pos", *columns)).alias("last")
    first = [F.min(at).alias("first")] if place else []
    return (
        blocks.groupBy("slot", "doc_id", "block_id")
        .agg(last, *first)
        .select(
            "slot",
            "doc_id",
            "block_id",
            *(["first.page_seq", "first.pos"] if place else []),
            *[F.col(f"last.{c}").alias(c) for c in columns],
        )
    )


def dangling(
    edge_rows: DataFrame, blocks: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Edges whose target id is no block of the document.

    An id that comes several times is found as well as one that comes once, so ids are only made distinct
    where ``hot`` ones are repeated for every salt.
    """
    known = blocks.select("doc_id", F.col("block_id").alias("child_id"))
    if hot is not None:
        known = known.distinct()
    place = ["block_id", "rel_type", "rel_pos", "child_pos"]
    return spread_join(edge_rows, known, ["doc_id", "child_id"], "left_anti", place, hot)
