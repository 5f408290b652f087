"""Images whose three feeds land as separate streams, put together in a table of open images.

One row an image holds what has landed of it. The image comes out when its last feed lands; one that
lacks a feed for too long is given up, and the feeds that are missing are named. Feeds may land in any order
and any batch. One row an image replaces a chain of two outer joins, each of which would keep both of its
sides until the watermark had passed, whole images included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import types
from ..sources.sinks import reject_rows
from .held import KIND, take_batch

FEEDS = ("labels", "text", "faces")


def _fields(name: str) -> str:
    return f"struct<{types.IMAGE_FEEDS[name]}>"


_SCHEMA = "image_id string, " + "".join(f"{f} {_fields(f)}, " for f in FEEDS) + f"last timestamp, {KIND} string"


def landed_feeds(labels: DataFrame, text: DataFrame, faces: DataFrame) -> DataFrame:
    """The three streams as one: ``image_id, landed_at`` and a struct for each feed, one of them not null.

    Null image ids are left out.
    """
    landed = None
    for name, feed in zip(FEEDS, (labels, text, faces)):
        own = F.struct(*[c for c in feed.columns if c != "landed_at"]).cast(_fields(name))
        one = feed.filter(F.col("image_id").isNotNull()).select(
            "image_id", "landed_at",
            *[(own if f == name else F.lit(None).cast(_fields(f))).alias(f) for f in FEEDS],
        )
        landed = one if landed is None else landed.unionByName(one)
    return landed


def _open_images(left: DataFrame, fresh: DataFrame, before: Column) -> DataFrame:
    """Every image known, and its kind: ``whole``, ``missing``, ``held``, or ``gone`` if it has come out before.

    Of a feed that landed several times the first counts. Images that have come out are remembered, without
    their feeds, until nothing of them has landed for too long.
    """
    held = F.col(KIND) == "held"
    # Landings follow what is held already.
    known = left.filter(F.col(KIND) != "missing").select(
        "image_id", "last", *[F.when(held, F.col(f)).alias(f) for f in FEEDS],
        (~held).alias("gone"), F.lit(0).alias("turn"),
    )
    landed = fresh.select(
        "image_id", F.col("landed_at").alias("last"), *FEEDS, F.lit(False).alias("gone"), F.lit(1).alias("turn")
    )
    order = F.struct("turn", "last")
    images = known.unionByName(landed).groupBy("image_id").agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in FEEDS],
        F.max("last").alias("last"),
        F.bool_or("gone").alias("gone"),
    )
    complete = F.lit(True)
    for f in FEEDS:
        complete = complete & F.col(f).isNotNull()
    late = F.coalesce(F.col("last") <= before, F.lit(False))
    kind = (
        F.when(F.col("gone"), "gone").when(complete, "whole").when(late, "missing").otherwise("held")
    )
    rows = images.filter(~(F.col("gone") & late)).withColumn(KIND, kind)
    kept = [F.when(F.col(KIND) != "gone", F.col(f)).alias(f) for f in FEEDS]
    return rows.select("image_id", *kept, "last", KIND)


def gathered_feeds(
    batch: DataFrame, batch_id: int, folder: str, timeout_seconds: int = 24 * 3600, late_seconds: int = 3600
) -> DataFrame:
    """``image_id, missing`` and a struct for each feed, from a batch of ``landed_feeds``.

    A row with a null ``missing`` is a whole image. An image that still lacks feeds when its last one landed
    ``timeout_seconds`` and ``late_seconds`` before the newest of all gives one row that names them. A feed that
    lands again counts once, the first time. ``folder``, which all executors share, holds the open images.
    """
    found = take_batch(batch, batch_id, folder, _SCHEMA, timeout_seconds, late_seconds, _open_images)
    names = F.concat_ws(", ", *[F.when(F.col(f).isNull(), F.lit(f)) for f in FEEDS])
    return found.filter(F.col(KIND).isin("whole", "missing")).select(
        "image_id", F.when(F.col(KIND) == "missing", names).alias("missing"), *FEEDS
    )


def gathered_records(gathered: DataFrame) -> DataFrame:
    """Image records (``types.IMAGE_RECORD``) of the whole images."""
    return gathered.filter(F.col("missing").isNull()).select(
        "labels.case_id", "image_id", "labels.Labels", "labels.ImageProperties", "text.TextDetections",
        "faces.FaceDetails",
    )


def gathered_rejects(gathered: DataFrame) -> DataFrame:
    """Rejects of the images given up; the detail names the missing feeds."""
    lost = gathered.filter(F.col("missing").isNotNull())
    return reject_rows(lost.select(F.col("image_id").alias("doc_id"), "missing"), "feeds", "missing_feed", "missing")
