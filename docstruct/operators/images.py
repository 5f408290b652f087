"""Image responses: feeds to one result per image, results to report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import images as fi
from ..functions.text import pct
from ..sources.sinks import reject_rows


def join_feeds(
    labels: DataFrame, text: DataFrame, faces: DataFrame, partial: bool = False
) -> DataFrame:
    """Three feeds of the same images, one row each.

    An image with a feed missing is left out, as its analysis failed (see ``feed_rejects``);
    ``partial`` keeps what is there.
    """
    how = "full_outer" if partial else "inner"
    return labels.join(text, "image_id", how).join(faces, "image_id", how)


def feed_rejects(labels: DataFrame, text: DataFrame, faces: DataFrame) -> DataFrame:
    """A reject for every image that some feed lacks; the detail names these feeds."""
    feeds = {"labels": labels, "text": text, "faces": faces}
    seen = None
    for name, feed in feeds.items():
        one = feed.select("image_id", F.lit(name).alias("feed"))
        seen = one if seen is None else seen.unionByName(one)
    missing = F.array_except(
        F.array(*map(F.lit, feeds)), F.when(F.col("image_id").isNotNull(), F.collect_set("feed"))
        .otherwise(F.array().cast("array<string>")),
    )
    images = seen.groupBy("image_id").agg(F.array_join(missing, ", ").alias("missing"))
    return reject_rows(
        images.filter("missing != ''").select(F.col("image_id").alias("doc_id"), "missing"),
        "feeds", "missing_feed", "missing",
    )


def image_results(
    records: DataFrame,
    threshold: float = fi.MIN_LABEL_CONFIDENCE,
    max_labels: int = fi.MAX_LABELS,
    sort_emotions: bool = False,
) -> DataFrame:
    """Shaped result of every image. Row-local: no shuffle."""
    kept = fi.top_labels(fi.min_confidence(F.col("Labels"), threshold), max_labels)
    return records.select(
        "case_id",
        "image_id",
        fi.labels(kept).alias("labels"),
        fi.foreground_colors(F.col("ImageProperties")).alias("dominant_colors"),
        fi.texts(fi.foreground_text(F.col("TextDetections"))).alias("text_detections"),
        fi.faces(F.col("FaceDetails"), sort_emotions).alias("faces"),
    )


def with_report_rows(results: DataFrame) -> DataFrame:
    rows = fi.report_rows(
        F.col("dominant_colors"), F.col("labels"), F.col("text_detections"), F.col("faces")
    )
    return results.select("case_id", "image_id", rows.alias("rows"))


def image_report(results: DataFrame) -> DataFrame:
    """Report rows of all images: colours, labels, text lines, faces.

    ``category_ord, pos`` give the order within an image; see ``report_order``.
    """
    return with_report_rows(results).select("case_id", "image_id", F.inline("rows"))


def display_report(report: DataFrame) -> DataFrame:
    return report.select(
        "image_id",
        "category_ord",
        "pos",
        F.col("category").alias("Category"),
        F.col("key").alias("Key"),
        F.col("value").alias("Value"),
        F.col("confidence_pct").alias("Confidence"),
    )


def report_order(report: DataFrame) -> DataFrame:
    """Sorted for reading. A range sort, so no image has to fit a task."""
    return report.orderBy("image_id", "category_ord", "pos")


def line_only(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col("type") == "LINE")


def number_faces(results: DataFrame) -> DataFrame:
    """One row per face, numbered ``Person 1..n`` in order of detection."""
    rows = results.select("case_id", "image_id", F.posexplode("faces").alias("pos", "face"))
    return rows.select(
        "case_id",
        "image_id",
        (F.col("pos") + 1).alias("person"),
        F.concat(F.lit("Person "), (F.col("pos") + 1).cast("string")).alias("key"),
        fi.face_text(F.col("face")).alias("value"),
        F.col("face.confidence").alias("confidence"),
        pct(F.col("face.confidence")).alias("confidence_pct"),
    )


def top_label_rows(rows: DataFrame, n: int = fi.MAX_LABELS) -> DataFrame:
    """Top labels of exploded rows ``image_id, pos, confidence``.

    The rank filter is pushed below the shuffle, so a task hands on at most ``n`` rows
    of an image.
    """
    place = W.partitionBy("image_id").orderBy(F.desc("confidence"), "pos")
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n)
