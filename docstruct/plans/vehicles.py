"""Vehicle images, licences and the cases they form."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json import payload_json
from ..operators.answers import build_prompt, parse_answers, structure_records
from ..operators.cases import ambiguous_rejects, pair_cases, single_inputs
from ..operators.enrich import enrich_with_model
from ..operators.images import feed_rejects, image_report, image_results, join_feeds
from ..operators.report import (
    IMAGE_ERROR,
    LICENCE_ERROR,
    NO_LICENCE,
    NO_STRUCTURED,
    NO_VEHICLE,
    with_status,
)
from ..schemas import VEHICLE
from ..sources.readers import with_answer_text
from ..sources.staging import stage
from .documents import extract_ids, id_payload, id_report
from .prompts import VEHICLE_TEMPLATE


class Images(NamedTuple):
    results: DataFrame
    report: DataFrame
    rejects: DataFrame


def analyze_images(
    labels: DataFrame, text: DataFrame, faces: DataFrame, partial: bool = False
) -> Images:
    """Results and report rows of images whose three feeds have landed, and rejects of the others.

    With ``partial`` an image counts with the feeds it has; its reject still names the others.
    """
    results = image_results(join_feeds(labels, text, faces, partial))
    return Images(results, image_report(results), feed_rejects(labels, text, faces))


def landed_inputs(inputs: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """Inputs without an ``error``, and ``case_id, error`` of all; ``step`` leads error texts.

    The column ``error`` is optional: the message of the service that failed on an input.
    """
    if "error" not in inputs.columns:
        return inputs, inputs.select("case_id", F.lit(None).cast("string").alias("error"))
    told = F.concat(F.lit(step), F.col("error")).alias("error")
    return inputs.filter(F.col("error").isNull()).drop("error"), inputs.select("case_id", told)


def vehicle_json() -> Column:
    """Payload of an image result; colours only where the response had any."""

    def part(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), payload_json(F.col(name)))

    parts = [part("labels"), F.when(F.col("dominant_colors").isNotNull(), part("dominant_colors")),
             part("text_detections"), part("faces")]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def case_prompts(results: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``case_id, prompt`` of cases with both inputs, and rejects of cases with too many.

    ``payloads``: ``case_id, payload`` of the licence. Results without any detection
    still count as present.
    """
    vehicles, many_images = single_inputs(results.select("case_id", vehicle_json().alias("vehicle")))
    licences, many_licences = single_inputs(payloads.select("case_id", "payload"))
    data = F.concat(
        F.lit('{"vehicle_analysis":'), F.col("vehicle"),
        F.lit(',"license_data":{"key_value_pairs":'), F.col("payload"), F.lit("}}"),
    )
    prompts = pair_cases(vehicles, licences).select(
        "case_id", build_prompt(data, VEHICLE_TEMPLATE, VEHICLE.json_schema()).alias("prompt")
    )
    crowded = ambiguous_rejects(many_images, "images").unionByName(
        ambiguous_rejects(many_licences, "licences")
    )
    return prompts, crowded


class Cases(NamedTuple):
    records: DataFrame
    rejects: DataFrame
    vehicle_report: DataFrame
    licence_report: DataFrame
    unstructured: DataFrame


def process_cases(
    cases: DataFrame,
    images: DataFrame,
    licences: DataFrame,
    call_factory: Callable[[dict], Callable[[str], str]],
    done: DataFrame | None = None,
) -> Cases:
    """Everything a case yields: record or reject, both reports, and a status text.

    ``cases`` lists the ``case_id`` expected, ``images`` are landed image records and
    ``licences`` licence results. The model is asked only about complete cases. Its
    responses are staged, so no prompt is sent twice; ``done`` holds ``prompt_sha, body`` of an
    earlier run. Cases with several images or licences are rejected as ambiguous. ``images`` and
    ``licences`` may have a column ``error``: such inputs give their text as status, and no result.
    """
    images, seen_images = landed_inputs(images, IMAGE_ERROR)
    licences, seen_licences = landed_inputs(licences, LICENCE_ERROR)
    results = image_results(images)
    pairs = stage(extract_ids(licences), "licence-pairs")
    owners = licences.select("case_id", "doc_id").distinct()
    payloads = id_payload(pairs, owners).join(owners, "doc_id")
    prompts, crowded = case_prompts(results, payloads)
    answered = stage(
        enrich_with_model(prompts, "prompt", call_factory, done, keep=["case_id"]), "responses"
    )
    parsed = parse_answers(with_answer_text(answered))
    records, rejects = structure_records(parsed, VEHICLE, ["case_id"])
    shown = id_report(pairs).join(owners, "doc_id")
    asked = prompts.select("case_id").unionByName(crowded.select("case_id"))
    missing = cases.select("case_id").join(asked, "case_id", "left_anti")
    return Cases(
        records,
        rejects.unionByName(crowded),
        with_status(cases, seen_images, image_report(results), NO_VEHICLE),
        with_status(cases, seen_licences, shown, NO_LICENCE),
        missing.withColumn("text", F.lit(NO_STRUCTURED)),
    )
