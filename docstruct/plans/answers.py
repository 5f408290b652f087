"""From key/value payloads to typed form records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.answers import build_prompt, parse_answers, prompt_chars, structure_records
from ..operators.enrich import enrich_with_model
from ..schemas import FORM, Record
from ..sources.readers import with_answer_text
from ..sources.staging import stage
from .prompts import FORM_TEMPLATE


def form_prompts(payloads: DataFrame, measured: bool = False) -> DataFrame:
    """A prompt per payload of ``kv_payload``; ``measured`` adds its length as ``chars``."""
    filled = (F.col("payload"), FORM_TEMPLATE, FORM.json_schema())
    chars = [prompt_chars(*filled).alias("chars")] if measured else []
    return payloads.select("doc_id", build_prompt(*filled).alias("prompt"), *chars)


def structure_saved(
    responses: DataFrame, schema: Record = FORM, keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of saved responses (``doc_id, body``)."""
    return structure_records(parse_answers(with_answer_text(responses)), schema, keep)


def structure_forms(
    payloads: DataFrame,
    call_factory: Callable[[dict], Callable[[str], str]],
    done: DataFrame | None = None,
    schema: Record = FORM,
) -> tuple[DataFrame, DataFrame]:
    """Ask the model about every payload, then records and rejects of its answers.

    Responses are staged, because both outputs read them and no prompt may be sent
    twice. ``done`` holds ``prompt_sha, body`` of an earlier run (see ``enrich_with_model``).
    """
    asked = enrich_with_model(form_prompts(payloads), "prompt", call_factory, done)
    return structure_saved(stage(asked, "responses"), schema)
