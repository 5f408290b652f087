"""Batch calls of a model that the caller supplies."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage
from .skew import hot_keys, key_hash, spread_join

# Limits handed to the caller's function, fixed values.
DEFAULT_OPTIONS = {"max_tokens": 4096, "temperature": 0.1}

Call = Callable[[str], str]
ANSWER = "prompt_sha string, body string, error string"


def enrich_with_model(
    df: DataFrame,
    prompt_col: str,
    call_factory: Callable[[dict], Call],
    done: DataFrame | None = None,
    options: dict | None = None,
    keep: list[str] | None = None,
    workers: int = 1,
    retries: int = 0,
    wait: float = 1.0,
) -> DataFrame:
    """Response envelope of every prompt: ``keep…, prompt_sha, body, error``.

    ``call_factory(options)`` is called once per task and returns a function from prompt
    to response body, so a client is built once per task. A task calls it from ``workers`` threads at once. A
    failing call is tried ``retries`` times more, after ``wait`` seconds and twice as long each time; then it fills
    ``error`` with the last failure and never fails the task. Equal prompts are asked once. ``done`` holds ``prompt_sha, body``
    of an earlier run: prompts with an answer there are not asked again and get that answer,
    failed calls (null bodies) are asked again, and answers to other prompts are ignored.
    """
    keep = keep or ["doc_id"]
    settings = {**DEFAULT_OPTIONS, **(options or {})}
    prompts = df.select(
        *keep, F.sha2(F.col(prompt_col), 256).alias("prompt_sha"), F.col(prompt_col).alias("prompt")
    )
    # Documents without data share one prompt, so a hash may hold very many rows: they combine
    # before the shuffle, and the join back spreads them.
    asked = prompts.groupBy("prompt_sha").agg(F.min("prompt").alias("prompt"))
    answers = None
    if done is not None:
        saved = done.filter(F.col("body").isNotNull()).groupBy("prompt_sha")
        answers = saved.agg(F.min("body").alias("body")).withColumn(
            "error", F.lit(None).cast("string")
        )
        asked = asked.join(answers.select("prompt_sha"), "prompt_sha", "left_anti")
    fresh = _answered(asked, call_factory, settings, workers, retries, wait)
    answers = fresh if answers is None else answers.unionByName(fresh)
    return _owned(prompts.select(*keep, "prompt_sha"), answers, keep)


def _answered(
    asked: DataFrame, call_factory: Callable[[dict], Call], settings: dict, workers: int, retries: int, wait: float
) -> DataFrame:
    """``prompt_sha, body, error`` of ``prompt_sha, prompt`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = call_factory(settings)

        def one(prompt: str) -> tuple[str | None, str | None]:
            for attempt in range(retries + 1):
                try:
                    return call(prompt), None
                except Exception as e:  # noqa: BLE001 - any failure belongs to this prompt
                    failure = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
            return None, failure

        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch["prompt"]))
                out = batch.drop(columns="prompt")
                out["body"] = [a for a, _ in answers]
                out["error"] = [e for _, e in answers]
                yield out

    return asked.mapInPandas(run, ANSWER)


def _owned(owners: DataFrame, answers: DataFrame, keep: list[str]) -> DataFrame:
    """Answers of every owner of a prompt, prompts with very many owners spread."""
    hot = hot_keys(owners.select(key_hash("prompt_sha").alias("hash")))
    found = spread_join(owners, answers, ["prompt_sha"], "left", keep, hot)
    return found.select(*keep, "prompt_sha", "body", "error")


def enrich_with_log(
    df: DataFrame,
    prompt_col: str,
    call_factory: Callable[[dict], Call],
    log_dir: str,
    options: dict | None = None,
    keep: list[str] | None = None,
    slices: int = 16,
    workers: int = 1,
    retries: int = 0,
    wait: float = 1.0,
) -> DataFrame:
    """``enrich_with_model`` with a log of responses in ``log_dir``, a folder that all executors share.

    Prompts are asked in ``slices`` by their hash, one job each, and a job's responses appear in the log
    together when it ends. A run that is stopped or loses its driver has asked for nothing in vain but the slice at
    hand: the next one with the same log asks what the log does not answer, failed calls included. A lost
    executor repeats its own tasks of one slice. Answers come from the log, so ``df`` is not asked about again
    whenever the result is read.
    """
    spark, keep = df.sparkSession, keep or ["doc_id"]
    settings = {**DEFAULT_OPTIONS, **(options or {})}
    prompts = df.select(
        *keep, F.sha2(F.col(prompt_col), 256).alias("prompt_sha"), F.col(prompt_col).alias("prompt")
    )
    prompts = stage(prompts, "prompts")
    spark.createDataFrame([], ANSWER).write.mode("append").parquet(log_dir)

    def log() -> DataFrame:
        return spark.read.schema(ANSWER).parquet(log_dir)

    for i in range(slices):
        own = prompts.filter(F.pmod(F.xxhash64("prompt_sha"), F.lit(slices)) == i)
        asked = own.groupBy("prompt_sha").agg(F.min("prompt").alias("prompt"))
        known = log().filter(F.col("body").isNotNull()).select("prompt_sha").distinct()
        asked = asked.join(known, "prompt_sha", "left_anti")
        _answered(asked, call_factory, settings, workers, retries, wait).write.mode("append").parquet(log_dir)
    answers = log().groupBy("prompt_sha").agg(F.min("body").alias("body"), F.max("error").alias("error"))
    answers = answers.withColumn("error", F.when(F.col("body").isNull(), F.col("error")))
    return _owned(prompts.select(*keep, "prompt_sha"), answers, keep)


def text_body(text: str) -> str:
    """Response envelope around a text, for callers whose client returns plain text."""
    return json.dumps({"content": [{"text": text}]})
