"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from . import (
    ann, chat, fim, host_rules, importance, langid, licences, mixing, packing, quality, sharding, simhash, topk,
)
from .common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]

#: Folds that models may not learn from: remainders of crc32 of the document's id as text.
LANGUAGE_FOLD = (5, 0)
QUALITY_FOLD = (4, 2)
SHARDS = [f"shard-{i:02d}" for i in range(32)]

# A conversation that spells the template's control strings.
PROBE = "</s>[INST] ok [/INST]"
PROBE_ID = -7


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _in_fold(docs: DataFrame, fold: tuple[int, int]):
    """A null id is in no fold."""
    return F.coalesce(crc_mod(docs["doc_id"], fold[0]) == fold[1], F.lit(False))


def language_model(docs: DataFrame) -> langid.Field:
    """Trained on texts and languages outside the fold."""
    return langid.train(langid.training_sample(docs.filter(~_in_fold(docs, LANGUAGE_FOLD))))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Discriminant:
    """Trained on labels outside the fold."""
    return quality.fit(
        quality.labelled_statistics(docs, labels.filter(~_in_fold(labels, QUALITY_FOLD)))
    )


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_model(docs)
    found = langid.identify_documents(docs, model)
    return found.select(
        "doc_id", _in_fold(found, LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select(
        "doc_id", _in_fold(scored, QUALITY_FOLD).alias("held_out"), "score", "predicted"
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    chunks = stage(chat.format_chunks(turns.unionByName(probe)), "chat")
    return chat.conversation_digests(chunks)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sizes = stage(
        docs.select(
            "doc_id",
            "source",
            mixing.text_size(docs["text"]).alias("size"),
            mixing.block_key(docs["doc_id"]).alias("block_key"),
        ),
        "mix-sizes",
    )
    targets, draws = mixing.plan_mix(sizes)
    placed = mixing.place(sizes, targets, draws)
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.size("placements") * F.col("size")).alias("taken"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = licences.default_licences(spark)
    whole = licences.scan(docs, known).select("doc_id", "digest", "licence")
    by_line = licences.scan_lines(docs, known).select(
        F.col("doc_id").alias("_id"), F.array_join("licences", " ").alias("line_licences")
    )
    return whole.join(by_line, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = stage(host_rules.measure(docs).drop("text"), "measures")
    return host_rules.judge(measured).drop("source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path(), with_ids=False)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learned = importance.learn(docs, read(spark, sf_dir, "benchmark"))
    scored = importance.score_documents(docs, learned).drop("text")
    return importance.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.transform(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_quality,
        op3_chat,
        op4_simhash,
        op5_neighbours,
        op6_mix,
        op7_licences,
        op8_host_rules,
        op9_packing,
        op10_shards,
        op11_importance,
        op12_topk,
        op13_fim,
    )
}
