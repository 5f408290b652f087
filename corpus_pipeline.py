"""From raw documents to packed sequences: five stages, each an operator of ``docstruct.llm``.

Every stage takes (spark, docs, sf_dir) and gives the columns of ``documents`` but for the last one.
Its result is written and read back before the next stage.

In all stages columns beside ``doc_id``, ``text``, ``lang`` and ``source`` are carried along whatever their
names; they may be those that an operator gives its results. A null text counts as empty, texts of any length
are read whole, an empty table gives an empty table. What a stage does with nulls, ties and repeated
rows is said with it.

Stages that call Python lower the size of its batches for the rest of the session (``common.small_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstruct.llm import langid, mixing, packing, quality, simhash
from docstruct.llm.common import small_batches
from docstruct.llm.queries import language_model, quality_model, read, tokenizer_path
from docstruct.sources.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_QUALITY = 0.7
#: A text of which no language has half is rejected, as is one without letters.
MIN_LANGUAGE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``MIN_QUALITY``.

    Empty texts have a score like any other; rows are judged one by one, so repeated rows stay or go
    together. Without labels of both kinds every score is a share of labels, 0.5 for none.
    """
    small_batches(spark)
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model, docs["text"]) >= MIN_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has half or more.

    Null, empty and letterless texts have no language and go. Rows are judged one by one; a null ``lang``
    only teaches nothing. Without any ``lang`` all documents go.
    """
    small_batches(spark)
    model = language_model(docs)
    return docs.filter(langid.predict(model, docs["text"])["score"] >= MIN_LANGUAGE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link, with the shingles and radius of the operator.

    The smallest ``doc_id`` of a group stays, and one row of it if rows repeat it. Empty texts are one group;
    a group of null ids keeps one row.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled inside their shards.

    A null ``source`` is a source. Rows of one ``doc_id`` and source are drawn together, as often as each other.
    """
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset.

    An empty text is the end id alone; repeated rows, which the mix makes, are packed each by itself; ties in
    length are placed by digest and key. The result has the columns of the packing query.
    """
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fitted models, hash components and draws are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
