"""Readers with explicit schemas. JSON-lines by default, Parquet with ``fmt="parquet"``.

A JSON line that is torn or does not fit its schema is no row of a reader; ``read_rejects`` gives
these lines as rejects. Files are read as text and every line is parsed whole, so that what counts as
torn does not depend on the columns a query needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import types
from .sinks import reject_rows

FORM_EXTENSIONS = ("pdf",)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")


_TORN = "_torn_line"


def _parse(lines: DataFrame, ddl: str) -> DataFrame:
    """Fields of the JSON lines in ``value``, and the line itself where it could not be read."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TORN}
    parsed = F.from_json("value", f"{ddl}, {_TORN} string", options)
    # Inlined, or Catalyst would push filters below the parse and parse twice.
    return lines.filter(~F.col("value").rlike(r"^\s*$")).select(F.inline(F.array(parsed)))


def parse_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """Rows of the JSON lines in column ``value``; null, blank and torn lines give none."""
    return _parse(lines, ddl).filter(F.col(_TORN).isNull()).drop(_TORN)


def torn_lines(lines: DataFrame, ddl: str, key: str = "doc_id") -> DataFrame:
    """A reject for every line that ``parse_lines`` leaves out; its text is the detail.

    ``doc_id`` is the ``key`` of the line where that could still be read, else null.
    """
    torn = _parse(lines, ddl).filter(F.col(_TORN).isNotNull())
    return reject_rows(
        torn.select(F.col(key).alias("doc_id"), _TORN), "landing", "torn_line", _TORN
    )


def _read(spark: SparkSession, path: str, ddl: str, fmt: str) -> DataFrame:
    if fmt == "json":
        return parse_lines(spark.read.text(path), ddl)
    return spark.read.schema(ddl).format(fmt).load(path)


def read_rejects(spark: SparkSession, path: str, ddl: str, key: str = "doc_id") -> DataFrame:
    """Rejects of the torn lines under ``path``; ``ddl`` is the schema of ``types`` it is read with."""
    return torn_lines(spark.read.text(path), ddl, key)


def read_form_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Result pages of form jobs; ``page_seq`` is the order they were handed out in."""
    return _read(spark, path, types.FORM_PAGE, fmt)


def read_id_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Licence results, one page per document."""
    return _read(spark, path, types.ID_RESULT, fmt).withColumn(
        "page_seq", F.lit(0).cast("bigint")
    )


def read_image_results(
    spark: SparkSession, path: str, kind: str | None = None, fmt: str = "json"
) -> DataFrame:
    """One feed of image responses (``labels``, ``text``, ``faces``), or records of all three."""
    return _read(spark, path, types.IMAGE_FEEDS[kind] if kind else types.IMAGE_RECORD, fmt)


def read_model_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model answers with the text of their first content part."""
    return with_answer_text(_read(spark, path, types.MODEL_RESPONSE, fmt))


def with_answer_text(responses: DataFrame) -> DataFrame:
    """Add ``answer``; null where the body is no response envelope."""
    content = F.from_json("body", types.MODEL_BODY)["content"]
    return responses.withColumn("answer", F.get(content, 0)["text"])


_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _of_kind(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """``path, length, modificationTime`` by lower-cased extension; contents are never read."""
    extension = F.lower(F.substring_index("path", ".", -1))
    files = files.select("path", "length", "modificationTime")
    return files.filter(extension.isin([e.lower().lstrip(".") for e in extensions]))


def list_landed_files(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """All landed files of these kinds, in one listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _of_kind(files, extensions)


def stream_landed_files(
    spark: SparkSession, path: str, extensions: Sequence[str], files_per_batch: int = 10_000
) -> DataFrame:
    """Files as they land: a run takes those that no earlier run with its checkpoint has listed.

    The stream's own log knows what was listed; a batch is ``files_per_batch`` files at most, so the driver
    plans that many at a time.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return _of_kind(files, extensions)


def append_pages(*pages: DataFrame) -> DataFrame:
    """All pages of several landings; their order is in ``page_seq``."""
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


def _stream(spark: SparkSession, path: str, ddl: str, fmt: str) -> DataFrame:
    if fmt == "json":
        return parse_lines(spark.readStream.text(path), ddl)
    return spark.readStream.schema(ddl).format(fmt).load(path)


def stream_form_pages(
    spark: SparkSession, path: str, fmt: str = "json", schema: str = types.FORM_PAGE
) -> DataFrame:
    """Landed form pages as a file stream; torn lines are left out, see ``stream_rejects``."""
    return _stream(spark, path, schema, fmt)


def stream_image_results(
    spark: SparkSession, path: str, fmt: str = "json", kind: str | None = None
) -> DataFrame:
    """Landed image records as a file stream, all three feeds in one record, or one feed of them."""
    return _stream(spark, path, types.IMAGE_FEEDS[kind] if kind else types.IMAGE_RECORD, fmt)


def stream_rejects(
    spark: SparkSession, path: str, ddl: str = types.FORM_PAGE, key: str = "doc_id"
) -> DataFrame:
    """Rejects of the torn lines of a file stream of JSON lines."""
    return torn_lines(spark.readStream.text(path), ddl, key)


LANDED, TORN = "rows", "torn"


def land_lines(lines: DataFrame, ddl: str, path: str, mode: str = "append") -> None:
    """Parse the JSON lines in column ``value`` once and write typed rows and rejects to ``path``.

    Both are parts of one Parquet table, dealt by a partition column, so one job writes both and they
    appear together. ``read_landed`` gives the rows and ``landed_rejects`` the rejects; both read their own part
    and columns only.
    """
    parsed = _parse(lines, ddl)
    kind = F.when(F.col(_TORN).isNull(), LANDED).otherwise(TORN)
    parsed.withColumn("landed", kind).write.mode(mode).partitionBy("landed").parquet(path)


def read_landed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    rows = spark.read.schema(f"{ddl}, {_TORN} string, landed string").parquet(path)
    return rows.filter(F.col("landed") == LANDED).drop("landed", _TORN)


def landed_rejects(spark: SparkSession, path: str, ddl: str, key: str = "doc_id") -> DataFrame:
    rows = spark.read.schema(f"{ddl}, {_TORN} string, landed string").parquet(path)
    torn = rows.filter(F.col("landed") == TORN).select(F.col(key).alias("doc_id"), _TORN)
    return reject_rows(torn, "landing", "torn_line", _TORN)
