"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space that parts words: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows that goes to Python; Spark's own limit allows 10,000 texts of any size.
BATCH_BYTES = "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

T = TypeVar("T")
#: What this Python worker remembers from task to task, of one operator at a time.
_REMEMBERED: dict[object, object] = {}


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about ``BATCH_BYTES``, unless the session sets a limit itself.

    Executor and worker each hold a batch several times over, so many wide rows would cost them hundreds of MB. The
    setting is read when a plan is made ready to run, after its operator has returned, so it stays set.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def give_back() -> None:
    """Return memory that this process no longer uses to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def remembered(name: object, make: Callable[[], T]) -> T:
    """What a worker keeps under ``name`` between tasks; it forgets what others have kept."""
    if name not in _REMEMBERED:
        forget()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    """Drop what operators have kept in this worker."""
    _REMEMBERED.clear()
    give_back()


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns, in any spelling of case, that a result column is about to replace."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def ascii_lower(text: Column) -> Column:
    return F.translate(
        text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))
