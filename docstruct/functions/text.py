"""Scalar text functions. All take and return Columns and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# All characters that count as blank: ASCII, the separator controls, Unicode spaces.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# The same as ``strip`` for SQL text.
STRIP_SQL = "btrim({}, '" + "".join(f"\\u{ord(c):04x}" for c in BLANKS) + "')"


def strip(col: Column) -> Column:
    """Remove blanks of any kind at both ends (plain ``trim`` removes spaces only)."""
    return F.trim(col, F.lit(BLANKS))


def strip_fences(col: Column) -> Column:
    """Remove a surrounding Markdown code fence.

    The steps are sequential, so both prefixes go if both are there, and no
    blanks are removed between the steps.
    """
    text = strip(col)
    for fence in (r"^```json", r"^```", r"```\z"):
        text = F.regexp_replace(text, fence, "")
    return strip(text)


def pct(col: Column) -> Column:
    """Two-decimal percent text such as ``97.30%``, rounding half up."""
    return F.concat(col.try_cast("decimal(18,2)").cast("string"), F.lit("%"))


def round2(col: Column) -> Column:
    return F.round(col, 2)


def conf0(col: Column) -> Column:
    """Confidence with a missing value read as 0."""
    return F.coalesce(col, F.lit(0.0))


def join_names(col: Column) -> Column:
    """Comma list of an array of names; null and empty both give ``''``."""
    return F.coalesce(F.array_join(col, ", "), F.lit(""))


def selection_mark(kind: Column, status: Column) -> Column:
    """``X`` for a selected selection element, otherwise null."""
    return F.when((kind == "SELECTION_ELEMENT") & (status == "SELECTED"), F.lit("X"))


def stamp(ts: Column) -> Column:
    """Second-resolution landing stamp, in the session time zone."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def as_date(col: Column, fmt: str = "MM/dd/yyyy") -> Column:
    """Parsed view of a date kept as text; null where it is no calendar date."""
    return F.try_to_date(col, fmt)
