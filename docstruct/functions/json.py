"""JSON columns: strict parsing to VARIANT, lax scalar coercion, dumping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Text accepted as a boolean, fixed values.
TRUE_TEXT = ["true", "t", "yes", "y", "on", "1"]
FALSE_TEXT = ["false", "f", "no", "n", "off", "0"]

_DIGITS = r"\d+(_\d+)*"
_FLOAT = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?\d+)?$"
_SPECIAL_FLOAT = r"(?i)^[+-]?(inf|infinity|nan)$"
_INT = rf"^[+-]?{_DIGITS}(\.0*)?$"


def parse_strict(col: Column) -> Column:
    """VARIANT of a text holding exactly one JSON value, otherwise null.

    Spark's parsers stop after the first value and accept what follows. Wrapping
    the text in an array and in an object closes that gap: after the first value
    only the end of the text fits both wraps.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), col, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), col, F.lit("}")))
    single = in_object.isNotNull() & F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(in_array, "$[0]", "variant"))


def as_object(v: Column) -> Column:
    """``map<string,variant>`` of a JSON object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    """``array<variant>`` of a JSON array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def scalar_type(v: Column) -> Column:
    """JSON type name of a scalar: str, int, float, bool or null."""
    return named_type(F.schema_of_variant(v))


def named_type(name: Column) -> Column:
    """The same of a scalar whose ``schema_of_variant`` is ``name``."""
    return (
        F.when(name == "STRING", "str")
        .when(name == "BOOLEAN", "bool")
        .when(name == "VOID", "null")
        .when(name == "BIGINT", "int")
        .when(name.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .otherwise("float")
    )


def as_text(v: Column) -> Column:
    """A JSON string as it is; no other type turns into text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(
        F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        F.try_variant_get(v, "$", "double"),
    )


def as_float(v: Column) -> Column:
    """Lax float: numbers, booleans and numeric text with underscores or blanks."""
    text = strip(as_text(v))
    parsed = F.when(
        text.rlike(_FLOAT) | text.rlike(_SPECIAL_FLOAT),
        F.regexp_replace(text, "_", "").try_cast("double"),
    )
    return F.coalesce(_number(v), as_flag(v).cast("double"), parsed)


def as_int(v: Column) -> Column:
    """Lax integer: integral numbers, booleans and integral text."""
    text = strip(as_text(v))
    parsed = F.when(
        text.rlike(_INT),
        F.regexp_replace(F.regexp_replace(text, "_", ""), r"\.0*$", "").try_cast("bigint"),
    )
    number = _number(v)
    exact = F.when(number == F.floor(number), F.try_variant_get(v, "$", "bigint"))
    return F.coalesce(exact, as_flag(v).cast("bigint"), parsed)


def as_flag(v: Column) -> Column:
    """A JSON boolean only."""
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def as_bool(v: Column) -> Column:
    """Lax boolean: booleans, 0 and 1, and the usual words in any case."""
    word = F.lower(as_text(v))
    number = _number(v)
    return F.coalesce(
        as_flag(v),
        F.when(word.isin(TRUE_TEXT) | (number == 1), F.lit(True)).when(
            word.isin(FALSE_TEXT) | (number == 0), F.lit(False)
        ),
    )


COERCE = {"str": as_text, "float": as_float, "int": as_int, "bool": as_bool}


def payload_json(col: Column) -> Column:
    return F.to_json(col, {"ignoreNullFields": "false"})


def record_json(col: Column) -> Column:
    """JSON of a typed record with every declared field, null ones included."""
    return F.to_json(col, {"ignoreNullFields": "false"})
