"""Rule-driven validation of parsed answers, and the typed record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from ..functions.json import COERCE, as_float, as_list, as_object, as_text
from ..functions.text import STRIP_SQL
from ..schemas.records import PATTERNS, RULES_OF_PATH, Record

# Characters of a mailbox name between dots, and a label of a domain.
_ATOM = r"(?U)^[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+\z"
_LABEL = r"(?U)^[\p{L}\p{N}]([\p{L}\p{N}-]*[\p{L}\p{N}])?\z"


def is_email(text: Column) -> Column:
    """One ``@``; before it atoms between single dots, 64 characters at most; after it two labels or more of
    63 characters at most, letters, digits and inner hyphens, the last one not all digits; 254 in all.

    Null for null.
    """
    sides = F.split(text, "@")
    local, labels = F.get(sides, 0), F.split(F.get(sides, 1), r"\.")
    return (
        (F.size(sides) == 2)
        & (F.length(text) <= 254)
        & (F.length(local) <= 64)
        & F.forall(F.split(local, r"\."), lambda a: a.rlike(_ATOM))
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: (F.length(x) <= 63) & x.rlike(_LABEL))
        & ~F.element_at(labels, -1).rlike(r"^[0-9]+\z")
    )


def _java(pattern: str) -> str:
    """Pattern text for Java: Unicode classes, and ``$`` only at the very end."""
    return "(?U)" + pattern.replace("$", r"\z")


def _broken(n: Column, r: Column) -> Column:
    """Whether rule ``r`` is broken by node ``n``, for rules on a single node."""
    v, kind, type_ = n["v"], n["kind"], r["type"]
    is_null = F.is_variant_null(v)
    text = as_text(v)
    typed = (
        F.when(type_ == "object", kind != "object")
        .when(type_ == "list", kind != "array")
        .when(kind != "scalar", F.lit(True))
    )
    for name, coerce in COERCE.items():
        typed = typed.when(type_ == name, coerce(v).isNull())
    pattern = F.element_at(r["args"], 1)
    mismatch = reduce(
        lambda acc, p: acc.when(pattern == p, ~text.rlike(_java(PATTERNS[p]))),
        PATTERNS,
        F.when(text.isNull(), F.lit(False)),
    )
    number = as_float(v)
    out_of_range = number.isNotNull() & (
        F.isnan(number) | (number < r["lo"]) | F.coalesce(number > r["hi"], F.lit(False))
    )
    rule = r["rule"]
    return (
        F.when(rule == "min_items", (kind == "array") & (F.size(as_list(v)) < r["lo"]))
        .when(kind.isin("object", "array") & ~rule.isin("type", "enum"), F.lit(False))
        .when(is_null, rule.isin("type", "enum") & ~r["nullable"])
        .when(rule == "type", typed)
        .when(rule == "enum", ~F.coalesce(F.array_contains(r["args"], text), F.lit(False)))
        .when(rule == "pattern", mismatch)
        .when(rule == "email", text.isNotNull() & ~F.coalesce(is_email(text), F.lit(False)))
        .when(rule == "range", out_of_range)
        .otherwise(F.lit(False))
    )


def _violations(n: Column, r: Column) -> Column:
    """Violations of one rule by one node. Missing and unknown keys come from the keys of the
    container itself."""
    v, rule, path = n["v"], r["rule"], n["path"]
    keys = F.map_keys(as_object(v))
    none = F.expr("cast(array() as array<string>)")
    names = (
        F.when(rule == "required", F.coalesce(F.array_except(r["args"], keys), none))
        .when(rule == "extra", F.coalesce(F.array_except(keys, r["args"]), none))
        .when(_broken(n, r), F.array(F.lit("")))
        .otherwise(none)
    )
    value = F.when(~rule.isin("required", "extra"), F.coalesce(as_text(v), F.to_json(v)))
    return F.transform(
        names,
        lambda name: F.struct(
            F.when(name == "", path)
            .when(path == "", name)
            .otherwise(F.concat(path, F.lit("."), name))
            .alias("path"),
            rule.alias("rule"),
            value.alias("value"),
        ),
    )


def violations_of(nodes: str, record: Record) -> Column:
    """Sorted array of ``path, rule, value``: the rules that an answer's nodes break.

    The rules are a constant map from normal path to rules, fixed by the schema.
    """
    rules = record.rules_by_path()
    none = F.expr(f"cast(array() as {RULES_OF_PATH})")
    found = F.transform(
        nodes,
        lambda n: F.flatten(
            F.transform(
                F.coalesce(F.try_element_at(rules, n["path_norm"]), none),
                lambda r: _violations(n, r),
            )
        ),
    )
    return F.array_sort(F.flatten(found))


def _cast_ddl(t: T.DataType) -> str:
    """Type to read a VARIANT as: texts as they are, other scalars still as VARIANT."""
    if isinstance(t, T.StructType):
        inner = ",".join(f"`{f.name}`:{_cast_ddl(f.dataType)}" for f in t.fields)
        return f"struct<{inner}>"
    if isinstance(t, T.ArrayType):
        return f"array<{_cast_ddl(t.elementType)}>"
    return "string" if isinstance(t, T.StringType) else "variant"


def _plain(sql: str) -> str:
    return f"replace({STRIP_SQL.format(f"try_variant_get({sql}, '$', 'string')")}, '_', '')"


def _typed(sql: str, t: T.DataType, depth: int = 0) -> str:
    """SQL that turns what ``_cast_ddl`` read into ``t``.

    Spark's own casts cover what valid answers hold, but for underscores, integral text
    with a decimal point, and on/off.
    """
    if isinstance(t, T.StructType):
        if all(isinstance(f.dataType, T.StringType) for f in t.fields):
            return sql
        fields = ", ".join(
            f"'{f.name}', {_typed(f'{sql}.`{f.name}`', f.dataType, depth)}" for f in t.fields
        )
        return f"if({sql} is null, null, named_struct({fields}))"
    if isinstance(t, T.ArrayType):
        x = f"x{depth}"
        return f"transform({sql}, {x} -> {_typed(x, t.elementType, depth + 1)})"
    if isinstance(t, T.StringType):
        return sql
    kind = t.simpleString()
    if isinstance(t, T.DoubleType):
        text = f"try_cast({_plain(sql)} as double)"
    elif isinstance(t, T.LongType):
        text = f"try_cast(try_cast({_plain(sql)} as decimal(38,6)) as bigint)"
    else:
        text = f"(lower(try_variant_get({sql}, '$', 'string')) = 'on')"
    return f"coalesce(try_variant_get({sql}, '$', '{kind}'), {text})"


def canonical(v: str, record: Record) -> Column:
    """Typed record of the valid answers in VARIANT column ``v``.

    Declared fields only, null where absent. The cast is bound to a lambda variable, so
    it is done once and not once per field.
    """
    t = record.struct()
    cast = f"try_variant_get({v}, '$', '{_cast_ddl(t)}')"
    return F.expr(f"element_at(transform(array({cast}), r -> {_typed('r', t)}), 1)")
