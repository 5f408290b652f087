"""Nested JSON to one row per path."""

from __future__ import annotations

import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.json import as_list, as_object, named_type

_NODES = (
    "array<struct<path:string,path_norm:string,v:variant,"
    "obj:map<string,variant>,arr:array<variant>>>"
)


def _node(path: Column, norm: Column, v: Column) -> Column:
    return F.struct(
        path.alias("path"),
        norm.alias("path_norm"),
        v.alias("v"),
        as_object(v).alias("obj"),
        as_list(v).alias("arr"),
    )


def _dotted(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _children(n: Column) -> Column:
    # Dots and brackets inside a key are escaped in the normal form, where they would
    # read as structure.
    members = F.transform(
        F.map_entries(n["obj"]),
        lambda e: _node(
            _dotted(n["path"], e["key"]),
            _dotted(n["path_norm"], F.regexp_replace(e["key"], r"([.\[\]\\])", r"\\$1")),
            e["value"],
        ),
    )
    elements = F.transform(
        n["arr"],
        lambda x, i: _node(
            F.concat(n["path"], F.lit("["), (i + 1).cast("string"), F.lit("]")),
            F.concat(n["path_norm"], F.lit("[]")),
            x,
        ),
    )
    return F.coalesce(members, elements, F.expr(f"cast(array() as {_NODES})"))


def _settled(n: Column, last: bool) -> Column:
    obj, arr = n["obj"], n["arr"]
    kind = F.when(obj.isNotNull(), "object").when(arr.isNotNull(), "array").otherwise("scalar")
    if last:
        kind = F.when((F.size(obj) > 0) | (F.size(arr) > 0), "truncated").otherwise(kind)
    return F.struct(n["path"], n["path_norm"], n["v"], kind.alias("kind"))


def with_nodes(df: DataFrame, col: str, max_depth: int, out: str) -> DataFrame:
    """Add ``out``, an array of every node of a VARIANT column: ``path, path_norm, v, kind``.

    The levels are opened one after the other inside the row, so every node is looked at
    once; nothing is shuffled. Kinds are ``object``, ``array``, ``scalar`` and, for a
    container below ``max_depth``, ``truncated``. Indexes in ``path`` start at 1.
    """
    # Rows without a value get no node. A filter would be pushed down to the scan and
    # parse the text a second time there.
    root = F.when(
        F.col(col).isNotNull(), F.array(_node(F.lit(""), F.lit(""), F.col(col)))
    ).otherwise(F.expr(f"cast(array() as {_NODES})"))
    rows = df.withColumn("level_0", root)
    levels = [f"level_{d}" for d in range(max_depth + 1)]
    for above, level in zip(levels, levels[1:], strict=False):
        rows = rows.withColumn(level, F.flatten(F.transform(above, _children)))
    settled = [F.transform(c, lambda n: _settled(n, last=False)) for c in levels[:-1]]
    deepest = F.transform(levels[-1], lambda n: _settled(n, last=True))
    return rows.withColumn(out, F.concat(*settled, deepest)).drop(*levels)


_LEAVES = T.ArrayType(
    T.StructType(
        [T.StructField(name, T.StringType()) for name in ("path", "value", "value_type")]
    )
)


def _scalar(x: object) -> tuple[str | None, str]:
    """Text and type name of a JSON scalar whose numbers were left as text."""
    if x is None:
        return None, "null"
    if isinstance(x, bool):
        return ("true" if x else "false"), "bool"
    return (x[1], x[0]) if isinstance(x, tuple) else (str(x), "str")


@F.arrow_udf(_LEAVES)
def _deep_leaves(found: pa.Array) -> pa.Array:
    """Leaves of the containers that a document has below the native levels."""
    read = json.JSONDecoder(
        parse_int=lambda t: ("int", t), parse_float=lambda t: ("float", t)
    ).decode
    nodes = found.flatten()
    containers = zip(nodes.field("path").to_pylist(), nodes.field("json").to_pylist(), strict=True)
    ends, paths, values, kinds = [0], [], [], []
    for n in found.value_lengths().to_pylist():
        for path, text in islice(containers, n or 0):
            todo = [(path, read(text))]
            while todo:
                at, x = todo.pop()
                if isinstance(x, dict):
                    todo += [(f"{at}.{k}" if at else k, v) for k, v in reversed(x.items())]
                elif isinstance(x, list):
                    todo += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x, 1)))]
                else:
                    value, kind = _scalar(x)
                    paths.append(at)
                    values.append(value)
                    kinds.append(kind)
        ends.append(len(paths))
    columns = [pa.array(c, pa.string()) for c in (paths, values, kinds)]
    rows = pa.StructArray.from_arrays(columns, ["path", "value", "value_type"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _kids(path: Column, v: Column) -> Column:
    """``path, v`` of what a container holds, null for a scalar."""
    members = F.transform(
        F.map_entries(as_object(v)),
        lambda e: F.struct(_dotted(path, e["key"]).alias("path"), e["value"].alias("v")),
    )
    elements = F.transform(
        as_list(v),
        lambda x, i: F.struct(
            F.concat(path, F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("path"), x.alias("v")
        ),
    )
    return F.coalesce(members, elements)


def _opened(n: Column, levels: int, containers: bool) -> Column:
    """``path, v, kind`` of the scalars below a node, and of containers that lie ``levels`` below it.

    Nodes are opened one within the other, so none is kept that is no leaf. With ``containers`` those of the levels
    are listed too.
    """
    def row(kind: Column) -> Column:
        return F.array(F.struct(n["path"].alias("path"), n["v"].alias("v"), kind.alias("kind")))

    own = row(F.when(as_object(n["v"]).isNotNull(), "object").otherwise("array")) if containers else None

    def found(kids: Column) -> Column:
        if levels:
            below = F.flatten(F.transform(kids, lambda k: _opened(k, levels - 1, containers)))
            below = F.concat(own, below) if containers else below
        else:
            below = F.when(F.size(kids) > 0, row(F.lit("truncated"))).otherwise(
                own if containers else F.filter(row(F.lit("")), lambda _: F.lit(False))
            )
        return F.when(kids.isNull(), row(F.lit("scalar"))).otherwise(below)

    # One element, so that the kids are made once for all that reads them.
    return F.get(F.transform(F.array(_kids(n["path"], n["v"])), found), F.lit(0))


def flatten_json(
    df: DataFrame,
    col: str,
    native_depth: int = 8,
    include_containers: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """``path, value, value_type`` of every scalar of a VARIANT column.

    Keys are joined with dots and list elements numbered from 1. Null gives a row, an
    empty object or array none, and a scalar root has the path ``''``. ``native_depth``
    levels are opened by SQL functions; what lies deeper is opened in Python, to any depth,
    with the same result. ``include_containers`` adds rows for the containers of the native
    levels.
    """
    keep = keep or ["doc_id"]
    root = F.struct(F.lit("").alias("path"), F.col(col).alias("v"))
    opened = F.when(F.col(col).isNotNull(), _opened(root, native_depth, include_containers))
    rows = df.select(*keep, opened.alias("nodes"))
    deeper = F.transform(
        F.filter("nodes", lambda n: n["kind"] == "truncated"),
        lambda n: F.struct(n["path"].alias("path"), F.to_json(n["v"]).alias("json")),
    )
    none = F.expr("cast(array() as array<struct<path:string,json:string>>)")
    native = F.transform(
        F.filter("nodes", lambda n: n["kind"] != "truncated"),
        lambda n: F.struct(
            n["path"].alias("path"), n["v"].alias("v"), n["kind"].alias("kind"),
            F.lit(None).cast("string").alias("deep"),
        ),
    )
    deep = F.transform(
        "deeper",
        lambda x: F.struct(
            x["path"].alias("path"), F.lit(None).cast("variant").alias("v"),
            x["value_type"].alias("kind"), x["value"].alias("deep"),
        ),
    )
    leaves = rows.withColumn("deeper", _deep_leaves(F.coalesce(deeper, none))).select(
        *keep, F.inline(F.concat(native, deep))
    ).withColumn("schema", F.when(F.col("kind") == "scalar", F.schema_of_variant("v")))
    v, kind = F.col("v"), F.col("kind")
    value_type = F.when(kind == "scalar", named_type(F.col("schema"))).otherwise(kind)
    text = F.when(v.isNull(), F.col("deep")).when(
        value_type == "str", F.try_variant_get(v, "$", "string")
    ).when(value_type != "null", F.to_json(v))
    return leaves.select(*keep, "path", text.alias("value"), value_type.alias("value_type"))
