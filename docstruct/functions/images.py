"""Row-local shaping of image-analysis responses.

Every function works on the arrays inside one record, so none of them moves rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import conf0, join_names, pct, round2

MIN_LABEL_CONFIDENCE = 70.0
MAX_LABELS = 50
MIN_TEXT_CONFIDENCE = 80.0
MIN_TEXT_AREA = 0.001
EMOTIONS_SHOWN = 3


def _or_empty(col: Column, element: str) -> Column:
    return F.coalesce(col, F.expr(f"cast(array() as array<{element}>)"))


def min_confidence(labels: Column, threshold: float = MIN_LABEL_CONFIDENCE) -> Column:
    """Raw labels at or above the threshold."""
    return F.filter(labels, lambda x: x["Confidence"] >= threshold)


def top_labels(labels: Column, n: int = MAX_LABELS) -> Column:
    """The ``n`` most confident raw labels; ties keep their order of arrival."""
    ranked = F.array_sort(
        F.transform(
            labels,
            lambda x, i: F.struct((-x["Confidence"]).alias("c"), i.alias("i"), x.alias("x")),
        ),
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["x"])


def labels(col: Column) -> Column:
    return F.transform(
        _or_empty(col, "struct<Name:string,Confidence:double,Categories:array<struct<Name:string>>>"),
        lambda x: F.struct(
            x["Name"].alias("name"),
            round2(x["Confidence"]).alias("confidence"),
            _or_empty(
                F.transform(x["Categories"], lambda c: c["Name"]), "string"
            ).alias("categories"),
        ),
    )


def color_name(color: Column) -> Column:
    return F.coalesce(color["SimplifiedColor"], color["CSSColor"], F.lit("Unknown"))


def foreground_colors(properties: Column) -> Column:
    """Dominant foreground colours; null when the response holds none."""
    return F.transform(
        properties["Foreground"]["DominantColors"],
        lambda c: F.struct(
            color_name(c).alias("color"),
            F.coalesce(c["HexCode"], F.lit("")).alias("hex"),
            round2(conf0(c["PixelPercent"])).alias("confidence"),
        ),
    )


def box_area(width: Column, height: Column) -> Column:
    return conf0(width) * conf0(height)


def foreground_text(
    col: Column, conf: float = MIN_TEXT_CONFIDENCE, area: float = MIN_TEXT_AREA
) -> Column:
    """Raw detections strictly above both bounds; a missing box has area 0."""
    return F.filter(
        col,
        lambda t: (t["Confidence"] > conf)
        & (
            box_area(
                t["Geometry"]["BoundingBox"]["Width"], t["Geometry"]["BoundingBox"]["Height"]
            )
            > area
        ),
    )


def texts(col: Column) -> Column:
    return F.transform(
        _or_empty(
            col,
            "struct<DetectedText:string,Type:string,Confidence:double,"
            "Geometry:struct<BoundingBox:struct<Width:double,Height:double>>>",
        ),
        lambda t: F.struct(
            t["DetectedText"].alias("detected_text"),
            t["Type"].alias("type"),
            round2(t["Confidence"]).alias("confidence"),
        ),
    )


def first_n(col: Column, n: int = EMOTIONS_SHOWN, sort: bool = False) -> Column:
    """First ``n`` entries in order of arrival, or by confidence with ``sort``."""
    if sort:
        col = F.transform(
            F.array_sort(
                F.transform(
                    col,
                    lambda x, i: F.struct((-x["Confidence"]).alias("c"), i.alias("i"), x.alias("x")),
                )
            ),
            lambda r: r["x"],
        )
    return F.slice(col, 1, n)


def faces(col: Column, sort_emotions: bool = False) -> Column:
    return F.transform(
        _or_empty(
            col,
            "struct<Confidence:double,AgeRange:struct<Low:int,High:int>,"
            "Gender:struct<Value:string>,Emotions:array<struct<Type:string,Confidence:double>>>",
        ),
        lambda f: F.struct(
            round2(f["Confidence"]).alias("confidence"),
            f["AgeRange"].alias("age_range"),
            f["Gender"]["Value"].alias("gender"),
            _or_empty(
                F.transform(
                    first_n(f["Emotions"], sort=sort_emotions),
                    lambda e: F.struct(
                        e["Type"].alias("type"), round2(e["Confidence"]).alias("confidence")
                    ),
                ),
                "struct<type:string,confidence:double>",
            ).alias("emotions"),
        ),
    )


def face_text(face: Column) -> Column:
    """One-line description; every unknown part reads ``N/A``."""
    unknown = F.lit("N/A")
    return F.concat(
        F.lit("Age: "),
        F.coalesce(face["age_range"]["Low"].cast("string"), unknown),
        F.lit("-"),
        F.coalesce(face["age_range"]["High"].cast("string"), unknown),
        F.lit(", Gender: "),
        F.coalesce(face["gender"], unknown),
        F.lit(", Emotions: "),
        join_names(F.transform(face["emotions"], lambda e: e["type"])),
    )


def _row(category: str, order: int, pos: Column, key: Column, value: Column, conf: Column):
    return F.struct(
        F.lit(order).alias("category_ord"),
        pos.cast("int").alias("pos"),
        F.lit(category).alias("category"),
        key.alias("key"),
        value.alias("value"),
        conf.alias("confidence"),
        pct(conf).alias("confidence_pct"),
    )


_REPORT_ROW = (
    "struct<category_ord:int,pos:int,category:string,key:string,value:string,"
    "confidence:double,confidence_pct:string>"
)


def report_rows(colors: Column, label_col: Column, text_col: Column, face_col: Column) -> Column:
    """All report rows of one image as an array: colours, labels, lines, faces.

    The four kinds are appended inside the record, so that the upstream is read
    once; exploding the result is the UNION ALL of the four projections.
    """
    parts = [
        F.transform(
            colors, lambda c, i: _row("Color", 1, i, c["color"], c["hex"], c["confidence"])
        ),
        F.transform(
            label_col,
            lambda x, i: _row(
                "Label", 2, i, x["name"], join_names(x["categories"]), x["confidence"]
            ),
        ),
        F.transform(
            F.filter(text_col, lambda t: t["type"] == "LINE"),
            lambda t, i: _row("Text", 3, i, t["detected_text"], t["type"], t["confidence"]),
        ),
        F.transform(
            face_col,
            lambda f, i: _row(
                "Face",
                4,
                i,
                F.concat(F.lit("Person "), (i + 1).cast("string")),
                face_text(f),
                f["confidence"],
            ),
        ),
    ]
    return F.concat(*[_or_empty(p, _REPORT_ROW) for p in parts])
