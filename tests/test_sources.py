import json

import pytest
from pyspark.sql import functions as F

from docstruct import types
from docstruct.operators.cases import pair_cases, single_inputs
from docstruct.operators.enrich import enrich_with_model, text_body
from docstruct.operators.images import image_report, image_results
from docstruct.plans.answers import structure_forms
from docstruct.plans.documents import extract_forms, form_outputs
from docstruct.plans.vehicles import analyze_images, landed_inputs, process_cases
from docstruct.sources import readers
from docstruct.sources.sinks import (
    IMAGE_PREFIX,
    split_ok_rejects,
    with_landing_key,
    write_kv,
    write_records,
    write_rejects,
)
from docstruct.sources.staging import shared_dir
from docstruct.streaming.ingest import ingest_forms, stream_images, write_stream
from test_kv import CASES, frame, key, ordered, page, value, word


def lines(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


IMAGE = {
    "case_id": "c1", "image_id": "i1",
    "Labels": [{"Name": "Car", "Confidence": 99.0, "Categories": [{"Name": "Vehicles"}]}],
    "TextDetections": [{"DetectedText": "AB 12", "Type": "LINE", "Confidence": 95.0,
                        "Geometry": {"BoundingBox": {"Width": 0.5, "Height": 0.2}}}],
    "FaceDetails": [],
}


def test_json_readers(spark, tmp_path):
    forms = lines(tmp_path / "forms", [page(n, b) for n, b in CASES.items()])
    got = ordered(extract_forms(readers.read_form_pages(spark, forms)).kv)
    assert got == ordered(extract_forms(frame(spark, [page(n, b) for n, b in CASES.items()])).kv)
    ids = lines(tmp_path / "ids", [{"case_id": "c", "doc_id": "d", "blocks": []}])
    assert readers.read_id_results(spark, ids).collect()[0].page_seq == 0
    image = lines(tmp_path / "img", [IMAGE])
    for kind in types.IMAGE_FEEDS:
        assert readers.read_image_results(spark, image, kind).count() == 1
    row = readers.read_image_results(spark, image).collect()[0]
    assert row.Labels[0].Name == "Car" and row.ImageProperties is None
    bodies = [text_body("hi"), '{"content":[]}', '{"error":1}', "junk", None]
    answers = lines(tmp_path / "ans", [{"doc_id": str(i), "body": b} for i, b in enumerate(bodies)])
    rows = readers.read_model_responses(spark, answers).orderBy("doc_id").collect()
    assert [r.answer for r in rows] == ["hi", None, None, None, None]
    both = readers.append_pages(
        readers.read_form_pages(spark, forms), readers.read_form_pages(spark, forms)
    )
    assert both.count() == 2 * len(CASES)


def test_torn_lines(spark, tmp_path):
    good = [page(n, b) for n, b in CASES.items()]
    folder = tmp_path / "torn"
    folder.mkdir()
    whole = [json.dumps(p) for p in good]
    bad = [whole[0][:-9], "junk", '{"doc_id": "d", "page_seq": "one"}']
    (folder / "part.json").write_text("\n".join([*whole, "", *bad, "  "]))
    got = readers.read_form_pages(spark, str(folder))
    assert got.count() == len(good) and got.columns == frame(spark, good).columns
    rejects = readers.read_rejects(spark, str(folder), types.FORM_PAGE).collect()
    assert sorted(r.detail for r in rejects) == sorted(bad)
    assert {(r.stage, r.reason) for r in rejects} == {("landing", "torn_line")}
    assert "d" in {r.doc_id for r in rejects}


def test_images_with_feeds_missing(spark, tmp_path):
    path = {k: lines(tmp_path / k, rows) for k, rows in {
        "labels": [IMAGE, dict(IMAGE, image_id="i2")], "text": [IMAGE, dict(IMAGE, image_id="i3")],
        "faces": [IMAGE, dict(IMAGE, image_id="i2")]}.items()}
    feeds = [readers.read_image_results(spark, path[k], k) for k in ("labels", "text", "faces")]
    out = analyze_images(*feeds)
    assert [r.image_id for r in out.results.collect()] == ["i1"]
    assert sorted((r.doc_id, r.detail) for r in out.rejects.collect()) == [
        ("i2", "text"), ("i3", "labels, faces")
    ]
    assert analyze_images(*feeds, partial=True).results.count() == 3


def test_errors_of_inputs_are_told(spark):
    df = spark.createDataFrame(
        [("c1", None), ("c2", "timeout")], "case_id string, error string"
    )
    good, seen = landed_inputs(df, "step: ")
    assert [tuple(r) for r in good.collect()] == [("c1",)]
    assert sorted(map(tuple, seen.collect())) == [("c1", None), ("c2", "step: timeout")]
    _, seen = landed_inputs(df.drop("error"), "step: ")
    assert {r.error for r in seen.collect()} == {None}


def test_landed_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/b.PDF", "c.png", "d.JPEG", "e.txt"):
        (tmp_path / name).write_text("x")
    pdfs = readers.list_landed_files(spark, str(tmp_path), readers.FORM_EXTENSIONS)
    images = readers.list_landed_files(spark, str(tmp_path), readers.IMAGE_EXTENSIONS)
    assert pdfs.count() == 2 and images.count() == 2
    plan = pdfs._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    rows = with_landing_key(
        pdfs.withColumn("modificationTime", F.to_timestamp(F.lit("2024-03-05 06:07:08"))),
        IMAGE_PREFIX,
    ).collect()
    assert {r.landing_key for r in rows} == {
        "uploads/images/20240305060708_a.pdf", "uploads/images/20240305060708_b.PDF"
    }
    keyed = with_landing_key(pdfs, unique=True).select("landing_key").distinct()
    assert keyed.count() == 2


def test_sinks(spark, tmp_path):
    found = extract_forms(frame(spark, [page(n, b) for n, b in CASES.items()]))
    write_kv(found.kv, str(tmp_path / "kv"))
    write_rejects(found.rejects, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "kv")).count() == found.kv.count()
    assert spark.read.parquet(str(tmp_path / "rejects")).filter("stage = 'pairing'").count() == 1
    df = spark.createDataFrame([("1", None), ("2", "bad")], "doc_id string, reason string")
    ok, rejects = split_ok_rejects(df)
    assert [r.doc_id for r in ok.collect()] == ["1"] and rejects.count() == 1
    records = spark.range(1).select(
        F.lit("d").alias("doc_id"), F.struct(F.lit(None).cast("string").alias("a")).alias("record")
    )
    write_records(records, str(tmp_path / "rec"), "json")
    assert spark.read.json(str(tmp_path / "rec")).collect()[0].record_json == '{"a":null}'


def test_enrichment(spark):
    df = spark.createDataFrame([("1", "one"), ("2", "boom"), ("3", "three")], "doc_id string, p string")

    def factory(options):
        def call(prompt):
            if prompt == "boom":
                raise ValueError("no")
            return text_body(f"{prompt} {options['temperature']}")

        return call

    out = {r.doc_id: r for r in enrich_with_model(df, "p", factory).collect()}
    assert json.loads(out["1"].body)["content"][0]["text"] == "one 0.1"
    assert out["2"].body is None and out["2"].error == "ValueError: no"


def test_resume(spark):
    sha = F.sha2("p", 256).alias("prompt_sha")
    ddl = "doc_id string, p string"
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "new"), ("4", "failed")], ddl)
    done = spark.createDataFrame(
        [("1", "a", "saved"), ("9", "a", "saved"), ("3", "old", "stale"), ("x", "foreign", "leak"),
         ("4", "failed", None)],
        f"{ddl}, body string",
    ).select("doc_id", sha, "body")
    asked = enrich_with_model(df, "p", lambda options: lambda prompt: f"asked {prompt}", done)
    got = sorted((r.doc_id, r.body) for r in asked.collect())
    assert got == [("1", "saved"), ("2", "saved"), ("3", "asked new"), ("4", "asked failed")]


def test_documents_without_pairs_have_a_payload(spark):
    pages = [page(n, b) for n, b in CASES.items()] + [page("bad", [], 0, "FAILED", "x")]
    found = extract_forms(frame(spark, [*pages, page("plain", [word("w", "text")])]))
    rejected = {r.doc_id for r in found.rejects.collect()}
    docs = [r.doc_id for r in found.docs.collect()]
    assert sorted(docs) == sorted({*CASES, "plain"} - rejected) and "bad" in rejected
    payloads, _ = form_outputs(found.kv, found.docs)
    got = {r.doc_id: r.payload for r in payloads.collect()}
    assert sorted(got) == sorted(docs) and got["plain"] == "[]"


def test_structure_forms(spark):
    found = extract_forms(frame(spark, [page(n, b) for n, b in CASES.items()]))
    payloads, _ = form_outputs(found.kv)

    def factory(options):
        def call(prompt):
            if '"Alone"' in prompt:
                return text_body("```json\n" + json.dumps(
                    {"policy_term": {}, "named_insureds": [{"name": "Alone"}]}) + "\n```")
            return text_body("sorry")

        return call

    records, rejects = structure_forms(payloads, factory)
    assert [r.doc_id for r in records.collect()] == ["no_value"]
    assert rejects.filter("reason = 'parse_error'").count() == payloads.count() - 1


def licence(case, doc, blocks):
    return (case, doc, 0, blocks)


def test_process_cases(spark):
    images = spark.createDataFrame(
        [
            tuple(dict(IMAGE, ImageProperties=None, case_id=c, image_id=f"i{c}")[f]
                  for f in ("case_id", "image_id", "Labels", "ImageProperties", "TextDetections",
                            "FaceDetails"))
            for c in ("c1", "c2")
        ],
        types.IMAGE_RECORD,
    )
    blocks = [key("k", CHILD=["a"], VALUE=["v"]), value("v", CHILD=["b"]), word("a", "Name"),
              word("b", "Ann")]
    licences = spark.createDataFrame(
        [licence("c1", "d1", blocks), licence("c3", "d3", [])],
        f"case_id string, doc_id string, page_seq bigint, blocks array<{types.BLOCK}>",
    )
    licences = licences.unionByName(
        spark.createDataFrame([licence("c2", d, blocks) for d in ("d2", "d2b")], licences.schema)
    )
    failed = spark.createDataFrame([("c5", "timeout")], "case_id string, error string")
    images = images.unionByName(failed, allowMissingColumns=True)
    licences = licences.unionByName(failed.withColumn("doc_id", F.lit("d5")), allowMissingColumns=True)
    cases = spark.createDataFrame(
        [(c,) for c in ("c1", "c2", "c3", "c4", "c5")], "case_id string"
    )

    def factory(options):
        def call(prompt):
            data = json.loads(prompt.split("Data:\n")[1])
            name = data["license_data"]["key_value_pairs"][0]["value"]
            kind = data["vehicle_analysis"]["labels"][0]["name"]
            return text_body(json.dumps({"vehicle": {"type": kind}, "driver": {"name": name}}))

        return call

    out = process_cases(cases, images, licences, factory)
    rec = out.records.collect()
    assert [(r.case_id, r.record.vehicle.type, r.record.driver.name) for r in rec] == [
        ("c1", "Car", "Ann")
    ]
    assert [(r.case_id, r.reason, r.detail) for r in out.rejects.collect()] == [
        ("c2", "ambiguous_case", "2 licences")
    ]
    assert {r.case_id for r in out.unstructured.collect()} == {"c3", "c4", "c5"}
    texts = {(r.case_id, r.text) for r in out.vehicle_report.collect() if r.text}
    assert texts == {("c3", "No vehicle image uploaded"), ("c4", "No vehicle image uploaded"),
                     ("c5", "Rekognition analysis error: timeout")}
    texts = {(r.case_id, r.text) for r in out.licence_report.collect() if r.text}
    assert texts == {("c3", "No data extracted"), ("c4", "No license image uploaded"),
                     ("c5", "Textract analysis error: timeout")}


def test_cases_never_multiply(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "case_id string, x int")
    single, crowded = single_inputs(df)
    assert [r.case_id for r in single.collect()] == ["a"]
    assert [(r.case_id, r.n) for r in crowded.collect()] == [("b", 2)]
    assert pair_cases(single, single.withColumnRenamed("x", "y")).count() == 1


def test_form_stream_equals_batch(spark, tmp_path):
    pages = [page(n, b) for n, b in CASES.items()] + [page("bad", [], 0, "FAILED", "x")]
    path = lines(tmp_path / "landed", pages)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new
        ingest_forms(
            readers.stream_form_pages(spark, path), out, f"{out}/checkpoint"
        ).awaitTermination()
    batch = extract_forms(readers.read_form_pages(spark, path))
    assert ordered(spark.read.parquet(f"{out}/kv")) == ordered(batch.kv)
    streamed = spark.read.parquet(f"{out}/rejects").select("doc_id", "reason")
    assert sorted(streamed.collect()) == sorted(batch.rejects.select("doc_id", "reason").collect())
    # A later landing is picked up.
    (tmp_path / "landed" / "more.json").write_text(
        json.dumps(page("late", [key("k", CHILD=["a"]), word("a", "Late")]))
    )
    ingest_forms(
        readers.stream_form_pages(spark, path), out, f"{out}/checkpoint"
    ).awaitTermination()
    assert spark.read.parquet(f"{out}/kv").filter("doc_id = 'late'").count() == 1


def test_image_stream_equals_batch(spark, tmp_path):
    path = lines(tmp_path / "landed", [IMAGE, dict(IMAGE, image_id="i2")])
    out = str(tmp_path / "out")
    report = stream_images(readers.stream_image_results(spark, path))
    write_stream(report, out, str(tmp_path / "cp")).awaitTermination()
    batch = image_report(image_results(readers.read_image_results(spark, path)))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    assert batch.count() == 4


def test_shared_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base)
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


@pytest.mark.parametrize("name", ["entry"])
def test_entry(spark, name):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
