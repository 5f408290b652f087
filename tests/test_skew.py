"""Hot keys and bit maps on empty, sparse and skewed input."""

import pytest
from docstruct import types
from docstruct.operators import kv, membership, skew
from docstruct.operators.enrich import enrich_with_model, text_body
from docstruct.plans.documents import extract_forms, extract_ids, form_outputs
from docstruct.plans.vehicles import process_cases
from docstruct.streaming.ingest import ingest_forms
from pyspark.sql import functions as F
from test_kv import frame, page, word


@pytest.fixture(params=[True, False])
def adaptive(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param).lower())
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 200), (1000, 3)])
def test_hot_keys_of_few_rows(spark, adaptive, n, parts):
    rows = spark.range(n, numPartitions=parts).select(F.lit(7).cast("bigint").alias("hash")).repartition(parts)
    assert [r.hash for r in skew.hot_keys(rows, 100).collect()] == ([7] if n >= 100 else [])


def test_plans_without_blocks_or_rows(spark, adaptive):
    lone = frame(spark, [page("d", [word("w", "x")]), page("e", None)])
    for pages in (lone, lone.limit(0)):
        found = extract_forms(pages)
        assert found.kv.count() == 0 and found.rejects.count() == 0
        payloads, report = form_outputs(found.kv, found.docs)
        assert {r.payload for r in payloads.collect()} <= {"[]"} and report.count() == 0
        assert extract_ids(pages.select("doc_id", "page_seq", "blocks")).count() == 0
    prompts = spark.createDataFrame([], "doc_id string, prompt string")
    assert enrich_with_model(prompts, "prompt", lambda options: text_body).count() == 0


def test_payloads_deal_documents_once(spark):
    """Key texts meet and payloads are gathered where the document was dealt, giants with spread keys; same rows."""
    rows = [(f"d{i % 7}", i % 5, i, f"k{i * 13 % 4}", f"v{i}", i / 8, None if i % 3 else 1.5) for i in range(200)]
    rows += [("big", 1, i, f"k{i % 2}", "v", 0.5, 0.5) for i in range(150)]
    rows += [(None, 3, 1, "k", "a", 1.0, 1.0), (None, 2, 1, "k", "b", 1.0, 1.0), ("d1", 9, 9, None, "x", 1.0, 1.0)]
    rows += [rows[0], rows[0], rows[-1]]
    names = "doc_id string, page_seq bigint, pos int, key string, value string, key_confidence double, value_confidence double"
    pairs = spark.createDataFrame(rows, names).repartition(3).cache()
    first = {}
    for d, page_seq, pos, key, *_ in rows:
        if d is not None and key is not None:
            first[d, key] = min(first.get((d, key), (page_seq, pos)), (page_seq, pos))
    want = sorted((str(r), first.get((r[0], r[3]), (None, None))) for r in rows)
    for most in (10**6, 100, 20):
        ordered = kv.first_seen_order(pairs, most)
        got = [(str((r.doc_id, r.page_seq, r.pos, r.key, r.value, r.key_confidence, r.value_confidence)),
                (r.first_page_seq, r.first_pos)) for r in ordered.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    payloads = kv.kv_payload(kv.first_seen_order(pairs))
    plan = payloads._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    spread = kv.kv_payload(kv.first_seen_order(pairs, 20))
    assert sorted(map(str, payloads.collect())) == sorted(map(str, spread.collect()))


def test_cases_and_streams_without_rows(spark, tmp_path):
    images = spark.createDataFrame([], types.IMAGE_RECORD)
    licences = spark.createDataFrame([], "case_id string, doc_id string, page_seq bigint, blocks " + types.ID_RESULT.split("blocks ")[1])
    cases = spark.createDataFrame([("c",)], "case_id string")
    found = process_cases(cases, images, licences, lambda options: text_body)
    assert found.records.count() == 0 and found.rejects.count() == 0 and found.unstructured.count() == 1
    landed = str(tmp_path / "landed")
    frame(spark, [page("d", [word("w", "x")])]).write.parquet(landed)
    stream = spark.readStream.schema(types.FORM_PAGE).parquet(landed)
    ingest_forms(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.schema("doc_id string").parquet(str(tmp_path / "out/kv")).count() == 0


@pytest.mark.parametrize("words", [1, 4, 1 << 12])
def test_members_are_left_out_exactly(spark, tmp_path, words):
    """However full the map is, and with a key that holds a third of all rows."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(
            (F.col("id") % 500).cast("string")
        ).alias("k"),
        "id",
    )
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    listed = [str(i) for i in range(0, 500, 5)] + ["hot", "absent"]
    members = spark.createDataFrame([(m,) for m in listed], "k string")
    got = membership.without_members(rows, members, ["k"], ["id"], 500, words)
    assert got.columns == rows.columns
    want = [r.id for r in rows.filter(F.col("k").isNull() | ~F.col("k").isin(listed)).collect()]
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert membership.bit_map(members, ["k"], words).count() <= words
    assert membership.without_members(rows, members.limit(0), ["k"], ["id"], 500, words).count() == 6000
