"""Jobs and images that land in parts, commits of batches, one-pass landing."""

import datetime
import json

import pytest
from docstruct import types
from docstruct.operators.enrich import enrich_with_log, text_body
from docstruct.operators.images import feed_rejects, image_report
from docstruct.operators.jobs import job_states
from docstruct.operators.report import NO_FILE, UPLOAD_ERROR, form_status
from docstruct.operators.validate import is_email
from docstruct.plans.documents import extract_forms
from docstruct.plans.vehicles import analyze_images
from docstruct.sources import readers
from docstruct.sources.sinks import read_committed
from docstruct.streaming import ingest
from docstruct.streaming.feeds import gathered_feeds, landed_feeds
from docstruct.streaming.held import forget
from docstruct.streaming.ingest import ingest_feeds, ingest_forms, ingest_jobs
from docstruct.streaming.jobs import whole_jobs
from pyspark.sql import functions as F
from test_kv import CASES, frame, key, ordered, page, value, word

START = datetime.datetime(2024, 1, 1)
LANDED = types.FORM_PAGE + ", page_count bigint, landed_at timestamp"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(spark, folder, pages, hour, total):
    rows = [(*p.values(), total.get(p["doc_id"]), START + datetime.timedelta(hours=hour)) for p in pages]
    spark.createDataFrame(rows, LANDED).write.mode("append").parquet(folder)


def test_jobs_in_three_batches_equal_one(spark, tmp_path):
    """Every document of the hand-written cases over three landings; one job never ends."""
    parts = [[], [], []]
    for n, blocks in CASES.items():
        for i in range(3):
            parts[i].append(page(n, (blocks or [])[i::3], i, "SUCCEEDED" if i else "IN_PROGRESS"))
    parts[0] += [page("bad", [], 0, "FAILED", "x"), page("open", [word("w", "x")], 0)]
    parts[1] += [page("open", [word("v", "x")], 1)]
    total = {**dict.fromkeys(CASES, 3), "open": 9}
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(LANDED).parquet(folder)
    seen = []
    for hour, pages in enumerate(parts):
        land(spark, folder, pages, hour, total)
        ingest_jobs(stream(), out, f"{out}/check", 3600 * 24).awaitTermination()
        seen.append(read_committed(spark, out, "kv").count())
    assert seen[0] == seen[1] == 0 < seen[2]
    batch = extract_forms(frame(spark, [p for part in parts for p in part if p["doc_id"] != "open"]))
    assert ordered(read_committed(spark, out, "kv")) == ordered(batch.kv)
    land(spark, folder, [page("later", [], 0, "IN_PROGRESS")], 100, {})
    ingest_jobs(stream(), out, f"{out}/check", 3600 * 24).awaitTermination()
    rejects = read_committed(spark, out, "rejects").select("doc_id", "reason", "detail").collect()
    want = [tuple(r) for r in batch.rejects.select("doc_id", "reason", "detail").collect()]
    assert sorted(map(tuple, rejects), key=str) == sorted([*want, ("open", "job_timeout", "2 pages")], key=str)


def test_feeds_in_any_order(spark, tmp_path):
    label = {"Name": "Car", "Confidence": 90.0, "Categories": [{"Name": "V"}]}
    text = {"DetectedText": "T", "Type": "LINE", "Confidence": 99.0, "Geometry": {"BoundingBox": {"Width": 0.5, "Height": 0.5}}}
    bodies = {
        "labels": lambda i: {"case_id": f"c{i}", "image_id": f"i{i}", "Labels": [label], "ImageProperties": None},
        "text": lambda i: {"image_id": f"i{i}", "TextDetections": [text]},
        "faces": lambda i: {"image_id": f"i{i}", "FaceDetails": [{"Confidence": 80.0}]},
    }
    held = {"labels": [1, 2, 3, 5], "text": [1, 2, 4, 5, 5], "faces": [1, 4, 5]}
    hours = {"labels": 2, "text": 0, "faces": 1}
    feeds, folders = {}, {}
    for name, body in bodies.items():
        folders[name] = str(tmp_path / name)
        rows = spark.read.schema(types.IMAGE_FEEDS[name]).json(spark.sparkContext.parallelize([json.dumps(body(i)) for i in held[name]]))
        feeds[name] = rows.dropDuplicates(["image_id"])
        rows.withColumn("landed_at", F.lit(START + datetime.timedelta(hours=hours[name]))).write.parquet(folders[name])
    out = str(tmp_path / "out")

    def run():
        streams = [spark.readStream.schema(f"{types.IMAGE_FEEDS[n]}, landed_at timestamp").parquet(folders[n]) for n in bodies]
        ingest_feeds(*streams, out, f"{out}/check", 3600 * 24).awaitTermination()

    run()
    batch = analyze_images(*feeds.values())
    columns = image_report(batch.results).columns
    got = read_committed(spark, out, "report").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.report.select(columns).collect()))
    assert read_committed(spark, out, "rejects").count() == 0
    late = spark.createDataFrame([("i9", None, START + datetime.timedelta(hours=100))], f"{types.TEXT_FEED}, landed_at timestamp")
    late.write.mode("append").parquet(folders["text"])
    run()
    columns = ["doc_id", "stage", "reason", "detail"]
    got = read_committed(spark, out, "rejects").select(columns)
    assert sorted(got.collect()) == sorted(feed_rejects(*feeds.values()).select(columns).collect())
    assert read_committed(spark, out, "report").count() == batch.report.count()


def test_half_written_batches_are_not_seen(spark, tmp_path, monkeypatch):
    """A failure between the two tables of a batch; the retry makes it whole."""
    folder, out = str(tmp_path / "landed"), str(tmp_path / "out")
    frame(spark, [page("a", [key("k", CHILD=["w"]), word("w", "One")])]).write.parquet(folder)
    stream = lambda: spark.readStream.schema(types.FORM_PAGE).parquet(folder)
    ingest_forms(stream(), out, f"{out}/check").awaitTermination()
    frame(spark, [page("b", [key("k", CHILD=["w"]), word("w", "Two")])]).write.mode("append").parquet(folder)
    whole = ingest.write_batch

    def half(out_dir, batch_id, tables):
        tables["kv"].write.mode("overwrite").parquet(f"{out_dir}/kv/batch_id={batch_id}")
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "write_batch", half)
    with pytest.raises(Exception, match="lost"):
        ingest_forms(stream(), out, f"{out}/check").awaitTermination()
    assert spark.read.parquet(f"{out}/kv").count() == 2
    assert [r.doc_id for r in read_committed(spark, out, "kv").collect()] == ["a"]
    monkeypatch.setattr(ingest, "write_batch", whole)
    ingest_forms(stream(), out, f"{out}/check").awaitTermination()
    assert sorted(r.doc_id for r in read_committed(spark, out, "kv").collect()) == ["a", "b"]


def test_lines_are_parsed_once(spark, tmp_path):
    good = page("a", [key("k", VALUE=["v"]), value("v")])
    lines = [json.dumps(good), '{"doc', "", json.dumps({**good, "page_seq": "first"}), None]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    path = str(tmp_path / "landed")
    readers.land_lines(table, types.FORM_PAGE, path)
    rows = readers.read_landed(spark, path, types.FORM_PAGE)
    assert [(r.doc_id, len(r.blocks)) for r in rows.collect()] == [("a", 2)]
    torn = readers.landed_rejects(spark, path, types.FORM_PAGE)
    assert sorted(torn.collect(), key=str) == sorted(readers.torn_lines(table, types.FORM_PAGE).collect(), key=str)
    assert torn.count() == 2
    plan = rows.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "ReadSchema: struct<doc_id:string>" in plan and "landed" in plan
    empty = str(tmp_path / "empty")
    readers.land_lines(table.limit(0), types.FORM_PAGE, empty)
    assert readers.read_landed(spark, empty, types.FORM_PAGE).count() == 0


def test_response_log(spark, tmp_path):
    """What one run was told is not asked again, whichever run reads it; failed calls are."""
    log, asked = str(tmp_path / "log"), tmp_path / "asked"
    asked.mkdir()
    df = spark.createDataFrame([(str(i), f"p{i % 10}") for i in range(40)], "doc_id string, p string")

    def factory(options):
        def call(prompt):
            (asked / f"{options['run']}-{prompt}-{len(list(asked.iterdir()))}").write_text("")
            if options["run"] == 1 and prompt in ("p1", "p2"):
                raise OSError("busy")
            if prompt == "p3":
                raise OSError("never")
            return text_body(f"run {options['run']}")

        return call

    first = enrich_with_log(df, "p", factory, log, {"run": 1}, slices=3, retries=2, wait=0.01, workers=3)
    assert first.count() == 40 and first.filter("error = 'OSError: busy'").count() == 8
    second = enrich_with_log(df, "p", factory, log, {"run": 2}, slices=3)
    got = {r.doc_id: (r.body and json.loads(r.body)["content"][0]["text"], r.error) for r in second.collect()}
    assert {got[str(i)] for i in range(40) if i % 10 in (1, 2)} == {("run 2", None)}
    assert {got[str(i)] for i in range(40) if i % 10 not in (1, 2, 3)} == {("run 1", None)}
    assert got["3"] == (None, "OSError: never")
    assert {f.name.split("-")[1] for f in asked.iterdir() if f.name[0] == "2"} == {"p1", "p2", "p3"}
    assert sum(f.name.startswith("1-p1-") for f in asked.iterdir()) == 3  # twice more after a failure
    second.count()
    assert sum(f.name.startswith("2-p1-") for f in asked.iterdir()) == 1


def test_form_states(spark):
    ids = spark.createDataFrame([(x,) for x in ["none", "up", "wait", "run", "bad", "rej", "ok", None, "ok"]], "doc_id string")
    landed = spark.createDataFrame(
        [(x, None) for x in ["wait", "run", "bad", "rej", "ok"]] + [("up", "denied"), ("up", None)], "doc_id string, error string"
    )
    pages = [page("run", [], 0, "IN_PROGRESS"), page("bad", [], 0, "FAILED"), page("rej", []), page("ok", [])]
    docs = spark.createDataFrame([("ok",), ("ok",)], "doc_id string")
    got = {r.doc_id: (r.state, r.kind, r.text) for r in form_status(ids, landed, job_states(frame(spark, pages)), docs).collect()}
    assert got == {
        "none": ("missing", "Message", NO_FILE), "up": ("upload_error", "Error", UPLOAD_ERROR + "denied"),
        "wait": ("waiting", None, None), "run": ("running", None, None), "bad": ("failed", "Error", "Unknown error"),
        "rej": ("rejected", None, None), "ok": ("done", None, None),
    }


def test_addresses(spark):
    good = ["a@b.cd", "first.last+x@sub.example.org", "ü@größe.de", "x" * 64 + "@b.cd", "a@" + "l" * 63 + ".cd", "a@1-2.io"]
    bad = ["", "a", "a@b", "@b.cd", "a@", "a@b@c.de", "a b@c.de", ".a@b.cd", "a.@b.cd", "a..b@c.de", "a@.b.cd", "a@b.cd.",
           "a@-b.cd", "a@b-.cd", "a@b_c.de", "a@b.12", "x" * 65 + "@b.cd", "a@" + "l" * 64 + ".cd", "a@b.cd\n", "a@" + "b." * 130 + "cd"]
    table = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "t string")
    found = {r.t: r.v for r in table.select("t", is_email(F.col("t")).alias("v")).collect()}
    assert found == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False), None: None}


def test_files_are_listed_once(spark, tmp_path):
    landed, out = tmp_path / "in", str(tmp_path / "out")
    (landed / "deep").mkdir(parents=True)
    stream = lambda: readers.stream_landed_files(spark, str(landed), ["pdf", ".PNG"], 1)
    runs = []
    for names in (["a.pdf", "deep/b.PDF", "c.txt"], ["d.png", "e.pdf.bak"], []):
        for n in names:
            (landed / n).write_bytes(b"12345")
        ingest.write_stream(stream(), out, f"{out}-check").awaitTermination()
        runs.append(sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect()))
    assert runs == [["a.pdf", "b.PDF"], ["a.pdf", "b.PDF", "d.png"], ["a.pdf", "b.PDF", "d.png"]]
    assert {r.length for r in spark.read.parquet(out).collect()} == {5}
    assert "content" not in stream().columns


def test_open_jobs_without_python(spark, tmp_path):
    """Batches of open jobs as plain tables: a retry changes nothing, late pages are left out, names may be null."""
    folder = str(tmp_path / "held")

    def step(batch_id, hour, pages):
        rows = [(*p.values(), t, START + datetime.timedelta(hours=hour + h)) for p, t, h in pages]
        found = whole_jobs(spark.createDataFrame(rows, LANDED), batch_id, folder, 3600 * 24)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        forget(found, batch_id, folder)
        return sorted((r.doc_id, r.kind, r.page_seq, r.status_message) for r in found.collect())

    first = [(page("a", [word("w", "x")], 0), 2, 0), (page("open", [], 0), 2, 0), (page("bad", [], 3, "FAILED", "x"), None, 0)]
    assert step(0, 0, first) == [("bad", "page", 3, "x")]
    second = [(page("a", [], 1), None, 0), (page("late", [], 0), 1, -10), ({**page("n", [], 0), "job_id": None}, 1, 0)]
    want = [("a", "page", 0, None), ("a", "page", 1, None), ("late", "page", 0, None), ("n", "page", 0, None)]
    assert step(1, 8, second) == [w for w in want if w[0] != "late"]
    assert step(1, 8, second) == [w for w in want if w[0] != "late"]
    assert step(2, 9, []) == []
    assert step(3, 40, [(page("later", [], 0, "IN_PROGRESS"), None, 0)]) == [("open", "timeout", 0, "1 pages")]
    assert step(4, 90, [(page("z", [], 0, "FAILED"), None, 0)]) == [("later", "timeout", 0, "1 pages"), ("z", "page", 0, None)]


def test_open_images_without_python(spark, tmp_path):
    """An image that has come out does so once; the first landing of a feed counts, later ones and retries do not."""
    folder = str(tmp_path / "held")

    def feed(name, rows, hour):
        df = spark.read.schema(types.IMAGE_FEEDS[name]).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
        return df.withColumn("landed_at", F.lit(START + datetime.timedelta(hours=hour)))

    def step(batch_id, hour, labels=(), text=(), faces=()):
        landed = landed_feeds(feed("labels", labels, hour), feed("text", text, hour), feed("faces", faces, hour))
        found = gathered_feeds(landed, batch_id, folder, 3600 * 24)
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        return sorted((r.image_id, r.missing, r.labels and r.labels.case_id) for r in found.collect())

    one = {"image_id": "i"}
    assert step(0, 0, [{**one, "case_id": "first"}], [one, {"image_id": "j"}, {"image_id": None}]) == []
    for _ in range(2):
        assert step(1, 1, [{**one, "case_id": "again"}], faces=[one]) == [("i", None, "first")]
    assert step(2, 2, [{**one, "case_id": "x"}], [one], [one]) == []
    assert step(3, 60, text=[{"image_id": "k"}]) == [("j", "labels, faces", None)]
    assert step(4, 61, [{**one, "case_id": "new"}], [one], [one]) == [("i", None, "new")]
