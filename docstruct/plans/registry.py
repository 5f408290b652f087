"""The registered queries. Each reads whole tables of ``sf_dir``; see ``oracles`` for SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import types
from ..functions import images as fi
from ..functions.json import record_json
from ..functions.text import as_date, pct, strip_fences
from ..operators.answers import (
    attach_records,
    build_prompt,
    judge_answers,
    judged_reason,
    locate_error,
    parse_answers,
    record_violations,
    structure_records,
)
from ..operators.blocks import dangling, edges, explode_blocks, key_blocks, value_blocks
from ..operators.cases import pair_cases, single_inputs
from ..operators.enrich import enrich_with_log, enrich_with_model, text_body
from ..operators.flatten import flatten_json
from ..operators.images import (
    display_report,
    feed_rejects,
    image_report,
    image_results,
    join_feeds,
    number_faces,
    top_label_rows,
)
from ..operators.jobs import failed_jobs, job_choice, job_states
from ..operators.kv import (
    block_text,
    first_seen_order,
    group_kv,
    kv_payload,
    tokens,
)
from ..operators.report import IMAGE_ERROR, NO_LICENCE, NO_VEHICLE, form_status, status_rows
from ..operators.validate import is_email
from ..schemas import FORM
from ..sources.readers import (
    append_pages,
    land_lines,
    landed_rejects,
    list_landed_files,
    parse_lines,
    read_id_results,
    read_image_results,
    read_landed,
    stream_form_pages,
    stream_image_results,
    stream_landed_files,
    stream_rejects,
    torn_lines,
    with_answer_text,
)
from ..sources.sinks import read_committed, with_landing_key, write_kv, write_records
from ..sources.staging import shared_dir, stage
from ..streaming.ingest import gather_jobs, ingest_feeds, ingest_forms, stream_images, write_stream
from . import derived
from .answers import form_prompts
from .documents import extract_forms, extract_ids, id_payload, id_report, stored_by_document
from .vehicles import analyze_images, process_cases

Query = Callable[[SparkSession, str], DataFrame]

ENRICH_TEMPLATE = "schema {schema} data {data} end"


def _split_lines(query: Query) -> Query:
    """A query that stores what it derives of lines, with scans that hand over a bounded number each."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with derived.split_scans(spark, derived.table(spark, sf_dir, "lineitem").count()):
            return query(spark, sf_dir)

    return run


def _kv_columns(kv: DataFrame) -> DataFrame:
    return kv.select(
        "doc_id",
        "page_seq",
        "key",
        "value",
        "key_confidence",
        "value_confidence",
        pct(F.col("key_confidence")).alias("key_pct"),
        pct(F.col("value_confidence")).alias("value_pct"),
    )


@_split_lines
def form_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv_columns(extract_forms(derived.form_pages(spark, sf_dir), dealt=True).kv)


@_split_lines
def _ordered_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = stage(extract_forms(derived.form_pages(spark, sf_dir), dealt=True).kv, "form-kv")
    return first_seen_order(kv)


def form_kv_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_kv(_ordered_forms(spark, sf_dir))
    entry = F.transform(
        "entries",
        lambda e: F.concat_ws(
            "|", e["value"], e["key_confidence"].cast("string"), e["value_confidence"].cast("string")
        ),
    )
    return groups.select(
        "doc_id", "key", "first_page_seq",
        F.size("entries").cast("bigint").alias("n"),
        F.array_join(entry, ";").alias("entries"),
    )


@_split_lines
def form_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_forms(derived.form_pages(spark, sf_dir), dealt=True).rejects


@_split_lines
def form_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.form_pages(spark, sf_dir)
    return stored_by_document(pages, lambda part, hot: block_text(part, "form", hot), "block-text")


@_split_lines
def id_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv_columns(extract_ids(derived.id_results(spark, sf_dir), dealt=True))


def id_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_report(extract_ids(derived.licence_results(spark, sf_dir)))


def id_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = derived.licence_cases(spark, sf_dir)
    results = derived.licence_results(spark, sf_dir, landed_only=True)
    shown = id_report(extract_ids(results)).select("doc_id").distinct()
    shown = shown.join(cases.select("case_id", "doc_id"), "doc_id")
    return status_rows(cases, results.select("case_id"), shown, NO_LICENCE)


@_split_lines
def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(explode_blocks(derived.form_pages(spark, sf_dir), "block_id", "relationships"))
    sums = rows.groupBy("doc_id", "rel_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rel_pos").cast("bigint").alias("rel_pos_sum"),
        F.sum("child_pos").cast("bigint").alias("child_pos_sum"),
    )
    return stage(sums, "edges")


@_split_lines
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.form_pages(spark, sf_dir)
    blocks = explode_blocks(pages, "block_id", "block_type", "entity_types")
    parts = [
        (key_blocks(blocks), "key"),
        (value_blocks(blocks, "form"), "form_value"),
        (value_blocks(blocks, "id"), "id_value"),
    ]
    rows = None
    for part, name in parts:
        one = part.select("doc_id", F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return stage(rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")), "kinds")


@_split_lines
def form_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lost(pages: DataFrame, hot: DataFrame | None) -> DataFrame:
        children = edges(explode_blocks(pages, "block_id", "relationships"))
        rows = dangling(children, explode_blocks(pages, "block_id"), hot)
        return rows.groupBy("doc_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))

    return stored_by_document(derived.form_pages(spark, sf_dir), lost, "dangling")


def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tokens(derived.form_pages(spark, sf_dir), "form")
    return known.select("doc_id", "block_id", "token")


def job_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = job_states(derived.order_polls(spark, sf_dir))
    failed = failed_jobs(states).select("doc_id", "reason", "detail")
    return states.join(failed, "doc_id", "left").select(
        "doc_id", "job_id", "job_status", "reason", "detail"
    )


def form_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_payload(_ordered_forms(spark, sf_dir))


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = form_prompts(form_payloads(spark, sf_dir), measured=True)
    return prompts.select("doc_id", "chars", F.sha2("prompt", 256).alias("prompt_sha"))


def model_enrich_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = id_payload(extract_ids(derived.licence_results(spark, sf_dir)))
    prompts = payloads.select(
        "doc_id", build_prompt(F.col("payload"), ENRICH_TEMPLATE, "{}").alias("prompt")
    )

    def factory(options: dict):
        def call(prompt: str) -> str:
            if "00\"" in prompt:
                raise RuntimeError("busy")
            return text_body(f"{len(prompt)}/{options['max_tokens']}")

        return call

    answered = enrich_with_model(prompts, "prompt", factory)
    return with_answer_text(answered).select("doc_id", "prompt_sha", "answer", "error")


def image_labels_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = image_results(derived.image_records(spark, sf_dir))
    return results.select("image_id", F.posexplode("labels")).select(
        "image_id",
        F.col("pos").cast("bigint").alias("pos"),
        "col.name",
        "col.confidence",
        F.array_join("col.categories", ",").alias("categories"),
    )


def image_labels_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.image_records(spark, sf_dir).select("image_id", F.posexplode("Labels"))
    rows = rows.select("image_id", "pos", F.col("col.Confidence").alias("confidence"))
    kept = top_label_rows(rows.filter(F.col("confidence") >= fi.MIN_LABEL_CONFIDENCE))
    return kept.select("image_id", F.col("rank").cast("bigint").alias("rank"), "confidence")


def image_text_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = image_results(derived.image_records(spark, sf_dir))
    return results.select("image_id", F.inline("text_detections"))


def image_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = image_results(derived.image_records(spark, sf_dir))
    return results.select("image_id", F.inline("dominant_colors"))


def image_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_faces(image_results(derived.image_records(spark, sf_dir)))
    return rows.select("image_id", "key", "value", "confidence", "confidence_pct")


def _report_columns(report: DataFrame) -> DataFrame:
    return display_report(report).select(
        "image_id",
        F.col("category_ord").cast("bigint").alias("category_ord"),
        F.col("pos").cast("bigint").alias("pos"),
        "Category", "Key", "Value", "Confidence",
    )


def image_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(image_report(image_results(derived.image_records(spark, sf_dir))))


STATUS_EVENTS = 512


def image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = derived.image_records(spark, sf_dir, STATUS_EVENTS)
    user = F.substring_index("image_id", "-", 1).cast("bigint")
    landed = images.filter(user % 7 != 2)
    failed = user % 10 == 3
    inputs = landed.select(
        "case_id", F.when(failed, F.lit(f"{IMAGE_ERROR}timeout")).alias("error")
    )
    report = image_report(image_results(landed.filter(~failed)))
    return status_rows(images.select("case_id"), inputs, report, NO_VEHICLE)


def case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = image_results(derived.image_records(spark, sf_dir))
    vehicles, _ = single_inputs(
        results.select("case_id", "image_id", F.size("labels").cast("bigint").alias("labels"))
    )
    licences = derived.licence_results(spark, sf_dir)
    payloads = id_payload(extract_ids(licences)).join(
        licences.select("case_id", "doc_id"), "doc_id"
    )
    paired, _ = single_inputs(payloads.select("case_id", "doc_id", "payload"))
    return pair_cases(vehicles, paired)


def fence_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = with_answer_text(derived.model_responses(spark, sf_dir))
    return answers.select("doc_id", strip_fences(F.col("answer")).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_answers(with_answer_text(derived.model_responses(spark, sf_dir)))


def json_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(
        "doc_id", F.col("v").isNotNull().alias("valid_json"), "reason"
    )


def form_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = record_violations(_parsed(spark, sf_dir), FORM)
    number = F.when(F.col("rule") == "range", F.col("value").try_cast("double"))
    return found.select(
        "doc_id", "path", "rule", number.alias("number"),
        F.when(F.col("rule") != "range", F.col("value")).alias("value"),
    )


def record_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_answers(_parsed(spark, sf_dir), FORM)
    return judged.select(
        "doc_id",
        judged_reason().alias("reason"),
        F.coalesce(F.size("broken"), F.lit(0)).cast("bigint").alias("violations"),
    )


def record_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = structure_records(_parsed(spark, sf_dir), FORM)
    r = F.col("record")
    premise = F.element_at(r["premises_information"], 2)
    return records.select(
        "doc_id",
        r["header"]["application_date"].alias("application_date"),
        r["transaction_info"]["status"].alias("status"),
        r["policy_term"]["deposit"].alias("deposit"),
        F.element_at(r["named_insureds"], 1)["fein_or_ssn"].alias("tax_id"),
        premise["zip"].alias("zip"),
        premise["num_employees_full_time"].alias("employees"),
        r["general_information"]["subsidiary_details"]["percent_owned"].alias("percent_owned"),
        r["loss_history"]["years_checked"].alias("years_checked"),
        r["loss_history"]["no_losses"].alias("no_losses"),
        r["signature_info"].isNull().alias("unsigned"),
        record_json(r["loss_history"]).alias("history_json"),
    )


def record_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = structure_records(_parsed(spark, sf_dir), FORM)
    return rejects.select("doc_id", "stage", "reason")


def parse_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _parsed(spark, sf_dir).withColumn("detail", F.col("text"))
    located = locate_error(rejected)
    return located.select(
        "doc_id",
        F.col("error.line").cast("bigint").alias("line"),
        F.col("error.col").cast("bigint").alias("col"),
        F.col("error.msg").alias("msg"),
        F.size("excerpt").cast("bigint").alias("shown"),
        F.get(F.filter("excerpt", lambda x: x["is_fault"]), 0)["text"].alias("fault"),
    )


@_split_lines
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = structure_records(_parsed(spark, sf_dir), FORM)
    forms = extract_forms(derived.form_pages(spark, sf_dir), dealt=True).kv
    joined = attach_records(forms, records)
    return joined.select("doc_id", F.col("record_json").isNotNull().alias("structured"))


def flatten_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_json(derived.event_json(spark, sf_dir), "v", 4)


def model_enrich_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerun: some prompts are shared, answered, answered for others, or failed before."""
    prompts = derived.segment_prompts(spark, sf_dir)

    def factory(options: dict):
        return lambda prompt: text_body(f"new {len(prompt)}")

    answered = enrich_with_model(
        prompts, "prompt", factory, done=derived.saved_answers(spark, sf_dir)
    )
    return with_answer_text(answered).select("doc_id", "prompt_sha", "answer", "error")


def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return torn_lines(derived.page_lines(spark, sf_dir), types.FORM_PAGE)


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_lines(derived.page_lines(spark, sf_dir), types.FORM_PAGE)
    return rows.select("doc_id", "job_id", "page_seq", "job_status")


def page_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = page_rows(spark, sf_dir)
    return append_pages(first, first.withColumn("page_seq", F.col("page_seq") + 1))


def form_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = derived.order_dates(spark, sf_dir)
    return dates.select("o_orderkey", as_date(F.col("written")).alias("date"))


def image_feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_rejects(*derived.image_feeds(spark, sf_dir))


def whole_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_feeds(*derived.image_feeds(spark, sf_dir))


def landing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = with_landing_key(derived.landed_events(spark, sf_dir))
    return landed.select("path", "landing_key")


def form_kv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = derived.table(spark, sf_dir, "lineitem")
    lines = (
        spark.readStream.schema(landed.schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf_dir)
    )
    out = shared_dir(spark, "form-stream")
    rows = landed.count()
    ingest_forms(
        lines, out, f"{out}/checkpoint", lambda batch: derived.line_pages(batch, rows)
    ).awaitTermination()
    return _kv_columns(spark.read.parquet(f"{out}/kv").drop("batch_id"))


def image_report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "image-stream")
    derived.image_records(spark, sf_dir).write.parquet(f"{base}/landed")
    report = stream_images(stream_image_results(spark, f"{base}/landed", "parquet"))
    write_stream(report, f"{base}/report", f"{base}/checkpoint").awaitTermination()
    return _report_columns(spark.read.parquet(f"{base}/report"))


def job_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several jobs a document: an order is a job, its date the attempt."""
    polls = derived.order_polls(spark, sf_dir).withColumn("attempt", F.col("page_seq") % 5)
    polls = polls.withColumn("job_id", F.concat_ws("-", "job_id", "attempt"))
    chosen = job_choice(job_states(polls))
    return chosen.select(
        "doc_id",
        F.col("chosen.job_id").alias("chosen"),
        F.col("latest.job_id").alias("latest"),
        F.col("latest.job_status").alias("job_status"),
    )


def form_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.form_pages(spark, sf_dir)
    orders = derived.table(spark, sf_dir, "orders")
    expected = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"))
    number = F.col("doc_id").cast("bigint")
    landed = expected.filter(number % 11 != 0).withColumn("error", F.when(number % 13 == 0, F.lit("timeout")))
    return form_status(expected, landed, job_states(pages), extract_forms(pages, dealt=True).docs)


def call_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed calls and responses without an answer said."""
    answers = derived.model_responses(spark, sf_dir).withColumn(
        "error", F.when(F.col("doc_id").cast("bigint") % 73 == 0, F.concat(F.lit("TimeoutError: "), "doc_id"))
    )
    answers = answers.withColumn("body", F.when(F.col("error").isNull(), F.col("body")))
    _, rejects = structure_records(parse_answers(with_answer_text(answers)), FORM)
    return rejects.filter("reason = 'call_error'")


def email_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived.addresses(spark, sf_dir)
    return found.select("c_custkey", is_email(F.col("address")).alias("valid"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "landed-pages")
    land_lines(derived.page_lines(spark, sf_dir), types.FORM_PAGE, path)
    return read_landed(spark, path, types.FORM_PAGE).select("doc_id", "job_id", "page_seq", "job_status")


def landed_page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "landed-pages")
    land_lines(derived.page_lines(spark, sf_dir), types.FORM_PAGE, path)
    return landed_rejects(spark, path, types.FORM_PAGE)


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a stream of JSON lines, torn ones left out."""
    base = shared_dir(spark, "page-stream")
    derived.page_lines(spark, sf_dir).write.text(f"{base}/landed")
    pages = stream_form_pages(spark, f"{base}/landed")
    write_stream(pages, f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/pages").select("doc_id", "job_id", "page_seq", "job_status")


def page_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "page-stream")
    derived.page_lines(spark, sf_dir).write.text(f"{base}/landed")
    torn = stream_rejects(spark, f"{base}/landed")
    write_stream(torn, f"{base}/rejects", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rejects")


def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence results read back from JSON lines, and their report."""
    path = shared_dir(spark, "licence-lines")
    derived.licence_results(spark, sf_dir).drop("page_seq").write.json(path)
    return id_report(extract_ids(read_id_results(spark, path)))


def image_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of images whose three feeds are read back from JSON lines."""
    base = shared_dir(spark, "feed-lines")
    feeds = []
    for name, landings in derived.feed_landings(spark, sf_dir).items():
        landings[0].drop("landed_at").write.json(f"{base}/{name}")
        feeds.append(read_image_results(spark, f"{base}/{name}", name))
    return _report_columns(analyze_images(*feeds).report)


def case_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every case: a record, a reject with its reason, or nothing to structure."""

    def factory(options: dict):
        def call(prompt: str) -> str:
            if '"key":""' in prompt:
                raise RuntimeError("busy")
            return text_body('{"vehicle": {}, "driver": {}}')

        return call

    found = process_cases(
        derived.licence_cases(spark, sf_dir), derived.image_records(spark, sf_dir),
        derived.licence_results(spark, sf_dir), factory,
    )
    return (
        found.records.select("case_id", F.lit("record").alias("outcome"))
        .unionByName(found.rejects.select("case_id", F.col("reason").alias("outcome")))
        .unionByName(found.unstructured.select("case_id", F.lit("unstructured").alias("outcome")))
    )


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON with every declared field, and read back."""
    records, _ = structure_records(_parsed(spark, sf_dir), FORM)
    path = shared_dir(spark, "records")
    write_records(records, path, "json")
    stored = spark.read.schema("doc_id string, record_json string").json(path)
    history = F.get_json_object("record_json", "$.loss_history.years_checked").cast("bigint")
    return stored.select(
        "doc_id", history.alias("years_checked"),
        F.contains("record_json", F.lit('"signature_info":null')).alias("unsigned"),
    )


def kv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence pairs written in folders by key text, and the report of one of them."""
    path = shared_dir(spark, "kv")
    write_kv(extract_ids(derived.licence_results(spark, sf_dir)), path, ("key",))
    return id_report(spark.read.parquet(path).filter("key = 'Name'"))


def _segment_files(spark: SparkSession, sf_dir: str, base: str) -> None:
    """A text file of names for each segment, in a folder of its own."""
    names = derived.table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    names.coalesce(1).write.mode("append").partitionBy("c_mktsegment").text(base)


def _segments(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", "c_mktsegment=([^/]+)", 1).alias("segment"), "length")


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "landed-files")
    _segment_files(spark, sf_dir, base)
    return _segments(list_landed_files(spark, base, ["TXT"]))


def landed_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings with a landing before each: every file once."""
    base = shared_dir(spark, "landed-files")
    for _ in range(2):
        _segment_files(spark, sf_dir, f"{base}/in")
        files = stream_landed_files(spark, f"{base}/in", ["txt"], 2)
        write_stream(files, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _segments(spark.read.parquet(f"{base}/out"))


def jobs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose pages land in three batches: the words of those that end, and those given up."""
    base = shared_dir(spark, "job-stream")
    for landing in derived.job_landings(spark, sf_dir):
        landing.write.mode("append").parquet(f"{base}/landed")
        stream = spark.readStream.schema(landing.schema).parquet(f"{base}/landed")
        gather_jobs(stream, f"{base}/out", f"{base}/checkpoint", 3600 * 24).awaitTermination()
    found = read_committed(spark, f"{base}/out", "jobs")
    return found.groupBy("doc_id", "job_id", "kind").agg(
        F.count_distinct("page_seq").alias("pages"),
        F.max(F.when(F.col("kind") == "timeout", F.col("status_message"))).alias("held"),
        F.count(F.get("blocks", F.lit(0))["Text"]).alias("words"),
    )


def feeds_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose feeds land one after another: their report rows, or what is missing."""
    base = shared_dir(spark, "feed-stream")
    streams = []
    for name, landings in derived.feed_landings(spark, sf_dir).items():
        for landing in landings:
            landing.write.mode("append").parquet(f"{base}/{name}")
        streams.append(spark.readStream.schema(landings[0].schema).parquet(f"{base}/{name}"))
    ingest_feeds(*streams, f"{base}/out", f"{base}/checkpoint", 3600 * 24).awaitTermination()
    report = read_committed(spark, f"{base}/out", "report").filter("image_id <> '~'")
    rejects = read_committed(spark, f"{base}/out", "rejects")
    return (
        report.groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("missing"))
        .unionByName(rejects.select(F.col("doc_id").alias("image_id"), F.lit(0).cast("bigint").alias("rows"), F.col("detail").alias("missing")))
    )


def model_enrich_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fails for some prompts, and one after it that asks for those only."""
    prompts = derived.segment_prompts(spark, sf_dir)
    log = shared_dir(spark, "responses")

    def factory(options: dict):
        def call(prompt: str) -> str:
            if options["run"] == 1 and len(prompt) % 2:
                raise RuntimeError("busy")
            if prompt.endswith("7"):
                raise ValueError("never")
            return text_body(f"run {options['run']}")

        return call

    for run in (1, 2):
        found = enrich_with_log(prompts, "prompt", factory, log, {"run": run}, slices=3, workers=4)
    return with_answer_text(found).select("doc_id", "prompt_sha", "answer", "error")


QUERIES: dict[str, Query] = {
    "id_kv": id_kv,
    "id_report": id_report_rows,
    "id_status": id_status,
    "block_edges": block_edges,
    "block_kinds": block_kinds,
    "block_dedupe": block_dedupe,
    "job_gate": job_gate,
    "image_labels_topk": image_labels_topk,
    "image_labels_ranked": image_labels_ranked,
    "image_text_foreground": image_text_foreground,
    "image_colors": image_colors,
    "image_faces": image_faces,
    "image_report": image_report_rows,
    "image_status": image_status,
    "case_pairs": case_pairs,
    "fence_clean": fence_clean,
    "json_verdict": json_verdict,
    "record_violations": form_violations,
    "record_verdict": record_verdict,
    "record_canonical": record_canonical,
    "record_rejects": record_rejects,
    "parse_faults": parse_faults,
    "document_records": document_records,
    "flatten_paths": flatten_paths,
    "prompt_rows": prompt_rows,
    "model_enrich_stub": model_enrich_stub,
    "model_enrich_resume": model_enrich_resume,
    "form_kv": form_kv,
    "form_kv_grouped": form_kv_grouped,
    "form_rejects": form_rejects,
    "form_block_text": form_block_text,
    "form_dangling": form_dangling,
    "form_payloads": form_payloads,
    "landing_keys": landing_keys,
    "page_rows": page_rows,
    "page_rejects": page_rejects,
    "page_landings": page_landings,
    "form_dates": form_dates,
    "feed_rejects": image_feed_rejects,
    "image_feeds": whole_images,
    "form_kv_stream": form_kv_stream,
    "image_report_stream": image_report_stream,
    "job_choice": job_choices,
    "form_status": form_statuses,
    "call_rejects": call_rejects,
    "email_check": email_check,
    "landed_pages": landed_pages,
    "landed_page_rejects": landed_page_rejects,
    "page_stream": page_stream,
    "page_stream_rejects": page_stream_rejects,
    "licence_lines": licence_lines,
    "image_feed_lines": image_feed_lines,
    "case_outcomes": case_outcomes,
    "record_files": record_files,
    "kv_files": kv_files,
    "landed_files": landed_files,
    "landed_files_stream": landed_files_stream,
    "jobs_stream": jobs_stream,
    "feeds_stream": feeds_stream,
    "model_enrich_log": model_enrich_log,
}
