import json

import pytest
from pyspark.sql import functions as F

from docstruct.functions.json import COERCE, parse_strict
from docstruct.functions.text import as_date, join_names, pct, strip, strip_fences
from docstruct.operators.answers import (
    build_prompt,
    locate_error,
    parse_answers,
    record_violations,
    structure_records,
)
from docstruct.operators.flatten import flatten_json, with_nodes
from docstruct.schemas import FORM, VEHICLE, record
from docstruct.schemas.records import FORM_MODELS


def texts(spark, rows, name="answer"):
    return spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(rows)], f"doc_id string, {name} string"
    )


def column(df, col):
    return [r[0] for r in sorted(df.select(col, "doc_id").collect(), key=lambda r: int(r[1]))]


FENCES = [
    ("plain", "plain"), ("```json\n{}\n```", "{}"), ("```{}```", "{}"),
    ("```JSON\n{}```", "JSON\n{}"), ("```json```{}", "{}"), ("{}```", "{}"),
    (" \n {}  \x1c", "{}"), ("``` ```", ""), ("a ```b``` c", "a ```b``` c"),
]


def test_fences(spark):
    df = texts(spark, [a for a, _ in FENCES])
    assert column(df, strip_fences(F.col("answer"))) == [b for _, b in FENCES]


PROBES = {
    '{"a":1}': True, '{"a":1} extra': False, '{"a":1}{"a":2}': False, '{"a":1},{"a":2}': False,
    '{"a":1}] x': False, '{"a":1}} x': False, '{"a":1, "a":2}': False, "": False,
    '  {"a":1}  ': True, '{"a":1}, "w":2': False, '{"a":1,}': False, "{'a':1}": False,
    '{"a":NaN}': False, "[]": True, '"a"': True, "null": True, '{"a":01}': False,
    '{"a":"x\ny"}': False, "]": False, "}": False, "[1],[2]": False, '1, "v": 2': False,
}


def test_strict_json(spark):
    df = texts(spark, list(PROBES))
    got = column(df, parse_strict(F.col("answer")).isNotNull())
    assert dict(zip(PROBES, got, strict=True)) == PROBES


def test_reasons(spark):
    rows = [None, "oops", "[]", '"a"', "null", '{"vehicle":{},"driver":{}}']
    assert column(parse_answers(texts(spark, rows)), "reason") == [
        "call_error", "parse_error", "not_an_object", "not_an_object", "not_an_object", None
    ]


# Accepted JSON texts with the value they turn into, and rejected ones.
ACCEPTED = {
    "str": {'"x"': "x", '""': ""},
    "float": {"1": 1.0, "1.5": 1.5, "true": 1.0, "false": 0.0, '" 2.5 "': 2.5, '"1e3"': 1000.0,
              '"1_000"': 1000.0, '"5."': 5.0, '".5"': 0.5, '"-3"': -3.0},
    "int": {"5": 5, "5.0": 5, "true": 1, '"5"': 5, '" 5 "': 5, '"5.0"': 5, '"1_000"': 1000,
            '"-7"': -7},
    "bool": {"true": True, "0": False, "1": True, "1.0": True, '"Yes"': True, '"off"': False,
             '"ON"': True, '"f"': False, '"1"': True, '"N"': False},
}
REJECTED = {
    "str": ["5", "1.5", "true", "{}", "[]"],
    "float": ['"$12"', '"1,200"', '""', '"0x1"', '"1.0d"', '"1__0"', "[]", "{}", '"_1"'],
    "int": ["5.5", '"5.5"', '"1e3"', '""', "[]", '"x"'],
    "bool": ["2", '"X"', '""', '" true "', "[]", "0.5"],
}


@pytest.mark.parametrize("kind", list(ACCEPTED))
def test_coercion(spark, kind):
    df = texts(spark, [*ACCEPTED[kind], *REJECTED[kind]])
    got = column(df.withColumn("v", F.parse_json("answer")), COERCE[kind](F.col("v")))
    assert got == [*ACCEPTED[kind].values(), *[None] * len(REJECTED[kind])]


MIN = {"policy_term": {}, "named_insureds": [{"name": "Acme Test LLC"}]}


def broken(spark, rows, schema=FORM):
    parsed = parse_answers(texts(spark, [json.dumps(r) for r in rows]))
    out = {str(i): set() for i in range(len(rows))}
    for r in record_violations(parsed, schema).collect():
        out[r.doc_id].add((r.path, r.rule))
    return [out[str(i)] for i in range(len(rows))]


FORM_CASES = [
    (MIN, set()),
    ({"named_insureds": [{"name": "A"}]}, {("policy_term", "required")}),
    ({**MIN, "policy_term": None}, {("policy_term", "type")}),
    ({**MIN, "policy_term": 5}, {("policy_term", "type")}),
    ({**MIN, "named_insureds": []}, {("named_insureds", "min_items")}),
    ({**MIN, "named_insureds": [{"name": None}]}, {("named_insureds[1].name", "type")}),
    ({**MIN, "named_insureds": [{}, {"name": "B"}]}, {("named_insureds[1].name", "required")}),
    ({**MIN, "named_insureds": [None]}, {("named_insureds[1]", "type")}),
    ({**MIN, "named_insureds": "A"}, {("named_insureds", "type")}),
    ({**MIN, "other": 1}, {("other", "extra")}),
    ({**MIN, "header": {"other": 1}}, set()),
    ({**MIN, "header": None, "attachments": None}, set()),
    ({**MIN, "header": []}, {("header", "type")}),
    ({**MIN, "attachments": ["a", 5]}, {("attachments[2]", "type")}),
    ({**MIN, "transaction_info": {"status": "quote"}}, {("transaction_info.status", "enum")}),
    ({**MIN, "transaction_info": {"status": 5}}, {("transaction_info.status", "enum")}),
    ({**MIN, "transaction_info": {"status": "QUOTE"}}, set()),
    ({**MIN, "premises_information": [{"state": "ca"}]},
     {("premises_information[1].state", "pattern")}),
    ({**MIN, "premises_information": [{"zip": "12345"}, {"zip": "1234"}]},
     {("premises_information[2].zip", "pattern")}),
    ({**MIN, "premises_information": [{"zip": "12345\n"}]},
     {("premises_information[1].zip", "pattern")}),
    ({**MIN, "general_information": {"subsidiary_details": {"percent_owned": 101}}},
     {("general_information.subsidiary_details.percent_owned", "range")}),
    ({**MIN, "loss_history": {"years_checked": 0}}, {("loss_history.years_checked", "range")}),
    ({**MIN, "loss_history": {"years_checked": 11}}, {("loss_history.years_checked", "range")}),
    ({**MIN, "loss_history": {"years_checked": "10"}}, set()),
    ({**MIN, "loss_history": {"losses": [{"amount_paid": -1}, {"claim_open": "maybe"}]}},
     {("loss_history.losses[1].amount_paid", "range"),
      ("loss_history.losses[2].claim_open", "type")}),
    ({**MIN, "lines_of_business": [{"premium": -1}]}, {("lines_of_business[1].premium", "range")}),
    ({**MIN, "lines_of_business": [{"premium": "nan"}]},
     {("lines_of_business[1].premium", "range")}),
    ({**MIN, "lines_of_business": [{"premium": "inf"}]}, set()),
    ({**MIN, "header": {"application_date": "1/2/2024"}},
     {("header.application_date", "pattern")}),
    ({**MIN, "header": {"application_date": "13/45/2024"}}, set()),
    ({**MIN, "header": {"application_date": 5}}, {("header.application_date", "type")}),
    ({**MIN, "agency_info": {"email": "a@b"}}, {("agency_info.email", "email")}),
    ({**MIN, "agency_info": {"email": "a.b@c.example"}}, set()),
    ({**MIN, "additional_interests": [{"interest_in_item": {"vehicle": 5}}]},
     {("additional_interests[1].interest_in_item.vehicle", "type")}),
    ({**MIN, "header.policy_number": 5}, {("header.policy_number", "extra")}),
]


def test_form_rules(spark):
    assert broken(spark, [c for c, _ in FORM_CASES]) == [w for _, w in FORM_CASES]


def test_tax_id_pattern(spark):
    ids = ["12-3456789", "123-45-6789", "12-3456789 junk", "junk 123-45-6789", "x12-3456789"]
    rows = [{**MIN, "named_insureds": [{"name": "A", "fein_or_ssn": i}]} for i in ids]
    assert [bool(b) for b in broken(spark, rows)] == [False, False, False, False, True]
    strict = record("form", FORM_MODELS, closed_root=True, strict_ids=True)
    assert [bool(b) for b in broken(spark, rows, strict)] == [False, False, True, True, True]


def test_vehicle_rules(spark):
    rows = [
        {"vehicle": {}, "driver": {}}, {"vehicle": {}}, {"vehicle": {"year": "2019"}, "driver": {}},
        {"vehicle": {"year": 20.5}, "driver": {"addressMatchesDVLA": "no"}},
        {"vehicle": {"other": 1}, "driver": {}, "vehicle.type": 5},
    ]
    assert broken(spark, rows, VEHICLE) == [
        set(), {("driver", "required")}, set(), {("vehicle.year", "type")}, set()
    ]


def test_inventory():
    kinds = [r[2] for r in FORM.rules()]
    assert len(FORM.models["Root"]) == 16 and len(FORM.models) == 20
    assert sum(len(m) for m in FORM.models.values()) == 16 + 138
    assert kinds.count("enum") == 9 and kinds.count("pattern") == 8
    assert kinds.count("range") == 20 and kinds.count("email") == 2
    assert kinds.count("min_items") == 1 and FORM.depth() == 4
    required = [a for r in FORM.rules() + VEHICLE.rules() if r[2] == "required" for a in r[5]]
    assert sorted(required) == ["driver", "name", "named_insureds", "policy_term", "vehicle"]
    assert json.loads(FORM.json_schema())["required"] == ["policy_term", "named_insureds"]


def test_records(spark):
    answer = {
        **MIN,
        "loss_history": {"years_checked": "5.0", "no_losses": "On", "total_losses_amount": "1_000",
                         "losses": [{"amount_paid": 1, "claim_open": 0, "junk": 1}]},
        "attachments": ["a"], "header": {"junk": 1, "policy_number": "P"},
    }
    rows = [json.dumps(answer), json.dumps({**MIN, "x": 1}), "{", None, "[]"]
    records, rejects = structure_records(parse_answers(texts(spark, rows)), FORM)
    got = records.collect()
    assert [r.doc_id for r in got] == ["0"]
    out = json.loads(got[0].record_json)
    assert list(out) == [f.name for f in FORM.models["Root"]]
    assert out["loss_history"]["years_checked"] == 5
    assert out["loss_history"]["no_losses"] is True
    assert out["loss_history"]["total_losses_amount"] == 1000.0
    assert out["loss_history"]["losses"][0]["amount_paid"] == 1.0
    assert out["loss_history"]["losses"][0]["claim_open"] is False
    assert "junk" not in out["header"] and out["header"]["application_date"] is None
    assert out["signature_info"] is None and out["attachments"] == ["a"]
    assert got[0].record.named_insureds[0].name == "Acme Test LLC"
    reasons = {r.doc_id: (r.reason, r.detail) for r in rejects.collect()}
    assert reasons["1"][0] == "validation_error" and '"rule":"extra"' in reasons["1"][1]
    assert reasons["2"] == ("parse_error", "{") and reasons["3"] == ("call_error", None)
    assert reasons["4"][0] == "not_an_object"


def test_answers_are_judged_in_their_row(spark):
    parsed = parse_answers(texts(spark, ["{}", json.dumps(MIN)]))
    records, rejects = structure_records(parsed.withColumn("doc_id", F.lit("same")), FORM)
    assert records.count() == 1 and rejects.count() == 1
    for df in (records, rejects, record_violations(parsed, FORM)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_fault_location(spark):
    text = '{\n "a": 1,\n "b": oops,\n "c": 2,\n "d": 3,\n "e": 4\n}'
    _, rejects = structure_records(parse_answers(texts(spark, [text])), FORM)
    row = locate_error(rejects).collect()[0]
    assert tuple(row.error) == (3, 7, "Expecting value")
    assert [tuple(x) for x in row.excerpt] == [
        (1, "{", False), (2, ' "a": 1,', False), (3, ' "b": oops,', True), (4, ' "c": 2,', False),
        (5, ' "d": 3,', False),
    ]


def model_flatten(x, path=""):
    if isinstance(x, dict):
        return [p for k, v in x.items() for p in model_flatten(v, f"{path}.{k}" if path else k)]
    if isinstance(x, list):
        return [p for i, v in enumerate(x, 1) for p in model_flatten(v, f"{path}[{i}]")]
    return [(path, x)]


def test_flatten(spark):
    docs = [
        {"a": {"b": 1, "c": [True, None, {"d": "x"}]}, "e": [], "f": {}, "g": [[1, 2], [[3.5]]]},
        [1, [2, {"a": "b"}]], "root", None, {"a.b": 1, "a": {"b": 2}}, {},
    ]
    df = texts(spark, [json.dumps(d) for d in docs]).withColumn("v", F.parse_json("answer"))
    got = {str(i): [] for i in range(len(docs))}
    kinds = {}
    for r in flatten_json(df, "v").collect():
        got[r.doc_id].append((r.path, r.value))
        kinds[r.path] = r.value_type
    show = {True: "true", False: "false"}
    for i, d in enumerate(docs):
        want = [(p, None if v is None else show.get(v, str(v)) if isinstance(v, bool) else str(v))
                for p, v in model_flatten(d)]
        assert sorted(got[str(i)]) == sorted(want)
    assert kinds["a.c[1]"] == "bool" and kinds["a.c[2]"] == "null" and kinds["g[2][1][1]"] == "float"
    assert ("", "root") in got["2"] and ("", None) in got["3"] and got["5"] == []
    for depth in (1, 2):
        shallow = flatten_json(df, "v", native_depth=depth)
        assert sorted(shallow.collect(), key=str) == sorted(flatten_json(df, "v").collect(), key=str)
    deep = "1"
    for i in range(60):
        deep = f'[{deep}]' if i % 2 else f'{{"k":{deep}}}'
    one = texts(spark, [deep]).withColumn("v", F.parse_json("answer"))
    assert [(r.path, r.value, r.value_type) for r in flatten_json(one, "v").collect()] == [
        ("[1]" + ".k[1]" * 29 + ".k", "1", "int")
    ]
    full = flatten_json(df, "v", include_containers=True).filter("doc_id = '0'").collect()
    assert {"object", "array"} <= {r.value_type for r in full}


def test_flatten_opens_nodes_within_each_other(spark):
    """Containers and leaves are those of ``with_nodes``; no node is kept for the levels below it, no key escaped."""
    docs = [{"a": [{"b": [1, [2.50, {"c": "x", "d": {}}]]}, [], None], "é.[": {"x": {"y": {"z": "q\"\n"}}}}, [], "s", [[[[]]]]]
    docs += [{"n": i, "deep": [[[i, str(i), {"k": None}]]] * (i % 3)} for i in range(50)]
    rows = texts(spark, [json.dumps(d) for d in docs] + ["not json"]).withColumn("v", F.try_parse_json("answer"))
    for depth in (1, 2, 4):
        kept = with_nodes(rows, "v", depth, "nodes").select("doc_id", F.inline("nodes")).filter("kind <> 'truncated'")
        got = flatten_json(rows, "v", depth, include_containers=True)
        held = got.filter("value_type in ('object', 'array')").select("doc_id", "path", "value")
        want = kept.filter("kind <> 'scalar'").select("doc_id", "path", F.to_json("v").alias("value"))
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.collect()))
        plain = flatten_json(rows, "v", depth)
        assert sorted(plain.collect(), key=str) == sorted(flatten_json(rows, "v", 9).collect(), key=str)
        plan = plain._jdf.queryExecution().executedPlan().toString()
        assert plan.count("level_") == plan.count("regexp_replace") == 0


def test_text_functions(spark):
    df = spark.createDataFrame(
        [(97.3, 97.345, "\t  x y \n", ["a", "b"], [], "12/31/2024", "13/45/2024")],
        "a double, b double, s string, n array<string>, e array<string>, d string, bad string",
    )
    row = df.select(
        pct(F.col("a")), pct(F.col("b")), strip(F.col("s")), join_names(F.col("n")),
        join_names(F.col("e")), as_date(F.col("d")).cast("string"), as_date(F.col("bad")),
        build_prompt(F.col("d"), "s={schema} d={data}.", '{"x":1}'),
    ).collect()[0]
    assert tuple(row) == (
        "97.30%", "97.35%", "x y", "a, b", "", "2024-12-31", None, 's={"x":1} d=12/31/2024.'
    )


def test_prompts_are_measured_by_parts(spark):
    """Lengths are those of the prompts, and the fixed text is not counted again in each."""
    from docstruct.plans.answers import form_prompts

    payloads = spark.createDataFrame([("a", "[]"), ("b", '[{"key":"é😀"}]'), ("c", None), (None, "")], "doc_id string, payload string")
    prompts = form_prompts(payloads, measured=True)
    assert [r.chars for r in prompts.collect()] == [None if r.prompt is None else len(r.prompt) for r in prompts.collect()]
    assert form_prompts(payloads).columns == ["doc_id", "prompt"]
    plan = prompts.select("chars", F.sha2("prompt", 256))._jdf.queryExecution().optimizedPlan().toString()
    assert "length(payload" in plan and "length(prompt" not in plan and "length(concat" not in plan


def test_faults_are_looked_for_after_spreading(spark):
    """Judging and parsing stay above an exchange that deals the answers out."""
    dealt = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{"), ("c", None)], "doc_id string, answer string").repartition(3, "doc_id")
    found = locate_error(parse_answers(dealt).withColumn("detail", F.col("text")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange ")[1]
    assert "Filter" not in below and "parse" not in below.lower()
    assert [(r.doc_id, r.error.line, r.error.col) for r in found.collect()] == [("b", 1, 2)]
