import json
import random

import pytest
from pyspark.sql import functions as F

from docstruct import types
from docstruct.operators import kv, skew
from docstruct.operators.blocks import dangling, edges, explode_blocks, key_blocks, value_blocks
from docstruct.operators.jobs import gate_jobs
from docstruct.plans import derived, registry
from docstruct.plans.documents import extract_forms, extract_ids, form_outputs, id_report
from model import pairs as model_pairs


def block(id_, kind, types_=None, conf=None, text=None, status=None, **rels):
    rel = [{"Type": k, "Ids": v} for k, v in rels.items()] or None
    return {
        "Id": id_, "BlockType": kind, "EntityTypes": types_, "Confidence": conf, "Text": text,
        "SelectionStatus": status, "Relationships": rel,
    }


def key(id_, conf=90.0, **rels):
    return block(id_, "KEY_VALUE_SET", ["KEY"], conf, **rels)


def value(id_, conf=80.0, **rels):
    return block(id_, "KEY_VALUE_SET", ["VALUE"], conf, **rels)


def word(id_, text):
    return block(id_, "WORD", text=text)


def mark(id_, selected):
    return block(id_, "SELECTION_ELEMENT", status="SELECTED" if selected else "NOT_SELECTED")


def page(doc, blocks, seq=0, status="SUCCEEDED", message=None, job=None):
    return {
        "doc_id": doc, "job_id": job or f"j-{doc}", "page_seq": seq, "job_status": status,
        "status_message": message, "blocks": blocks,
    }


def frame(spark, pages):
    return spark.createDataFrame(
        [tuple(p.values()) for p in pages], types.FORM_PAGE
    )


def ordered(df):
    """Pairs per document in block order."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.page_seq, r.pos)):
        out.setdefault(r.doc_id, []).append(
            (r.key, r.value, r.key_confidence, r.value_confidence)
        )
    return out


CASES = {
    "basic": [key("k", VALUE=["v"], CHILD=["a"]), value("v", CHILD=["b", "c"]),
              word("a", "Name"), word("b", "Ann"), word("c", "Example")],
    "dup_key": [key("k1", CHILD=["a"], VALUE=["v1"]), key("k2", CHILD=["b"]),
                key("k3", CHILD=["a"]), key("k4", CHILD=["a"], VALUE=["v1"]),
                value("v1", CHILD=["c"]), word("a", "Date"), word("b", "City"), word("c", "one")],
    "no_value": [key("k", CHILD=["a"]), word("a", "Alone")],
    "empty_key": [key("k", VALUE=["v"]), value("v", CHILD=["a"]), word("a", "text")],
    "selection": [key("k", CHILD=["a"], VALUE=["v"]), value("v", CHILD=["s", "n", "b"]),
                  word("a", "Box"), mark("s", True), mark("n", False), word("b", "yes")],
    "multi_value": [key("k", CHILD=["a"], VALUE=["v1", "gone", "v2"]),
                    value("v1", 10.0, CHILD=["b"]), value("v2", 20.0, CHILD=["c"]),
                    word("a", "K"), word("b", "one"), word("c", "two")],
    "first_dangling": [key("k", CHILD=["a"], VALUE=["gone", "v"]), value("v", CHILD=["b"]),
                       word("a", "K"), word("b", "later")],
    "last_without_words": [key("k", CHILD=["a"], VALUE=["v1", "v2"]),
                           value("v1", 10.0, CHILD=["a"]), value("v2", 55.0), word("a", "w")],
    "dangling_child": [key("k", CHILD=["a"], VALUE=["v"]), value("v", CHILD=["gone", "b"]),
                       word("a", "K"), word("b", "kept")],
    "unvisited_dangling": [key("k", CHILD=["a"]), value("v", CHILD=["gone"]), word("a", "K")],
    "no_types": [key("k", CHILD=["a"]), block("u", "KEY_VALUE_SET"), word("a", "K")],
    "other_type": [key("k", CHILD=["a"], VALUE=["v"]),
                   block("v", "KEY_VALUE_SET", ["OTHER"], 33.0, CHILD=["a"]), word("a", "K")],
    "no_confidence": [key("k", None, CHILD=["a"], VALUE=["v"]), value("v", None, CHILD=["a"]),
                      word("a", "K")],
    "child_is_key": [key("k", CHILD=["k", "a"]), word("a", "K")],
    "blank_words": [key("k", CHILD=["a", "b", "c"]), word("a", " x"), word("b", ""),
                    word("c", "y ")],
    "repeated_child": [key("k", CHILD=["a", "a"]), word("a", "twice")],
}


@pytest.fixture(scope="module")
def corpus(spark):
    pages = [page(n, b) for n, b in CASES.items()]
    # The same id on a later page: the last content counts, at the first position.
    pages += [
        page("dup_id", [key("k", 1.0, CHILD=["a"]), key("z", CHILD=["b"]), word("a", "old")], 0),
        page("dup_id", [word("a", "new"), key("k", 2.0, CHILD=["a", "b"]), word("b", "B")], 1),
    ]
    return frame(spark, pages).persist()


def expected(mode):
    docs = dict(CASES)
    docs["dup_id"] = [
        key("k", 1.0, CHILD=["a"]), key("z", CHILD=["b"]), word("a", "old"),
        word("a", "new"), key("k", 2.0, CHILD=["a", "b"]), word("b", "B"),
    ]
    return {n: model_pairs(b, mode) for n, b in docs.items()}


def test_id_mode_cases(corpus):
    got = ordered(extract_ids(corpus))
    want = expected("id")
    assert got == want
    assert got["multi_value"] == [("K", "one two", 90.0, 20.0)]
    assert got["selection"] == [("Box", "yes", 90.0, 80.0)]
    assert got["dangling_child"] == [("K", "kept", 90.0, 80.0)]
    assert got["other_type"] == [("K", "", 90.0, 0.0)]
    assert got["dup_id"] == [("new B", "", 2.0, 0.0), ("B", "", 90.0, 0.0)]


def test_form_mode_cases(corpus):
    found = extract_forms(corpus)
    by_key = {}
    for doc, rows in ordered(found.kv).items():
        groups = {}
        for r in rows:
            groups.setdefault(r[0], []).append(r)
        by_key[doc] = [r for g in groups.values() for r in g]
    want = {d: p for d, p in expected("form").items() if p is not None}
    assert by_key == want
    assert by_key["selection"] == [("Box", "X yes", 90.0, 80.0)]
    assert by_key["first_dangling"] == [("K", "", 90.0, 0.0)]
    rejects = {(r.doc_id, r.reason) for r in found.rejects.collect()}
    assert rejects == {
        ("dangling_child", "dangling_child"), ("no_types", "missing_entity_types")
    }


def test_form_outputs(spark, corpus):
    kv_rows = extract_forms(corpus).kv.persist()
    payload, report = form_outputs(kv_rows, spark.createDataFrame([("void",)], "doc_id string"))
    rows = {r.doc_id: json.loads(r.payload) for r in payload.collect()}
    assert [(p["key"], p["value"]) for p in rows["dup_key"]] == [
        ("Date", "one"), ("Date", ""), ("Date", "one"), ("City", "")
    ]
    assert rows["void"] == []
    shown = report.filter("doc_id = 'basic'").collect()[0]
    assert (shown["Key"], shown["Key Confidence"]) == ("Name", "90.00%")
    groups = kv.group_kv(kv.first_seen_order(kv_rows)).filter("doc_id = 'dup_key'").collect()
    assert {g.key: len(g.entries) for g in groups} == {"Date": 3, "City": 1}
    assert payload.count() == kv_rows.select("doc_id").distinct().count() + 1


def test_id_report_drops_empty_keys(corpus):
    keys = {r.doc_id for r in id_report(extract_ids(corpus)).collect()}
    assert "empty_key" not in keys and "basic" in keys


def random_document(rng):
    ids = [f"b{i}" for i in range(rng.randint(1, 14))]
    anywhere = [*ids, "gone"]

    def rels():
        out = []
        for _ in range(rng.randint(0, 3)):
            out.append({
                "Type": rng.choice(["VALUE", "CHILD", "CHILD", "OTHER"]),
                "Ids": [rng.choice(anywhere if rng.random() < 0.2 else ids)
                        for _ in range(rng.randint(0, 3))],
            })
        return out or None

    blocks = []
    for _ in range(rng.randint(1, 18)):
        kind = rng.choice(["KEY_VALUE_SET"] * 3 + ["WORD"] * 4 + ["SELECTION_ELEMENT", "LINE"])
        blocks.append({
            "Id": rng.choice(ids), "BlockType": kind,
            "EntityTypes": rng.choice([["KEY"], ["VALUE"], ["KEY", "VALUE"], [], ["VALUE"]])
            if rng.random() < 0.97 else None,
            "Confidence": rng.choice([None, 12.5, 99.0]),
            "Text": rng.choice(["a", "bb", "", " c "]) if kind == "WORD" else None,
            "SelectionStatus": rng.choice(["SELECTED", "NOT_SELECTED"])
            if kind == "SELECTION_ELEMENT" else None,
            "Relationships": rels() if kind == "KEY_VALUE_SET" else None,
        })
    return blocks


@pytest.mark.parametrize("mode", ["form", "id"])
@pytest.mark.parametrize("min_hot_rows", [1, 1_000_000])
def test_random_documents(spark, mode, min_hot_rows):
    """Against the model; with every frequent id salted, and with none."""
    rng = random.Random(7)
    docs = {f"d{i}": random_document(rng) for i in range(150)}
    pages = []
    for doc, blocks in docs.items():
        cut = rng.randint(0, len(blocks))
        pages += [page(doc, blocks[:cut], 0), page(doc, blocks[cut:], 1)]
    corpus = frame(spark, pages)
    want = {d: model_pairs(b, mode) for d, b in docs.items()}
    if mode == "form":
        got = ordered(extract_forms(corpus, min_hot_rows).kv)
        want = {
            d: sorted(p) for d, p in want.items() if p
        }
        assert {d: sorted(p) for d, p in got.items()} == want
    else:
        assert ordered(extract_ids(corpus, min_hot_rows)) == {d: p for d, p in want.items() if p}


def test_hot_keys_are_spread(spark):
    """A key with a third of all rows gets many slots, and the join stays exact."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    one = many.select("k").distinct().withColumn("n", F.length("k"))
    hot = skew.hot_keys(many.select(skew.key_hash("k").alias("hash")), 1000, 100)
    assert [r.salts for r in hot.collect()] == [100]
    slots = skew.slot_many(many, ["k"], ["id"], hot).filter("k = 'hot'")
    assert slots.select("slot").distinct().count() == 100
    joined = skew.spread_join(many, one, ["k"], "inner", ["id"], hot)
    assert joined.count() == 30_000 and joined.select("id").distinct().count() == 30_000


def test_hot_word_and_document(spark):
    """One document holds most blocks and all its keys share one word."""
    pages = [
        page("big", [key(f"k{i}", float(i), CHILD=["w", f"n{i}"]), word(f"n{i}", str(i)),
                     word("w", "Key")], i)
        for i in range(300)
    ] + [page(f"s{i}", [key("k", CHILD=["w"]), word("w", "small")]) for i in range(20)]
    corpus = frame(spark, pages)
    hot = kv.hot_targets(corpus, 50)
    assert hot.count() == 1
    found = extract_forms(corpus, 50)
    got = ordered(found.kv)
    assert [r[0] for r in got["big"]] == [f"Key {i}" for i in range(300)]
    assert len(got) == 21 and found.rejects.count() == 0
    text = kv.block_text(corpus, "form", hot).filter("doc_id = 'big'")
    assert text.count() == 300 and text.filter("text = 'Key 7'").count() == 1


def test_job_gate(spark):
    pages = [
        page("ok", [], 0, "IN_PROGRESS"), page("ok", [word("a", "x")], 1),
        page("bad", [], 0, "FAILED", "broken file"), page("bad2", [], 0, "FAILED"),
        page("wait", [], 0, "IN_PROGRESS"),
        page("retried", [], 0, "FAILED", "first"), page("retried", [], 1, "SUCCEEDED", job="j2"),
        page("retried", [], 2, None, job="j2"), page("retried", [], 3, "IN_PROGRESS", job="j3"),
        page("twice", [], 0, "SUCCEEDED"), page("twice", [], 1, "SUCCEEDED", job="j2"),
    ]
    ready, blocked, rejects = gate_jobs(frame(spark, pages))
    assert sorted((r.doc_id, r.page_seq) for r in ready.collect()) == [
        ("ok", 0), ("ok", 1), ("retried", 1), ("retried", 2), ("twice", 1)
    ]
    assert {r.doc_id for r in blocked.collect()} == {"bad", "bad2", "wait"}
    assert {(r.doc_id, r.detail) for r in rejects.collect()} == {
        ("bad", "broken file"), ("bad2", "Unknown error")
    }


def test_later_attempts_and_nameless_jobs(spark):
    """A newer job of one page beats an older one of many; a null job id is a job."""
    rows = [("a", "old", s, "SUCCEEDED", None, [word("x", "1")], 1) for s in range(9)]
    rows += [("a", "new", 0, "SUCCEEDED", None, [word("x", "2")], 2)]
    rows += [("b", "old", 5, "SUCCEEDED", None, [], 1), ("b", "new", 0, "FAILED", "late", [], 2)]
    rows += [("c", "old", 5, "IN_PROGRESS", None, [], 1), ("c", "new", 0, "FAILED", "late", [], 2)]
    rows += [("d", None, 0, "SUCCEEDED", None, [], 1), ("d", None, 1, None, None, [], 1)]
    rows += [("e", None, 0, "FAILED", None, [], 1), (None, None, 0, "FAILED", "who", [], 1)]
    rows += [("f", None, 3, "FAILED", None, [], 1), ("f", "j", 1, "SUCCEEDED", None, [], None)]
    pages = spark.createDataFrame(rows, types.FORM_PAGE + ", attempt bigint")
    ready, blocked, rejects = gate_jobs(pages)
    assert sorted((r.doc_id, str(r.job_id), r.page_seq) for r in ready.collect()) == [
        ("a", "new", 0), ("b", "old", 5), ("d", "None", 0), ("d", "None", 1), ("f", "j", 1),
    ]
    assert {r.doc_id for r in blocked.collect()} == {"c", "e", None}
    assert {(r.doc_id, r.detail) for r in rejects.collect()} == {("c", "late"), ("e", "Unknown error"), (None, "who")}


def test_classification_and_edges(corpus):
    blocks = explode_blocks(corpus)
    no_types = blocks.filter("doc_id = 'no_types'")
    assert value_blocks(no_types, "form").count() == 1
    assert value_blocks(no_types, "id").count() == 0
    assert key_blocks(no_types).count() == 1
    rows = edges(blocks.filter("doc_id = 'multi_value' and block_id = 'k'"))
    assert {(r.rel_type, r.child_pos, r.child_id) for r in rows.collect()} == {
        ("CHILD", 0, "a"), ("VALUE", 0, "v1"), ("VALUE", 1, "gone"), ("VALUE", 2, "v2")
    }
    lost = dangling(edges(blocks), explode_blocks(corpus, "block_id"))
    assert {r.doc_id for r in lost.collect()} == {
        "multi_value", "first_dangling", "dangling_child", "unvisited_dangling"
    }


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_by_document_plan(spark, tmp_path, corpus):
    """Three exchanges, all of them the first dealing of blocks; nothing is sorted before it."""
    corpus.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.schema(types.FORM_PAGE).parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with skew.partitions_kept(spark):
            plan = plan_of(kv.pair_blocks(stored, "form", by_document=True))
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange ") == 3
    for below in plan.split("Exchange ")[1:]:
        depth = below.split("\n")[1].find("+-")
        inside = [x for x in below.split("\n")[1:] if x.find("+-") >= depth > 0 or x.find(":-") >= depth > 0]
        assert not any("Sort " in x or "Aggregate" in x for x in inside[:4])


def test_giant_documents_are_paired_block_by_block(spark, monkeypatch):
    small = [page(f"s{i}", [key("k", VALUE=["v"], CHILD=["w"]), value("v", CHILD=["x"]), word("w", "a"), word("x", str(i))]) for i in range(30)]
    big = [page("big", [key(f"k{i}", VALUE=["v"], CHILD=["w"]), value("v", CHILD=["x"]), word("w", "a"), word("x", "big")], i) for i in range(50)]
    corpus = frame(spark, small + big)
    assert kv.giant_documents(corpus, 100) == ["big"] and kv.giant_documents(corpus, 1000) == []
    assert kv.giant_documents(corpus.limit(0), 0) == []
    whole, parted = (sorted(map(tuple, kv.pair_pages(corpus, "form", g, 20).collect())) for g in ([], ["big"]))
    assert whole == parted and len(whole) == 80


def test_pairing_happens_once(spark, corpus):
    """What remains of it in the results are scans of the stored pairs."""
    found = extract_forms(corpus)
    for df in (found.kv, found.rejects, found.docs):
        plan = plan_of(df)
        assert "collect_list" not in plan and "posexplode" not in plan


def test_pairing_plan(spark, tmp_path, corpus):
    """Six exchanges, each a change of key; scans leave unused block fields out."""
    corpus.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.schema(types.FORM_PAGE).parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(kv.pair_blocks(stored, "form"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 6
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    schemas = [x.split("\n")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert len(schemas) == 3
    assert sum("Text" in x for x in schemas) == 1
    assert sum("Relationships" in x or "..." in x for x in schemas) >= 2


def test_dealt_pages_stay_where_they_are(spark, corpus):
    """The gate, pairing and de-duplication leave pages in the tasks they were dealt to, and make arrays once."""
    dealt = corpus.repartition(3, "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with skew.partitions_kept(spark):
            ready = gate_jobs(dealt)[0]
            plans = [plan_of(kv.pair_blocks(ready, "form", by_document=True, dealt=True)), plan_of(kv.tokens(dealt, "form"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    for plan in plans:
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") > 0
        assert "size(" not in plan.split("Generate")[-1]


def test_spread_tasks_grow_with_rows(spark):
    rows = spark.range(10)
    few, many = (derived.spread(rows, n, ("id",)).rdd.getNumPartitions() for n in (10, 50 * derived.ROWS_PER_TASK))
    assert few == spark.sparkContext.defaultParallelism and many == 50


def untidy_document(rng):
    """Blocks as in ``random_document``, some of them and some children without an id."""
    blocks = random_document(rng)
    for b in blocks:
        b["Id"] = None if rng.random() < 0.1 else b["Id"]
        for r in b["Relationships"] or []:
            r["Ids"] = None if rng.random() < 0.05 else [None if rng.random() < 0.1 else i for i in r["Ids"]]
    return blocks


@pytest.mark.parametrize("mode", ["form", "id"])
def test_pairs_within_a_row_are_those_of_the_joins(spark, mode, monkeypatch):
    """Also with null ids and pages of one number, and where a part of the documents is too large for a row."""
    rng = random.Random(11)
    pages = []
    for d in range(120):
        blocks = untidy_document(rng)
        cut = rng.randint(0, len(blocks))
        pages += [page(f"d{d}", blocks[:cut], 0), page(f"d{d}", blocks[cut:], rng.randint(0, 1))]
    pages += [page("void", None), page(None, [key("k", CHILD=["a"]), word("a", "x")], job="j")]
    corpus = frame(spark, pages).persist()

    def shown(df):
        columns = [*kv.PAIR_COLUMNS, "dangling"]
        return sorted(map(tuple, df.select(columns).collect()), key=str), [df.schema[c].dataType for c in columns]

    named = corpus.filter("doc_id is not null")
    want = shown(kv.pair_blocks(corpus, mode))
    assert shown(kv.pair_rows(named, mode)) == shown(kv.pair_blocks(named, mode))
    assert shown(kv.pair_pages(corpus, mode, [])) == want
    assert kv.size_classes(corpus) == ([], True) and kv.size_classes(named) == ([], False)
    monkeypatch.setattr(kv, "ROW_BLOCKS", 9)
    assert kv.size_classes(named) == ([], True)
    assert shown(kv.pair_pages(corpus, mode, [])) == want


def test_small_documents_need_no_join(spark, corpus):
    """Their pairs come from one grouping of the pages where they were dealt to: nothing is joined or moved."""
    giants, large = kv.size_classes(corpus)
    plan = plan_of(kv.pair_pages(corpus.repartition(3, "doc_id"), "id", giants, dealt=True, large=large))
    assert "Join" not in plan and plan.count("Exchange ") == 1 == plan.count("REPARTITION_BY_NUM")
    assert "posexplode" not in plan


@pytest.mark.parametrize("name", ["block_edges", "block_kinds"])
def test_scans_of_lines_are_split_by_rows(spark, monkeypatch, name):
    """While lines are dealt scans are asked for more tasks the more lines there are; the setting is put back."""
    setting, asked = "spark.sql.files.minPartitionNum", []

    def stage(df, folder):
        asked.append(int(spark.conf.get(setting)))
        return df

    monkeypatch.setattr(registry, "stage", stage)
    monkeypatch.setattr(derived, "ROWS_PER_SCAN", 100)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert asked == [-(-lines // 100)] and asked[0] > 8 and spark.conf.get(setting, None) is None


def shuffled_documents(seed, documents):
    """Pages with null and repeated ids, null children, places that come twice with other content."""
    rnd = random.Random(seed)
    ids = ["a", "b", "c", "d", "e", "x,y", "", None]

    def related():
        kinds = rnd.sample(["VALUE", "CHILD"], rnd.randint(0, 2))
        return {k: rnd.choice([None, [], rnd.choices(ids, k=rnd.randint(1, 4))]) for k in kinds}

    def one():
        kind = rnd.choice(["KEY_VALUE_SET"] * 2 + ["WORD"] * 2 + ["LINE", None])
        types_ = rnd.choice([["KEY"], ["VALUE"], ["VALUE", "KEY"], [], None])
        text = rnd.choice([None, "", " w ", "w1", "w2"])
        return block(rnd.choice(ids), kind, types_, rnd.choice([None, 0.0, 1.0, 2.0]), text, **related())

    pages = []
    for n in range(documents):
        for seq in rnd.choices([0, 1, None], k=rnd.randint(1, 3)):
            one_page = page(f"doc{n}", rnd.choice([None, [], *[[one() for _ in range(6)]] * 6]), seq)
            pages += [one_page] * rnd.choice([1, 1, 1, 2])
    return pages


@pytest.mark.parametrize("mode", ["id", "form"])
def test_rows_pair_odd_documents_as_joins_do(spark, mode):
    pages = frame(spark, shuffled_documents(3, 150))

    def same_keys(pairs):
        return sorted(map(repr, pairs.collect()))

    joined = same_keys(kv.pair_blocks(pages, mode).select(*kv.PAIR_COLUMNS, "dangling"))
    assert same_keys(kv.pair_rows(pages, mode).select(*kv.PAIR_COLUMNS, "dangling")) == joined
    assert len(joined) > 100


def test_rows_look_ids_up_in_maps(corpus):
    plan = kv.pair_rows(corpus, "id")._jdf.queryExecution().executedPlan().toString()
    assert "array_position" not in plan
    # Each map is made once a document, not for every key that reads it.
    assert "map_from_arrays" not in plan[: plan.index("Project")]


def test_dangling_takes_repeated_ids_as_they_come(spark):
    pages = frame(spark, shuffled_documents(4, 60) + [
        page("many", [key("k", CHILD=["a", "gone", None]), *[word("a", "A")] * 50], 0),
        page("many", [word("a", "B"), word(None, "C")], 1),
        page(None, [key("k", CHILD=["k"])]),
    ])
    rows = [
        (p.doc_id, b.Id, r.Type, c)
        for p in pages.collect() for b in p.blocks or [] for r in b.Relationships or [] for c in r.Ids or []
    ]
    known = {(p.doc_id, b.Id) for p in pages.collect() for b in p.blocks or [] if b.Id is not None}
    # A document without an id knows none of its blocks.
    want = [r for r in rows if r[0] is None or (r[0], r[3]) not in known]

    def found(hot):
        children = edges(explode_blocks(pages, "block_id", "relationships"))
        return dangling(children, explode_blocks(pages, "block_id"), hot)

    def listed(df):
        return sorted(map(repr, df.select("doc_id", "block_id", "rel_type", "child_id").toLocalIterator()))

    plain = found(None)
    hot = pages.limit(1).select(skew.key_hash(F.lit("many"), F.lit("a")).alias("hash"), F.lit(3).alias("salts"))
    assert listed(plain) == sorted(repr(r) for r in plain.sparkSession.createDataFrame(
        want, "doc_id string, block_id string, rel_type string, child_id string").collect())
    assert listed(found(hot)) == listed(plain)
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString()
