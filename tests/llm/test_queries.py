"""Registered queries against their SQL, and the pipeline against plain Python."""

import corpus_pipeline
import pyarrow as pa
import pytest
from check_oracles import compare, connect
from docstruct.llm.oracles import ORACLES
from docstruct.llm.queries import QUERIES
from docstruct.llm import simhash
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, step(spark, kept, SF_DIR).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            marked = [
                (r.doc_id, simhash.fingerprint(simhash.shingle_hashes(r.text.encode())))
                for r in before.collect()
            ]
            group = {d: d for d, _ in marked}
            for d, f in marked:
                for e, g in marked:
                    if bin(f ^ g).count("1") <= 3 and group[d] != group[e]:
                        a, b = sorted((group[d], group[e]))
                        group = {k: a if v == b else v for k, v in group.items()}
            assert ids == set(group.values())
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
            lost = [d for d, q in labels.items() if q == 1 and d not in ids]
            junk = [d for d, q in labels.items() if q == 0 and d in ids]
            assert len(lost) <= 2 and len(junk) <= 3
    pieces = corpus_pipeline.packed(spark, kept, SF_DIR)
    whole = pieces.filter(F.col("start") == 0)
    assert whole.count() == kept.count()


def test_stages_hand_python_few_bytes_at_once(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(5)
    for name, step in corpus_pipeline.STAGES:
        if name == "mixing":  # calls no Python
            continue
        spark.conf.unset(setting)
        step(spark, docs, SF_DIR)
        assert max(r.n for r in texts.mapInArrow(bytes_of, "n long").collect()) < 5_000_000
    spark.conf.set(setting, "1m")
    corpus_pipeline.packed(spark, docs, SF_DIR)
    assert spark.conf.get(setting) == "1m"
    spark.conf.unset(setting)


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF_DIR)
        assert docs.count() == 0
