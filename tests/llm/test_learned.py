import random

import numpy as np
import pytest
from docstruct.llm import ann, common, langid, packing, quality, simhash
from docstruct.llm.queries import tokenizer_path
from pyspark.sql import functions as F

from .helpers import DOCS, clash, docs

LONG = "alpha beta gamma delta " * 20_000


# --- language ---------------------------------------------------------------------------------


def slow_marginals(emission, transitions):
    a, e = np.exp(transitions), np.exp(emission)
    n, k = emission.shape
    f, b, v = np.zeros((n, k)), np.ones((n, k)), np.full(k, 1 / k)
    for t in range(n):
        v = (v @ a) * e[t]
        v /= v.sum()
        f[t] = v
    for t in range(n - 2, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


def test_blocked_recursions():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 64, 65, 300, 2, 128])
    emission, transitions = rng.normal(size=(lengths.sum(), 3)) * 4, rng.normal(size=(3, 3)) * 3
    got = langid.forward_backward(emission, transitions, lengths)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], slow_marginals(emission[at : at + n], transitions))
        at += n


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    words = {
        "aa": ["ka", "kaki", "maka", "tika", "kami"],
        "bb": ["ßor", "größ", "froß", "oßer", "gorr"],
    }
    sample = [(lang, [rng.choice(w) for _ in range(40)]) for lang, w in words.items() for _ in range(30)]
    return langid.train(sample, rounds=25)


def test_words_of_switched_text(spark, field):
    text = "kaki maka tika kami ka maka größ froß oßer gorr ßor froß"
    row = docs(spark, [(1, text)]).select(langid.label_words(field, F.col("text")).alias("w")).first()
    langs = [w.lang for w in row.w]
    assert langs == ["aa"] * 6 + ["bb"] * 6
    assert field.transitions[0, 0] > field.transitions[0, 1]


def test_language_of_odd_texts(spark, field):
    rows = [(1, "Kaki MAKA tika"), (2, "größ oßer"), (3, None), (4, ""), (5, "123 !!"), (8, "½ ² Ⅷ _ ٣"), (6, "kaki " * 50_000), (1, "Kaki MAKA tika")]
    table = clash(docs(spark, rows), "lang_pred", "score")
    out = langid.identify_documents(table, field).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in out) == [
        (1, "aa"), (1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "aa"), (8, "und"),
    ]
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify_documents(table.limit(0), field).count() == 0


def test_no_labels_no_language(spark):
    table = docs(spark, [(1, "kaki", "s", None), (2, None, "s", "aa")])
    model = langid.train(langid.training_sample(table))
    assert [r.lang_pred for r in langid.identify_documents(table, model).collect()] == ["und", "und"]


def test_no_language_is_left_out(spark):
    """Languages share the sample; long texts are learned from where there are no others."""
    rows = [(i, f"{chr(0x430 + i)}{chr(0x440 + i % 9)}{chr(0x430 + i)} " * 30, "s", f"l{i:02d}") for i in range(90)]
    rows += [(100 + i, "kaki " * 30_000, "s", "long") for i in range(3)]
    sample = langid.training_sample(docs(spark, rows + rows[:9]), all_texts=100)
    assert {lang for lang, _ in sample} == {r[3] for r in rows}
    assert all(0 < len(w) <= langid.WORDS for _, w in sample)
    assert sum(len(w) for lang, w in sample if lang == "long") == 30_000
    assert sum(len(w) for lang, w in sample if lang == "l07") == 30


def test_language_held_out(spark):
    from docstruct.llm.queries import op1_language

    sf = "/root/testdata/sf0.01"
    got = op1_language(spark, sf).filter("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# --- quality ----------------------------------------------------------------------------------


def test_quality_held_out(spark):
    from docstruct.llm.queries import op2_quality

    sf = "/root/testdata/sf0.01"
    got = op2_quality(spark, sf).filter("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_discriminant_by_hand(spark):
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(1, 2, (200, d)), 1: rng.normal(0, 1, (300, d))}
    rows = [(row.tolist(), k) for k in x for row in x[k]] + [([9.0] * d, None), ([9.0] * d, 5)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int"))
    pooled = (200 * np.cov(x[0].T, bias=True) + 300 * np.cov(x[1].T, bias=True)) / 500
    log = {}
    probe = rng.normal(size=(20, d))
    for k in (0, 1):
        c = 0.5 * np.cov(x[k].T, bias=True) + 0.5 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.01 * np.eye(d)
        z = probe - x[k].mean(axis=0)
        log[k] = np.log(len(x[k]) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z @ np.linalg.inv(c) * z).sum(axis=1)
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_without_classes(spark):
    table = clash(docs(spark, [(1, "a b c"), (2, None), (2, None), (None, ""), (3, LONG)]), "score", "predicted")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.labelled_statistics(table, none))
    assert [r.score for r in quality.score_documents(table, model).collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 1, 0), (None, 0, 0)], none.schema)
    model = quality.fit(quality.labelled_statistics(table, one))
    assert {r.score for r in quality.score_documents(table, model).collect()} == {0.8}
    assert quality.score_documents(table.limit(0), model).count() == 0


# --- SimHash ----------------------------------------------------------------------------------


def slow_components(values):
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(int(values[i]) ^ int(values[j])).count("1") <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [[g == h for h in group] for g in group]


def linked(values, links):
    group = {int(v): i for i, v in enumerate(values)}
    for a, b in links:
        old, new = group[a], group[b]
        group = {k: new if g == old else g for k, g in group.items()}
    return [[group[int(a)] == group[int(b)] for b in values] for a in values]


def near_values(rng, n):
    """Different fingerprints of which many lie near one another."""
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    return np.array(sorted(out)[:n], np.uint64)


def test_bit_sliced_distances():
    rng = random.Random(1)
    v = near_values(rng, 150)
    near = ~simhash.beyond(simhash.planes_of(v)[:, None, :], simhash.query_masks(v)[:, :, None])
    got = simhash._lanes(near)[:, :150]
    want = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    assert (got == want).all()


def test_links_of_buckets():
    rng = random.Random(2)
    v = near_values(rng, 130)
    assert linked(v, simhash.spanning_links(v)) == slow_components(v)
    parts = [near_values(rng, n) for n in (2, 64, 5, 1, 30)]
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
    links = simhash.small_links(np.concatenate(parts), starts)
    for p in parts:
        own = [(a, b) for a, b in links if a in set(p.tolist()) and b in set(p.tolist())]
        assert linked(p, own) == slow_components(p)


@pytest.mark.parametrize("tile", [8, 2048])
def test_classes_of_fingerprints(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (tile,))
    rng = random.Random(7)
    v = near_values(rng, 400)
    rows = [(1000 - i, simhash._signed(int(x))) for i, x in enumerate(v)] + [(None, 5), (3, 5), (None, 99 << 40)]
    rows += [(2000 + i, 0) for i in range(50)]
    got = {r.fp: r.component_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    values = sorted({f for _, f in rows})
    same = slow_components(np.array([f % (1 << 64) for f in values], np.uint64))
    for i, f in enumerate(values):
        ids = [d for d, g in rows for j, h in enumerate(values) if h == g and same[i][j] and d is not None]
        assert got[f] == (min(ids) if ids else None)


def test_near_duplicates_of_odd_texts(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(9, text), (4, text.upper()), (4, text.upper()), (5, None), (6, ""), (7, " \n"), (8, "one two"), (1, LONG)]
    table = clash(docs(spark, rows), "fp", "key", "row", "root", "component_id")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect())
    assert len(got) == len(rows)
    assert {(d, c) for d, _, c in got} == {(9, 4), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (1, 1)}
    assert [f for d, f, _ in got if d == 5] == ["0" * 16]
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 8]
    assert simhash.near_duplicates(table.limit(0)).count() == 0
    assert simhash.keep_one(table.limit(0)).count() == 0


# --- nearest neighbours -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (150, 8)) for c in range(10)]).astype(np.float32)
    x[40:90] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(3000, None, 0), (3100, [0.0] * 8, 0), (3200, [float("nan")] * 8, 0), (3300, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0)]
    table = clash(spark.createDataFrame(rows + odd + rows[:3], VECTORS), "x", "leaf", "score")
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, block=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = sorted(zip(d, range(len(d))))[:10]
        assert len(near) == 10 and near == sorted(near)
        assert all(abs(s - d[v]) < 1e-12 for s, v in near)
        hits += len({v for _, v in near} & {v for _, v in true})
    assert hits / (10 * len(found)) > 0.9
    assert [v for _, v in found[60]][:10] == list(range(40, 50))  # equal vectors: smaller ids


def test_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c % 7, 0.5, (250, 6)) for c in range(20)])
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, sample=300).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in near.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(near) == 100 and hits / 1000 > 0.9


def test_sample_is_gathered_in_its_own_size(spark):
    rows = spark.range(50_000, numPartitions=50).selectExpr("xxhash64(id) AS point", "array(1D) AS x", "array(id) AS ids")
    got = {r.point for r in ann.sampled(rows, 400).collect()}
    digest = F.xxhash64("point", F.lit(5))
    assert got == {r.point for r in rows.orderBy(digest, "point").limit(400).collect()}
    before = ann.sampled(rows, 400)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in before
    assert ann.sampled(rows.limit(30), 400).count() == 30 and ann.sampled(rows.limit(0), 400).count() == 0


def test_small_outlying_clusters(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(0, 0.1, (400, 4)) + 100 * rng.normal(size=4) for _ in range(8)]
    x += [rng.normal(0, 0.01, (n, 4)) + 10_000 * (i + 1) * np.eye(4)[i % 4] for i, n in enumerate([1, 2, 3, 5, 1, 4])]
    x = np.concatenate(x)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = ann.nearest(table, F.col("vec_id") >= 3190).collect()
    near = {q: {r.vec_id for r in got if r.query_id == q} for q in range(3190, len(x))}
    assert all(len(v) == 10 for v in near.values())
    assert near[3203] >= {3204, 3205} and near[3201] >= {3202}


def test_most_frequent_length(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(20)]
    for stray in ([(100 + n, [1.0] * n, 0)] for n in range(3, 300)):
        rows += stray
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect()
    assert {r.query_id for r in got} == {0, 10} and len(got) == 20


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (100, [1.0, 3.0], 0), (7, [2.0, 2.0], 0)]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert [g[:3] for g in got] == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(table.limit(1), F.col("vec_id") % 100 == 0).count() == 0


# --- packing ----------------------------------------------------------------------------------


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [
        "It's  a\ttest, isn't it?\x0bfoo bar", "<|endoftext|>x <|ENDOFTEXT|>.", "İSTANBUL ΣΑΣ. é, É!! é",
        "İ. -İ.!", "\ufb1d. \u0958, \u1fb3; ǰ!",
        "", None, " \n ", "a.b.c... 3,14 x\x1cy", "日本語。 ok", "don't. 'll", " z",
    ]
    for t, raw in zip(texts, packing.token_bytes(texts, tokenizer_path())):
        want = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(raw, "<u4").tolist() == want


def test_workers_remember_one_operator(field):
    import pandas as pd

    langid.identify(field, ["the quick fox"])
    packing.token_bytes(["a quick fox"], tokenizer_path())
    assert [name for name, _ in common._REMEMBERED] == ["packing"]
    _, stems = packing._load(tokenizer_path())
    assert "quick" in stems and packing._load(tokenizer_path())[1] is stems
    langid.identify(field, ["the quick fox"])
    assert [name for name, _ in common._REMEMBERED] == ["langid"]
    list(quality.statistics.func(iter([pd.Series(["a quick fox"])])))
    assert not common._REMEMBERED


def placed_pieces(h, length):
    """Contents of all sequences, from runs that have to cover every rank of every length once."""
    runs, n = packing.pack_histogram(h, length)
    filled = {i: [] for i in range(n)}
    for size in h:
        at = 0
        for r in sorted((r for r in runs if r.length == size), key=lambda r: r.first):
            assert r.first == at
            at += r.packs * r.each
        assert at == h[size]
    for r in runs:
        for j in range(r.packs * r.each):
            filled[r.sequence + j // r.each].append((r.offset + j % r.each * r.length, r.length))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert 0 < at <= length
    return filled


def test_histogram_packing():
    rng = random.Random(0)
    for _ in range(20):
        placed_pieces({rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}, 64)


@pytest.mark.parametrize(
    "h,most",
    [
        ({300: 10_000}, 1667),  # six to a sequence
        ({1000: 3000, 30: 50}, 1500),
        ({1: 1000}, 1),
        ({1024: 5, 1: 3000, 2048: 2}, 6),
        ({700: 999, 648: 500}, 500),
        ({}, 0),
    ],
)
def test_sequences_are_full(h, most):
    assert len(placed_pieces(h, 2048)) <= most


def test_skewed_histograms_are_packed_tightly():
    rng = random.Random(9)
    for _ in range(10):
        h = {rng.choice([rng.randint(1, 60), rng.randint(1, 1000)]): rng.choice([3, 40, 900]) for _ in range(80)}
        tokens = sum(k * v for k, v in h.items())
        assert len(placed_pieces(h, 2048)) <= 1.03 * tokens / 2048 + 2


def test_pieces_of_texts(spark):
    from tokenizers import Tokenizer
    import zlib

    plain = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "A b, c."), (2, None), (3, ""), (4, "word | other | İ. " * 700), (5, "x " * 63), (6, LONG)]
    table = clash(docs(spark, rows), "start", "length", "ids_crc32", "doc_tokens", "key")
    got = packing.tokenize_pieces(table, tokenizer_path(), length=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)))
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(a, len(ids[a : a + 64]), ids[a : a + 64].tobytes()) for a in range(0, len(ids), 64)]
        assert found[i] == [(a, n, zlib.crc32(raw), len(ids), raw) for a, n, raw in want]


def test_packed_documents(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (4, LONG)]
    table = clash(docs(spark, rows), "start", "length", "sequence_id", "offset")
    out = packing.pack(table, tokenizer_path(), length=128).cache()
    packed = out.collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id != 4) == 4 + 4 + 1 + 1 + 2
    whole = {}
    for r in packed:
        whole.setdefault(r.sequence_id, []).append(r)
    for parts in whole.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    seqs = packing.sequences(out, 128).collect()
    assert len(seqs) == len(whole) and all(len(s.ids) == packing.padded_length(s.n_tokens, 128) for s in seqs)
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
