"""Importance resampling, exact top-k and fill-in-the-middle against plain models."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from docstruct.llm import fim, importance, topk
from pyspark.sql import functions as F

from .helpers import clash, docs

LONG = "alpha beta gamma delta " * 20_000


# --- fill in the middle -----------------------------------------------------------------------


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in [0, 1, 2, 31, 32, 33, 100, 1000, 70_000]:
        lengths = np.array([rng.randint(1, 9) for _ in range(n)], np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        lanes = fim.SkipList(lengths)
        assert all(u.sum() == n for u in lanes.units) and all(p.sum() == before[-1] for p in lanes.points)
        assert n < 100 or len(lanes.units) > 1
        for rank in {0, n, *(rng.randint(0, n) for _ in range(200))}:
            assert lanes.point(rank) == before[rank]


def slow_fim(doc_id, text, unit=None):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if unit:
        starts = [m.start() for m in re.finditer(unit, text)]
        at = [0, *starts[1:], len(text)] if text else [0]
    else:
        at = list(range(len(text) + 1))
    n = len(at) - 1
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, r"\S+"])
def test_fim_of_odd_texts(spark, unit):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ß日𝄞\n<>PSM") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, LONG), (203, "a <S> b"), (204, "<P"), (205, "P><S<M"), (None, "no key at all")]
    rows += rows[:3]
    table = clash(docs(spark, rows), "n", "form", "output", "cut", "row")
    made = fim.transform(table, unit=unit)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "cut", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == slow_fim(r.doc_id, r.text, unit)
        assert r.again == (r.text or "")
    assert fim.transform(table.limit(0)).count() == 0


# --- importance resampling --------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_grams(text, n):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ngrams_by_shifted_indices(n):
    texts = ["One two  one TWO three", "", None, "ÄÖ über-ß 日本 1x", "...", "two", "one two one two one two", "a\x00b\x7fc"]
    got = [[] for _ in texts]
    for buckets, of, _ in importance.ngram_buckets(pa.array(texts), n, 1000):
        for b, i in zip(buckets, of):
            got[i].append(int(b))
    want = [[zlib.crc32(g.encode()) % 1000 for g in plain_grams(t, n)] for t in texts]
    assert [sorted(g) for g in got] == [sorted(w) for w in want]
    assert all(len(b) == 0 for b, _, _ in importance.ngram_buckets(pa.array([], pa.string()), n, 10))


def slow_draw(rows, target, n, buckets, min_words, percent):
    t, s = np.zeros(buckets, int), np.zeros(buckets, int)
    for text in target:
        for g in plain_grams(text, n):
            t[zlib.crc32(g.encode()) % buckets] += 1
    for _, text in rows:
        for g in plain_grams(text, n):
            s[zlib.crc32(g.encode()) % buckets] += 1
    gain = [
        math.floor(1000 * math.log((a + 1) * (s.sum() + buckets) / ((b + 1) * (t.sum() + buckets))))
        for a, b in zip(t.tolist(), s.tolist())
    ]
    out = []
    for i, text in rows:
        f = [gain[zlib.crc32(g.encode()) % buckets] for g in plain_grams(text, n)]
        w = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = [o for o, (_, text) in zip(out, rows) if len(plain_words(text)) >= min_words]
    best = sorted(fit, key=lambda o: (-o[3], o[0] is None, o[0]))[: percent * len(fit) // 100]
    for rank, o in enumerate(best, 1):
        o[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_draw_of_odd_texts(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "日本"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, LONG), (None, "w1 w2 w3 w4 w5 w6"), (304, "... !"), (7, "w1 w2 w3 w4 w5")]
    rows += [(400, "same words in each of these")] * 150
    target = ["w1 w2 w3 w1 w2 w3", "w5", None, "", "Something else: über w1"]
    table = clash(docs(spark, rows), "rank", "score", "n_words", "w", "key")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    learned = importance.learn(table, bench, n=n, buckets=97)
    got = importance.draw(importance.score_documents(table, learned, n=n), min_words=5, percent=30)
    assert {"text", "w", "key"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    found = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    want = slow_draw(rows, target, n, 97, 5, 30)
    assert found == want
    none = importance.draw(importance.score_documents(table.limit(0), learned, n=n))
    assert none.count() == 0 and "rank" in none.columns
    few = importance.draw(importance.score_documents(table.limit(5), learned, n=n), min_words=99)
    assert [r["rank"] for r in few.collect()] == [None] * 5
    assert (importance.learn(table.limit(0), bench.limit(0), n=n) == 0).all()


# --- exact top-k ------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def slow_topk(rows, k, every):
    good = {
        (i, tuple(math.floor(256 * x) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        near = [
            (-sum(a * b for a, b in zip(v, w)), i)
            for p, v in good if p == q
            for i, w in good if i != q and len(v) == len(w)
        ]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


@pytest.mark.parametrize("shard,queries,leaf", [(8192, 4096, 256), (40, 7, 4)])
def test_topk(spark, shard, queries, leaf):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.4, (60, 6)) for c in range(5)])
    x[100:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (310, [float("nan")] * 6), (320, [None] + [1.0] * 5), (330, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(340, [0.0] * 6), (350, []), (351, []), (360, [1.0, 2.0]), (361, [2.0, -1.0]), (370, [3.0] * 7)]
    rows += rows[:5] + [(20, [0.5] * 6), (380, [-7.0] * 6)]
    table = clash(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), "x", "id", "score", "rank")
    got = topk.nearest(table, F.col("vec_id") % 10 == 0, shard=shard, queries=queries, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == slow_topk(rows, 5, 10)


def test_topk_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), -1.0]) for i in range(30)] + [(50, [1e200, 1e200]), (51, [-1e200, 0.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    got = topk.nearest(table, F.col("vec_id") % 10 == 0, k=3, shard=8, leaf=2).collect()
    edge, best = 2**63 - 1, {}
    for q, _, i, score in slow_topk(rows, 40, 10):
        best.setdefault(q, []).append((-min(max(score, -edge - 1), edge), i))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (q, n, i, -s) for q in sorted(best) for n, (s, i) in enumerate(sorted(best[q])[:3], 1)
    ]


def test_topk_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [2.0, 0.0], 0)], VECTORS)
    got = topk.nearest(table, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]
    assert topk.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.nearest(table, F.col("vec_id") > 5).count() == 0
