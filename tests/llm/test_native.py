import hashlib
import random
import re
import textwrap
from collections import Counter

import pytest
from docstruct.llm import chat, host_rules, licences, mixing, sharding
from pyspark.sql import functions as F

from .helpers import DOCS, clash, docs

LONG = "word other thing " * 30_000


# --- sharding ---------------------------------------------------------------------------------


def slow_table(names, m):
    """Every shard's whole preference list, walked turn by turn."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    names = sorted(names)
    prefer = [
        [(number(f"offset/{n}") + j * (number(f"step/{n}") % (m - 1) + 1)) % m for j in range(m)]
        for n in names
    ]
    owner = {}
    while len(owner) < m:
        for i, p in enumerate(prefer):
            slot = next((s for s in p if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    return [owner[s] for s in range(m)]


def test_table_is_filled_in_turns():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 101)
    assert table == slow_table(names, 101)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_losing_a_shard_moves_little():
    names = [f"n{i}" for i in range(10)]
    before = sharding.fill_table(names, 4099)
    after = sharding.fill_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(before, after) if a != 9)
    assert moved < 0.2 * 4099


@pytest.mark.parametrize("bad", [([], 11), (["a", "a"], 11), (["a"], 10), (["a", "b", "c"], 2)])
def test_bad_tables(bad):
    with pytest.raises(ValueError):
        sharding.fill_table(*bad)


def test_shards_of_odd_rows(spark):
    rows = clash(docs(spark, [(1, "a"), (1, "a"), (None, None), (2, "")]), "slot", "shard")
    out = sharding.assign_shards(rows, "doc_id", ["x", "y", "z"]).collect()
    assert len(out) == 4 and {r.shard for r in out} <= {"x", "y", "z"}
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    empty = sharding.assign_shards(rows.limit(0), "doc_id", ["x"])
    assert empty.count() == 0 and {"slot", "shard", "text"} <= set(empty.columns)


# --- licences ---------------------------------------------------------------------------------


def test_licences_by_canonical_text(spark):
    known = spark.createDataFrame(
        [("L", "The licence, of Foo."), ("L2", "the LICENSE of foo"), ("E", " ... "), (None, "x")],
        "licence string, text string",
    )
    rows = [
        (1, "the license of foo"),
        (2, "Copyright 2020 Me\nTHE -- LICENCE of; Foo!\nAll rights reserved."),
        (3, "the licences of foo"),
        (4, None),
        (5, ""),
        (6, "prose\nThe licence of foo.\nprose"),
        (6, "prose\nThe licence of foo.\nprose"),
        (None, "the license of foo"),
        (7, LONG),
    ]
    table = clash(docs(spark, rows), "digest", "licence")
    found = licences.scan(table, known).collect()
    assert len(found) == len(rows)
    assert sorted(str(r.doc_id) for r in found if r.licence == "L") == ["1", "2", "None"]
    lines = {r.doc_id: r.licences for r in licences.scan_lines(table, known).collect()}
    assert lines == {1: ["L"], 2: ["L"], 6: ["L"], None: ["L"]}
    assert licences.scan(table.limit(0), known).count() == 0
    assert licences.scan(table, known.limit(0)).filter("licence is not null").count() == 0


@pytest.mark.parametrize("width", [40, 60, 72, 79, 2000])
def test_known_texts_as_files(spark, width):
    """Every known text of some length, wrapped, with a title and owners, and as its licence is often spelled."""
    texts = [(n, t) for n, t in licences.KNOWN if len(t) > 200]
    heads = ["", "Copyright (c) 1999-2024 A. Person\nCopyright Big Org, Inc. All rights reserved.\n\n", "\n© 2020 me\n"]
    titles = {"MIT": "The MIT License (MIT)\n\n", "ISC": "ISC License\n", "BSD-3-Clause": "BSD 3-Clause License\n\n",
              "Zlib": "zlib License:\n", "BSD-2-Clause": 'BSD 2-Clause "Simplified" License\n\n'}
    rows, want = [], {}
    for name, text in texts:
        for head in heads:
            for body in (text, text.replace("license", "licence").upper(), text.replace("holder", "owner")):
                want[len(rows)] = name
                rows.append((len(rows), titles.get(name, "") + head + textwrap.fill(body, width, break_long_words=False)))
    table = docs(spark, rows)
    got = {r.doc_id: r.licence for r in licences.scan(table, licences.default_licences(spark)).collect()}
    assert got == want


def test_near_licences_are_none(spark):
    mit = dict(licences.KNOWN[::-1])["MIT"]
    rows = [
        (1, licences.KNOWN[4][1] + " Except on Sundays."),
        (2, licences.KNOWN[4][1].replace("free of charge", "for a charge")),
        (3, "MIT License"),
        (4, "licence licence"),
        (5, "license license"),
        (6, "Copyright notice"),
        (7, "Copyright 2020 notice"),
    ]
    assert mit
    got = {r.doc_id: r for r in licences.scan(docs(spark, rows), licences.default_licences(spark)).collect()}
    assert [r.licence for r in got.values()] == [None] * len(rows)
    assert got[4].digest == got[5].digest
    assert got[6].digest == sha("copyright notice") and got[7].digest == sha("")


# --- host rules -------------------------------------------------------------------------------


def slow_measure(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "é # a|b\n\nx\nx\n x\n", LONG]
    texts += [
        "".join(rng.choice(["a", "b", "c", " ", " ", "\n", " ", "#", "\x0b"]) for _ in range(n))
        for n in range(0, 200, 3)
    ]
    table = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in host_rules.measure(table).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measure(t)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, "few words", "bad") for i in range(40)]
    rows += [(200, good, "bad"), (201, good, None), (202, None, None), (201, good, None)]
    out = host_rules.judge(host_rules.measure(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    kept = {(r.doc_id, r.kept, r.base_failed) for r in out}
    assert (200, False, False) in kept  # only its host speaks against it
    assert (0, True, False) in kept and (201, True, False) in kept and (202, False, True) in kept
    empty = host_rules.judge(host_rules.measure(spark.createDataFrame([], DOCS)))
    assert empty.count() == 0


# --- chat -------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(2)
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\x10", "\x101|", "<<|", None, "", LONG, "é\n\n<s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb<|"]), rng.choice(odd)) for c in range(20) for t in range(c * 7)]
    rows += [(50, None, None, "x"), (50, 3, "assistant", "y"), (50, 3, "assistant", "y"), (None, 0, "assistant", "n")]
    table = clash(spark.createDataFrame(rows, TURNS), "chunk", "examples", "formatted")
    chunks = chat.format_chunks(table)
    got = {r.conv_id: r for r in chat.conversation_digests(chunks).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        r = got[c]
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.n_examples == sum(x[2] == "assistant" for x in turns)
    empty = chat.format_chunks(table.limit(0))
    assert chat.conversation_digests(empty).count() == 0 and chat.expand_examples(empty).count() == 0


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "assistant", "a</s>"), (1, 0, "assistant", "a</s>"), (1, None, "assistant", None), (None, 5, "user", "q"), (None, 6, "assistant", "r")]
    found = chat.expand_examples(chat.format_chunks(spark.createDataFrame(rows, TURNS)))
    got = sorted((str(r.conv_id), r.turn_no, r.target_chars) for r in found.collect())
    assert got == [("1", 0, 0), ("1", 1, 6), ("1", 2, 6), ("None", 1, 1)]
    moved = [
        line for line in chat.format_chunks(spark.createDataFrame(rows, TURNS))._jdf.queryExecution().optimizedPlan().toString().splitlines()
        if "Window" in line
    ]
    assert moved and not any("formatted" in line or "segments" in line for line in moved)


def test_examples_are_prefixes(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(150)]
    chunks = chat.format_chunks(spark.createDataFrame(rows, TURNS))
    found = sorted(chat.example_texts(chunks).collect(), key=lambda r: r.turn_no)
    assert len(found) == 75
    stream = ""
    at = {r.turn_no: r for r in found}
    for t in range(150):
        role = "user" if t % 2 == 0 else "assistant"
        if t in at:
            assert at[t].context == stream + f"<|im_start|>{role}\n" and at[t].target == f"t{t}"
        stream += f"<|im_start|>{role}\nt{t}<|im_end|>\n"
    assert chat.format_chunks(spark.createDataFrame([], TURNS)).count() == 0


def test_digests_read_written_examples(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} é<|") for c in (1, None) for t in range(140)]
    rows += [(2, 0, "user", "alone"), (3, 0, "assistant", None)]
    chunks = chat.format_chunks(spark.createDataFrame(rows, TURNS)).cache()
    whole = {r.conv_id: r for r in chat.conversation_digests(chunks).collect()}
    spread = chat.example_texts(chunks, min_hot=5, per_salt=3)
    written = {}
    for r in spread.collect():
        written.setdefault(r.conv_id, []).append(r)
    assert set(written) == {1, None, 3} and whole[2].example_chars == 0
    for c, examples in written.items():
        assert len(examples) == whole[c].n_examples
        assert whole[c].example_chars == sum(len(r.context + r.target) + len(chat.END) for r in examples)
    # Lengths are those of texts that were made, not sums of places: without the first chunk contexts are shorter.
    cut = chunks.filter("chunk > 0")
    places = {}
    for r in chat.expand_examples(cut).collect():
        places[r.conv_id] = places.get(r.conv_id, 0) + r.target_start + r.target_chars + len(chat.END)
    got = {r.conv_id: r.example_chars for r in chat.conversation_digests(cut).collect()}
    assert set(got) == {1, None} and all(0 < got[c] < places[c] for c in got)


# --- mixing -----------------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    """Reshare the excess of capped sources until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, free = share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        each = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += each * w[s]
            if target[s] >= passes * sizes[s]:
                left += target[s] - passes * sizes[s]
                target[s] = passes * sizes[s]
                free.discard(s)
    return target


def sized(spark, rows):
    table = docs(spark, rows)
    return table.select(
        "doc_id", "source", mixing.text_size(table["text"]).alias("size"),
        mixing.block_key(table["doc_id"]).alias("block_key"),
    )


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a"] * 8 + ["b", "c", "d", None])) for i in range(1500)]
    rows += [(7, "w w w", "b"), (7, "w w w", "b"), (None, None, "a"), (3000, "w " * 3000, "c")]
    sizes = sized(spark, rows).cache()
    targets, draws = mixing.plan_mix(sizes, blocks=64)
    placed = mixing.place(sizes, targets, draws, blocks=64).collect()
    assert len(placed) == len(rows)
    total, taken, want = Counter(), Counter(), {}
    for r in placed:
        total[r.source] += r.size
        taken[r.source] += r.size * len(r.placements)
        want[r.source] = r.target
        assert len(r.placements) <= 2
    expected = slow_targets(total)
    for s, t in want.items():
        assert abs(t - expected[s]) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= (3000 if s == "c" else 60)
    # Quotas: shards hold the same number of blocks, each source's blocks spread over them.
    units = mixing.draw_blocks(sizes, targets, 64)
    per = Counter(r.shard for r in mixing.deal_blocks(units, 8).collect())
    assert max(per.values()) - min(per.values()) <= 3 and sum(per.values()) == units.count()


def test_splitting_is_without_replacement(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 9), (None, 1)], "source string, quota long")
    halves = []
    for seed in range(12):
        leaves = mixing.split_quotas(quotas, 2, seed).collect()
        assert sum(r.quota for r in leaves) == 50
        assert {sum(r.quota for r in leaves if r.shard == s) for s in (0, 1)} == {25}
        halves.append(sum(r.quota for r in leaves if r.shard == 0 and r.source == "a"))
    assert len(set(halves)) > 1 and 17 <= sum(halves) / len(halves) <= 23
    with pytest.raises(ValueError):
        mixing.split_quotas(quotas, 3)


def test_mix_rows(spark):
    rows = [(i, "one two three", "a" if i % 3 else None) for i in range(60)]
    table = clash(docs(spark, rows), "shard", "block_key", "size")
    first = mixing.mix(table, blocks=8, shards=4)
    assert set(table.columns) == set(first.columns)
    a = sorted((r.doc_id, r.shard) for r in first.collect())
    assert a == sorted((r.doc_id, r.shard) for r in mixing.mix(table, blocks=8, shards=4).collect())
    assert abs(len(a) - 90) <= 4 and max(Counter(x for x, _ in a).values()) <= 2
    assert mixing.mix(table.limit(0)).count() == 0
    nothing = docs(spark, [(1, None), (2, "")])
    assert mixing.mix(nothing).count() == 0
    assert F is not None
