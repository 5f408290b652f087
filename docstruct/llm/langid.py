"""Language identification with a linear-chain conditional random field.

Every word of a text gets a language. A word's features are its affixes, its character n-grams and
the languages a lexicon has seen it in; transitions between languages are learned too, from
sequences that switch language in the middle. Word marginals come from the forward-backward
recursions, a text's language from the mean of its words' marginals.

Training takes a bounded sample of labelled texts. Prediction is exact over whole texts: a text
is cut into blocks whose transfer matrices are multiplied up side by side, and then the
recursions run inside all blocks at once, so one long text is as fast as many short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import give_back, remembered, without

#: Bounds of the training sample: texts of a language, and of all languages; each has one at least.
TEXTS = 100
ALL_TEXTS = 20_000
#: Texts of more characters are only picked where a language has too few shorter ones.
LONG = 20_000
#: Whole texts are learned from as sequences of so many words.
WORDS = 48
UNKNOWN = "und"

#: Hashed feature space of n-grams and affixes; the lexicon has its own rows behind it.
SPACE = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Confidence steps of the lexicon features.
STEPS = (0.6, 0.9, 0.99)
BLOCK = 64
#: Words that are labelled at once, different words that are scored at once, and word scores that a
#: Python worker remembers.
AT_ONCE = 100_000
SCORED = 20_000
CACHED_WORDS = 300_000

#: Letters, and numerals such as a half, which are no letters.
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _LETTERS.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def _features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words one after another, and the word each belongs to.

    Words stand between boundary marks, so n-grams with a mark are affixes. Every n-gram of
    ``ORDERS`` is a feature; n-grams never cross words.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4")
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    value = np.zeros(len(codes), np.uint64)
    ids, own = [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            fits = room >= n
            nxt = np.zeros(len(codes), np.uint64)
            nxt[: len(codes) - n + 1] = codes[n - 1 :]
            value = (value * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(n)) * np.uint64(
                0xBF58476D1CE4E5B9
            )
            if n in ORDERS:
                ids.append(((value >> np.uint64(40)) % np.uint64(SPACE))[fits].astype(np.int64))
                own.append(owner[fits])
    return np.concatenate(ids), np.concatenate(own)


@dataclass
class Field:
    """The trained model: a weight row for each feature, transitions, and the lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    #: Word to the number of its lexicon feature, counted from the end of the hashed features.
    lexicon: dict[str, int]
    name: str
    scores: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Scores of different words, a row each."""
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), SCORED):
            out[at : at + SCORED] = self._emissions(words[at : at + SCORED])
        return out

    def _emissions(self, words: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        ids, own = _features(words)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(own, self.weights[ids, k], len(words))
        out /= np.sqrt(np.bincount(own, minlength=len(words)))[:, None]
        look = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        has = look >= 0
        out[has] += self.weights[SPACE + look[has]]
        return out


def forward_backward(
    emission: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, block: int = BLOCK
) -> np.ndarray:
    """Word marginals of sequences that stand one after another in ``emission``.

    With A the transitions and e the emissions, both as factors, the recursions multiply by
    A diag(e). Each block's product is built up first, all blocks side by side; a pass over
    blocks carries the messages from block to block; then the recursions run inside all blocks.
    """
    n, k = emission.shape
    if not n:
        return emission.copy()
    a = np.exp(transitions - transitions.max())
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    blocks = -(-lengths // block)
    nb = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    # Words into a grid of blocks; a place without a word leaves messages as they are.
    seq = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first[seq] + inside // block, inside % block
    grid = np.ones((block, nb, k))
    used = np.zeros((block, nb), bool)
    grid[col, row] = e
    used[col, row] = True

    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        on = used[t]
        if not on.any():
            break
        step = (product[on].reshape(-1, k) @ a).reshape(-1, k, k) * grid[t][on][:, None, :]
        product[on] = step / step.max(axis=(1, 2), keepdims=True)

    enter = np.full((nb, k), 1.0 / k)
    leave = np.ones((nb, k))
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    for b in range(1, int(sizes[0]) if len(sizes) else 0):
        has = order[: int(np.searchsorted(-sizes, -b, side="left"))]
        to = first[has] + b
        v = np.einsum("ij,ijk->ik", enter[to - 1], product[to - 1])
        enter[to] = v / v.sum(axis=1, keepdims=True)
        back = first[has] + blocks[has] - 1 - b
        w = np.einsum("ijk,ik->ij", product[back + 1], leave[back + 1])
        leave[back] = w / w.sum(axis=1, keepdims=True)

    forward = np.empty((block, nb, k))
    v = enter
    for t in range(block):
        new = (v @ a) * grid[t]
        v = np.where(used[t][:, None], new / new.sum(axis=1, keepdims=True), v)
        forward[t] = v
    w = leave
    marginal = np.empty((block, nb, k))
    for t in range(block - 1, -1, -1):
        both = forward[t] * w
        marginal[t] = both / both.sum(axis=1, keepdims=True)
        new = (grid[t] * w) @ a.T
        w = np.where(used[t][:, None], new / new.sum(axis=1, keepdims=True), w)
    return marginal[col, row]


def _lexicon(
    sample: list[tuple[int, list[str]]], k: int, least: int = 3
) -> dict[str, int]:
    """Words seen at least ``least`` times in half of the sample: their language and confidence."""
    counts: dict[str, np.ndarray] = {}
    for lang, words in sample[::2]:
        for w in words:
            counts.setdefault(w, np.zeros(k))[lang] += 1
    out = {}
    for w, c in counts.items():
        share = c.max() / c.sum()
        if c.sum() >= least and share >= STEPS[0]:
            out[w] = int(c.argmax()) * len(STEPS) + sum(share >= s for s in STEPS) - 1
    return out


def train(
    sample: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4
) -> Field:
    """Fit on ``language, words`` pairs by gradient steps on the conditional likelihood.

    Pairs of one language would teach that languages never change, so texts are cut into runs of
    words and runs of random languages are strung together.
    """
    sample = [(lang, w) for lang, w in sample if w]
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    if not k:
        return Field([], np.zeros((SPACE, 0)), np.zeros((0, 0)), {}, "none")
    numbered = [(languages.index(lang), w) for lang, w in sample]
    rng = np.random.default_rng(3)
    lexicon = _lexicon(numbered, k)
    runs = []
    for lang, words in numbered:
        at = 0
        while at < len(words):
            n = int(rng.integers(6, 25))
            runs.append((lang, words[at : at + n]))
            at += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    words = [w for _, r in runs for w in r]
    label = np.array([lang for lang, r in runs for _ in r], np.int64)
    types: dict[str, int] = {}
    token = np.array([types.setdefault(w, len(types)) for w in words], np.int64)
    # Strings of four runs: long enough to switch, short enough to run side by side.
    size = np.array([len(r) for _, r in runs])
    lengths = np.add.reduceat(size, np.arange(0, len(size), 4)) if len(size) else size
    starts = np.cumsum(lengths) - lengths

    ids, own = _features(list(types))
    look = np.fromiter((lexicon.get(w, -1) for w in types), np.int64, len(types))
    has = look >= 0
    norm = np.sqrt(np.bincount(own, minlength=len(types)))[:, None]
    weights = np.zeros((SPACE + k * len(STEPS), k))
    transitions = np.zeros((k, k))
    # Neighbours within a string; expected transitions come from the pairwise marginals.
    follows = np.ones(len(words), bool)
    follows[starts] = False
    prev = np.flatnonzero(follows) - 1
    nxt = prev + 1
    seen = np.zeros((k, k))
    np.add.at(seen, (label[prev], label[nxt]), 1)
    squares = [np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)]
    for _ in range(rounds):
        emission_of = np.zeros((len(types), k))
        for c in range(k):
            emission_of[:, c] = np.bincount(own, weights[ids, c], len(types))
        emission_of /= norm
        emission_of[has] += weights[SPACE + look[has]]
        emission = emission_of[token]
        p, pairs = _expectations(emission, transitions, starts, lengths)
        error = -p
        error[np.arange(len(words)), label] += 1
        by_type = np.zeros((len(types), k))
        np.add.at(by_type, token, error)
        grad = np.zeros_like(weights)
        scaled = by_type / norm
        for c in range(k):
            grad[:SPACE, c] = np.bincount(ids, scaled[own, c], SPACE)
        np.add.at(grad, SPACE + look[has], by_type[has])
        grads = [grad - penalty * len(words) * weights / 100, (seen - pairs)]
        for i, target in enumerate((weights, transitions)):
            squares[i] += grads[i] ** 2
            target += rate * grads[i] / np.sqrt(squares[i])
    name = f"{hash((tuple(languages), weights.sum(), transitions.sum()))}"
    return Field(languages, weights.astype(np.float32), transitions, lexicon, name)


def _expectations(
    emission: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and the expected number of each transition, strings side by side."""
    n, k = emission.shape
    a = np.exp(transitions - transitions.max())
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    forward, backward = np.empty((n, k)), np.ones((n, k))
    longest = int(lengths[0]) if len(lengths) else 0
    v = np.full((len(lengths), k), 1.0 / k)
    for t in range(longest):
        m = int(np.searchsorted(-lengths, -t, side="left"))
        new = (v[:m] @ a) * e[starts[:m] + t]
        v = new / new.sum(axis=1, keepdims=True)
        forward[starts[:m] + t] = v
    pairs = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        m = int(np.searchsorted(-lengths, -(t + 1), side="left"))
        at = starts[:m] + t
        ahead = e[at + 1] * backward[at + 1]
        joint = forward[at][:, :, None] * a[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = ahead @ a.T
        backward[at] = new / new.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), pairs


def training_sample(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    texts: int = TEXTS,
    all_texts: int = ALL_TEXTS,
    n_words: int = WORDS,
) -> list[tuple[str, list[str]]]:
    """A bounded sample of labelled texts, whole, as sequences of up to ``n_words`` words.

    Every language has ``texts`` of them, or fewer if all together would be more than ``all_texts``, but
    one at least. Texts are picked by a digest, those of over ``LONG`` characters last. Null languages and
    texts, and texts without letters, teach nothing; copies count once.
    """
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )

    @F.pandas_udf("array<string>")
    def letters(column: pd.Series) -> pd.Series:
        return pd.Series([words_of(text) for text in column], dtype=object)

    # Digests only are ranked; the words of the chosen texts are found before they are moved.
    long_ones = F.length("text") > LONG
    digests = rows.select("lang", F.xxhash64("text").alias("digest"), long_ones.alias("long")).distinct()
    digests = digests.withColumn("order", F.xxhash64("digest", F.lit(17)))
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    texts = max(1, min(texts, all_texts // max(1, languages)))
    by_language = Window.partitionBy("lang").orderBy("long", "order", "digest")
    chosen = (
        digests.withColumn("r", F.row_number().over(by_language)).filter(F.col("r") <= texts).select("lang", "digest")
    )
    # At most ``all_texts`` rows, or one a language, so they go to all tasks.
    picked = rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "digest"])
    found = picked.select("lang", "digest", letters("text").alias("words")).dropDuplicates(["lang", "digest"])
    return [
        (r["lang"], r["words"][at : at + n_words])
        for r in found.orderBy("lang", "digest").collect()
        for at in range(0, len(r["words"]), n_words)
    ]


class _Scores:
    """Emissions of words, remembered by worker as rows of growing tables."""

    def __init__(self, model: Field) -> None:
        self.model = model
        self.rows: dict[str, int]
        self.tables: list[np.ndarray]
        self.rows, self.tables = remembered(
            ("langid", model.name), lambda: ({}, [np.zeros((0, len(model.languages)), np.float32)])
        )

    def of(self, words: list[str]) -> np.ndarray:
        fresh = list({w for w in words if w not in self.rows})
        scores = self.model.emissions(fresh).astype(np.float32)
        room = max(0, CACHED_WORDS - len(self.rows))
        base = len(self.rows)
        self.rows.update((w, base + i) for i, w in enumerate(fresh[:room]))
        self.tables[0] = np.concatenate([self.tables[0], scores[:room]])
        if len(fresh) <= room:
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            return self.tables[0][at]
        end = len(self.rows)
        rest = {w: end + i for i, w in enumerate(fresh[room:])}
        known = self.rows.get
        at = np.fromiter((known(w) if w not in rest else rest[w] for w in words), np.int64, len(words))
        return np.concatenate([self.tables[0], scores[room:]])[at]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """Texts as words, about ``AT_ONCE`` words at a time, with the place of the first one."""
    held: list[list[str]] = []
    start = total = 0
    for i, t in enumerate(texts):
        w = words_of(t)
        held.append(w)
        total += len(w)
        if total >= AT_ONCE:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held


def marginals(model: Field, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of texts one after another, and the texts' lengths."""
    lengths = np.array([len(w) for w in texts], np.int64)
    emission = _Scores(model).of([w for t in texts for w in t]).astype(np.float64)
    some = lengths > 0
    return forward_backward(emission, model.transitions, lengths[some]), lengths


def identify(model: Field, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and mean marginal of each text; ``und`` and 0 for one without letters."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return langs, scores
    for start, words in _batches(texts):
        p, lengths = marginals(model, words)
        some = np.flatnonzero(lengths)
        if not len(some):
            continue
        sums = np.add.reduceat(p, np.cumsum(lengths[some]) - lengths[some])
        mean = sums / lengths[some][:, None]
        best = mean.argmax(axis=1)
        for i, b, m in zip(some.tolist(), best.tolist(), mean.max(axis=1).tolist()):
            langs[start + i], scores[start + i] = model.languages[b], min(1.0, m)
    return langs, scores


def predict(model: Field, text: Column) -> Column:
    """Struct ``lang, score`` of a whole text."""

    @F.arrow_udf("lang string, score double")
    def predicted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            lang, score = identify(model, batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"]
            )
            give_back()

    return predicted(text)


def label_words(model: Field, text: Column) -> Column:
    """Array of ``word, lang, score`` for code-switched text: each word's likeliest language.

    Null, empty and letterless texts have no words, and no text has any for a model without languages.
    Texts are labelled whole; equal texts get equal labels.
    """

    @F.arrow_udf("array<struct<word:string,lang:string,score:double>>")
    def labelled(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
        for batch in column:
            rows = []
            for _, words in _batches(batch.to_pylist()):
                p, lengths = marginals(model, words) if model.languages else (None, None)
                at = 0
                for w in words:
                    part = p[at : at + len(w)] if p is not None else np.zeros((0, 1))
                    at += len(w)
                    rows.append(
                        [
                            {"word": x, "lang": model.languages[int(m.argmax())], "score": float(m.max())}
                            for x, m in zip(w, part)
                        ]
                    )
            yield pa.array(rows, kind)

    return labelled(text)


def identify_documents(
    docs: DataFrame, model: Field, text_col: str = "text"
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row.

    Row by row: repeated rows get equal results, null, empty and letterless texts get ``und`` and 0, an
    empty table stays empty, input columns of these names are replaced.
    """
    found = without(docs.withColumn("_found", predict(model, docs[text_col])), "lang_pred", "score")
    return found.select(
        *[c for c in found.columns if c != "_found"],
        F.col("_found.lang").alias("lang_pred"),
        F.col("_found.score").alias("score"),
    )
