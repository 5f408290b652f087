"""Importance resampling towards a target, with hashed n-grams.

Every n-gram of a text falls into one of a fixed number of buckets. A bucket's gain is the logarithm
of how much more often target texts use it than the corpus does, smoothed by one; a document's weight is
the mean gain of its n-grams. Documents are drawn without replacement in proportion to the exponent of
their weights: a Gumbel number from a digest of the key is added to each weight, and the highest sums win.

Words become n-grams in Arrow kernels, a batch of texts at a time: lower case, split, flatten, encode as
a dictionary. An n-gram of n words is a pair of an n-gram of n - 1 words and the word after it, found by
shifting the dictionary's indices against one another; every distinct pair is digested once. Taking the gains
of all n-grams and reducing them by text gives the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .common import without
from .packing import slices

#: What parts words, once A to Z are lower case: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
NGRAM = 1
SEED = 2024
#: Documents of fewer words are not drawn; of the others, so many in 100 are.
MIN_WORDS = 20
PERCENT = 10
#: Bytes of text that are split at once.
AT_ONCE = 8_000_000
#: Gains and weights are whole thousandths.
UNIT = 1000
COUNTS = "bucket int, n long"


def _flat_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch in order, as a dictionary array, and the number of the text of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # Splitting leaves empty parts at the ends of a text.
    real = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(real), parents.filter(real)
    return pc.dictionary_encode(words), parents.to_numpy(zero_copy_only=False)


def ngram_buckets(
    texts: pa.Array, n: int = NGRAM, buckets: int = BUCKETS
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For lengths 1 to n: the bucket of every n-gram of a batch, the number of its text, and the length."""
    words, text = _flat_words(texts)
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.as_buffer().to_pybytes() for w in words.dictionary]
    digest = np.array([zlib.crc32(w) for w in spelled], np.int64)
    gram, first = index, text
    for length in range(1, n + 1):
        if length > 1:
            # Each n-gram of one word less, and the word after it, as a pair; runs stay inside a text.
            own = np.flatnonzero(text[length - 1 :] == text[: len(text) - length + 1])
            pair = gram[own] * len(spelled) + index[own + length - 1]
            different, at = np.unique(pair, return_inverse=True)
            longer = [
                zlib.crc32(b" " + spelled[w], int(digest[g]))
                for g, w in zip(*np.divmod(different, max(1, len(spelled))))
            ]
            digest = np.array(longer, np.int64)
            # The place of the n-gram that starts at each word; unused where it would leave its text.
            gram = np.zeros(len(index), np.int64)
            gram[own] = at
            yield digest[at] % buckets, text[own], length
        else:
            yield digest[gram] % buckets, first, length


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many n-grams of all texts fall into each bucket that has any.

    A task counts in one array of ``buckets`` numbers, so the shuffle has at most that many rows a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at, rows in slices(texts, AT_ONCE):
                for found, _, _ in ngram_buckets(texts.slice(at, rows), n, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"]
        )

    parts = texts.select(texts[text_col].alias("text")).mapInArrow(count, COUNTS)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Gain of every bucket, from its counts in target and corpus, as floored thousandths."""
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    share = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(UNIT * np.log(share)).astype(np.int64)


def learn(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
    n: int = NGRAM, buckets: int = BUCKETS,
) -> np.ndarray:
    """Gains over all texts of both tables. What reaches the driver is a number for each bucket."""
    counts = []
    for table, column in ((target, target_col), (docs, text_col)):
        total = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, column, n, buckets).collect():
            total[r["bucket"]] = r["n"]
        counts.append(total)
    return gains(*counts)


def weigh(docs: DataFrame, learned: np.ndarray, text_col: str = "text", n: int = NGRAM) -> Column:
    """``n_words, n_features, weight`` of a text: the weight is the floored mean gain, 0 without n-grams."""
    buckets = len(learned)

    def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, size, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for found, text, length in ngram_buckets(texts, n, buckets):
            # Texts come in order, so every text is one segment.
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            if not len(starts):
                continue
            of = text[starts]
            count = np.diff(np.append(starts, len(text)))
            size[of] += count
            total[of] += np.add.reduceat(learned.take(found), starts)
            if length == 1:
                words[of] = count
        return words, size, total // np.maximum(size, 1)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weights(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [sums(batch.slice(at, rows)) for at, rows in slices(batch, AT_ONCE)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(3)],
                names=["n_words", "n_features", "weight"],
            )

    return weights(docs[text_col])


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths from a digest of the key; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score_documents(
    docs: DataFrame,
    learned: np.ndarray,
    key: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    seed: int = SEED,
) -> DataFrame:
    """Add ``n_words, n_features, weight, score`` to every row, replacing such columns.

    Null and empty texts, and texts without words, have no n-grams and weight 0. Rows are independent:
    repeated ones get equal numbers; the score depends on the key as well. An empty table stays empty.
    """
    kept = without(docs, "n_words", "n_features", "weight", "score")
    rows = docs.select(
        F.struct(*[docs[c] for c in kept.columns]).alias("row"),
        docs[key].alias("key"),
        weigh(docs, learned, text_col, n).alias("w"),
    )
    return rows.select("row.*", "w.*", (F.col("w.weight") + gumbel(F.col("key"), seed)).alias("score"))


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``_rank``, 1 for the first row in this order, by range partitions and their sizes.

    Rows are dealt to tasks by ranges of the order and numbered inside them; what is summed up over all
    tasks is one row a task. The order has to tell all rows apart, or one value may be all of a task.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(shifts), "_part").withColumn("_rank", rank).drop("_at", "_part", "_before")


def draw(
    scored: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Add ``rank`` to rows of ``score_documents``: 1, 2, 3... for the drawn ones, null for the others.

    Drawn are ``percent`` in 100 of the rows with ``min_words`` words or more, highest scores first; ties go
    to the smaller key, a null key last. Repeated rows count each by itself and take ranks next to
    one another. An input column ``rank`` is replaced. An empty table gives an empty result.
    """
    rows = stage(without(scored, "rank").withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= min_words
    # Scores are whole thousandths in a range that the buckets bound, so there are not many different ones.
    marks = rows.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    take = percent * F.sum("n").over(Window.partitionBy()) / 100
    edge = marks.select("score", upto.alias("upto"), F.floor(take).alias("take")).filter("upto >= take AND take > 0")
    found = edge.orderBy(F.desc("score")).first()
    if found is None:
        return rows.drop("_row").withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= found["score"])
    best = numbered(rows.filter(near), [F.desc("score"), F.asc_nulls_last(key), F.asc("_row")])
    best = best.withColumn("rank", F.when(F.col("_rank") <= found["take"], F.col("_rank")))
    rest = rows.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return best.drop("_rank", "_row").unionByName(rest.drop("_row"))
