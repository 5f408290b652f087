"""Packing token sequences, shortest pack first, over the histogram of lengths.

Documents become token ids with an end id, cut into pieces of at most the sequence length. Whole
pieces are sequences of their own. The other pieces are counted by length, and the histogram, of a
fixed size, is packed on the driver: lengths from longest to shortest, each into the packs that are
shortest so far. Packs of equal content are one pattern with a count, so a step updates counts
and never touches single packs. Then the pieces of each length are ranked, and a rank is looked up
in the pattern runs of its length, which give sequence and offset.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import stage
from .common import give_back, remembered, without

LENGTH = 2048
END_ID = 1
#: Ranks are counted in so many parts of each length, so that a length with a third of all
#: pieces is no single task's work.
RANK_PARTS = 256
#: Stems whose ids a Python worker remembers: about 60 MB when full.
CACHED_STEMS = 300_000
#: Bytes of text that are tokenized at once.
AT_ONCE = 6_000_000

#: Letters that stay one letter in composed lower case, and marks that follow a word.
_LETTER = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]$"
_MARKS = ".,;:!?"
#: A token of its own that is put between stems when many are encoded as one text.
_BETWEEN = "|"

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def _load(path: str) -> tuple[object, dict[str, bytes]]:
    """The tokenizer, and the ids of stems that a worker remembers."""

    def load():
        # One task is one core's work; the library would start a thread for each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path), {}

    return remembered(("packing", path), load)


def encode_parts(tokenizer, parts: list[str], block: int = 2000) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each part, which must not hold ``_BETWEEN``.

    Many parts are one text with that mark between them, which is cheaper than a text each; where it
    does not come back as often as it was put in, they are encoded one by one.
    """
    mark = tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
    for start in range(0, len(parts), block):
        own = parts[start : start + block]
        # One block at a time: an encoding holds far more than ids.
        [e] = tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(own)], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        at = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
        if len(at) == len(own) - 1:
            raw = ids.tobytes()
            starts, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)]
            yield from (raw[a:b] for a, b in zip(starts, ends))
        else:
            for x in tokenizer.encode_batch_fast(own, add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()


def part_ids(parts: list[str], path: str) -> list[bytes]:
    """Ids of different parts of texts; a worker remembers those it has seen."""
    tokenizer, known = _load(path)
    fresh = [p for p in parts if p not in known]
    plain = [p for p in fresh if _BETWEEN not in p]
    found = dict(zip(plain, encode_parts(tokenizer, plain)))
    if len(plain) < len(fresh):
        odd = [p for p in fresh if _BETWEEN in p]
        ids = tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        found.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(odd, ids))
    out = [found[p] if p in found else known[p] for p in parts]
    known.update(itertools.islice(found.items(), max(0, CACHED_STEMS - len(known))))
    return out


def _different(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Different values, and the index of each row among them."""
    encoded = pc.dictionary_encode(values)
    return encoded.indices.to_numpy(), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()


def token_bytes(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Ids of whole texts, each with the end id, as little-endian 32-bit numbers."""
    ids, ends = token_ids(pa.array(texts, pa.string()), path, end_id)
    return [p.astype("<u4").tobytes() for p in np.split(ids, ends[:-1])] if texts else []


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts one after the other, each with the end id, and the place where each ends.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    parts between blanks and line feeds; any other white space stays inside its part and is left to the
    tokenizer. Marks after a letter are tokens of their own, so a part is a stem and its marks, unless
    the letter may end in a combining mark once composed and lower case. Parts are split and encoded as
    a dictionary in Arrow, and Python meets every different stem once; taking their ids by the
    dictionary's indices puts the texts together again.
    """
    lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
    words = pc.dictionary_encode(lists.flatten())
    bare = pc.utf8_rtrim(words.dictionary, _MARKS)
    apart = pc.match_substring_regex(bare, _LETTER)
    stem, stems = _different(pc.if_else(apart, bare, words.dictionary))
    marks = pc.replace_substring_regex(words.dictionary, rf"(?s)^.*?([{_MARKS}]*)$", r"\1")
    tail, tails = _different(pc.if_else(apart, marks, pa.scalar("", marks.type)))
    raw = part_ids(stems, path) + part_ids(tails, path)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    table = pa.LargeListArray.from_arrays(
        np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(raw), "<u4")
    )
    # Stem and tail of every word of the texts, by turns.
    both = np.stack([stem, tail + np.int32(len(stems))], axis=1)[words.indices.to_numpy()]
    ids = table.take(pa.array(both.reshape(-1))).flatten().to_numpy()
    upto = np.concatenate([[0], np.cumsum(sizes[both].sum(axis=1))])
    places = lists.offsets.to_numpy().astype(np.int64)
    ends = upto[places[1:] - places[0]]
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as start and number, of about ``most`` bytes each, one row at least."""
    sizes = np.nan_to_num(
        pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    )
    block = (np.cumsum(sizes) // most).astype(np.int64)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    yield from zip(starts.tolist(), np.diff(np.append(starts, len(texts))).tolist())


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` and, if wanted, ``ids`` for every piece.

    A text is cut at every ``length`` ids. A null or empty text is the end id alone. Repeated rows
    give repeated pieces. ``ids`` is an array of int.
    """
    columns = f"{PIECE}, ids binary" if with_ids else PIECE
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n_rows in slices(batch.column(1), AT_ONCE):
                part = batch.slice(at, n_rows)
                ids, ends = token_ids(part.column(1), tokenizer_path, end_id)
                sizes = np.diff(ends, prepend=0)
                pieces = -(-sizes // length)
                origin = np.repeat(np.arange(n_rows), pieces)
                # The number of a piece inside its text.
                place = np.arange(len(origin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, whole = place * length, sizes[origin]
                size = np.minimum(length, whole - start)
                first = (ends - sizes)[origin] + start
                raw = ids.astype("<u4").tobytes()
                view = memoryview(raw)
                cuts = [view[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), size.tolist())]
                arrays = [part.column(0).take(pa.array(origin, pa.int64()))]
                arrays += [pa.array(a, pa.int64()) for a in (start, size, [zlib.crc32(c) for c in cuts], whole)]
                names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                del ids, ends, raw, view, cuts, arrays
                give_back()

    pieces = docs.select(docs[key].alias("key"), docs[text_col].alias("text")).mapInArrow(
        cut, f"key {kind}, {columns}"
    )
    return pieces.withColumnRenamed("key", key)


@dataclass(frozen=True)
class Run:
    """Ranks ``first .. first + packs * each - 1`` of a length: ``each`` of them, one after the other
    from ``offset`` on, go to every sequence from ``sequence`` on."""

    length: int
    first: int
    packs: int
    each: int
    sequence: int
    offset: int


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[Run], int]:
    """Pattern runs for a histogram of lengths, and the number of sequences.

    From longest to shortest, all pieces of a length go to the shortest packs with room for
    them, and pieces without one open new packs, which the next pieces of their length fill. Packs of
    equal content are one pattern with a count: it takes as many pieces a pack as keep it the shortest, and is
    split in two where only some of its packs get one. The histogram has at most ``length``
    entries, so time and result depend on that and not on the number of pieces.
    """
    #: Open patterns as a heap by filled length: (filled, order, packs, ((size, pieces of it), ...)).
    heap: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []
    done: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    order = 0

    def put(filled: int, packs: int, content: tuple[tuple[int, int], ...], size: int, each: int) -> None:
        nonlocal order
        if content and content[-1][0] == size:
            content, each, filled = content[:-1], each + content[-1][1], filled - size * content[-1][1]
        order += 1
        new = (filled + size * each, order, packs, (*content, (size, each)))
        if new[0] == length:
            done.append((packs, new[3]))
        else:
            heapq.heappush(heap, new)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and heap and heap[0][0] + size <= length:
            filled, _, packs, content = heapq.heappop(heap)
            room = (length - filled) // size
            each = min(room, (heap[0][0] - filled) // size + 1 if heap else room, left // packs)
            used = packs if each else left
            if used < packs:
                order += 1
                heapq.heappush(heap, (filled, order, packs - used, content))
            put(filled, used, content, size, max(1, each))
            left -= used * max(1, each)
        each = length // size
        if left // each:
            put(0, left // each, (), size, each)
        if left % each:
            put(0, 1, (), size, left % each)
    patterns = done + [(packs, content) for _, _, packs, content in sorted(heap)]
    runs: list[Run] = []
    ranked: dict[int, int] = {}
    sequence = 0
    for packs, content in patterns:
        offset = 0
        for size, each in content:
            first = ranked.get(size, 0)
            runs.append(Run(size, first, packs, each, sequence, offset))
            ranked[size] = first + packs * each
            offset += size * each
        sequence += packs
    return runs, sequence


def assign_sequences(pieces: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see ``tokenize_pieces``).

    ``pieces`` is read several times, so it should be a stored table. Pieces of a length are ranked
    within parts, by a digest, and the parts' ranks are shifted by the parts before them: at most
    ``RANK_PARTS`` rows for each length. Runs are as many as the histogram allows, so they are
    broadcast.
    """
    spark = pieces.sparkSession
    base = without(pieces, "sequence_id", "offset")
    digest = F.xxhash64(key, "start", "ids_crc32", "doc_tokens")
    parted = base.withColumn("_part", F.pmod(digest, F.lit(RANK_PARTS)))
    counts = stage(
        parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "lengths"
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = pack_histogram(histogram, length)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("length").alias("_l"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("length", "_part").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = parted.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(shifts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = spark.createDataFrame(
        [(r.length, r.first, r.first + r.packs * r.each, r.each, r.sequence, r.offset) for r in runs],
        "_length long, _first long, _end long, _each long, _sequence long, _offset long",
    )
    placed = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_end")),
    )
    place = F.col("_rank") - F.col("_first")
    return placed.select(
        *base.columns,
        (F.col("_sequence") + F.floor(place / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + place % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place: see ``tokenize_pieces``, ``assign_sequences``."""
    pieces = tokenize_pieces(docs, tokenizer_path, key, text_col, length, end_id, with_ids)
    return assign_sequences(stage(pieces, "pieces"), key, length)


def padded_length(filled: int, length: int = LENGTH) -> int:
    """Length of a sequence after padding: as it is if a power of two, else the full length."""
    return filled if filled & (filled - 1) == 0 else length


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, n_tokens``: the pieces' ids put together and padded.

    Takes pieces with ``ids``. A sequence is a bounded group: at most ``length`` ids.
    """
    whole = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces")
    )

    @F.pandas_udf("array<int>")
    def joined(pieces):
        import pandas as pd

        def one(row) -> np.ndarray:
            ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in row), "<u4").astype(np.int32)
            return np.pad(ids, (0, padded_length(len(ids), length) - len(ids)), constant_values=pad_id)

        return pd.Series([one(row) for row in pieces])

    n = F.aggregate("pieces", F.lit(0), lambda a, p: a + (F.length(p["ids"]) / 4).cast("int"))
    return whole.select("sequence_id", joined("pieces").alias("ids"), n.alias("n_tokens"))
