"""Near-duplicates by SimHash with bit-sliced comparison.

Documents get a 64-bit fingerprint of their word shingles. Different fingerprints that may lie within
the radius meet in buckets (a pigeonhole argument on blocks of bits, twice), and inside a
bucket they are compared bit-sliced: the block's bits are stored as vertical planes, one bit
of 64 fingerprints in a word, and the distances of all 64 lanes grow together in carry-save
counters, plane by plane; once every lane of a block has passed the radius, the rest of its
planes is skipped. Buckets give spanning links, not all pairs, and links are joined to components
by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .common import forget, without

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one bucket that a task compares with as many others at once.
TILE = 2048
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included; of all words if there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long. A null text counts as empty: fingerprint zero."""

    @F.arrow_udf("long")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for batch in texts:
            raw = batch.cast(pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary())
            yield pa.array(
                [_signed(fingerprint(shingle_hashes(t.as_py()))) for t in raw], pa.int64()
            )

    value = fingerprints(docs[text_col])
    return without(docs.withColumn("_fp", value), out).withColumnRenamed("_fp", out)


def bucket_keys(fp: Column) -> Column:
    """Keys of the 16 buckets of a fingerprint: 28 bits each, and 4 bits that name the bucket.

    Two fingerprints within 3 bits agree in one of four blocks of 16 bits, and, the rest being
    48 bits with 3 differences at most, in one of its four blocks of 12 bits as well.
    """
    keys = []
    for i in range(4):
        first = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("bigint")
        high = F.shiftrightunsigned(fp, 16 * i + 16) if i < 3 else F.lit(0).cast("bigint")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            second = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(
                F.shiftleft(first, 16).bitwiseOR(F.shiftleft(second, 4)).bitwiseOR(F.lit(4 * i + j))
            )
    return F.array(*keys)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: ``planes[b]`` holds bit b of all of them, 64 lanes a word."""
    lanes = -len(values) % 64
    padded = np.concatenate([values, np.zeros(lanes, np.uint64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def query_masks(values: np.ndarray) -> np.ndarray:
    """``masks[b]`` is all ones for the queries that have bit b, else zero."""
    bits = (values[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.uint64(0) - bits


def beyond(planes: np.ndarray, masks: np.ndarray, check_every: int = 8) -> np.ndarray:
    """For every query (masks ``[64, ...]``) the lanes of its block that differ in over 3 bits.

    ``planes`` and ``masks`` broadcast against each other after their first axis. Ones and twos
    are carry-save counters of all lanes at once; a carry out of the twos means four differences,
    which lanes never leave. Blocks whose lanes are all beyond the radius are abandoned.
    """
    shape = np.broadcast_shapes(planes.shape[1:], masks.shape[1:])
    planes, masks = np.broadcast_to(planes, (BITS, *shape)), np.broadcast_to(masks, (BITS, *shape))
    size = int(np.prod(shape))
    over = np.zeros(size, np.uint64)
    live = np.arange(size)
    p, m = planes.reshape(BITS, -1), masks.reshape(BITS, -1)
    ones, twos, fours = (np.zeros(size, np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    for b in range(BITS):
        diff = p[b] ^ m[b] if len(live) == size else p[b][live] ^ m[b][live]
        carry = ones & diff
        ones ^= diff
        fours |= twos & carry
        twos ^= carry
        if b % check_every == check_every - 1:
            on = fours != full
            if not on.all():
                over[live[~on]] = full
                live, ones, twos, fours = live[on], ones[on], twos[on], fours[on]
                if not len(live):
                    break
    over[live] = fours
    return over.reshape(shape)


def _lanes(near: np.ndarray) -> np.ndarray:
    """Words of lanes as rows of booleans."""
    return np.unpackbits(
        np.ascontiguousarray(near).astype("<u8").view(np.uint8).reshape(*near.shape[:-1], -1),
        axis=-1,
        bitorder="little",
    ).astype(bool)


def spanning_links(values: np.ndarray, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what lies within the radius, as pairs of fingerprints.

    With ``first``, a mark for each value, only values of different marks are held against each
    other. At most one link fewer than there are values.
    """
    n = len(values)
    planes = planes_of(values)
    words = planes.shape[1]
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    step = max(1, (1 << 18) // max(1, words))
    for at in range(0, n, step):
        masks = query_masks(values[at : at + step])
        near = ~beyond(planes[:, None, :], masks[:, :, None])
        hits = _lanes(near)[:, :n]
        for q in range(hits.shape[0]):
            i = at + q
            found = np.flatnonzero(hits[q])
            if first is not None:
                found = found[first[found] != first[i]]
            if len(found) == 0:
                continue
            for g in np.unique(group[found]):
                if g != group[i]:
                    j = found[np.flatnonzero(group[found] == g)[0]]
                    links.append((int(values[i]), int(values[j])))
                    group[group == g] = group[i]
    return links


def small_links(values: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Links inside many small buckets at once, a bucket of up to 64 values in one word.

    ``starts`` are the places where buckets begin. In round r every bucket's r-th value is held
    against all lanes of its own word; lanes after it that stay within the radius are links.
    """
    sizes = np.diff(np.append(starts, len(values)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    lanes = np.zeros((len(sizes), 64), np.uint64)
    for r in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -r, side="left"))
        lanes[:k, r] = values[starts[:k] + r]
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(sizes), 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed).view("<u8")[:, :, 0]
    links: list[tuple[int, int]] = []
    for r in range(int(sizes[0]) - 1 if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -(r + 1), side="left"))
        if not k:
            break
        near = ~beyond(planes[:, :k], query_masks(lanes[:k, r]))
        hits = _lanes(near[:, None])
        hits[:, : r + 1] = False
        hits &= np.arange(64)[None, :] < sizes[:k, None]
        g, lane = np.nonzero(hits)
        links += zip(lanes[g, r].tolist(), lanes[g, lane].tolist())
    return links


LINKS = "a long, b long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition whose rows ``key, i, j, mark, fp`` come sorted by bucket."""

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = {(min(a, b), max(a, b)) for a, b in ((_signed(a), _signed(b)) for a, b in links)}
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )

    held: list[np.ndarray] = []

    def run(rows: np.ndarray) -> list[tuple[int, int]]:
        """``rows`` holds whole buckets, in order."""
        new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        sizes = np.diff(np.append(starts, len(rows)))
        values = rows[:, 4].view(np.uint64)
        crossed = rows[starts, 1] != rows[starts, 2]
        small = (sizes <= 64) & ~crossed & (sizes > 1)
        keep = np.repeat(small, sizes)
        links: list[tuple[int, int]] = []
        if small.any():
            links += small_links(
                values[keep], np.concatenate([[0], np.cumsum(sizes[small])[:-1]])
            )
        for s, n, x in zip(starts[~small], sizes[~small], crossed[~small]):
            if n > 1:
                part = slice(s, s + n)
                links += spanning_links(values[part].copy(), rows[part, 3] if x else None)
        return links

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        rows = np.concatenate(held)
        if not len(rows):
            continue
        last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [np.ascontiguousarray(rows[cut:])]
        if cut:
            yield emit(run(np.ascontiguousarray(rows[:cut])))
    if held and len(held[0]):
        yield emit(run(np.ascontiguousarray(np.concatenate(held))))


def near_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b`` links that connect all different fingerprints within the radius.

    ``fps`` has a column ``fp`` of different values. Buckets of one fingerprint drop out before any
    comparison. Larger buckets than ``tile`` are split into tiles, and every pair of tiles is a
    group of its own, so no task holds more than two tiles and no pair is left out.
    """
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("bigint"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    rows = rows.select(
        "key", "fp", own.alias("mark"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    ).select(
        "key",
        F.least("mark", "other").alias("i"),
        F.greatest("mark", "other").alias("j"),
        "mark",
        "fp",
    )
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare, LINKS).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that has a link; the root is the smallest node it reaches.

    Alternating star contractions: the large star links a node's larger neighbours to the smallest
    one, the small star its smaller ones. Every round's links are written to the shared folder.
    It ends when a round changes nothing, a number of rounds that grows with the logarithm
    of the number of links. Nothing but counts and checksums reaches the driver.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        linked = both.join(low, "a")
        if large:
            return linked.filter("b > a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        out = linked.select(F.col("low").alias("a"), "b").unionByName(
            low.select(F.col("low").alias("a"), F.col("a").alias("b"))
        )
        return out.filter("a < b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(
            edges.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
        )

    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = stage(star(star(edges, True), False), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # Every node but the root now has one link, to the root.
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def classes(marked: DataFrame, key: str = "doc_id", links: DataFrame | None = None) -> DataFrame:
    """``fp, root, component_id``: a row for each different fingerprint of ``key, fp`` rows.

    ``links`` connects fingerprints; without it, those within the radius are connected.
    ``component_id`` is the smallest key among all documents it is connected with; null keys are
    left out of that, and a component of null keys only has a null id.
    """
    fps = stage(marked.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    roots = components(near_links(fps.select("fp")) if links is None else links)
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, fingerprint, component_id``: a row for each input row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are
    members of one class. An empty table gives an empty result.
    """
    marked = stage(
        with_fingerprints(docs.select(docs[key].alias(key), docs[text_col].alias("text")), "text").drop("text"),
        "simhash",
    )
    named = marked.join(classes(marked, key), "fp")
    return named.select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their class: the one with the smallest key.

    Repeated rows of that key leave one row; of a class of null keys one row stays. Columns are
    those of ``docs``, whatever their names.
    """
    row = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[key].alias("key"),
        docs[text_col].alias("text"),
    )
    marked = stage(with_fingerprints(row, "text").drop("text"), "simhash-rows")
    return representatives(marked, classes(marked.select("key", "fp"), "key"))


def representatives(marked: DataFrame, known: DataFrame) -> DataFrame:
    """The rows inside ``row, key, fp`` rows that represent their class in ``known``, see ``keep_one``."""
    first = marked.join(known, "fp").filter(F.col("key").eqNullSafe(F.col("component_id")))
    several = (
        first.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    )
    single = first.join(several, "root", "left_anti").select("row")
    repeated = first.join(several, "root", "left_semi").dropDuplicates(["root"]).select("row")
    return single.unionByName(repeated).select("row.*")
