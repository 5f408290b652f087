"""Exact top-k by inner product: ball trees and branch and bound, shard by shard.

Vectors are rounded to whole numbers and dealt into shards by a digest. A task builds the ball tree of
one shard: every node knows a centre and a radius, so no vector below it has a larger inner product with
a query than centre times query plus radius times the query's length. A query opens nodes by that bound,
the highest first, and stops at the first that cannot improve its k best. Shards come in waves, each
about three times all before it; after every wave the k-th best score of each query so far is shared with all
shards of the next one, which then prune with it from their first node on.

No vector leaves its shard, and a query brings back at most k rows from a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

#: Vectors of a shard and queries of a block: what one task holds at a time.
SHARD = 8192
QUERIES = 4096
LEAF = 256
SCALE = 256
#: Below this all sums of products are exact in doubles.
_EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "query_id long, score long, vec_id long"


@dataclass(frozen=True)
class BallTree:
    """Nodes ``centre, radius, least`` (smallest id below) and ``child``: two nodes, or none for a leaf,
    whose vectors are ``start .. end`` of ``x`` and ``ids``."""

    x: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    child: list[tuple[int, int] | None]
    span: list[tuple[int, int]]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, a row for each query and a column for each node.

        Scores are whole numbers, so bounds are rounded down after adding what rounding errors may
        have taken away.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((q * q).sum(axis=1))[:, None]
            reach = np.sqrt((self.centre * self.centre).sum(axis=1))[None] + self.radius[None]
            bound = np.floor(q @ self.centre.T + norm * self.radius[None] + 1e-9 * norm * reach + 1e-6)
        # Beyond the range of doubles there is no bound.
        return np.where(np.isnan(bound), np.inf, bound)

    def search(
        self, q: np.ndarray, own: int, bound: np.ndarray, k: int, start: tuple[float, int] | None
    ) -> list[tuple[float, int]]:
        """The k best ``(score, -id)``, without the query's own id, of those better than ``start``.

        ``start`` is the k-th best of earlier shards as ``(score, -id)``.
        """
        best: list[tuple[float, int]] = []
        least = start
        queue = [(-float(bound[0]), int(self.least[0]), 0)]
        while queue:
            high, smallest, node = heapq.heappop(queue)
            # What is left in the queue is no better than this node.
            if least is not None and (-high, -smallest) <= least:
                break
            pair = self.child[node]
            if pair is not None:
                for c in pair:
                    heapq.heappush(queue, (-float(bound[c]), int(self.least[c]), c))
                continue
            a, b = self.span[node]
            scores = _scores(self.x[a:b], q)
            near = range(b - a) if least is None else np.flatnonzero(scores >= least[0]).tolist()
            for i in near:
                item = (scores[i], -int(self.ids[a + i]))
                if -item[1] == own or (least is not None and item <= least):
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                else:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    least = best[0]
        return best


def build(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
    """A tree over the rows of ``x``: nodes of over ``leaf`` rows are halved across the direction between
    two far points; equal rows are halved by id."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _build(x.astype(np.float64), ids, leaf)


def _build(x: np.ndarray, ids: np.ndarray, leaf: int) -> BallTree:
    order = np.argsort(ids, kind="stable")
    centre: list[np.ndarray] = []
    radius: list[float] = []
    child: list[tuple[int, int] | None] = []
    span: list[tuple[int, int]] = []

    def add(a: int, b: int) -> int:
        rows = x[order[a:b]]
        mid = rows.mean(axis=0)
        centre.append(mid)
        radius.append(float(np.sqrt(((rows - mid) ** 2).sum(axis=1).max())))
        child.append(None)
        span.append((a, b))
        return len(centre) - 1

    todo = [add(0, len(x))]
    while todo:
        node = todo.pop()
        a, b = span[node]
        if b - a <= leaf:
            continue
        part = order[a:b]
        rows = x[part]
        far = rows[((rows - centre[node]) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        # Ties keep the order of ids, so equal rows are parted into smaller and larger ids.
        order[a:b] = part[np.argsort(rows @ (other - far), kind="stable")]
        half = (a + b) // 2
        pair = (add(a, half), add(half, b))
        child[node] = pair
        todo += pair
    sorted_ids = ids[order]
    least = np.array([sorted_ids[a:b].min() for a, b in span])
    return BallTree(x[order], sorted_ids, np.array(centre), np.array(radius), least, child, span)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; whole numbers of any size end at the edge of 64 bits."""
    scores = x @ q
    if scores.dtype == object:
        scores = np.array([min(max(s, _LONG[0]), _LONG[1]) for s in scores], object)
    return scores


def _exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where these hold all sums exactly, else as Python's whole numbers."""
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    if most < _EXACT:
        return x, q
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(q)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, x`` of the rows that take part: an id, and a vector of finite numbers. Repeated rows count once."""
    rows = vectors.select(vectors[key].alias("id"), vectors[vector].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def _numbers(rows: pa.RecordBatch, scale: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rounded vectors of rows of one length."""
    x = _column(rows, "x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim)
    return _column(rows, "id").to_numpy(zero_copy_only=False), np.floor(x * scale)


def _answers(tree: BallTree, rows: pa.RecordBatch, k: int, scale: float, dim: int) -> pa.RecordBatch:
    """The k best of a tree for each query in ``rows``, as far as they beat its ``score, last``."""
    ids, q = _numbers(rows, scale, dim)
    x, asked = _exact(tree.x, q)
    tree = replace(tree, x=x)
    score, last = (_column(rows, n).to_pylist() for n in ("score", "last"))
    found: list[tuple[int, int, int]] = []
    for at in range(0, len(q), 256):
        for i, bound in enumerate(tree.bounds(q[at : at + 256]), at):
            known = None if score[i] is None else (score[i], -last[i])
            best = tree.search(asked[i], int(ids[i]), bound, k, known)
            found += [(int(ids[i]), int(s), -m) for s, m in best]
    columns = list(zip(*found)) if found else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["query_id", "score", "vec_id"]
    )


def _search_groups(k: int, scale: float, leaf: int):
    """For partitions of ``shard, part, dim, kind, id, x, score, last`` sorted by these: the vectors of
    a group (kind 0) come before its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tree: BallTree | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [_column(batch, n).to_numpy(zero_copy_only=False) for n in ("shard", "part", "dim", "kind")]
            place = np.stack(names, axis=1)
            starts = np.flatnonzero(np.r_[True, np.any(place[1:] != place[:-1], axis=1)])
            for s, e in zip(starts, [*starts[1:], len(place)]):
                here, dim, rows = tuple(place[s, :3]), int(place[s, 2]), batch.slice(s, e - s)
                if here != at:
                    at, held, tree = here, [], None
                if place[s, 3] == 0:
                    held.append(_numbers(rows, scale, dim))
                elif held:
                    if tree is None:
                        tree = build(np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held]), leaf)
                    yield _answers(tree, rows, k, scale, dim)

    return search


def waves(shards: int) -> list[tuple[int, int]]:
    """Runs of shards ``first .. end``: one, then three times as many as all before."""
    out, at = [], 0
    while at < shards:
        end = min(shards, max(1, 4 * at))
        out.append((at, end))
        at = end
    return out


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    shard: int = SHARD,
    queries: int = QUERIES,
    leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each row that ``is_query`` picks.

    Components count as ``floor(scale * x)`` and the score is the inner product of these whole numbers; one
    beyond 64 bits counts as their edge. Candidates are all rows of other ids and equal length; ties go to
    the smaller id. A query has k rows, or as many as there are candidates. ``is_query`` is a condition on
    the key column. Rows without id, without vector, or with a component that is null or not finite take no part;
    repeated rows count once; columns beside key and vector are not read. Without usable rows the
    result is empty. An id with several vectors asks with each and keeps the k best of all.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).withColumn("dim", F.size("x"))
    shards = max(1, -(-vectors.count() // shard))
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards))
    indexed = stage(rows.select(place.alias("shard"), "dim", "id", "x"), "topk-vectors")
    own = usable(vectors.filter(is_query), key, vector).withColumn("dim", F.size("x"))
    own = stage(own, "topk-queries")
    blocks = max(1, -(-own.count() // queries))
    part = F.pmod(F.xxhash64("id", "x", F.lit(4)), F.lit(blocks))
    asked = own.select(part.alias("part"), "dim", "id", "x")
    best = spark.createDataFrame([], FOUND)
    search = _search_groups(k, scale, leaf)
    every = lambda a, b: F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(b - 1).cast("bigint")))
    for first, end in waves(shards):
        stored = indexed.filter((F.col("shard") >= first) & (F.col("shard") < end)).select(
            "shard", every(0, blocks).alias("part"), "dim", F.lit(0).alias("kind"), "id", "x",
            F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("last"),
        )
        # The k-th best of a query so far, if it has k.
        worst = F.struct(F.col("score"), (-F.col("vec_id")).alias("id"))
        known = (
            best.groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min(worst).alias("kth"))
            .filter(F.col("n") >= k)
            .select(F.col("query_id").alias("id"), "kth.score", (-F.col("kth.id")).alias("last"))
        )
        sent = asked.join(known, "id", "left").select(
            every(first, end).alias("shard"), "part", "dim", F.lit(1).alias("kind"), "id", "x", "score", "last"
        )
        group = ["shard", "part", "dim"]
        dealt = stored.unionByName(sent).repartition(*group).sortWithinPartitions(*group, "kind")
        found = dealt.mapInArrow(search, FOUND)
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = best.unionByName(found).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
        best = stage(top.drop("rank"), "topk-best")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(by_query).alias("rank"), "vec_id", "score")
