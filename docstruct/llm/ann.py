"""Approximate nearest neighbours with a hierarchical k-means tree.

A tree of k-means splits is grown on a bounded sample; its leaves divide the space, and every
vector goes to the leaf that a greedy descent reaches. A query walks the tree best bin first: a
priority queue holds the branches not taken by the distance of their centres, and leaves are
visited in that order. How many leaves are visited is calibrated on the sample: it widens until
the wanted recall is reached there. A query goes on until its leaves hold enough ids for a whole
result. Queries then meet the vectors of their leaves, leaf by leaf and in
blocks, with exact distances in double precision.

Equal vectors are one point with the smallest of their ids, which is all a result can use.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

#: Bound of the sample the tree is grown and calibrated on, in vectors.
SAMPLE = 20_000
BRANCHES = 8
LEAF = 512
RECALL = 0.96
#: Points of a leaf that one task holds at a time; a fuller leaf is split into blocks.
BLOCK = 4096


@dataclass(frozen=True)
class Tree:
    """``centres[n]`` and ``children[n]`` of inner nodes; ``leaf[n]`` numbers the leaves."""

    centres: list[np.ndarray | None]
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row by greedy descent."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = _distances(x[rows], self.centres[node]).argmin(axis=1)
            for i, child in enumerate(self.children[node]):
                own = rows[nearest == i]
                if len(own):
                    todo.append((child, own))
        return out

    def visit(self, q: np.ndarray, leaves: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves in best-bin-first order, and more until they hold ``least`` ids.

        ``held`` is the number of ids of each leaf.
        """
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        ids = 0
        while queue and (len(found) < leaves or ids < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                d = _distances(q[None], self.centres[node])[0]
                best = int(d.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), child))
                node = self.children[node][best]
            found.append(self.leaf[node])
            if held is not None:
                ids += int(held[self.leaf[node]])
        return found


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of x to all rows of y."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centres: seeds far from one another, then a few rounds of Lloyd's steps."""
    seeds = [int(rng.integers(len(x)))]
    d = _distances(x, x[seeds]).min(axis=1).clip(0)
    for _ in range(k - 1):
        if d.sum() <= 0:
            break
        seeds.append(int(rng.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, _distances(x, x[seeds[-1:]])[:, 0]).clip(0)
    centres = x[seeds].copy()
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = x[own == i].mean(axis=0)
    return centres


def grow(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7) -> Tree:
    """Tree over sample rows: nodes of over ``leaf`` rows are split again, unless all are equal."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray | None] = [None]
    children: list[list[int]] = [[]]
    number = [-1]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf:
            c = _split(x[rows], branches, rng)
            own = _distances(x[rows], c).argmin(axis=1)
            used = [i for i in range(len(c)) if (own == i).any()]
            parts = [rows[own == i] for i in used]
        if len(parts) < 2:
            number[node] = sum(n >= 0 for n in number)
            continue
        centres[node] = c[used]
        for part in parts:
            children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(None)
            children.append([])
            number.append(-1)
    return Tree(centres, children, number)


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL, queries: int = 300) -> int:
    """Leaves to visit: doubled until the sample's own queries find ``recall`` of their true
    nearest, then lowered while they still do."""
    if len(x) < 2:
        return 1
    rng = np.random.default_rng(11)
    rows = rng.permutation(len(x))[:queries]
    k = min(k, len(x) - 1)
    leaf = tree.assign(x)
    d = _distances(x[rows], x)
    d[np.arange(len(rows)), rows] = np.inf
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = [tree.visit(x[r], tree.leaves) for r in rows]
    #: Place at which each query reaches the leaf of each of its true neighbours.
    places = []
    for i, o in enumerate(order):
        at = {leaf_: p for p, leaf_ in enumerate(o)}
        places += [at[int(leaf[j])] for j in true[i]]
    reached = np.sort(np.array(places))
    return int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, x`` of the rows that take part: an id, and a vector of finite numbers, not all zero.

    Vectors are arrays of float or double; repeated rows count once.
    """
    x = vectors[vector].cast("array<double>")
    rows = vectors.select(vectors[key].alias("id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))
        & F.exists("x", lambda v: v != 0)
    )


def points(rows: DataFrame, keep: int) -> DataFrame:
    """``point, x, ids``: different vectors with their ``keep`` smallest ids, a digest as name.

    Spark applies the limit of the ranks before the shuffle as well, so a vector that a third of
    all rows share costs each task ``keep`` rows.
    """
    name = F.xxhash64("x", F.lit(1)).alias("point")
    by_vector = Window.partitionBy("point", "x").orderBy("id")
    ranked = (
        rows.distinct()
        .select("id", "x", name)
        .withColumn("r", F.row_number().over(by_vector))
        .filter(F.col("r") <= keep)
    )
    return ranked.groupBy("point", "x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of ``point, x, ids`` with the smallest digests, or all if there are fewer.

    Every task of a sorted limit would send its own ``size`` rows. So digests above a limit that holds back about
    ``size`` rows and four standard deviations more go first, and all tasks together send that many.
    """
    n = rows.count()
    digest = F.xxhash64("point", F.lit(5))
    want = size + 4 * size**0.5 + 16
    near = rows.filter(digest < int(want / n * 2**64) - 2**63) if n > want else rows
    return near.orderBy(digest, "point").limit(size)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``is_query`` picks.

    ``is_query`` is a condition on the key column. Candidates are all other usable rows; a query has
    ``k`` rows, or as many as there are candidates: it visits leaves until they hold ``k + 1`` ids.
    Ties go to the smaller id. Unusable rows (see ``usable``) are neither queries nor candidates; without
    usable rows the result is empty. Vectors have one length, the most frequent one (the
    shortest of several); others are left out. The sample is the ``sample`` points of smallest digest.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dim = (lengths.orderBy(F.desc("n"), "dim").first() or {"dim": 0})["dim"]
    all_points = stage(points(rows.filter(F.size("x") == dim), k + 1), "points")
    data = [r["x"] for r in sampled(all_points, sample).select("x").collect()]
    if not data:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array(data)
    tree = grow(x)
    visits = calibrate(tree, x, k, recall)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("x"))
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield batch.append_column("leaf", pa.array(tree.assign(values), pa.int64()))

    def visits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("x"))
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            found = [tree.visit(q, visits, held, k + 1) for q in values]
            yield batch.append_column("leaves", pa.array(found, pa.list_(pa.int64())))

    indexed = stage(
        all_points.mapInArrow(leaves_of, "point long, x array<double>, ids array<bigint>, leaf long"),
        "leaves",
    )
    fill = indexed.groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"), F.sum(F.size("ids")).alias("ids")
    )
    # A row for each leaf of the tree, which the sample bounds.
    full = fill.collect()
    held = np.zeros(tree.leaves, np.int64)
    for r in full:
        held[r["leaf"]] = r["ids"]
    fill = F.broadcast(
        spark.createDataFrame([(r["leaf"], r["blocks"]) for r in full], "leaf long, blocks long")
    )
    # Queries by point: equal queries search once.
    own = vectors.filter(is_query)
    query_rows = usable(own, key, vector).filter(F.size("x") == dim).distinct()
    query_rows = stage(query_rows.select("id", F.xxhash64("x", F.lit(1)).alias("point"), "x"), "queries")
    query_points = query_rows.groupBy("point", "x").agg(F.count(F.lit(1)).alias("n")).select("point", "x")
    walked = query_points.mapInArrow(visits_of, "point long, x array<double>, leaves array<bigint>")
    walked = walked.select("point", "x", F.explode("leaves").alias("leaf")).join(fill, "leaf")
    asked = walked.select(
        "leaf",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("kind"), "point", "x", F.lit(None).cast("array<bigint>").alias("ids"),
    )
    stored = indexed.join(fill, "leaf").select(
        "leaf", F.pmod(F.xxhash64("point", F.lit(9)), F.col("blocks")).alias("block"),
        F.lit(0).alias("kind"), "point", "x", "ids",
    )
    dealt = stored.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, pa.Array]] = []
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            leaf, blk, kind = (col[n].to_numpy(zero_copy_only=False) for n in ("leaf", "block", "kind"))
            values = col["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            change = np.flatnonzero(
                np.r_[True, (leaf[1:] != leaf[:-1]) | (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1])]
            ) if len(leaf) else []
            for s, e in zip(change, [*change[1:], len(leaf)]):
                here = (int(leaf[s]), int(blk[s]))
                if here != at:
                    at, held = here, []
                if kind[s] == 0:
                    held.append((values[s:e], col["ids"].slice(s, e - s)))
                elif held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]))]
                    yield _best(col["point"].slice(s, e - s), values[s:e], *held[0], k + 1)

    found = dealt.mapInArrow(compare, "point long, score double, vec_id long")
    by_query = Window.partitionBy("point").orderBy("score", "vec_id")
    best = (
        found.withColumn("r", F.row_number().over(by_query))
        .filter(F.col("r") <= k + 1)
        .groupBy("point")
        .agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    )
    # A query drops itself and keeps the first k of the k + 1 best.
    named = query_rows.select("id", "point").join(best, "point")
    others = F.slice(
        F.filter("near", lambda n: n["vec_id"] != F.col("id")), 1, k
    )
    return named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("i", "n")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "n.vec_id", "n.score"
    )


def _best(names: pa.Array, q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int) -> pa.RecordBatch:
    """The k best (distance, id) pairs of a block for each query; distances exact."""
    out_name: list[np.ndarray] = []
    out_score: list[np.ndarray] = []
    out_id: list[np.ndarray] = []
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)
    names_np = names.to_numpy(zero_copy_only=False)
    step = max(1, (1 << 22) // max(1, len(x)))
    for a in range(0, len(q), step):
        rough = _distances(q[a : a + step], x)
        m = min(len(x), k)
        # Points at equal distance may be cut here in any order, so the cut keeps all near its edge.
        edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= edge[i] + 1e-9 * (1 + abs(edge[i])))
            diff = x[near] - q[a + i]
            score = np.sqrt((diff * diff).sum(axis=1))
            counts = offsets[near + 1] - offsets[near]
            each = np.repeat(score, counts)
            own = np.concatenate([flat[offsets[n] : offsets[n + 1]] for n in near])
            first = np.lexsort((own, each))[:k]
            out_name.append(np.full(len(first), names_np[a + i]))
            out_score.append(each[first])
            out_id.append(own[first])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(out_name), pa.int64()),
            pa.array(np.concatenate(out_score), pa.float64()),
            pa.array(np.concatenate(out_id), pa.int64()),
        ],
        names=["point", "score", "vec_id"],
    )
