"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Sources get target sizes by weight, bounded by a number of passes over what they have. Each source
is dealt into blocks by a digest of its documents' keys; its quota is the number of blocks it
sends into the mix, the last one cut inside so that the words come near the target. The quotas of
all sources are then split over the output shards: at every node of a binary tree half of
the node's blocks go left, drawn without replacement, which is a multivariate hypergeometric draw
of counts by source. A leaf is a shard with an exact count for each source; sources deal their
blocks, permuted, to the shards by these counts, so shards are disjoint. Rows are
shuffled inside their shard.

The tables over blocks have about ``blocks`` rows plus one for each source, whatever the
size of the documents; documents only ever meet them by source and block. Blocks of a source
with a third of all rows are a third of all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .common import without, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
BLOCKS = 1024
SHARDS = 16
#: Keys of 60 bits fall into 4,096 cells; only one cell of a block is ever sorted by key.
CELL_BITS = 48
#: Plans up to this many rows (under 100 bytes each) are sent to all tasks; larger ones are joined.
BROADCAST_ROWS = 50_000

#: The columns that ``place`` adds.
PLACED = ("size", "block_key", "placements")


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def block_key(key: Column) -> Column:
    """The document's place in a pseudorandom permutation: 60 bits of a digest of its key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_passes: int = MAX_PASSES,
) -> DataFrame:
    """``source, source_size, n_blocks_of, total, target`` from ``source, size`` rows.

    Sources in code point order, null last, have the weights in turn. They share ``share`` times
    all sizes; a target stops at ``max_passes`` times its source's size and the excess is shared
    again. That ends where every source has the smaller of its cap and one common level times its
    weight, so the level is found directly: sources by cap over weight, the first one
    whose share of what is left fits under its cap sets the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.get(
        F.array(*[F.lit(w) for w in weights]),
        (F.row_number().over(by_name) - 1) % len(weights),
    )
    rows = totals.withColumn("weight", weight).withColumn("cap", max_passes * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rank", F.row_number().over(by_cap))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(onward))
        .withColumn("level", (share * F.col("total") - F.col("capped")) / F.col("weight_left"))
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(
        F.when(fits, F.col("level")), F.when(fits, F.col("rank"))
    ).over(everything)
    return rows.withColumn("level", level).select(
        "source",
        "source_size",
        "total",
        F.least(
            F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
        ).alias("target"),
    )


def _blocks_of(blocks: int) -> Column:
    """How many blocks a source has: its share of ``blocks``, rounded up, at least one."""
    share = F.ceil(blocks * F.col("source_size") / F.greatest(F.col("total"), F.lit(1)))
    return F.greatest(F.lit(1), share).cast("bigint")


def draw_blocks(sizes: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``source, block, pass, cut``: the blocks that the mix takes.

    A source gives all its blocks once for every whole time its size goes into the target. In the
    last pass it gives blocks in the order of a digest until the rest is reached; the block
    in which that happens is cut at the document whose middle lies nearest: ``cut`` is the
    largest key it still gives, null for a whole block. Documents of one key stay together.
    """
    sized = sizes.join(
        targets.select(
            F.col("source").alias("_source"), "source_size", "target", _blocks_of(blocks).alias("n_blocks")
        ),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    keyed = sized.withColumn("block", F.pmod(F.col("block_key"), F.col("n_blocks")))
    whole = keyed.groupBy("source", "block").agg(
        F.sum("size").alias("block_size"),
        F.max("source_size").alias("source_size"),
        F.max("target").alias("target"),
    )
    order = Window.partitionBy("source").orderBy(
        F.md5(F.concat_ws("/", F.col("source"), F.col("block").cast("string")).cast("binary")), "block"
    )
    whole = (
        whole.withColumn(
            "full",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        )
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("end", F.sum("block_size").over(order))
        .withColumn("from", F.col("end") - F.col("block_size"))
    )
    cut_here = (F.col("from") < F.col("rest")) & (F.col("rest") < F.col("end"))
    # The cut block of each source, narrowed down to the cell of keys in which the rest is reached.
    celled = keyed.select(
        "source", "block", "block_key", "size", F.shiftright("block_key", CELL_BITS).alias("cell")
    )
    cells = (
        celled.join(
            whole.filter(cut_here).select(
                F.col("source").alias("_source"), F.col("block").alias("_block"), "from", "rest"
            ),
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")),
        )
        .groupBy("source", "block", "cell")
        .agg(
            F.sum("size").alias("cell_size"), F.max("block_key").alias("highest"),
            F.max("from").alias("from"), F.max("rest").alias("rest"),
        )
    )
    by_cell = Window.partitionBy("source", "block").orderBy("cell")
    crossed = (
        cells.withColumn("cell_end", F.col("from") + F.sum("cell_size").over(by_cell))
        .withColumn("cell_from", F.col("cell_end") - F.col("cell_size"))
        .withColumn("below", F.max("highest").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("cell_from <= rest and rest < cell_end")
        .select(
            F.col("source").alias("_source"), F.col("block").alias("_block"),
            F.col("cell").alias("_cell"), "cell_from", "rest", "below",
        )
    )
    inside = (
        celled.join(
            crossed,
            F.col("source").eqNullSafe(F.col("_source"))
            & (F.col("block") == F.col("_block"))
            & (F.col("cell") == F.col("_cell")),
        )
        .groupBy("source", "block", "block_key")
        .agg(
            F.sum("size").alias("size"), F.max("cell_from").alias("cell_from"),
            F.max("rest").alias("rest"), F.max("below").alias("below"),
        )
    )
    in_cell = Window.partitionBy("source", "block").orderBy("block_key")
    middle = F.col("cell_from") + F.sum("size").over(in_cell) - F.col("size") / 2
    cuts = (
        inside.withColumn("taken", middle <= F.col("rest"))
        .groupBy("source", "block")
        .agg(
            F.max(F.when(F.col("taken"), F.col("block_key"))).alias("cut"),
            F.max("below").alias("below"),
        )
        .select(
            F.col("source").alias("_source"), F.col("block").alias("_block"),
            F.coalesce("cut", "below", F.lit(-1).cast("bigint")).alias("cut"),
        )
    )
    with_cuts = whole.join(
        cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left"
    )
    again = (F.col("rest") > 0) & ((F.col("end") <= F.col("rest")) | (F.col("cut") >= 0))
    last = F.when(again, F.col("full") + 1).otherwise(F.col("full"))
    passes = F.when(last > 0, F.sequence(F.lit(1).cast("bigint"), last))
    return with_cuts.select(
        "source", "block", F.explode(passes).alias("pass"), "full", "cut"
    ).select(
        "source",
        "block",
        "pass",
        F.when(F.col("pass") > F.col("full"), F.col("cut")).alias("cut"),
    )


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``source, shard, quota`` from ``source, quota``: the leaves of the splitting tree.

    ``shards`` is a power of two. Each level gives half of every node's blocks, drawn without
    replacement, to the left child; only counts by source are kept. Quotas add up exactly.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    node = quotas.select("source", F.lit(0).cast("bigint").alias("node"), "quota")
    for _ in range(shards.bit_length() - 1):
        balls = node.select("node", "source", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("ball"))
        urn = Window.partitionBy("node")
        drawn = urn.orderBy(F.xxhash64(F.lit(seed), "node", "source", "ball"), "source", "ball")
        right = (2 * F.row_number().over(drawn) > F.count(F.lit(1)).over(urn)).cast("bigint")
        node = (
            balls.withColumn("node", 2 * F.col("node") + right)
            .groupBy("source", "node")
            .agg(F.count(F.lit(1)).alias("quota"))
        )
    return node.select("source", F.col("node").alias("shard"), "quota")


def deal_blocks(units: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Add ``shard`` to the drawn blocks: each source's blocks, permuted, by its shards' quotas."""
    quotas = units.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    leaves = split_quotas(quotas, shards, seed)
    places = leaves.select(
        F.col("source").alias("_source"), "shard", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("i")
    )
    places = places.select(
        "_source", "shard",
        F.row_number().over(Window.partitionBy("_source").orderBy("shard", "i")).alias("_slot"),
    )
    permuted = Window.partitionBy("source").orderBy(
        F.xxhash64(F.lit(seed + 1), "source", "block", "pass"), "block", "pass"
    )
    ranked = units.withColumn("slot", F.row_number().over(permuted))
    return ranked.join(
        places, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slot") == F.col("_slot"))
    ).drop("_source", "_slot", "slot")


def plan_mix(
    sizes: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of ``source, size, block_key`` rows.

    Gives ``source, source_size, target`` and ``source, n_blocks, block, draws``, where
    ``draws`` has a ``pass, cut, shard`` for every time the block is drawn. Both are stored in
    the shared folder: they are small and used by every task.
    """
    targets = stage(source_targets(sizes), "mix-targets")
    units = deal_blocks(draw_blocks(sizes, targets, blocks), shards, seed)
    draws = units.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "cut", "shard"))).alias("draws")
    )
    return targets, stage(draws, "mix-draws")


def place(
    docs: DataFrame,
    targets: DataFrame,
    draws: DataFrame,
    source_col: str = "source",
    blocks: int = BLOCKS,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``placements`` to rows that have ``block_key``.

    ``placements`` has a ``pass, shard`` for each time the row is in the mix; none is an empty array.
    """

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    by_source = small(
        targets.select(
            F.col("source").alias("_source"), "source_size", "target", _blocks_of(blocks).alias("_n_blocks")
        )
    )
    by_block = small(
        draws.select(F.col("source").alias("_of"), F.col("block").alias("_drawn"), F.col("draws").alias("_draws"))
    )
    rows = docs.join(by_source, F.col(source_col).eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_block", F.pmod(F.col("block_key"), F.col("_n_blocks")))
    rows = rows.join(
        by_block,
        F.col(source_col).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_drawn")),
        "left",
    )
    taken = F.filter(
        "_draws", lambda d: d["cut"].isNull() | (F.col("block_key") <= d["cut"])
    )
    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    return rows.withColumn(
        "placements",
        F.coalesce(
            F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))), none
        ),
    ).drop("_source", "_n_blocks", "_block", "_of", "_drawn", "_draws")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    blocks: int = BLOCKS,
    shards: int = SHARDS,
    seed: int = 0,
) -> DataFrame:
    """The mix: columns of ``docs`` (a row for each time it is drawn) and ``shard``.

    Rows with one key, repeated rows too, share a place in the permutation and are drawn together.
    A null text has size zero, a null source is a source, a null key counts as the empty text. An
    empty table gives an empty mix. An input column ``shard`` is replaced. Rows of a shard
    are sorted by a digest inside each of its tasks. The same input gives the same mix.
    """
    base = without(docs, "shard")
    held = base.select(
        base[source_col].alias("source"),
        text_size(base[text_col]).alias("size"),
        block_key(base[key]).alias("block_key"),
    )
    targets, draws = plan_mix(stage(held, "mix-sizes"), blocks, shards, seed)
    packed = base.select(
        F.struct(*[base[c] for c in base.columns]).alias("row"),
        base[source_col].alias("source"),
        block_key(base[key]).alias("block_key"),
    )
    drawn = place(packed, targets, draws, blocks=blocks).select(
        "row", "block_key", F.explode("placements").alias("at")
    )
    order = F.xxhash64(F.lit(seed + 2), "block_key", "at.pass")
    # Each shard is spread over several times its share of the shuffle partitions.
    spread = -(-4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    shuffled = (
        drawn.select("row", F.col("at.shard").alias("shard"), order.alias("order"))
        .repartition("shard", F.pmod("order", F.lit(spread)))
        .sortWithinPartitions("shard", "order")
    )
    return shuffled.select("row.*", "shard")
