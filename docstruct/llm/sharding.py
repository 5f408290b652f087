"""Sharding by a lookup table that the shards fill in turns.

Every shard has a preference order over the slots of a table of prime size: an offset and a
step, both from a digest of its name. The shards take turns, each claiming the first slot of its
order that is still free, until the table is full. The table has a fixed number of slots, so
it is broadcast; placing a row is one digest, one remainder and one lookup. Adding or removing a
shard moves little more than that shard's own slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import without

#: Primes to choose a table size from; at least a hundred slots a shard keep shards within 1 %.
SLOTS = 4099
_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot.

    ``slots`` has to be prime, so that every step walks through all slots, and no smaller than the
    number of shards. Shards take turns in code point order of their names; names must differ.
    """
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must differ, and there must be one")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime, and at least the number of shards")
    at = [_number(f"offset/{n}") % slots for n in names]
    step = [_number(f"step/{n}") % (slots - 1) + 1 for n in names]
    table, free = [-1] * slots, slots
    while free:
        for i in range(min(len(names), free)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key, by a digest of its text; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint"), F.lit(slots))


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS
) -> DataFrame:
    """Add ``slot`` and ``shard`` (a name) to every row.

    Rows of one key share a shard, repeated rows too; a null key is placed like the empty
    text; an empty table stays empty. Input columns called ``slot`` or ``shard`` are replaced. No
    shuffle: the table has ``slots`` rows, whatever the data.
    """
    names = sorted(shards)
    table = df.sparkSession.createDataFrame(
        [(s, names[i]) for s, i in enumerate(fill_table(names, slots))], "slot bigint, shard string"
    )
    placed = without(df.withColumn("_slot_key", df[key]), "slot", "shard")
    placed = placed.withColumn("slot", slot_of(F.col("_slot_key"), slots)).drop("_slot_key")
    return placed.join(F.broadcast(table), "slot")


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1, mode: str = "error") -> None:
    """One folder a shard. Rows of a shard spread over ``files_per_shard`` tasks, in any order."""
    salt = F.pmod(F.xxhash64(*[c for c in sharded.columns if c != "shard"]), F.lit(files_per_shard))
    spread = sharded.repartition("shard", salt) if files_per_shard > 1 else sharded.repartition("shard")
    spread.write.mode(mode).partitionBy("shard").parquet(path)
