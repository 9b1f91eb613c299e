"""Placement of documents on shards by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has its own order of preference over all slots,
a start and a step drawn from its name; the shards take turns and each claims its next free slot.
So shards own equal numbers of slots, give or take one, and when a shard leaves or joins, few slots
of the others change hands. A key's 64-bit hash, modulo the table's size, is its slot.

The table is a few hundred kilobytes whatever the data's size, so it is broadcast: placing a row is
one look-up, without any shuffle. Keys are hashed as text with XXH64 (seed 42), which readers
outside Spark can repeat. A null key counts as the empty text's hash beside the text's own, so rows
without a key spread out. Repeated keys share a shard unless `spread_by` names columns that split
hot keys. Empty tables give no rows; `place` keeps further columns, also of clashing names, in `row`. Shards
tie for no slot: they take turns in the order in which they are given.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
#: Slots that a broadcast table may have.
MOST_SLOTS = 1 << 21


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that owns each slot."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named, distinct and no more than the slots")
    place = [xxhash.xxh64(name, seed=1).intdigest() % slots for name in shards]
    step = [xxhash.xxh64(name, seed=2).intdigest() % (slots - 1) + 1 for name in shards]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % slots
            owner[at], place[shard] = shard, (at + step[shard]) % slots
            free -= 1
            if not free:
                break
    return np.array(owner)


def slot_of(key: Column, slots: int, spread_by: Sequence[Column] = ()) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(text, *spread_by), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, spread_by: Sequence[str] = ()) -> DataFrame:
    """Rows (row, slot, shard): every row whole, with its slot and the name of its shard."""
    owner = lookup_table(shards, slots)
    table = docs.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(owner.tolist())], "slot int, shard string")
    lost = F.when(F.col(key).isNull(), F.xxhash64("text")) if "text" in docs.columns else F.lit(None).cast("long")
    slot = slot_of(F.col(key), slots, [lost, *(F.col(c) for c in spread_by)])
    rows = docs.select(F.struct(*docs.columns).alias("row"), slot.alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("row", "slot", "shard")


def write_shards(placed: DataFrame, folder: str, column: str = "shard_name") -> None:
    """A folder of Parquet files for each shard, named by `column`; one of that name in the rows makes it longer.

    Rows are dealt by shard first, in parts of the size that Spark advises, so a shard has few files.
    """
    taken = placed.select("row.*").columns
    while column in taken:
        column += "_"
    named = placed.select("row.*", F.col("shard").alias(column))
    named.hint("rebalance", column).write.partitionBy(column).parquet(folder)
