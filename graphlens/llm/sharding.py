"""Shard placement through a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: a
start and a step from two hashes of its name. The shards take turns, and each
claims the first slot of its order that is still free, until none is. Shares
differ by one slot at most, and taking a shard away moves little but its own
slots. The table depends on the shard names and its size alone; a key is placed
by its hash's slot, a join with a broadcast table of ``slots`` rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, over a hundred times the number of shards.
SLOTS = 65_537
#: The largest table: its rows are broadcast.
MOST_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The position in ``shards`` of each slot's owner."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards, and within the bound of the broadcast")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]] = k
            free -= 1
            if not free:
                break
    return tuple(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table size; a missing key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` as a relation of ``slots`` rows."""
    owners = ",".join(map(str, lookup_table(tuple(shards), slots)))
    names = F.split(F.lit(",".join(shards)), ",")
    filled = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return filled.select("slot", names[F.col("owner").cast("int")].alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, without a shuffle.

    A missing key has the slot of the empty text; equal keys share a shard;
    existing columns of these two names are replaced; an empty table stays
    empty. Shard names must be distinct and free of commas.
    """
    if any("," in name for name in shards):
        raise ValueError("shard names must not hold commas")
    kept = [F.col(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return rows.join(F.broadcast(table(df.sparkSession, shards, slots)), "slot").select(*rows.columns, "shard")
