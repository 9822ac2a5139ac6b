"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size.  Shards take turns, each claiming the first slot of its order that is
still free, until the table is full.  A key's slot is its hash modulo the
table's size, so placement is one array read.  When a shard leaves, the slots
of the others mostly keep their owner.

The table has a fixed number of slots, whatever the data, so it is broadcast
and each row finds its slot in constant time.  A null key hashes as Spark hashes null and so has one
fixed shard.  Rows with equal keys go to the same shard; an empty table gives
no rows; other columns are kept or ignored as the caller selects.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import table

SLOTS = 65_537
SHARDS = 64


def _order(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "little") % slots, int.from_bytes(digest[8:16], "little") % (slots - 1) + 1


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Owner of each slot, as an index into names; slots must be prime, so that every step size visits all slots."""
    if not names or len(names) > min(slots, 65_536):
        raise ValueError("between 1 shard and as many as there are slots (65,536 at most)")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    orders = [_order(n, slots) for n in names]
    owner, place, left = [-1] * slots, [start for start, _ in orders], slots
    while left:
        for i, (_, step) in enumerate(orders):
            at = place[i]
            while owner[at] >= 0:
                at = (at + step) % slots
            owner[at], place[i] = i, (at + step) % slots
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def lookup(spark, owners: list[int]) -> DataFrame:
    """The table as rows (slot, shard); its size is the number of slots, whatever the data."""
    return spark.createDataFrame(list(enumerate(owners)), "slot int, shard long")


def assign_shards(docs: DataFrame, key_col: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`docs` with the columns slot and shard (in place of any it had), by a broadcast of the fixed-size table."""
    owners = fill_table(names or [f"shard-{i:05d}" for i in range(SHARDS)], slots)
    return docs.withColumn("slot", slot_of(F.col(key_col), slots)).drop("shard").join(F.broadcast(lookup(docs.sparkSession, owners)), "slot")


def op4_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")
