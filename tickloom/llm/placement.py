"""Sharding by a lookup table that shards fill in turns, each by a permutation of its own."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime well above a hundred times the number of shards.
SLOTS = 65_537


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard of each slot. Shards take turns; each claims the first free slot of its own order of preference.

    The order is ``(offset + j * skip) mod slots`` with both numbers from a digest of the shard's name; as ``slots`` is prime it
    visits every slot. Shares differ by one slot at most, and when a shard leaves, few slots of the others change.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be one or more distinct names, no more than there are slots")
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    digests = [hashlib.sha256(x.encode()).digest() for x in shards]
    at = [int.from_bytes(x[:8], "big") % slots for x in digests]
    skip = [int.from_bytes(x[8:16], "big") % (slots - 1) + 1 for x in digests]
    table = np.full(slots, -1, np.int32)
    taken = 0
    while taken < slots:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            table[at[shard]] = shard
            taken += 1
            if taken == slots:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``, one row a slot; its size is the parameter, not the data's."""
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill(shards, slots).tolist())], "slot long, shard string")


def placed(docs: DataFrame, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as ``(id_col, slot, shard)``.

    The slot is 60 bits of the id's MD5 modulo the number of slots, so placement needs no shuffle: the table is broadcast.
    A null id is placed by its text, so that many of them spread; if the text is null too, by the empty text. Rows that
    repeat have one place; an empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    table = lookup_table(docs.sparkSession, shards, slots)
    return docs.select(F.col(id_col), slot.alias("slot")).join(F.broadcast(table), "slot").select(id_col, "slot", "shard")
