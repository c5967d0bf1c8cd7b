"""Placement of documents on shards through a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, ``offset + j * skip``.
Shards take turns, each claiming its next free slot, until the table is full.  A document's slot
is a hash of its id modulo the table size, so placing it is one look-up in a broadcast table of fixed
size.  A shard added or removed moves few documents between the others, and shares stay even.

Defined results: a null id is placed as the empty text; repeated rows share a shard; any column
called like an output is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards of the production query, and slots: a prime, many times the shards.
SHARDS, SLOTS = 64, 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot.  The bound on the table is ``slots``, whatever the data."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shards need different names, at least one and no more than slots")
    at = [_number(n, "offset") % slots for n in names]
    skip = [_number(n, "skip") % (slots - 1) + 1 for n in names]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(id_col: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def placed(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``docs`` with slot and shard number."""
    table = ",".join(map(str, lookup_table([f"shard-{k}" for k in range(shards)], slots)))
    side = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("__slot", "__shard"))
    side = side.select(F.col("__slot").cast("long"), F.col("__shard").cast("long"))
    found = docs.drop(slot, shard) if id_col not in (slot, shard) else docs
    found = found.withColumn("__own", slot_of(F.col(id_col), slots)).join(F.broadcast(side), F.col("__own") == F.col("__slot"), "left")
    return found.withColumn(slot, F.col("__own")).withColumn(shard, F.col("__shard")).drop("__own", "__slot", "__shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, lookup_table([f"shard-{k}" for k in range(shards)], slots)))
    return f"""
WITH own AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents),
tab AS (SELECT string_split('{table}', ',') AS t)
SELECT doc_id, slot, t[slot + 1]::BIGINT AS shard FROM own, tab"""


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return placed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id"))
