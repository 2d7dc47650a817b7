"""Operator 9, sharding by a permutation-filled lookup table, with DataFrame functions alone.

Each shard has an order of preference over the slots of a table of prime size (an offset and a skip, both from its name).
Shards take turns; at its turn a shard claims the first slot in its order that is free. A row's slot is a hash of its key
modulo the table size. Dropping a shard moves few rows between the others.

Edge cases: a null key is hashed as the text `null`'s own marker and goes to one slot; equal keys go to one shard, so a
hot key makes a hot shard by definition, but placing it needs no shuffle; an empty table gives no rows; extra columns stay,
and a column that is already called `slot` or `shard` is replaced, also if it is the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import table

#: A prime; at least a hundred slots for each shard keep the shares within about one per cent.
SLOTS = 65537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the index of its shard. slots must be prime and not below the number of shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards, of which there must be one")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, turn = [-1] * slots, 0
    for _ in range(slots):
        while owner[at[turn]] >= 0:
            at[turn] = (at[turn] + skip[turn]) % slots
        owner[at[turn]] = turn
        turn = (turn + 1) % len(shards)
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def shard(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with columns slot (long) and shard (int). The table has `slots` rows, whatever the data's size, and is broadcast; df is not shuffled."""
    owner = fill(shards if shards is not None else [f"shard-{i}" for i in range(SHARDS)], slots)
    spark = df.sparkSession
    listed = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "shard"))
    lookup = listed.select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*rest, slot(F.col(f"`{key}`"), slots).alias("slot")).join(F.broadcast(lookup), "slot")


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes: doc_id, slot, shard."""
    return shard(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op9_sql() -> str:
    """The same with the filled table written out: SQL tells the hash, the slot and the join, not the filling."""
    return f"""WITH t AS (SELECT unnest(range({SLOTS})) AS slot, unnest({fill([f"shard-{i}" for i in range(SHARDS)])}) AS shard),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, CAST(shard AS INTEGER) AS shard FROM d JOIN t USING (slot)"""
