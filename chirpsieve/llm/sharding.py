"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots (offset and skip from a hash of its
name); shards take turns claiming the next free slot of their own order, until
the prime-sized table is full. Placement is one array lookup, and a lost or
added shard moves few keys beyond its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2039  # prime; over 100 slots a shard
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def lookup_table(shards: list[str], slots: int = SLOTS, turns: dict[str, int] | None = None) -> list[int]:
    """slot -> position in shards. turns: how many slots a shard claims in each round (1 if not named)."""
    if not shards or slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")

    def draw(name: str, salt: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")

    offset = [draw(s, "offset") % slots for s in shards]
    skip = [draw(s, "skip") % (slots - 1) + 1 for s in shards]
    at, table, filled = [0] * len(shards), np.full(slots, -1), 0
    while filled < slots:
        for i, s in enumerate(shards):
            for _ in range((turns or {}).get(s, 1)):
                if filled == slots:
                    break
                while table[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
                    at[i] += 1
                table[slot] = i
                filled += 1
    return table.tolist()


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of MD5 of the key as text (null: empty), so any engine can place a row."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS, name: str = "shard", turns: dict[str, int] | None = None) -> DataFrame:
    """Adds `name` to df; the table is a literal of `slots` entries and travels with the plan.

    No shuffle. Null keys go to the slot of the empty text, equal keys to one
    shard (as placement by key must); no column is overwritten: a df that has
    `name` already raises, whatever the case of its letters. An empty df stays
    empty.
    """
    if name.lower() in map(str.lower, df.columns):
        raise ValueError(f"df has a column {name}: choose another name for the shard")
    table = lookup_table(shards, slots, turns)
    names = F.array(*[F.lit(s) for s in shards])
    row = F.split(F.lit(",".join(map(str, table))), ",")
    return df.withColumn(name, F.element_at(names, F.element_at(row, slot_of(df[key], slots) + 1).cast("int") + 1))


def write(df: DataFrame, key: str, path: str, files: int = 1, **how) -> None:
    """Writes df below path, a folder for each shard (`name`, "shard" if not given). A shard's rows, equal ones too, are salted over `files` files; null keys as in place()."""
    name = how.setdefault("name", "shard")
    placed = place(df, key, **how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    placed.repartition(files * len(how.get("shards", SHARDS)), name, salt).write.partitionBy(name).parquet(path)


def op6(spark, sf_dir):
    """doc_id, slot, shard, shard_if_last_lost of all documents; null ids as in place()."""
    from .common import documents

    d = documents(spark, sf_dir).select("doc_id", slot_of(F.col("doc_id")).alias("slot"))
    d = place(d, "doc_id")
    return place(d, "doc_id", shards=SHARDS[:-1], name="shard_if_last_lost")


def op6_sql() -> str:
    def listed(shards):
        return "[" + ", ".join(f"'{shards[i]}'" for i in lookup_table(shards)) + "]"

    return f"""
    with s as (select doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {SLOTS} as integer) as slot from documents)
    select doc_id, slot, {listed(SHARDS)}[slot + 1] as shard, {listed(SHARDS[:-1])}[slot + 1] as shard_if_last_lost from s"""
