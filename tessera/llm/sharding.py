"""Operator 7: placement by a permutation-filled lookup table. DataFrame functions only.

Every shard has a preference order over the slots of a table of prime size: offset, offset + skip, offset + 2 skip, ...
modulo the size, both from a hash of the shard's name. The shards take turns, each claiming its next free slot, until
the table is full, so shares differ by one slot at most and a removed shard moves hardly any other key. A row goes to the
shard in slot hash(key) modulo size: one lookup, in a broadcast table whose rows are the slots and so never grow with the data.

Null keys count as the text "null"; equal keys share a shard; further columns pass through; a column named like an
added one is an error. An empty table stays empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:02d}" for k in range(20))
MAX_SLOTS = 4_000_037


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Shard index of every slot. A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k, s in enumerate(shards):
            for _ in range((weights or {}).get(s, 1)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                free -= 1
                if not free:
                    return table
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def slots_frame(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The table as rows (slot, shard), built from one literal."""
    table = ",".join(map(str, lookup_table(shards, slots, weights)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "_k")).select(F.col("slot").cast("long"), F.element_at(names, F.col("_k").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """df with the columns slot and shard."""
    if clash := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(slots_frame(df.sparkSession, shards, slots, weights)), "slot", "left").select(*[F.col(f"`{c}`") for c in df.columns], "slot", "shard")


def write_shards(df: DataFrame, key: str, where: str, shards: tuple[str, ...] = SHARDS, files_per_shard: int = 4, **options) -> None:
    """Writes a folder for each shard. A second hash of the key deals a shard's rows to several tasks."""
    placed = place(df, key, shards, **options)
    salt = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), salt).write.mode("overwrite").partitionBy("shard").parquet(where)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle_sql() -> str:
    """The placement in SQL over the same filled table; the filling itself is tested against a plain simulation."""
    table = ",".join(map(str, lookup_table(SHARDS)))
    names = ",".join(SHARDS)
    return f"""
    WITH t AS (SELECT string_split('{table}', ',') AS slots, string_split('{names}', ',') AS names),
    d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents)
    SELECT d.doc_id, d.slot, t.names[CAST(t.slots[d.slot + 1] AS INTEGER) + 1] AS shard FROM d, t
    """
