"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table whose size is
prime; the shards take turns, each claiming the first slot in its order that is
still free.  Loads differ by at most one slot, and taking a shard away moves few
keys of the others.  Placement is one hash and one lookup, by a join with the
broadcast table, whose size (``slots`` rows) is a parameter and so bounded.

Nulls: a null key is placed as the empty string.  An empty table gives an empty
one, and repeated keys are placed alike, so there are no ties to break.  A very long
key is hashed whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """A shard's first slot and its step; the step is coprime to the prime table size."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number that owns each slot."""
    if not is_prime(slots) or not 0 < len(names) <= slots:
        raise ValueError("slots must be a prime no smaller than the number of shards")
    place, step = map(list, zip(*(preference(n, slots) for n in names)))
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(names)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % slots
            owner[at] = shard
            place[shard] = (at + step[shard]) % slots
            left -= 1
            if not left:
                break
    return owner


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def slot_of(key: F.Column, slots: int) -> F.Column:
    """The first 60 bits of the key's MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def assign(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard (these two replace columns of the same name)."""
    owner = F.from_json(F.lit(str(lookup_table(names, slots))), "array<int>")
    lookup = df.sparkSession.range(1).select(F.posexplode(owner).alias("_slot", "_shard"))
    lookup = lookup.select(F.col("_slot").cast("long").alias("_slot"), "_shard")
    placed = df.withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(lookup), placed["slot"] == lookup["_slot"]).drop("_slot", "shard").withColumnRenamed("_shard", "shard")


def write_shards(df: DataFrame, key: str, path: str, names: list[str], slots: int = SLOTS) -> None:
    """One folder per shard.  The slot is the shuffle key, so a shard is written by several tasks."""
    placed = assign(df, key, names, slots)
    placed.repartition("slot").drop("slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"))
    out = assign(docs, "doc_id", shard_names(SHARDS))
    return out.select("doc_id", "slot", F.col("shard").cast("long").alias("shard"))


def sql() -> str:
    owner = ",".join(map(str, lookup_table(shard_names(SHARDS))))
    return f"""WITH t AS (SELECT string_split('{owner}', ',') AS owner),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, CAST(owner[slot + 1] AS BIGINT) AS shard FROM d, t"""
