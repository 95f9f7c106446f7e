"""Sharding by weighted rendezvous hashing of stable keys.

Each shard s draws u(key, s) in (0, 1) from a hash of key and shard; the shard with the largest weight / -ln(u) takes the
key. The score of a shard does not depend on the others, so a further shard takes keys only into itself, and changing a
weight moves keys only into or out of that shard.

Defined results: the key is doc_id as text; null keys and rows that repeat a key go to one shard together, each with a slot
of its own; of equal scores the smaller shard wins; a null text has no bytes and the crc32 of nothing, 0, like an empty one;
a text of any length counts whole; an empty table gives no rows. Only doc_id and text are read, so any further columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, serial, staged


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double")
        return F.lit(float(weight)) / -F.log((bits + 0.5) / F.lit(float(1 << 53)))

    # equal scores: the smaller shard
    return -F.array_max(F.array(*[F.struct(score(s, w).alias("x"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]))["s"]


def shard(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) a row per row of docs. slot: 0, 1, ... inside each shard;
    grown_shard: the shard if there were one more, of weight 1."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"), rendezvous(F.col("doc_id"), [*weights, 1.0]).cast("int").alias("grown_shard"),
    )
    rows = staged(rows.select("*", F.xxhash64("doc_id", "text_crc32", "size").alias("order_hash"), serial()), "shards")
    return gapless(rows, "shard", len(weights), ["doc_id", "text_crc32", "size"], "order_hash", "slot").drop("order_hash")
