"""Weighted rendezvous hashing of stable record keys.

Each shard draws a number for a key, -ln(u) / weight with u from a hash of shard and key, and the least number wins. Other shards' draws don't depend on how
many shards there are, so a new shard takes rows only into itself, about its share of the weights. All of it is built-in expressions.

Edge cases: a null key is a key like any other (all null keys go to one shard); a null text has no bytes and the checksum 0; ties go to the lower shard.
Rows that repeat a key share its shard and have slots of their own, in any order where all else is equal too. Extra columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import RESULT_ROWS, gapless_rank, salt_count, tasks_for

SHARDS = 24


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The number that a shard draws for a key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / float(weight)


def best(key: Column, weights: Sequence[float]) -> Column:
    """struct<score, shard> of the winning shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    draws = [F.struct(draw(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return draws[0] if len(draws) == 1 else F.least(*draws)


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = (), shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Add the shard of every row, and the shard it would have if shards of the weights ``grown`` were added."""
    own = [F.struct(draw(F.col(key), len(weights) + i, w).alias("score"), F.lit(len(weights) + i).alias("shard")) for i, w in enumerate(grown)]
    df = df.withColumn("__best", best(F.col(key), weights))
    last = F.least(F.col("__best"), *own)["shard"] if own else F.lit(None).cast("int")
    return df.withColumn(shard, F.col("__best.shard")).withColumn(grown_shard, last).drop("__best")


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, shards and gapless slots of all documents. Only key, size and checksum are shuffled, never texts."""
    sized = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(sized, key, [1.0] * shards, [1.0])
    rows = docs.select(key).count()  # from the files' footers
    ranked = gapless_rank(placed, ["shard"], [key, "size", "text_crc32"], "slot", salt_count(rows // shards)).coalesce(tasks_for(rows, RESULT_ROWS))
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
