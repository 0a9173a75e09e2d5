"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard draws a number for a record's key; the record goes to the shard with the best one, where
a shard of weight w wins in proportion to w. The draw depends on key and shard alone, so adding a shard
moves only those records that the new shard wins, and removing one moves only its own.

Defined results: a null key is one more key; equal keys share a shard, repeated rows stay separate
rows; a null text has size 1 (no bytes, plus 1) and the checksum of the empty text; an empty table
gives no rows; other columns of the input are never looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import gapless, stored

# 13 hex digits: a draw is exact in a double.
_DRAWS = float(16**13)


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard that wins `key`; `weights` maps shard numbers to positive weights."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard is needed, and weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    bids = []
    for shard, weight in sorted(weights.items()):
        digest = F.md5(F.concat(name, F.lit(f":{shard}")))
        draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_DRAWS)
        bids.append(F.struct((-F.log(draw) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard")))
    return (bids[0] if len(bids) == 1 else F.least(*bids))["shard"]


def place(records: DataFrame, key: str, weights: dict[int, float], grown: dict[int, float]) -> DataFrame:
    """`records` with `shard`, the shard under the weights `grown`, and a gapless `slot` in the shard.

    Slots follow the order in which the records are stored; a shard's rows are numbered by many tasks.
    """
    placed = records.withColumns(
        {"shard": shard_of(F.col(key), weights), "grown_shard": shard_of(F.col(key), grown)}
    )
    return gapless(stored(placed, "shards"), ["shard"], "slot").drop("_mid")


def sizes(docs: DataFrame) -> DataFrame:
    """Document id with the UTF-8 size of the text plus 1 and the text's checksum."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def even(shards: int) -> dict[int, float]:
    """Equal weights for shards 0 to `shards` - 1."""
    return {i: 1.0 for i in range(shards)}
