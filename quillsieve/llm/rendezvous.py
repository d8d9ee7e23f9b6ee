"""Sharding by weighted rendezvous hashing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillsieve.llm.common import materialize

#: Rows that one window of the slot numbering holds on average.
ROWS_PER_BUCKET = 20_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -w / ln(u) is highest; u in (0, 1) comes from 52 bits of md5(key|shard).

    The score of a shard depends on the key and that shard alone, so a further shard takes rows
    only into itself, and a changed weight moves rows only to or from its shard. A null key is
    the key '' (all such rows share a shard). A shard of weight 0 gets nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("a positive weight is needed")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
            score = -F.lit(float(weight)) / F.ln((bits + 0.5) / float(1 << 52))
            scored.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["shard"]).cast("int")


def slots(df: DataFrame, shard: str, order: Sequence[Column], out: str = "slot", per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap.

    Rows go to (shard, bucket) windows by a hash of ``order``; a bucket's first number is the sum of
    the counts before it, so no window holds a whole shard. Equal rows are dealt over sub-buckets by
    their row position in the input, so many repeats of one row stay spread too. The rows are written
    with their sub-buckets first: counts and windows read the same ones even if a task runs again.
    """
    held = materialize(df.withColumn("__at", F.monotonically_increasing_id()), "slots")
    per = max(1, -(-held.count() // per_bucket))
    sub = F.pmod(F.col("__at"), F.lit(per)).cast("int")
    numbered = held.withColumn("__sub", sub).withColumn("__bucket", F.pmod(F.xxhash64(*order, F.col("__sub")), F.lit(per)).cast("int"))
    numbered = numbered.withColumn("__n", F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order, "__at")))
    sizes = numbered.groupBy(shard, "__bucket").agg(F.count("*").alias("__c"))
    # One row per (shard, bucket), so a row stands for about ROWS_PER_BUCKET / shards rows of the input.
    first = sizes.withColumn("__first", F.sum("__c").over(Window.partitionBy(shard).orderBy("__bucket")) - F.col("__c")).withColumnRenamed(shard, "__shard").withColumnRenamed("__bucket", "__b")
    joined = numbered.join(first, numbered[shard].eqNullSafe(first["__shard"]) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(out, (F.col("__first") + F.col("__n") - 1).cast("long")).drop("__at", "__sub", "__bucket", "__n", "__c", "__first", "__shard", "__b")


def shard_documents(df: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, grown_shard, slot) for every row.

    size is the UTF-8 length (null: none) plus 8; text_crc32 is of the UTF-8 bytes (null: null).
    grown_shard is the shard with one more shard of weight 1. Repeated rows share a shard and have
    slots of their own; a null id is a key of its own; other columns are not read; an empty table
    gives an empty table.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    flat = df.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        rendezvous_shard(F.col(id_col), weights).alias("shard"),
        rendezvous_shard(F.col(id_col), [*weights, 1.0]).alias("grown_shard"),
    )
    return slots(flat, "shard", [F.col(id_col), F.col("text_crc32"), F.col("size")])
