"""Buckets for two-sided comparison within a key, dealt so that no task gets a whole large bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import materialize

#: Rows of a table that may go to every executor: some megabytes. A longer one is joined by its key.
FEW = 200_000


def deal(df: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Adds tile numbers i, j to rows of (keys, side 0 or 1, member) and gathers each tile in one partition, in order.

    A bucket with over ``limit`` rows of a side is cut into parts of about that many by a hash of the
    member; each part of side 0 meets each part of side 1 in a tile of its own, so no pair is lost.
    """
    counts = df.groupBy(*keys).agg(F.count(F.when(F.col("side") == 0, 1)).alias("__l"), F.count(F.when(F.col("side") == 1, 1)).alias("__r"))
    wide = counts.filter((F.col("__l") > limit) | (F.col("__r") > limit)).select(*keys, F.ceil(F.col("__l") / limit).cast("int").alias("__i"), F.ceil(F.col("__r") / limit).cast("int").alias("__j"))
    wide = materialize(wide, "wide")
    if wide.count() <= FEW:
        # joined before anything is dealt by key, so that no task gets a whole large bucket
        wide = F.broadcast(wide)
    left = F.col("side") == 0
    own = F.pmod(F.xxhash64(member), F.greatest(F.lit(1), F.coalesce(F.when(left, F.col("__i")).otherwise(F.col("__j")), F.lit(1)))).cast("int")
    across = F.greatest(F.lit(1), F.coalesce(F.when(left, F.col("__j")).otherwise(F.col("__i")), F.lit(1)))
    dealt = df.join(wide, keys, "left").withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), across - 1)))
    dealt = dealt.withColumns({"i": F.when(left, F.col("__own")).otherwise(F.col("__other")), "j": F.when(left, F.col("__other")).otherwise(F.col("__own"))}).drop("__i", "__j", "__own", "__other")
    return dealt.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "side")


def runs(batches, n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles of sorted batches: a table and the first row of each tile in it."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        heads = _heads(now, n_keys)
        if len(heads) > 1:
            yield now.slice(0, heads[-1]), heads[:-1]
        held = now.slice(heads[-1]).combine_chunks() if len(heads) else None
    if held is not None and held.num_rows:
        yield held, _heads(held, n_keys)


def _heads(table: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(n_keys):
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) with the same components as the given pairs."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    move = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[move], nodes[label[move]]
