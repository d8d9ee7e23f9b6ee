"""Connected components by alternating star contraction, on DataFrames only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import discard, materialize
from quillsieve.llm.tiles import forest

#: Up to so many edges (256 KB of them) one task contracts the graph as a whole.
SMALL = 1 << 14


#: From this many edges on, joins on a node of over HUB edges are dealt over several tasks.
SPLIT, HUB = 1 << 20, 1 << 16


def _with_least(edges: DataFrame, least: DataFrame, split: bool) -> DataFrame:
    """The edges (u, v) with the least m of u, given (u, m, n) with the number n of u's edges.

    A hub has one row in ``least`` and ever so many edges: these are dealt by their other end, and the
    row goes to each part. Hubs are a 1 / HUB of the edges at most, so their list can go everywhere.
    """
    if not split:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > HUB).select("u", F.ceil(F.col("n") / HUB).cast("int").alias("parts")))
    dealt = edges.join(hubs, "u", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts"))).otherwise(F.lit(0)).cast("int")).drop("parts")
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / HUB), F.lit(1)).cast("int") - 1)
    return dealt.join(least.select("u", "m", F.explode(F.when(F.col("n") > HUB, parts).otherwise(F.array(F.lit(0)))).alias("part")), ["u", "part"]).select("u", "v", "m")


def _star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """One large-star or small-star step over directed pairs (u > v)."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        out = _with_least(both.filter("v > u"), least, split).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(edges, least, split)
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges, in one task."""

    def run(batches):
        us, vs = [], []
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            node, least = forest(u, v)
            roots = np.setdiff1d(np.concatenate([u, v]), node)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([least, roots]))], names=["node", "component"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (u, v); component is the least node reachable.

    Large-star and small-star steps alternate until the edge set stands still; each step is a
    min-aggregation and an equi-join, and a hub's edges are dealt over several tasks. A graph of up to
    ``SMALL`` edges is contracted by one task instead. Self-loops and
    nulls are ignored: a node seen only in them is not returned. Empty edges give an empty table.
    """
    now = materialize(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    size = now.count()
    if not size:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if size <= SMALL:
        return _at_once(now)
    split = size >= SPLIT
    for _ in range(max_rounds):
        after = materialize(_star(_star(now, True, split), False, split), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
