"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 60, kind: str = "long") -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns node, component (both of the kind: long, string or binary).

    Each round is two aggregations and two joins over at most the edges there are; a node
    with very many neighbours is only ever a join key, which adaptive execution splits, or
    a minimum, which is combined before the shuffle. Rounds end when the edge set no longer
    changes. Null ends and loops are ignored; no edges give no rows.
    """
    a, b = F.col(src).cast(kind), F.col(dst).cast(kind)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    seen, kept = None, None
    for _ in range(max_rounds):
        if kept is not None:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        watch = Observation()
        new = scratch.keep(now.observe(watch, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        got = (watch.get["n"], watch.get["x"])
        if kept is not None:
            scratch.drop(kept)
        now = kept = new
        if got == seen or not got[0]:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
