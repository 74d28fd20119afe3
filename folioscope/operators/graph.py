"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.storage import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of an edge, the smallest node that it is connected with.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until no edge changes. Each step is a
    partially aggregated minimum and a join. The minima are checkpointed, as adaptive execution splits a node with very many
    neighbours only where both sides of the join come straight from a shuffle, not from an aggregate in the same stage.
    Each round is checkpointed. Null ends and loops are ignored. Raises if it does not settle in max_rounds.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)))
    now = checkpointed(now.distinct())
    last = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last or state[0] == 0:
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends).distinct()
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
