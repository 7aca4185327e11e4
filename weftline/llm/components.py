"""Connected components by alternating star contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import handed_on, materialize, remove, scratch


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all neighbours of u.

    The least is aggregated by u and joined by the complement of u: so both sides are
    exchanged right below the join, and a node with very many edges can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, F.bitwise_not("u") == F.col("k")).select("u", "v", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges(a, b) of longs: the least node that it reaches.

    Large-star and small-star rounds in turn; all edges stay distributed, each round is
    written to the shared folder. No edges: no rows. Loops and repeated edges are ignored.
    """
    spark = edges.sparkSession

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    def written(df: DataFrame, before: list[str]) -> DataFrame:
        """df in the shared folder; what it was made from goes."""
        with scratch(spark) as made:
            df = materialize(df)
            here = made.pop()
        remove(spark, before)
        before[:] = [here]
        return df

    held: list[str] = []
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), held)
    before = print_of(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(star.select("e.u", "e.v").where("u != v").distinct(), held)
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    handed_on(held)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
