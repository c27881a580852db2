"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightrow.session import durable, free

MOST_ROUNDS = 60


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Each round links every node's neighbours to the smallest of them (large star, then
    small star), so rounds grow with the logarithm of the longest chain. The table of each
    round is written out; minima are combined before the shuffle. Edges without two
    different ends are left out.
    """
    ends = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    table = durable(ends.where("u <> v").distinct())
    state = _state(table)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        before, table = table, durable(_small_star(_large_star(table)))
        free(before)
        after = _state(table)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(table: DataFrame) -> tuple:
    row = table.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(table: DataFrame) -> DataFrame:
    both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Neighbours above u are those of the rows (neighbour, u) of the table.
    up = table.select(F.col("v").alias("u"), F.col("u").alias("above"))
    return up.join(least, "u").select(F.col("above").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(table: DataFrame) -> DataFrame:
    least = table.groupBy("u").agg(F.min("v").alias("m"))
    moved = table.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
