"""Tables written between steps, and connected components, shared by several operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.staging import written

BITS = 22


def bit_of(value: Column, bits: int = BITS) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A set of hashed longs as a bit table of fixed size: at most ``2 ** bits`` positions reach the driver, whatever the input. It may
    say yes too often, never no; users must stay right with any false yes."""
    found = values.select(bit_of(F.col(column), bits).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    table = np.zeros(1 << bits, dtype=bool)
    table[found] = True
    return table


def most_frequent(counts: DataFrame, most: int, count: str = "c") -> list:
    """The rows of largest ``count``, ``most`` at most and without breaking a tie: counts are cut at one of some thousand steps of their
    logarithm, so neither the search for the cut nor its result grows with the table. A sorted limit would send ``most`` rows from each task."""
    step = F.floor(F.log2(count) * 64)
    left, cut = most, None
    for row in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        left -= row.n
        if left < 0:
            break
        cut = row.s
    return counts.where(step >= cut).collect() if cut is not None else []


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Smallest vertex that each vertex of ``edges`` can reach: large-star and small-star steps on tables until nothing changes.
    Each round is written to the shared folder, so lineage stays short. Returns ``v`` and ``root``; vertices are longs."""
    at = written(
        edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("root")).where("v > root").distinct()
    )
    state = None
    while True:
        both = at.unionByName(at.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"))
        large = both.where("root > v").join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).where("v > root").distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v").select(
            F.explode(F.array(F.struct(F.col("root").alias("v"), F.col("m").alias("root")), F.struct("v", F.col("m").alias("root")))).alias("e")
        )
        at = written(small.select("e.*").where("v > root").distinct())
        found = at.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return at
        state = tuple(found)
