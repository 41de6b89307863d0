"""Connected components of a link table, on Spark joins only.

Alternating large-star / small-star rounds (Kiveris et al. 2014): every round
re-hangs links towards smaller vertices until each component is a star around
its smallest vertex.  Rounds grow with the logarithm of a component's size; a
round never holds the neighbours of one vertex in one task -- neighbour minima
are plain aggregates with map-side combine, and the joins back are equi-joins
whose hot keys AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def _sum_of(e: DataFrame) -> tuple:
    """Links and an order-free checksum: equal when two link sets are equal."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, component`` for every vertex that has a link; ``component`` is
    the smallest vertex it can reach.  Self links, repeated links and either
    direction are allowed; rows with a null end are ignored."""
    x, y = F.col(a), F.col(b)
    e = stored(
        links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = _sum_of(e)
    while before[0]:
        large = _large_star(e).distinct()
        e = stored(_small_star(large).distinct())
        after = _sum_of(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
