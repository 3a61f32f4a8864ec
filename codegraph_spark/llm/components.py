"""Connected components of a link table, by alternating star contractions on DataFrames.

Each round replaces links so that every vertex points to a smaller one near it. Rounds are logarithmic in the size
of the longest chain. Only minima per vertex are aggregated (partial sums before the shuffle); no component is ever
gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved


def _digest(links: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mark)).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger to the smaller end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    turned = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return turned.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of links (a, b): the component is its smallest vertex.

    Loops, repeated links and either direction are allowed; links with a null end are left out. A table without
    links gives no rows.
    """
    whole = links.where("a is not null and b is not null")
    turned = whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = saved(turned.distinct(), "links")
    before = None
    while (digest := _digest(now)) != before:
        if digest[0] == 0:
            break
        before, old = digest, now
        now = saved(_small_star(_large_star(old)), "links")
        dropped(old)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
