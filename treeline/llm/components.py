"""Connected components of a table of links, by alternating large and small stars.

Links are re-hung level by level in DataFrame steps, each written to the shared folder; neither
links nor components reach the driver, and a hub's links are never gathered in one task: they are
reduced to a minimum before the shuffle and joined by an ordinary, splittable join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """links: a, b of any one orderable type, without nulls -> node, root (smallest node it reaches) of each node with a link.

    Links of a node with itself are dropped; an empty table gives an empty result. Rounds needed are
    about the logarithm of the longest chain.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.write(links, f"{name}0")
    seen = None
    for k in range(1, most_rounds + 1):
        # large star: each node hands its greater neighbours to the least node near it
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node hands its smaller neighbours and itself to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l"))
        links = scratch.write(small.select("l.a", "l.b").filter("a <> b").distinct(), f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 1}")
        else:
            scratch.drop(f"{name}0")
        now = links.select(F.xxhash64("a", "b").cast("decimal(20,0)").alias("h")).agg(F.sum("h"), F.count(F.lit(1))).first()
        if now == seen or not now[1]:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = links.groupBy("b").agg(F.min("b").alias("root")).select(F.col("b").alias("node"), "root")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
