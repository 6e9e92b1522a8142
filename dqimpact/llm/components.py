"""Connected components of a table of links, by alternating stars.

A round turns every node's larger neighbours to its smallest one, then every node's smaller neighbours
to the smallest of them, until nothing changes.  Links stay in tables throughout; a round is two
aggregates with map-side minima and two joins, and its result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v.  One star step over each node's neighbourhood."""
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        turned = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        turned = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return turned.filter("u > v").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that has a link to another one."""
    at = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links"
    )
    before, now = None, _mark(at)
    while before != now:
        at = stored(_star(_star(at, True), False), "links")
        before, now = now, _mark(at)
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
