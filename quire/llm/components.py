"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node that it reaches.

    Each round writes its edges to the shared folder; grouping takes minima only, so a hub with many
    neighbours is summed up before the shuffle. Rows with a null or with a = b add nothing.
    """
    now = scratch.cut(edges.filter("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) v", "least(a, b) m").distinct())
    mark = None
    for _ in range(rounds):
        both = now.select("v", "m").union(now.selectExpr("m", "v"))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("least"))
        large = both.join(least, "v").filter("m > v").selectExpr("m v", "least m").filter("v <> m").distinct()
        small = large.groupBy("v").agg(F.min("m").alias("least"))
        stars = large.join(small, "v")
        after = stars.selectExpr("m v", "least m").union(stars.selectExpr("v", "least m")).filter("v <> m").distinct()
        after = scratch.cut(after)
        seen = tuple(after.agg(F.count("*"), F.sum(F.hash("v", "m").cast("long")), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.selectExpr("v node", "m component").union(now.selectExpr("m node", "m component").distinct())
