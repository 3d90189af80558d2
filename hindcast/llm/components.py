"""Connected components of a link table by alternating large and small stars
(Kiveris et al. 2014): every round links each node's neighbours to the
smallest node known, until no link changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round on links ``(a, b)`` with ``a > b``. The smallest
    neighbour is an aggregate and a join, so no neighbourhood is gathered."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        # the larger neighbours of a node go to its smallest neighbour, or to itself if it has no smaller one
        centre = least.select(F.col("a").alias("b"), "m")
        out = links.join(centre, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    else:
        moved = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link to another node;
    ``root`` is the smallest node reachable. Links have no direction; loops,
    repeats and links with a null end are ignored."""
    x, y = F.col(a), F.col(b)
    start = links.filter(x.isNotNull() & y.isNotNull() & (x != y))
    now = materialize(start.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        large = _star(now, True)
        new = materialize(_star(large, False), "links")
        after = _mark(new)
        discard(now)
        now = new
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Count and order-free fingerprint of a link table."""
    h = F.xxhash64("a", "b")
    row = links.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)
