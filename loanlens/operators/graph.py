"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round. Minima are joined back instead of collecting neighbours, so a hub is never one row."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(flipped)
    toward = both.filter("b < a") if small else both
    least = toward.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    kept = toward if small else both.filter("b > a")
    linked = kept.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), "m")
    if small:
        linked = linked.unionByName(least.select(F.col("u").alias("x"), "m"))
    out = linked.filter("x != m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type, in any direction, repeats and loops allowed -> (node, component), for nodes with
    an edge to another; component is the smallest node. Null ends are not nodes.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until no edge changes. Each round is written to the
    shared folder and the one before is deleted; only a count and a hash sum of the edges reach the driver."""
    ends = edges.filter("a is not null and b is not null and a != b")
    now, last = staged(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        after = staged(_star(_star(now, small=False), small=True), "edges")
        discard(now)
        now = after
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
