"""Connected components in Spark by alternating large-star and small-star
steps (Kiveris et al., 2014): each step is a join with the least neighbour of
each node, and no node's neighbourhood is ever gathered in one row. The least
neighbours are broadcast where the edges were counted to be few; else they are
written first, so that the join stands between plain tables, where Spark splits
the edges of a star's centre among tasks. Every round ends in a table in the
shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, small, store

#: Edges that are written to one file, about.
FILE = 100_000


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges(a, b) of long ids -> (node, root): root is the smallest id that
    node reaches. Self loops, repeated and reversed edges are fine; null ends
    are ignored; no edges give no rows."""
    cur = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name
    )
    seen = None
    while True:
        sign = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == seen:
            ends = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            out = store(cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(ends).coalesce(max(1, sign[0] // FILE)), name)
            drop(cur)
            return out
        seen = sign
        few, files = 2 * sign[0] <= BROADCAST_ROWS, max(1, sign[0] // FILE)
        held = []

        def least(df: DataFrame) -> DataFrame:
            """The rows of df (at most two for each edge) for the smaller side of a join."""
            if few:
                return F.broadcast(df)
            held.append(store(df, name))
            return small(held[-1])

        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large.coalesce(files), name)
        pairs = large.join(least(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        pairs = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        nxt = store(pairs.select("e.a", "e.b").filter("a <> b").distinct().coalesce(files), name)
        drop(large, *held)
        drop(cur)
        cur = nxt
