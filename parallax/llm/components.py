"""Connected components of a link table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, shared_table

MOST_STEPS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links (a, b), longs, with the smallest node that it reaches.

    Every step is a few joins and grouped minima; the links are written to the shared folder after
    each step, so no plan grows and a lost executor costs one step at most.  A node with very many
    links is one key of a join that adaptive execution splits, and of a minimum that is combined
    before the shuffle.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = shared_table(edges, "links")
    state = _state(edges)
    for _ in range(MOST_STEPS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select("v", F.col("m").alias("u")).filter("v > u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        new = shared_table(small.select("e.v", "e.u").filter("v > u").distinct(), "links")
        before, edges, last = edges, new, state
        state = _state(edges)
        drop_shared(links.sparkSession, before)
        if state == last:
            break
    else:
        raise RuntimeError(f"links did not settle in {MOST_STEPS} steps")
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _state(edges: DataFrame) -> tuple:
    """A digest of the link table; equal before and after a step when nothing changed."""
    part = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(part.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(part, 33))).first())
