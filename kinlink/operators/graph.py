"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.plans.scratch import drop, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node that links reach, for every node of an edge.

    Each round re-hangs neighbours onto the smallest one they know; stars flatten in O(log^2 n) rounds and
    a round moves each edge a constant number of times. Self links and repeated links are allowed, null
    ends are ignored; an empty frame gives an empty one. Ends must be whole numbers: others raise.
    """
    for c in (src, dst):
        if edges.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
            raise TypeError(f"{c} must hold whole numbers; number string ids first")
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull()).distinct()
    e = materialize(e, "cc")
    loops, before = e.where("a = b").select("a", "b"), None
    cur = materialize(e.where("a <> b"), "cc")
    for _ in range(max_rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialize(small, "cc")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(cur)
        cur = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node")).unionByName(loops.select(F.col("a").alias("node"))).distinct()
    tied = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(tied.unionByName(roots.join(tied, "node", "left_anti").select("node", F.col("node").alias("component"))), "cc")
    drop(e, cur)
    return out
