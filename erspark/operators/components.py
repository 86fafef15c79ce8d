"""Connected components of a pair relation by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.plans.runtime import join_split_hot, materialize, release


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step. Large: each larger neighbour of u is linked to the least of u's neighbourhood;
    small: u and its smaller neighbours are. A hub's neighbours are dealt to salts."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        out = join_split_hot(both.filter("v > u"), least, ["u"], None, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = (join_split_hot(edges, least, ["u"], None, 2 * total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.distinct()


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """Edges that are no loops, loops, and whether the edges are stars: each larger end has one smaller, which is no larger end itself."""
    ends = edges.select(F.col("u").alias("x"), (F.col("u") != F.col("v")).cast("int").alias("as_u"), F.lit(0).alias("as_v"), (F.col("u") == F.col("v")).cast("int").alias("loop")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), (F.col("u") != F.col("v")).cast("int").alias("as_v"), F.lit(0).alias("loop")))
    r = ends.groupBy("x").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("v"), F.max("loop").alias("loop")).agg(
        F.sum("n").alias("n"), F.sum("loop").alias("loops"), F.count_if((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("v") == 1))).alias("open")).first()
    return r.n or 0, r.loops or 0, not r.open


def connected_components(edges: DataFrame, src: str = "id_a", dst: str = "id_b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that an edge touches; component is the least node reachable.

    Edges may repeat, point either way or loop; those with a null end are dropped. Each round
    is written to the shared folder, so no state lives on the driver or on one executor; the steps end when
    only stars are left. Raises RuntimeError if ``rounds`` do not suffice.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(
        F.col(src).isNotNull() & F.col(dst).isNotNull())
    first = materialize(e.distinct())
    (total, loops, settled), now = _state(first), first.filter("u > v")
    for _ in range(rounds):
        if settled:
            break
        half = materialize(_star(now, True, total))
        new = materialize(_star(half, False, total))
        release(half)
        release(now)  # the first edges stay, for their loops
        now = new
        total, _, settled = _state(now)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
    if not loops:
        return out
    alone = first.filter("u = v").select(F.col("u").alias("node")).join(out.select("node"), "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))
