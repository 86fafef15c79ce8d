"""Clusters of scored pairs: components, splits of oversized ones, quality and upkeep.

``membership(__cluster_id__, __row_id__)`` names a cluster by its least member;
``clusters(__cluster_id__, size, oversized, confidence, bottleneck_pair, cluster_quality)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.operators.blocking import least_pairs, tree_links, within
from erspark.operators.components import connected_components
from erspark.plans.runtime import materialize, ship

ID, CID = "__row_id__", "__cluster_id__"


def membership_of(pairs: DataFrame, ids: DataFrame | None = None, id_col: str = ID) -> DataFrame:
    """Members by cluster; rows of ``ids`` that no pair touches are clusters of their own."""
    groups = connected_components(pairs).select(F.col("component").alias(CID), F.col("node").alias(ID))
    if ids is None:
        return groups
    return ids.select(F.col(id_col).alias(ID)).distinct().join(groups, ID, "left").select(F.coalesce(CID, ID).alias(CID), ID)


def split_cluster(edges: list[tuple[int, int, float]], members: list[int], max_size: int) -> dict[int, int]:
    """Parts of one oversized cluster: the weakest edge of a maximum spanning tree goes until no part is too large."""
    parent = {m: m for m in members}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            tree.append((a, b, s))
    # the tree put together from its strongest edge to its weakest: the top of each part is the edge that is cut first
    parent = {m: m for m in members}
    made: dict[int, tuple] = {m: (m, 1, m) for m in members}  # of each root: its tree (a member, or two trees), size and least member
    for a, b, s in sorted(tree, key=lambda e: (e[2], e[0], e[1]), reverse=True):
        x, y = root(a), root(b)
        parent[x] = y
        made[y] = ((made[x], made[y]), made[x][1] + made[y][1], min(made[x][2], made[y][2]))
        del made[x]
    out, todo = {}, [(t, None) for t in made.values()]
    while todo:
        (what, size, least), name = todo.pop()
        if not isinstance(what, tuple):
            out[what] = least if name is None else name
            continue
        if name is None and size <= max_size:
            name = least
        todo += [(t, name) for t in what]
    return out


def split_oversized(membership: DataFrame, pairs: DataFrame, max_size: int) -> tuple[DataFrame, DataFrame]:
    """(membership, ids of clusters that a split made); only oversized clusters leave the plan of built-ins."""
    ship(membership.sparkSession)
    big = materialize(membership.groupBy(CID).count().filter(F.col("count") > max_size).select(CID))
    if big.isEmpty():
        return membership, big
    rows = materialize(membership.join(big, CID, "left_semi"))
    edges = materialize(pairs.join(rows.select(F.col(ID).alias("id_a"), CID), "id_a").select(CID, "id_a", "id_b", "score"))

    def run(members: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame({CID: pd.Series(dtype="int64"), ID: pd.Series(dtype="int64")})
        parts = split_cluster(list(e[["id_a", "id_b", "score"]].itertuples(index=False, name=None)), members[ID].tolist(), max_size)
        return pd.DataFrame({CID: list(parts.values()), ID: list(parts)})

    parted = materialize(rows.groupBy(CID).cogroup(edges.groupBy(CID)).applyInPandas(run, f"{CID} long, {ID} long"))
    return membership.join(big, CID, "left_anti").unionByName(parted), parted.select(CID).distinct()


def cluster_stats(membership: DataFrame, pairs: DataFrame, max_size: int = 100, weak: float = 0.3, split: DataFrame | None = None) -> DataFrame:
    """One aggregation over the pairs that lie within a cluster; a column ``pairs`` tells how many pairs a row stands for."""
    times = F.col("pairs") if "pairs" in pairs.columns else F.lit(1)
    inside = pairs.join(membership.select(F.col(ID).alias("id_a"), F.col(CID).alias("ca")), "id_a").join(membership.select(F.col(ID).alias("id_b"), F.col(CID).alias("cb")), "id_b").filter("ca = cb")
    edge = inside.groupBy(F.col("ca").alias(CID)).agg(F.min("score").alias("low"), (F.sum(F.col("score") * times) / F.sum(times)).alias("mean"), F.sum(times).alias("edges"),
                                                  F.min_by(F.struct(F.col("id_a").alias("a"), F.col("id_b").alias("b")), F.struct("score", "id_a", "id_b")).alias("bottleneck_pair"))
    out = membership.groupBy(CID).agg(F.count("*").alias("size")).join(edge, CID, "left")
    possible = F.col("size") * (F.col("size") - 1) / 2
    raw = F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce(0.4 * F.col("low") + 0.3 * F.col("mean") + 0.3 * F.least(F.lit(1.0), F.col("edges") / possible), F.lit(0.0)))
    is_weak = F.coalesce(F.col("mean") - F.col("low") > weak, F.lit(False))
    if split is not None:
        out = out.join(split.withColumn("__split", F.lit(True)), CID, "left")
    else:
        out = out.withColumn("__split", F.lit(None).cast("boolean"))
    return out.select(CID, F.col("size").cast("int").alias("size"), (F.col("size") > max_size).alias("oversized"), F.round(F.when(is_weak & F.col("__split").isNull(), raw * 0.7).otherwise(raw), 6).alias("confidence"),
                      "bottleneck_pair", F.when(F.col("__split"), "split").when(is_weak, "weak").otherwise("strong").alias("cluster_quality"))


def build_clusters(pairs: DataFrame, ids: DataFrame | None = None, max_size: int = 100, auto_split: bool = True, weak: float = 0.3, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, clusters) of scored pairs, and of those that ``classes``, rows of ``class_rows`` with ``score``, stand for."""
    exact = pairs
    if classes is not None:
        pairs = materialize(pairs.select("id_a", "id_b", "score").unionByName(tree_links(classes)))
    members, split = materialize(membership_of(pairs, ids)), None
    if auto_split:
        parted, split = split_oversized(members, pairs, max_size)
        members = parted if parted is members else materialize(parted)
    if classes is not None:
        counted = least_pairs(within(classes, members, ID, CID)).withColumn("pairs", F.col("pairs").cast("double"))
        pairs = (exact if "pairs" in exact.columns else exact.withColumn("pairs", F.lit(1.0))).select("id_a", "id_b", "score", "pairs").unionByName(counted.select("id_a", "id_b", "score", "pairs"))
    return members, cluster_stats(members, pairs, max_size, weak, split)


def pair_scores(membership: DataFrame, pairs: DataFrame, cluster_id: int) -> DataFrame:
    of = membership.filter(F.col(CID) == cluster_id)
    return pairs.join(of.select(F.col(ID).alias("id_a")), "id_a", "left_semi").join(of.select(F.col(ID).alias("id_b")), "id_b", "left_semi")


def add_to_clusters(membership: DataFrame, new_ids: DataFrame, matches: DataFrame) -> DataFrame:
    """Membership after rows ``new_ids`` came with ``matches (id_a, id_b)``: no match makes a cluster, one joins it, many merge theirs.

    Components are taken over clusters, not rows: an edge for each match, so old members cost one join.
    """
    known = membership.select(F.col(ID).alias("node"), F.col(CID).alias("c"))
    named = known.unionByName(new_ids.select(F.col(ID).alias("node"), F.col(ID).alias("c")))
    edges = matches.join(named.select(F.col("node").alias("id_a"), F.col("c").alias("ca")), "id_a").join(named.select(F.col("node").alias("id_b"), F.col("c").alias("cb")), "id_b").select(F.col("ca").alias("id_a"), F.col("cb").alias("id_b"))
    roots = connected_components(edges).select(F.col("node").alias("c"), "component")
    return named.join(roots, "c", "left").select(F.coalesce("component", "c").alias(CID), F.col("node").alias(ID))


def unmerge(membership: DataFrame, pairs: DataFrame, row_id: int, threshold: float = 0.0) -> DataFrame:
    """The row alone, the rest of its cluster clustered again by pairs at or above the threshold."""
    own = membership.filter(F.col(ID) == row_id).select(CID)
    rest = membership.join(own, CID, "left_semi").filter(F.col(ID) != row_id)
    inside = pairs.filter((F.col("score") >= threshold) & (F.col("id_a") != row_id) & (F.col("id_b") != row_id)).join(
        rest.select(F.col(ID).alias("id_a")), "id_a", "left_semi").join(rest.select(F.col(ID).alias("id_b")), "id_b", "left_semi")
    single = membership.filter(F.col(ID) == row_id).select(F.col(ID).alias(CID), ID)
    return membership.join(own, CID, "left_anti").unionByName(membership_of(inside, rest)).unionByName(single)


def shatter(membership: DataFrame, cluster_id: int) -> DataFrame:
    return membership.select(F.when(F.col(CID) == cluster_id, F.col(ID)).otherwise(F.col(CID)).alias(CID), ID)


def recluster_at(pairs: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    return membership_of(pairs.filter(F.col("score") >= threshold), ids)
