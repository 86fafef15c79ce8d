"""Sharding of indivisible groups into byte-balanced shards by Karmarkar-Karp differencing.

Rows of equal text form a group. Groups are dealt by hash into parts of about ``PART`` groups;
in each part, partial partitions (a tuple of shard sums each) are combined two at a time,
those of largest spread first and oppositely ordered, until one is left. The parts' own
tuples, ``shards`` numbers a part, are dealt and combined in the same way, level by level, by tasks
of at most PARTS tuples each, until one tuple is left, whose bins are the shards. Rows then get their group's shard, and a place in it.

Law: ``bytes``. A group is never cut, so a group above an eighth of all bytes sets the largest shard.

Defined cases: null and empty texts have size 1 and are two groups; rows that repeat an id and a text stay in one
group, null ids too; texts of any length count whole; an empty table gives an empty one; only the columns named are read, so others can't clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.plans.runtime import join_split_hot, materialize, release, ship

SHARDS = 8
#: Groups, and tuples of parts, that one task combines.
PART, PARTS = 8192, 4096


def differencing(sums: np.ndarray) -> np.ndarray:
    """For partial partitions ``sums`` (n, k): the labels (n, k) that put their bins into k shards."""
    n, k = sums.shape
    labels = np.zeros((n, k), np.int64)
    if not n:
        return labels
    sums = np.asarray(sums, np.int64)
    total, order, heap = [], [], []  # of each node: its sums, largest first, and where its parts go
    for i in range(n):
        o = np.argsort(-sums[i], kind="stable")
        total.append(sums[i][o])
        order.append((i, o, -1, None))
        heap.append((-int(total[i][0] - total[i][-1]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = total[a] + total[b][::-1]
        o = np.argsort(-both, kind="stable")
        total[a] = total[b] = None
        at = np.empty(k, np.int64)  # the place of each bin of a
        at[o] = np.arange(k)
        order.append((a, at, b, at[::-1]))
        total.append(both[o])
        heapq.heappush(heap, (-int(total[-1][0] - total[-1][-1]), len(total) - 1))
    shard = {len(order) - 1: np.arange(k)}  # of each bin of a node
    for node in range(len(order) - 1, -1, -1):
        mine = shard.pop(node)
        a, at_a, b, at_b = order[node]
        if b < 0:
            labels[a][at_a] = mine
        else:
            shard[a], shard[b] = mine[at_a], mine[at_b]
    return labels


def _part(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True], ignore_index=True)
    sums = np.zeros((len(pdf), shards), np.int64)
    sums[:, 0] = pdf["bytes"]
    pdf["bin"] = differencing(sums)[:, 0]
    return pdf[["part", "g1", "g2", "n", "bytes", "bin"]]


def _tuples(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Bins of the parts in one part of the next level."""
    ids = np.unique(pdf["part"])
    sums = np.zeros((len(ids), shards), np.int64)
    sums[np.searchsorted(ids, pdf["part"]), pdf["bin"]] = pdf["bytes"]
    return pd.DataFrame({"part": np.repeat(ids, shards), "bin": np.tile(np.arange(shards), len(ids)), "up": int(pdf["up"].iloc[0]), "up_bin": differencing(sums).ravel()})


def assign_groups(groups: DataFrame, shards: int = SHARDS, part: int | None = None, parts: int | None = None) -> DataFrame:
    """``(g1, g2, n, shard)`` of groups ``(g1, g2, n, bytes)``."""
    ship(groups.sparkSession)
    part, parts = part or PART, parts or PARTS
    n = max(1, -(-groups.count() // part))
    binned = materialize(groups.withColumn("part", F.pmod("g1", F.lit(n)).cast("int")).groupBy("part").applyInPandas(
        lambda pdf: _part(pdf, shards), "part int, g1 long, g2 long, n long, bytes long, bin long"))
    few = lambda d, n: F.broadcast(d) if n <= parts else d  # noqa: E731  # shards rows a part, so at most shards * parts
    sums, first, chain = materialize(binned.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes"))), n, None
    while chain is None or n > 1:
        below, n = n, -(-n // parts)
        up = materialize(sums.withColumn("up", F.pmod("part", F.lit(n)).cast("int")).groupBy("up").applyInPandas(
            lambda pdf: _tuples(pdf, shards), "part int, bin long, up int, up_bin long"))
        sums = materialize(sums.join(few(up, below), ["part", "bin"]).groupBy(F.col("up").alias("part"), F.col("up_bin").alias("bin")).agg(F.sum("bytes").alias("bytes")))
        if chain is not None:
            step = up.select(F.col("part").alias("up"), F.col("bin").alias("up_bin"), F.col("up").alias("top"), F.col("up_bin").alias("top_bin"))
            up = materialize(chain.join(few(step, below), ["up", "up_bin"]).select("part", "bin", F.col("top").alias("up"), F.col("top_bin").alias("up_bin")))
        chain = up
    return binned.join(few(chain, first), ["part", "bin"]).select("g1", "g2", "n", F.col("up_bin").cast("int").alias("shard"))


def shard_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of each row."""
    t = F.col(text)
    rows = materialize(df.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(3), t).alias("g1"), F.xxhash64(F.lit(5), t).alias("g2")))
    groups = materialize(rows.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    chosen = materialize(assign_groups(groups, shards))
    release(groups)
    buckets = max(1, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # a place is given within a bucket of its shard; a bucket holds rows of any group, so hot groups are spread
    placed = materialize(join_split_hot(rows, chosen, ["g1", "g2"], None, total).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(buckets)).cast("int")).drop("n", "g2"))
    release(rows)
    release(chosen)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))  # shards * buckets rows at most
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    here = Window.partitionBy("shard", "bucket").orderBy("doc_id", "g1", "size", "text_crc32")
    return placed.withColumn("at", F.row_number().over(here) - 1).join(
        F.broadcast(before.select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op10(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
