"""Near-duplicate documents: five-word shingles, Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints linked by Golay keys (``simhash``). Four of 64
bits hold only pairs of about 0.95 and more, so the same pass over the texts also takes
BANDS x ROWS minima of the shingle hashes, and texts that share a band are candidates too: a
pair at 0.8 shares none with a chance below 0.0001. Each bucket first yields links of its members to
the first one, unless their numbers of shingles rule 0.8 out. All of them are verified exactly on the whole
sets: first each text's likeliest candidate by agreeing minima, then those between groups that are still apart, however
few minima agree. Last, buckets of three and more whose members are not yet of one group are compared exactly, every two
members of different groups: in blocks, two at a time, on whole sets, so that no bucket is the work of one task.

Texts are nodes named by numbers of their own, found by two 64-bit hashes. Defined cases: texts without words are copies of each
other; texts of fewer words than a shingle are one shingle; texts of any length are hashed whole; equal rows are one document; of
a group the row of smallest id stays, nulls first; an empty table gives an empty one; no column is touched, whatever its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.simhash import fingerprint_links, shingle_hashes, simhash
from erspark.llm.text import maybe_in, packed, row_key, unpacked
from erspark.operators.components import connected_components
from erspark.plans.runtime import join_split_hot, materialize, release, scratch, ship

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SLACK, SURE = 25, 5, 0.6, 0.9
#: Members and shingles of a block of a large bucket, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Salts and names of the two hashes that stand for a text.
TEXT_KEY = ((3, "h1"), (5, "h2"))
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits."""
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ h >> np.uint64(29)


def minima(blocks: list[np.ndarray]) -> np.ndarray:
    """Of each of the BANDS x ROWS hash functions the least value over all shingles."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for block in blocks:
        for at in range(0, len(block), 2048):
            h = mix(block[at:at + 2048])
            values = _MUL[:, None] * h[None, :] + _ADD[:, None]
            np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ least.reshape(BANDS, ROWS)[:, r])
    return key


def signatures(df: DataFrame, size: int) -> DataFrame:
    """``(h1, h2, fp, n, sketch, bands)`` of ``(h1, h2, text)``; n is the number of different shingles."""
    def run(batches):
        for batch in batches:
            fps, ns, sketches, bands = [], [], [], []
            for t in batch.column(2).to_pylist():
                blocks = [*shingle_hashes(t, size)]
                fps.append(simhash(blocks))
                distinct = [np.unique(np.concatenate(blocks))] if blocks else []
                ns.append(len(distinct[0]) if distinct else 0)
                least = minima(distinct)
                sketches.append((mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                bands.append(band_keys(least).view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(flat))], ["h1", "h2", "fp", "n", "sketch", "bands"])

    return df.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, fp long, n long, sketch binary, bands array<long>")


def bucket_edges(nodes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes (node, n, bands)``: links ``(u, v)`` of members of a bucket to its first, by size, unless sizes rule the
    similarity out; and the members ``(key, node, n)`` of buckets of three and more, whose other pairs are still to be met.

    Buckets of one are told by a bitmap and never shuffled again; a large one is dealt to salts.
    """
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "n")
    first = materialize(keyed.groupBy("key").agg(F.min(F.struct("n", "node")).alias("first"), F.count("*").alias("c")).filter("c > 1"))
    shared = maybe_in(keyed, "key", first.select("key"), first.count()).filter("maybe").drop("maybe")
    met = materialize(join_split_hot(shared, first, ["key"], None, total * BANDS, count="c"))
    links = met.filter((F.col("node") != F.col("first.node")) & (F.col("first.n") >= SIMILARITY * F.col("n"))).select(
        F.greatest("node", "first.node").alias("u"), F.least("node", "first.node").alias("v"))
    return links, met.filter("c > 2").select("key", "node", "n")


def bucket_units(crowd: DataFrame) -> DataFrame:
    """``(unit, node, root)`` of members ``(key, node, n, root)`` of buckets, so that any two of a bucket that are of different
    roots, and whose sizes do not rule the similarity out, share a unit.

    A bucket falls into blocks of about BLOCK members and BLOCK_SHINGLES shingles; a unit is two blocks, or one. Members of the root that has
    most of a bucket have blocks of their own, which never meet each other: they are joined already.
    """
    roots = materialize(crowd.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w")))
    keys = materialize(roots.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"),
                                               F.max_by("w", F.struct("c", "root")).alias("w_major"), F.count("*").alias("roots")).filter("roots > 1"))
    sized = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    keys = keys.select("key", "major", "c", sized(F.col("most"), F.col("w_major")).alias("n_major"), sized(F.col("c") - F.col("most"), F.col("w") - F.col("w_major")).alias("n_minor"))
    member = materialize(join_split_hot(crowd, keys, ["key"], None, crowd.count(), count="c").withColumn("own", F.col("root") == F.col("major")).withColumn(
        "block", F.when(F.col("own"), -1 - F.pmod(F.xxhash64("node"), F.col("n_major"))).otherwise(F.pmod(F.xxhash64("node"), F.col("n_minor"))).cast("int")))
    blocks = materialize(member.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root")).alias("members"), F.min("n").alias("low"), F.max("n").alias("high")))
    bare = blocks.select("key", "block", "low", "high")
    side = lambda d, s: d.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")))
    pair = side(bare.filter("block >= 0"), "a").join(side(bare, "b"), "key").filter("block_b <= block_a").filter(
        (F.col("high_a") >= SIMILARITY * F.col("low_b")) & (F.col("high_b") >= SIMILARITY * F.col("low_a")))
    ends = materialize(pair.select("key", F.xxhash64("key", "block_a", "block_b").alias("unit"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block")))
    return join_split_hot(ends, blocks, ["key", "block"], ends.groupBy("key", "block").agg(F.count("*").alias("n")), ends.count()).select(
        "unit", F.explode("members").alias("m")).select("unit", "m.node", "m.root")


def common_counts(sets: list[np.ndarray], often: int = 24) -> np.ndarray:
    """How many values each two of the sets have in common: values of many sets by matrix products, others pair by pair."""
    m = len(sets)
    which = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, which = value[order], which[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(value)])
    out = np.zeros((m, m), np.float32)
    columns = np.flatnonzero(size > often)
    for at in range(0, len(columns), 2048):
        some = columns[at:at + 2048]
        dense = np.zeros((m, len(some)), np.float32)
        for c, k in enumerate(some.tolist()):
            dense[which[head[k]:head[k] + size[k]], c] = 1
        out += dense @ dense.T
    few = np.repeat((size > 1) & (size <= often), size)
    value, which = value[few], which[few]
    for d in range(1, often):
        i = np.flatnonzero(value[d:] == value[:-d])
        if not len(i):
            break
        times = np.bincount(which[i] * m + which[i + d], minlength=m * m).reshape(m, m)
        out += times + times.T
    return out


def _unit_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links that join the members of one unit as all its pairs of the similarity do; those of one root are joined already."""
    rows = rows.drop_duplicates("node")
    node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    n = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    near = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-9
    u, v, open_ = [], [], np.ones(len(node), bool)
    near |= root[:, None] == root[None, :]
    while open_.any():
        todo = [int(np.argmax(open_))]
        open_[todo[0]] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & open_)
            open_[found] = False
            todo.extend(found.tolist())
            found = found[root[found] != root[x]]
            u.append(np.maximum(node[found], node[x]))
            v.append(np.minimum(node[found], node[x]))
    return pd.DataFrame({"u": np.concatenate(u).astype(np.int64), "v": np.concatenate(v).astype(np.int64)})


def _joined_ends(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Stored ``pairs (u, v, ...)`` with ``column`` of both ends as ``a`` and ``b``; a node of very many pairs is dealt to salts."""
    total = pairs.count()
    out = pairs
    for end, name in (("u", "a"), ("v", "b")):
        side = of.select(F.col("node").alias(end), F.col(column).alias(name))
        out = join_split_hot(out, side, [end], pairs.groupBy(end).agg(F.count("*").alias("n")), total)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(u, v)`` of a stored table whose whole sets have the similarity."""
    both = _joined_ends(pairs.select("u", "v"), sets, "set").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(j)[i].as_py(), np.uint64) for j in (2, 3))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _shares(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored candidate ``edges (u, v)`` with ``share``, how many of the sketches' minima agree."""
    both = _joined_ends(edges, nodes, "sketch").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(j).to_pylist()), "<u2").reshape(batch.num_rows, -1) for j in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1))], ["u", "v", "share"])

    return both.mapInArrow(run, "u long, v long, share double")


def _joined(groups: DataFrame, more: DataFrame) -> DataFrame:
    """``groups (node, root)`` after the links ``more (u, v)``; the groups' own roots stand for them."""
    if more.isEmpty():
        return groups
    of = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    joined = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    over = connected_components(joined, "u", "v").select(F.col("node").alias("root"), F.col("component").alias("above"))
    known = groups.unionByName(over.select(F.col("root").alias("node"), "root")).distinct()
    return materialize(known.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root")).distinct())


def text_groups(df: DataFrame, text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(h1, h2, root)`` of texts that have a near-duplicate; h1 and h2 are hashes of the text with salts 3 and 5."""
    if similarity < SIMILARITY:
        raise ValueError(f"bands are laid out for a similarity of {SIMILARITY} or more")
    ship(df.sparkSession)
    with scratch() as keep:
        return keep(_text_groups(df, text, size, similarity))


def _text_groups(df: DataFrame, text: str, size: int, similarity: float) -> DataFrame:
    texts = df.select(*(F.xxhash64(F.lit(salt), F.col(text)).alias(name) for salt, name in TEXT_KEY), F.col(text).alias("text"))
    found = materialize(signatures(texts, size))
    # nodes are named by numbers that are given once, so no two texts share one
    nodes = materialize(found.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("fp", "n", "sketch", "bands")), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    release(found)
    names = materialize(nodes.select("node", "h1", "h2", "copies"))
    # fingerprints: one node stands for each, its others are linked to it
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    linked = materialize(fingerprint_links(by_fp))
    head = lambda end, name: by_fp.select(F.col("fp").alias(end), F.col("head").alias(name))
    many = nodes.count()
    hashed = linked.join(head("a", "u"), "a").join(head("b", "v"), "b").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(
        join_split_hot(nodes.select("fp", "node"), by_fp, ["fp"], None, many).filter("node <> head").select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")))
    firsts, crowd = bucket_edges(nodes, many)
    edges = materialize(firsts.unionByName(hashed).distinct())
    near = materialize(_shares(edges, nodes))

    def whole(batches):
        for batch in batches:
            sets = [np.unique(np.concatenate(blocks)).tobytes() if (blocks := [*shingle_hashes(t, size)]) else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    # equal texts are one node, and a third of all rows may be one text
    total = names.agg(F.sum("copies")).first()[0] or 0

    def whole_sets(ends: DataFrame) -> DataFrame:
        wanted = ends.join(names, "node").select("h1", "h2", "node", "copies")
        some = join_split_hot(texts, wanted, ["h1", "h2"], names, total, count="copies").select("node", "text").mapInArrow(whole, "node long, set binary")
        return materialize(some.groupBy("node").agg(F.first("set").alias("set")))

    # first the likeliest candidate of each node, so that most links are stars from the start
    likely = near.filter(F.col("share") >= SLACK)
    best = materialize(likely.groupBy("u").agg(F.max_by("v", F.struct(F.least("share", F.lit(SURE)), -F.col("v"))).alias("v")))
    sets = whole_sets(best.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    groups = materialize(connected_components(materialize(_verified(best, sets, similarity)), "u", "v").withColumnRenamed("component", "root"))
    # then whatever is still apart, however few minima agree
    of = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    apart = materialize(near.join(of("u"), "u", "left").join(of("v"), "v", "left").withColumns({"ru": F.coalesce("root_u", "u"), "rv": F.coalesce("root_v", "v")}).filter("ru <> rv").select("u", "v"))
    release(sets)
    if not apart.isEmpty():
        sets = whole_sets(apart.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        groups = _joined(groups, materialize(_verified(apart, sets, similarity)))
    # members of a bucket have met no other than its first
    rooted = crowd.join(groups, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    units = materialize(bucket_units(materialize(rooted)))
    if not units.isEmpty():
        sets = whole_sets(units.select("node").distinct())
        links = join_split_hot(units, sets, ["node"], units.groupBy("node").agg(F.count("*").alias("n")), units.count()).groupBy("unit").applyInPandas(lambda rows: _unit_links(rows, similarity), "u long, v long")
        groups = _joined(groups, materialize(links))
    return groups.join(names, "node").select("h1", "h2", "root")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` without the rows whose group, by ``text_groups`` or an equal text, has a row of smaller id."""
    groups = text_groups(df, text, size, similarity)
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    h1, h2 = (F.xxhash64(F.lit(salt), F.col(text)).alias(name) for salt, name in TEXT_KEY)
    # equal texts are few rows a key from here on
    heads = materialize(df.select(F.col(doc_id).alias("id"), k1, k2, h1, h2).groupBy("h1", "h2").agg(F.min(F.struct("id", "__k1", "__k2")).alias("head"), F.count("*").alias("n")))
    rooted = materialize(heads.join(groups, ["h1", "h2"], "left"))
    kept = rooted.filter("root is null").select("head.__k1", "head.__k2").unionByName(rooted.filter("root is not null").groupBy("root").agg(F.min("head").alias("head")).select("head.__k1", "head.__k2"))
    # texts without a copy or a near one stay where they are
    several = materialize(rooted.filter("root is not null or n > 1").select("h1"))
    marked = maybe_in(packed(df, __k1=k1, __k2=k2, h1=h1), "h1", several, several.count())
    rest = marked.filter("maybe").join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return unpacked(marked.filter("not maybe"), df).unionByName(unpacked(rest, df))
