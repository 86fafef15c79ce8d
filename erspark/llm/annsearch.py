"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Lists are of vectors nearest to a centroid by cosine. Equal vectors are one entry that keeps its smallest ids, one more than neighbours asked for,
which is all that any query can return of them. Centroids and codebooks are fitted on a sample
of at most SAMPLE entries; every entry is indexed. A query visits the lists that may hold one of its nearest: what its nearest of PILOT entries
reach is a lower bound, and a list's widest angle an upper one. There the codes bound each cosine from both sides, and what they leave open
is measured exactly, in double precision, on the original vectors, so nothing is lost whatever the rows look like. A task holds lists of SPLIT
entries together, or a part of a larger one, and a block of query vectors, equal ones once.

Defined cases: null and zero vectors, and those holding null or non-finite components, take no
part; shorter vectors count as filled up with zeros; null ids take no part; other columns are not read; with
fewer candidates than neighbours all found are returned; ties go to the smaller id; an empty
table gives an empty one; rows that repeat an id count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.plans.runtime import join_split_hot, materialize, ship

#: Entries whose cosines say what a query's nearest reach at least, and what is allowed for rounding where bounds are compared.
PILOT, SLACK = 2048, 1e-5
#: Entries that centroids are fitted on, entries of a task, query vectors of a task, lists at most and entries a list
#: at least, dimensions of a code, and vectors that are compared with centroids at once.
SAMPLE, SPLIT, QUERIES, LISTS, IN_LIST, SUB, CHUNK = 20_000, 16_384, 4096, 4096, 8, 4, 1024


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By distance; of unit centroids that is by cosine."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i:i + CHUNK] @ c.T - half, axis=1) for i in range(0, len(x), CHUNK)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool = False) -> np.ndarray:
    """Centroids of the rows of ``x``, of length 1 if spherical; starts from evenly spread rows, so equal inputs give equal results."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].astype(np.float32)
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        total = np.zeros_like(c, np.float64)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        new = total / np.maximum(np.linalg.norm(total, axis=1) if spherical else n, 1e-12)[:, None]
        c = np.where(n[:, None] > 0, new, c).astype(np.float32)
    return c


def fit(sample: np.ndarray, n: int, sub: int = SUB) -> dict:
    """Coarse centroids and residual codebooks of unit vectors."""
    sample = sample.astype(np.float32)
    coarse = kmeans(sample, min(LISTS, max(1, n // IN_LIST)), 6, True)
    residual = sample - coarse[nearest_centroid(sample, coarse)]
    cuts = [slice(i, min(i + sub, sample.shape[1])) for i in range(0, sample.shape[1], sub)]
    return {"coarse": coarse, "cuts": cuts, "books": [kmeans(residual[:, c], 256, 8) for c in cuts]}


def encode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each unit vector, and the codes of its residual."""
    x = x.astype(np.float32)
    near = nearest_centroid(x, model["coarse"])
    residual = x - model["coarse"][near]
    codes = np.stack([nearest_centroid(residual[:, s], b) for s, b in zip(model["cuts"], model["books"])], axis=1)
    return near, codes.astype(np.uint8)


def unit(lists, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, or of lists, scaled to length 1."""
    flat = lists.flatten().to_numpy(zero_copy_only=False) if hasattr(lists, "flatten") else np.concatenate([np.asarray(v, np.float64) for v in lists])
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square runs over
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lists_of(model: dict, x: np.ndarray, least: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Whether each of the unit vectors visits each list: those that may hold an entry whose cosine is ``least`` or more.

    ``wide`` is the largest angle between a list's centroid and its entries, negative where a list has none; an entry's angle to
    the query is at least the centroid's less that.
    """
    away = np.arccos(np.clip(x @ model["coarse"].T.astype(np.float64), -1.0, 1.0))
    return (np.cos(np.maximum(0.0, away - wide)) >= least[:, None] - SLACK) & (wide >= 0)


def scores_in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows of two matrices, summed from the first component to the last as the definition reads; scaled by powers of two, which rounds nothing."""
    q, v = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) for m in (q, v))
    qv, qq, vv = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for j in range(q.shape[1]):
        a, b = q[:, j], v[:, j]
        qv, qq, vv = qv + a * b, qq + a * a, vv + b * b
    return qv / (np.sqrt(qq) * np.sqrt(vv))


def best_in_part(model: dict, x: np.ndarray, least: np.ndarray, visited: np.ndarray, entries: dict, k: int) -> list[np.ndarray]:
    """For each unit vector, entries of this part among which all are that can be one of its ``k`` nearest here, ties included.

    A code says how its vector lies about its centroid, up to ``err``, the length of what it leaves out, so it bounds the cosine from both sides;
    what the bounds leave open is measured on the vectors.
    """
    near = x.astype(np.float32) @ entries["decoded"].T
    if near.shape[1] > k:
        low = near - entries["err"]
        least = np.maximum(least, -np.partition(-low, k - 1, axis=1)[:, k - 1] - SLACK)
    open_ = (near + entries["err"] >= least[:, None] - SLACK) & visited
    any_ = np.flatnonzero(open_.any(axis=0))
    if not len(any_):
        return [any_] * len(x)
    exact = np.where(open_[:, any_], x @ entries["unit"][any_].T, -np.inf)
    if len(any_) > k:
        edge = -np.partition(-exact, k - 1, axis=1)[:, k - 1:k]
        keep = (exact >= edge - 1e-9) & np.isfinite(exact)
    else:
        keep = np.isfinite(exact)
    return [any_[row] for row in keep]


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(e, lambda x: x != 0)
    good = df.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & some)
    return good


def of_one_length(good: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, v, k1, k2)`` with zeros up to the longest vector's length, and that length."""
    dim = good.agg(F.max(F.size("v"))).first()[0] or 0
    v = F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v"))
    return good.select("vec_id", v.alias("v")).select("vec_id", "v", F.xxhash64(F.lit(3), "v").alias("k1"), F.xxhash64(F.lit(5), "v").alias("k2")), dim


def nearest(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest by cosine of each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    rows, dim = of_one_length(valid_vectors(df, vec_id, embedding))
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    entries = materialize(few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    share = min(1.0, SAMPLE / n)
    sample = entries.filter(F.pmod("k2", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("k1", "k2").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    model = spark.sparkContext.broadcast(fit(unit(sample, dim), n))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(2), dim)
            near, codes = encode(model.value, x)
            at = (x * model.value["coarse"][near]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                                              pa.array(np.arccos(np.clip(at, -1.0, 1.0))), batch.column(2), batch.column(3)], ["k1", "k2", "list", "codes", "angle", "v", "ids"])

    coded = materialize(entries.select("k1", "k2", "v", "ids").mapInArrow(index, "k1 long, k2 long, list int, codes binary, angle double, v array<double>, ids array<long>"))
    found = {r["list"]: r for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}  # LISTS rows at most
    wide = np.full(len(model.value["coarse"]), -1.0)
    first, several, part, room = np.zeros(LISTS, int), np.ones(LISTS, int), 0, SPLIT
    # small lists share a part, those next to each other by cosine to the first centroid; large ones have several
    toward = model.value["coarse"] @ model.value["coarse"][0]
    for c in sorted(found, key=lambda c: (-float(toward[c]), c)):
        n_here, wide[c] = found[c]["n"], found[c]["angle"] + 1e-6
        if n_here > room and room < SPLIT:
            part, room = part + 1, SPLIT
        first[c], several[c] = part, -(-n_here // SPLIT)
        if several[c] > 1:
            part, room = part + int(several[c]), SPLIT
        else:
            room -= n_here
    of_list = spark.createDataFrame([(c, int(first[c]), int(several[c])) for c in sorted(found)], "list int, first int, several int")  # LISTS rows at most
    queries = materialize(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "k1", "k2"]))
    vectors = materialize(queries.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("n")))
    blocks = max(1, -(-vectors.count() // QUERIES))
    index_rows = coded.join(F.broadcast(of_list), "list").withColumn("part", (F.col("first") + F.pmod("k1", F.col("several"))).cast("int")).drop("first", "several", "angle").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # what a query's k + 1 nearest reach among some entries they reach among all: its own entry may be one of them
    some_entries = spark.sparkContext.broadcast(unit(sample.slice(0, PILOT), dim))
    parts_of = [sorted({int(p) for p in range(first[c], first[c] + several[c])}) if c in found else [] for c in range(len(wide))]
    holds = np.zeros((len(wide), 1 + max(p for ps in parts_of for p in ps)), bool)
    for c, ps in enumerate(parts_of):
        holds[c, ps] = True

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                x, pilot = unit(some.column(2), dim), some_entries.value
                least = -np.partition(-(x @ pilot.T), k, axis=1)[:, k] - SLACK if len(pilot) > k else np.full(len(x), -2.0)
                i, p = np.nonzero((lists_of(model.value, x, least, wide).astype(np.float32) @ holds.astype(np.float32)) > 0)
                take = pa.array(i.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(some.column(j).take(take) for j in range(3)), pa.array(least[i]), pa.array(p.astype(np.int32))], ["q1", "q2", "q", "least", "part"])

    probing = vectors.select("k1", "k2", "v").mapInArrow(visit, "q1 long, q2 long, q array<double>, least double, part int").withColumn(
        "block", F.pmod(F.xxhash64("q1", "q2"), F.lit(blocks)).cast("int"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            m = model.value
            there, v = left["list"].to_numpy(), np.array(left["v"].tolist())
            codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
            here = {"unit": unit(v.tolist(), dim), "decoded": m["coarse"][there] + np.concatenate([b[codes[:, j]] for j, b in enumerate(m["books"])], axis=1)}
            here["err"] = (np.linalg.norm(here["unit"] - here["decoded"], axis=1) + 1e-5).astype(np.float32)
            ids, lead = left["ids"].tolist(), np.array([i[0] for i in left["ids"]])
            q1, q2, least = (right[c].to_numpy() for c in ("q1", "q2", "least"))
            for start in range(0, len(right), 128):
                q = np.array(right["q"].iloc[start:start + 128].tolist())
                x, low = unit(q.tolist(), dim), least[start:start + 128]
                visited = lists_of(m, x, low, wide)[:, there]
                for i, at in enumerate(best_in_part(m, x, low, visited, here, k + 1)):
                    if not len(at):
                        continue
                    score = scores_in_order(np.repeat(q[i:i + 1], len(at), axis=0), v[at])
                    top = np.lexsort((lead[at], -score))[:k + 1]
                    out += [(q1[start + i], q2[start + i], s, ids[j]) for s, j in zip(score[top], at[top])]
        return pd.DataFrame(out, columns=["q1", "q2", "score", "ids"]).astype({"q1": "int64", "q2": "int64", "score": "float64"})

    exact = index_rows.groupBy("part", "block").cogroup(probing.groupBy("part", "block")).applyInPandas(scan, "q1 long, q2 long, score double, ids array<long>")
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    # one more than asked for: a query's own entry is among them
    found = exact.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("q1", "q2").agg(
        F.collect_list(F.struct("score", "ids")).alias("found"))
    named = materialize(found.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "found").join(vectors.select("k1", "k2", "n"), ["k1", "k2"]))
    total = vectors.agg(F.sum("n")).first()[0] or 0
    each = join_split_hot(queries.select(F.col("vec_id").alias("query_id"), "k1", "k2"), named, ["k1", "k2"], None, total)
    flat = F.flatten(F.transform("found", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("far"), i.alias("vec_id")))))
    kept = F.slice(F.sort_array(F.filter(flat, lambda e: e["vec_id"] != F.col("query_id"))), 1, k)
    return each.select("query_id", F.posexplode(kept).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.far")).alias("score"))


def op5(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
