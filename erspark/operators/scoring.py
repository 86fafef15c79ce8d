"""Scores of candidate pairs: weighted, Fellegi-Sunter, reranked, judged and corrected."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.functions.similarity import DEAR, score
from erspark.functions.transforms import apply_transforms
from erspark.plans.runtime import materialize, release

ID = "__row_id__"


def with_records(pairs: DataFrame, df: DataFrame, columns: list[str], id_col: str = ID, right: DataFrame | None = None) -> DataFrame:
    """Pairs with the columns of both rows as a_name and b_name."""
    side = lambda d, s: d.select(F.col(id_col).alias(f"id_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys(columns)))
    return pairs.join(side(df, "a"), "id_a").join(side(right if right is not None else df, "b"), "id_b")


def field_score(f: dict) -> Column:
    a, b = (apply_transforms(F.col(f"{s}_{f['field']}"), f.get("transforms", [])) if f["scorer"] not in ("embedding", "record_embedding") else F.col(f"{s}_{f['field']}") for s in "ab")
    return score(a, b, f["scorer"])


def weighted_scores(pairs: DataFrame, df: DataFrame, fields: list[dict], threshold: float, id_col: str = ID, right: DataFrame | None = None) -> DataFrame:
    """``(id_a, id_b, score)`` at or above the threshold: the weighted mean over fields filled on both sides."""
    return score_rows(with_records(pairs.select("id_a", "id_b"), df, [f["field"] for f in fields], id_col, right), fields, threshold)


def score_rows(rows: DataFrame, fields: list[dict], threshold: float, keep: tuple = ("id_a", "id_b"), parts: bool = False) -> DataFrame:
    """``weighted_scores`` of rows that have both records' fields beside each other.

    Cheap fields come first; a pair whose dear fields could not lift it over the threshold even
    at 1.0 is gone before Python sees it, which is safe as a perfect field never lowers the mean. Columns ``keep`` stay,
    and with ``parts`` the scores of the fields as s0, s1, ...
    """
    names = [f"s{i}" for i in range(len(fields))] if parts else []
    fields = sorted(enumerate(fields), key=lambda x: (x[1]["scorer"] in DEAR, x[0]))
    cheap = [(i, f) for i, f in fields if f["scorer"] not in DEAR]
    dear = [(i, f) for i, f in fields if f["scorer"] in DEAR]
    weight = lambda i, f: F.when(F.col(f"s{i}").isNotNull(), F.lit(float(f.get("weight", 1.0)))).otherwise(0.0)
    total = lambda fs: (sum((F.coalesce(f"s{i}", F.lit(0.0)) * float(f.get("weight", 1.0)) for i, f in fs), F.lit(0.0)), sum((weight(i, f) for i, f in fs), F.lit(0.0)))
    rows = rows.withColumns({f"s{i}": field_score(f) for i, f in cheap}) if cheap else rows
    if cheap and dear:
        num, den = total(cheap)
        most = sum(float(f.get("weight", 1.0)) for _, f in dear)
        rows = rows.filter((num + most) / (den + most) >= threshold - 1e-9)
    rows = rows.withColumns({f"s{i}": field_score(f) for i, f in dear}) if dear else rows
    num, den = total([x for x in fields])
    return rows.select(*keep, F.when(den > 0, num / den).otherwise(0.0).alias("score"), *names).filter(F.col("score") >= threshold)


def best_per_pair(*scored: DataFrame) -> DataFrame:
    """The largest score of each pair."""
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("score").alias("score"))


def exclude_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


def across_sources(pairs: DataFrame, df: DataFrame, source: str = "__source__", id_col: str = ID) -> DataFrame:
    return with_records(pairs, df, [source], id_col).filter(F.col(f"a_{source}") != F.col(f"b_{source}")).drop(f"a_{source}", f"b_{source}")


def gate(scored: DataFrame, merge: float = 0.95, review: float = 0.75) -> DataFrame:
    """Pairs with ``decision``: merge above 0.95, review from 0.75, else reject."""
    return scored.withColumn("decision", F.when(F.col("score") > merge, "merge").when(F.col("score") >= review, "review").otherwise("reject"))


# -- Fellegi-Sunter


def levels(f: dict) -> Column:
    """The agreement level of a field, 0 for nulls."""
    s, n, part = F.coalesce(field_score(f), F.lit(-1.0)), f.get("levels", 2), f.get("partial_threshold", 0.8)
    if n == 2:
        return F.when(s >= part, 1).otherwise(0)
    if n == 3:
        return F.when(s >= 0.95, 2).when(s >= part, 1).otherwise(0)
    out = F.lit(0)
    for k in range(1, n):
        out = F.when(s >= k / n, k).otherwise(out)
    return out


def vector_rows(rows: DataFrame, fields: list[dict], keep: tuple = ("id_a", "id_b")) -> DataFrame:
    """Levels of rows that have both records' fields beside each other."""
    return rows.select(*keep, *(levels(f).alias(f"l{i}") for i, f in enumerate(fields)))


def comparison_vectors(pairs: DataFrame, df: DataFrame, fields: list[dict], id_col: str = ID, right: DataFrame | None = None) -> DataFrame:
    rows = with_records(pairs.select("id_a", "id_b"), df, [f["field"] for f in fields], id_col, right)
    return rows.select("id_a", "id_b", *(levels(f).alias(f"l{i}") for i, f in enumerate(fields)))


def sample_pairs(df: DataFrame, n: int = 5000, id_col: str = ID, seed: int = 42) -> DataFrame:
    """Pairs of rows chosen by hash: as many rows as give ``n`` pairs, matched in a fixed shuffle."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h", "id").limit(int(math.sqrt(2 * n)) + 2)
    a, b = rows.select(F.col("id").alias("id_a")), F.broadcast(rows.select(F.col("id").alias("id_b")))  # at most sqrt(2 n) rows
    return a.join(b, F.col("id_a") < F.col("id_b")).orderBy(F.xxhash64(F.lit(seed), "id_a", "id_b"), "id_a", "id_b").limit(n)


def sample_cross(a: DataFrame, b: DataFrame, n: int = 5000, id_col: str = ID, seed: int = 42) -> DataFrame:
    """Pairs of rows of two tables chosen by hash: at most sqrt(n) + 1 of each, so at most n or so pairs."""
    few = lambda d, i: d.select(F.col(id_col).alias(i)).orderBy(F.xxhash64(F.lit(seed), i), i).limit(int(math.sqrt(n)) + 1)
    return few(a, "id_a").join(F.broadcast(few(b, "id_b")))


def sample_blocked(keys: DataFrame, n: int = 10_000, per_block: int = 100) -> DataFrame:
    """Pairs within blocks, of ``per_block`` rows by hash a block at most."""
    from erspark.operators.blocking import pairs_of_keys

    few = keys.withColumn("r", F.row_number().over(Window.partitionBy("pass", "key").orderBy(F.xxhash64(F.lit(42), "id"), "id"))).filter(F.col("r") <= per_block).drop("r")
    return pairs_of_keys(few).orderBy(F.xxhash64(F.lit(42), "id_a", "id_b"), "id_a", "id_b").limit(n)


def train_em(matched: DataFrame, random: DataFrame, fields: list[dict], blocking: tuple = (), rounds: int = 20, tolerance: float = 1e-3, prior: float = 0.02) -> dict:
    """m and u of each field's levels, and the weights log2(m / u).

    EM needs no more than the counts of each pattern of levels, a table bounded by the product of the
    levels: Spark groups the pairs, the driver iterates over patterns. u comes from random pairs
    and stays; fields that blocks are made of tell nothing, so their weights are pinned.
    """
    names = [f"l{i}" for i in range(len(fields))]
    # a row stands for as many pairs as its column ``pairs`` says
    times = lambda d: F.sum("pairs") if "pairs" in d.columns else F.count("*")
    count = lambda d: [(tuple(r[x] for x in names), r["c"]) for r in d.groupBy(*names).agg(times(d).alias("c")).collect()]
    pats, rand = count(matched), count(random)
    n_levels = [f.get("levels", 2) for f in fields]
    total = sum(c for _, c in pats)
    u = [np.full(k, 1e-6) for k in n_levels]
    for p, c in rand:
        for i, l in enumerate(p):
            u[i][l] += c
    u = [x / x.sum() for x in u]
    pinned = [f["field"] in blocking for f in fields]
    for i, p in enumerate(pinned):
        if p:
            u[i] = np.full(n_levels[i], 1 / n_levels[i])
    if total < 10:
        m = [np.r_[np.full(k - 1, 0.1 / max(1, k - 1)), 0.9] if k > 1 else np.ones(1) for k in n_levels]
        history = []
    else:
        m = [np.arange(1, k + 1) ** 2 / (np.arange(1, k + 1) ** 2).sum() for k in n_levels]
        x, c, p, history = np.array([p for p, _ in pats]), np.array([c for _, c in pats], float), prior, []
        for _ in range(rounds):
            lm = sum(np.log(np.maximum(m[i][x[:, i]], 1e-12)) for i in range(len(fields)) if not pinned[i]) + np.log(p)
            lu = sum(np.log(np.maximum(u[i][x[:, i]], 1e-12)) for i in range(len(fields)) if not pinned[i]) + np.log(1 - p)
            r = 1 / (1 + np.exp(np.clip(lu - lm, -500, 500)))
            new = [np.bincount(x[:, i], r * c, n_levels[i]) + 1e-6 for i in range(len(fields))]
            new = [v / v.sum() for v in new]
            p = float(np.clip((r * c).sum() / total, 1e-4, 0.999))
            moved = max(float(abs(a - b).max()) for a, b in zip(m, new))
            m = new
            history.append(moved)
            if moved < tolerance:
                break
    weights = [np.log2(np.maximum(a, 1e-10) / np.maximum(b, 1e-10)) if not pin else np.linspace(-3, 3, k) if k > 1 else np.full(1, 3.0) for a, b, pin, k in zip(m, u, pinned, n_levels)]
    return {"m": [v.tolist() for v in m], "u": [v.tolist() for v in u], "weights": [v.tolist() for v in weights], "moved": history}


def probabilistic_scores(vectors: DataFrame, model: dict, threshold: float = 0.5, keep: tuple = ("id_a", "id_b")) -> DataFrame:
    """Summed weights scaled between the least and the largest sum, at or above the threshold."""
    raw = sum((F.array(*(F.lit(float(x)) for x in w))[F.col(f"l{i}")] for i, w in enumerate(model["weights"])), F.lit(0.0))
    low, high = sum(min(w) for w in model["weights"]), sum(max(w) for w in model["weights"])
    s = F.round((raw - low) / (high - low), 4) if high > low else F.lit(0.5)
    return vectors.select(*keep, s.alias("score")).filter(F.col("score") >= threshold)


def score_one(a: dict, b: dict, fields: list[dict], model: dict, spark=None) -> float:
    """The scaled Fellegi-Sunter score of two records, each a dict of its fields."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    text = lambda v: None if v is None else str(v)
    names = list(dict.fromkeys(f["field"] for f in fields))
    row = spark.createDataFrame([(*(text(a.get(n)) for n in names), *(text(b.get(n)) for n in names))], ", ".join(f"`{s}_{n}` string" for s in "ab" for n in names))
    vector = row.select(F.lit(0).alias("id_a"), F.lit(1).alias("id_b"), *(levels(f).alias(f"l{i}") for i, f in enumerate(fields)))
    return probabilistic_scores(vector, model, -1.0).first().score


def train_continuous(scores: DataFrame, n_fields: int, rounds: int = 20, prior: float = 0.02) -> dict:
    """Two normal distributions a field, fitted on all rows ``s0, s1, ...``: equal ones, to three places, are counted
    once, and each round of EM is one aggregation over those counts."""
    names = [f"s{i}" for i in range(n_fields)]
    grouped = materialize(scores.select(*(F.round(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in names)).groupBy(*names).agg(F.count("*").alias("n")))
    mu, sd, p = [[0.9] * n_fields, [0.2] * n_fields], [[0.2] * n_fields, [0.2] * n_fields], prior
    n = grouped.agg(F.sum("n")).first()[0] or 0
    for _ in range(rounds if n else 0):
        r = _odds(mu, sd, p, names)
        w = [F.col("n") * r, F.col("n") * (1 - r)]
        sums = grouped.select(*names, w[0].alias("w0"), w[1].alias("w1")).agg(
            *(F.sum(f"w{k}").alias(f"t{k}") for k in (0, 1)), *(F.sum(F.col(f"w{k}") * F.col(c)).alias(f"a{k}_{c}") for k in (0, 1) for c in names),
            *(F.sum(F.col(f"w{k}") * F.col(c) * F.col(c)).alias(f"b{k}_{c}") for k in (0, 1) for c in names)).first()
        for k in (0, 1):
            t = max(sums[f"t{k}"], 1e-9)
            mu[k] = [sums[f"a{k}_{c}"] / t for c in names]
            sd[k] = [max(math.sqrt(max(sums[f"b{k}_{c}"] / t - m * m, 0.0)), 0.01) for c, m in zip(names, mu[k])]
        p = min(0.999, max(1e-4, sums["t0"] / n))
    release(grouped)
    return {"mu": mu, "sd": sd, "prior": p}


def _odds(mu: list, sd: list, prior: float, names: list[str]) -> Column:
    """The chance of a match of a row of scores."""
    log = F.lit(math.log(prior / (1 - prior)))
    for i, c in enumerate(names):
        for k, sign in ((0, 1), (1, -1)):
            z = (F.col(c) - mu[k][i]) / sd[k][i]
            log = log + sign * (-0.5 * z * z - math.log(sd[k][i]))
    return 1 / (1 + F.exp(-F.greatest(F.least(log, F.lit(500.0)), F.lit(-500.0))))


def continuous_scores(scores: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    names = [f"s{i}" for i in range(len(model["mu"][0]))]
    filled = scores.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    return filled.withColumn("score", _odds(model["mu"], model["sd"], model["prior"], names)).filter(F.col("score") >= threshold)


def link_thresholds(scored: DataFrame) -> tuple[float, float]:
    """(link, review) of the scores' percentiles where there are over 50 of them, else fixed ones."""
    r = scored.agg(F.count("*").alias("n"), F.percentile_approx("score", [0.9, 0.75]).alias("p")).first()
    return (float(r.p[0]), float(r.p[1])) if r.n > 50 else (0.50, 0.35)


# -- second opinions


def rerank(scored: DataFrame, df: DataFrame, columns: list[str], model: Callable[[Column, Column], Column], threshold: float, band: float = 0.1, id_col: str = ID, right: DataFrame | None = None) -> DataFrame:
    """Pairs within ``band`` of the threshold scored again by ``model`` on their record texts."""
    from erspark.functions.similarity import record_text

    edge = F.abs(F.col("score") - threshold) <= band
    near = with_records(scored.filter(edge), df, columns, id_col, right)
    again = near.select("id_a", "id_b", model(record_text(columns, prefix="a_"), record_text(columns, prefix="b_")).alias("score"))
    # names of the columns carry the side's prefix, the text doesn't
    return scored.filter(~edge).select("id_a", "id_b", "score").unionByName(again).filter(F.col("score") >= threshold)


def judge(scored: DataFrame, df: DataFrame, columns: list[str], decide: Callable[[Column, Column], Column], low: float = 0.75, high: float = 0.95, id_col: str = ID) -> DataFrame:
    """At ``high`` or more accepted, between asked (a yes gives 1.0, a no changes nothing), below untouched."""
    from erspark.functions.similarity import record_text

    ask = (F.col("score") >= low) & (F.col("score") < high)
    asked = with_records(scored.filter(ask), df, columns, id_col)
    out = asked.select("id_a", "id_b", F.when(decide(record_text(columns, prefix="a_"), record_text(columns, prefix="b_")), 1.0).otherwise(F.col("score")).alias("score"))
    rest = scored.filter(~ask).select("id_a", "id_b", F.when(F.col("score") >= high, 1.0).otherwise(F.col("score")).alias("score"))
    return rest.unionByName(out)


def merge_scores(bi: DataFrame, cross: DataFrame) -> DataFrame:
    return bi.join(cross.select("id_a", "id_b", F.col("score").alias("c")), ["id_a", "id_b"], "left").select("id_a", "id_b", F.coalesce("c", "score").alias("score"))


def record_hash(columns: list[str], prefix: str = "") -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(prefix + c).cast("string"), F.lit("")) for c in columns)), 256), 1, 16)


def apply_corrections(scored: DataFrame, df: DataFrame, corrections: DataFrame, columns: list[str], id_col: str = ID) -> DataFrame:
    """Scores with ``correction``: approved pairs 1.0, rejected 0.0, where both rows still have the hashes that
    were corrected (or none was kept); else the correction is stale and changes nothing."""
    hashed = df.select(F.col(id_col).alias("id"), record_hash(columns).alias("h"))
    c = corrections.select("id_a", "id_b", "decision", "hash_a", "hash_b")
    both = scored.join(c, ["id_a", "id_b"], "left")
    if "h_a" not in scored.columns or "h_b" not in scored.columns:  # pairs may come with the hashes of both rows
        both = both.join(hashed.select(F.col("id").alias("id_a"), F.col("h").alias("h_a")), "id_a", "left").join(hashed.select(F.col("id").alias("id_b"), F.col("h").alias("h_b")), "id_b", "left")
    none = (F.coalesce("hash_a", F.lit("")) == "") & (F.coalesce("hash_b", F.lit("")) == "")
    fresh = none | ((F.col("hash_a") == F.col("h_a")) & (F.col("hash_b") == F.col("h_b")))
    return both.select("id_a", "id_b", F.when(fresh & (F.col("decision") == "approve"), 1.0).when(fresh & (F.col("decision") == "reject"), 0.0).otherwise(F.col("score")).alias("score"),
                       F.when(F.col("decision").isNull(), "none").when(fresh, F.col("decision")).otherwise("stale").alias("correction"))


def latest_corrections(log: DataFrame) -> DataFrame:
    """One correction a pair: the most trusted, then the newest."""
    w = Window.partitionBy("id_a", "id_b").orderBy(F.desc("trust"), F.desc("at"))
    return log.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def upsert_corrections(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new corrections: of a pair, ends in order, one stays, the most trusted and then the newest."""
    ordered = lambda d: d.withColumns({"id_a": F.least("id_a", "id_b"), "id_b": F.greatest("id_a", "id_b"),
                                       "hash_a": F.when(F.col("id_a") <= F.col("id_b"), F.col("hash_a")).otherwise(F.col("hash_b")),
                                       "hash_b": F.when(F.col("id_a") <= F.col("id_b"), F.col("hash_b")).otherwise(F.col("hash_a"))})
    return latest_corrections(ordered(log).unionByName(ordered(new)))


#: Scores between which typical thresholds lie, and bounds of the score strata.
RANGE, STRATA = (0.6, 0.9), (0.3, 0.5, 0.7, 0.85)
#: Shares of the strategies that make up the combined one; the rest is diversity.
SHARES = {"uncertainty": 0.4, "boundary": 0.2, "disagreement": 0.2}


def active_sample(scored: DataFrame, n: int, strategy: str = "uncertainty", threshold: float = 0.5, features: list[str] | None = None) -> DataFrame:
    """Pairs worth labelling, with the columns of ``scored``.

    uncertainty: nearest to the threshold; boundary: by hash among the scores that thresholds usually lie between, then nearest to their middle;
    disagreement: of largest spread of ``features``, columns of scores (nulls count 0); diversity: alike from five strata of the score, by hash, then any by hash;
    combined: 40 %, 20 %, 20 % and the rest, each among what those before left; without features disagreement's share goes to diversity.

    Every strategy takes its first few by an order, so pairs are never sorted or dealt out: a pass finds the first ``n`` of each
    order, which hold all that the strategies can take.
    """
    h, last = F.xxhash64(F.lit(42), "id_a", "id_b"), ["id_a", "id_b"]
    stratum = reduce(lambda x, i: F.when(F.col("score") < STRATA[i], i).otherwise(x), reversed(range(len(STRATA))), F.lit(len(STRATA)))
    mid = F.abs(F.col("score") - sum(RANGE) / 2)
    spread = F.lit(0.0)
    if features:
        v = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
        mean = sum(v[1:], v[0]) / len(v)
        spread = sum(((x - mean) * (x - mean) for x in v[1:]), (v[0] - mean) * (v[0] - mean))
    inside = F.col("score").between(*RANGE)
    orders = {"uncertainty": [F.abs(F.col("score") - threshold)], "boundary": [F.when(inside, 0).otherwise(1), F.when(inside, h.cast("double")).otherwise(mid)], "disagreement": [-spread], "any": [h]}

    def first(name: str, rows: DataFrame, most: int) -> DataFrame:
        return rows.orderBy(*orders[name], *last).limit(most)

    def diverse(rows: DataFrame, most: int) -> DataFrame:
        each = reduce(DataFrame.unionByName, [rows.filter(stratum == i).orderBy(h, *last).limit(most // 5) for i in range(len(STRATA) + 1)])
        few = materialize(each)
        return few.unionByName(first("any", exclude_pairs(rows, few), most - few.count()))

    if strategy == "disagreement" and len(features or []) < 2:
        return scored.limit(0)
    if strategy in ("uncertainty", "boundary", "disagreement"):
        return first(strategy, scored, n)
    if strategy in ("diversity", "stratified"):
        return diverse(scored, n)
    if strategy != "combined":
        raise ValueError(f"no such strategy: {strategy}")
    names = [s for s in SHARES if s != "disagreement" or len(features or []) > 1]
    pool = reduce(DataFrame.unionByName, [first(s, scored, n) for s in [*names, "any"]] + [scored.filter(stratum == i).orderBy(h, *last).limit(n) for i in range(len(STRATA) + 1)])
    pool = left = materialize(pool.dropDuplicates(last))  # 10 n rows at most
    taken = []
    for s in names:
        taken.append(materialize(first(s, left, int(n * SHARES[s]))))
        left = materialize(exclude_pairs(left, taken[-1]))
    taken.append(diverse(left, n - sum(t.count() for t in taken)))
    return reduce(DataFrame.unionByName, taken)


def boost(pairs: DataFrame, df: DataFrame, columns: list[str], labelled: DataFrame, id_col: str = ID) -> DataFrame:
    """Scores of a logistic regression on pair features, fitted on labelled pairs ``(id_a, id_b, label)``, classes balanced."""
    rows = with_records(pairs.select("id_a", "id_b"), df, columns, id_col)
    train = rows.join(labelled.select("id_a", "id_b", F.col("label").cast("double").alias("label")), ["id_a", "id_b"])
    return boost_rows(rows, train.withColumn("n", F.lit(1)), columns, ("id_a", "id_b"))


def boost_rows(rows: DataFrame, train: DataFrame, columns: list[str], keep: tuple) -> DataFrame:
    """``boost`` of rows that have both records' fields beside each other: columns ``keep`` and ``score``. A row of ``train``, with ``label``, stands for ``n`` pairs;
    those of equal features are one row of the fit, which weighs as many."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from erspark.functions.similarity import boost_features

    features = boost_features(columns)
    fields = [f"{s}_{c}" for s in "ab" for c in dict.fromkeys(columns)]
    few = materialize(train.groupBy(*fields, "label").agg(F.sum("n").alias("n")))
    seen = few.select("label", "n", *features)
    names = [c for c in seen.columns if c not in ("label", "n")]
    seen = materialize(seen.groupBy("label", *names).agg(F.sum("n").alias("n")))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    weight = F.when(F.col("label") == 1.0, sum(n.values()) / (2 * max(1, n.get(1.0, 0)))).otherwise(sum(n.values()) / (2 * max(1, n.get(0.0, 0))))
    model = LogisticRegression(weightCol="w").fit(assemble.transform(seen).withColumn("w", weight * F.col("n")))
    return model.transform(assemble.transform(rows.select(*keep, *features))).select(*keep, vector_to_array("probability")[1].alias("score"))
