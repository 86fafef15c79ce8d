"""Evaluation against known pairs, comparison of clusterings, thresholds from score histograms, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.operators.blocking import class_rows, pairs_of_keys, pairs_within
from erspark.operators.clusters import CID, ID, membership_of
from erspark.plans.runtime import materialize


def load_truth(df: DataFrame) -> DataFrame:
    """Pairs of a truth table whose ends are called id_a and id_b, or something like it."""
    names = {c.lower(): c for c in df.columns}
    for a, b in (("id_a", "id_b"), ("ida", "idb"), ("left_id", "right_id"), ("id1", "id2"), ("source_id", "target_id")):
        if a in names and b in names:
            return df.select(F.col(names[a]).alias("id_a"), F.col(names[b]).alias("id_b"))
    raise ValueError(f"no pair of id columns in {df.columns}")


def canonical(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a < id_b").distinct()


def cluster_pairs(membership: DataFrame) -> DataFrame:
    return pairs_of_keys(membership.select(F.lit(0).alias("pass"), F.col(CID).cast("string").alias("key"), F.col(ID).alias("id")))


def evaluate_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    p, t = canonical(predicted).withColumn("p", F.lit(1)), canonical(truth).withColumn("t", F.lit(1))
    return _measures(p.join(t, ["id_a", "id_b"], "full").agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("p = 1 and t is null")).alias("fp"), F.count_if(F.expr("p is null and t = 1")).alias("fn")))


def evaluate_keys(df: DataFrame, predicted: list[dict], truth: list[dict], id_col: str = ID) -> DataFrame:
    """``evaluate_pairs`` where both are the pairs that share one of some keys: pairs are counted by classes of equal rows and never made."""
    counts = lambda keys, unlike=None: class_rows(df, keys, [], id_col, unlike).agg(F.coalesce(F.sum(pairs_within()), F.lit(0).cast("long"))).first()[0]
    n_p, n_t, fp = counts(predicted), counts(truth), counts(predicted, truth)
    return _measures(df.sparkSession.createDataFrame([(n_p - fp, fp, n_t - n_p + fp)], "tp long, fp long, fn long"))


def _measures(both: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def gates(measured: DataFrame, min_f1: float | None = None, min_precision: float | None = None, min_recall: float | None = None) -> list[str]:
    """What of an evaluation falls short, one text a measure; empty if all is well."""
    r = measured.first()
    return [f"{n} {r[n]:.4f} is below {least}" for n, least in (("f1", min_f1), ("precision", min_precision), ("recall", min_recall)) if least is not None and r[n] < least]


def compare_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases of the clusters of ``a`` in ``b``, and the index sqrt(|a| |b|) / |overlaps|.

    unchanged: the same members; merged: all in one larger cluster of b; partitioned: parted
    into whole clusters of b; overlapping: else.
    """
    x = a.select(F.col(CID).alias("ca"), ID).join(b.select(F.col(CID).alias("cb"), ID), ID)
    table = materialize(x.groupBy("ca", "cb").count())
    sa, sb = table.groupBy("ca").agg(F.sum("count").alias("na"), F.count("*").alias("parts")), table.groupBy("cb").agg(F.sum("count").alias("nb"))
    full = table.join(sa, "ca").join(sb, "cb")
    kind = full.groupBy("ca").agg(F.first("parts").alias("parts"), F.min((F.col("count") == F.col("nb")).cast("int")).alias("whole"), F.first("na").alias("na"), F.max("nb").alias("nb"))
    case = F.when((F.col("parts") == 1) & (F.col("na") == F.col("nb")), "unchanged").when(F.col("parts") == 1, "merged").when(F.col("whole") == 1, "partitioned").otherwise("overlapping")
    cases = kind.agg(F.count("*").alias("n_a"), *(F.count_if(case == c).alias(c) for c in ("unchanged", "merged", "partitioned", "overlapping")))
    return cases.join(sb.agg(F.count("*").alias("n_b"))).join(table.agg(F.count("*").alias("overlaps"))).withColumn("twi", F.round(F.sqrt(F.col("n_a") * F.col("n_b")) / F.col("overlaps"), 6))


def sensitivity(scored: DataFrame, ids: DataFrame, thresholds: list[float], baseline: float) -> DataFrame:
    """Comparisons with the baseline's clusters over thresholds; candidates are scored once. Links that have the components of all
    pairs at every threshold, as ``star_links`` gives them, do."""
    scored = materialize(scored)
    base, out = materialize(membership_of(scored.filter(F.col("score") >= baseline), ids)), None
    for t in thresholds:
        row = compare_clusters(base, materialize(membership_of(scored.filter(F.col("score") >= t), ids))).withColumn("threshold", F.lit(float(t)))
        out = row if out is None else out.unionByName(row)
    return out


def score_histogram(scored: DataFrame, bins: int = 100) -> np.ndarray:
    """Counts of scores in equal bins; ``bins`` rows reach the driver."""
    out = np.zeros(bins, np.int64)
    for b, n in scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("b")).count().collect():
        if b is not None and 0 <= b < bins:
            out[b] = n
    return out


def otsu_threshold(scored: DataFrame, bins: int = 100, least: float = 0.70) -> float | None:
    """The middle of the plateau of largest between-class variance; None where it explains too little."""
    h = score_histogram(scored, bins).astype(float)
    n = h.sum()
    if n == 0:
        return None
    x = (np.arange(bins) + 0.5) / bins
    w0, m0 = np.cumsum(h), np.cumsum(h * x)
    w1, total = n - w0, (h * x).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (m0 / w0 - (total - m0) / w1) ** 2, 0) / n ** 2
    variance = (h * (x - total / n) ** 2).sum() / n
    top = between.max()
    if variance <= 0 or top / variance < least:
        return None
    plateau = np.flatnonzero(between >= top * (1 - 1e-9))
    return float((np.median(plateau) + 1) / bins)


def valley(scored: DataFrame, bins: int = 100) -> float | None:
    """The score at the bottom between two peaks of the smoothed histogram; None unless it is half as deep as the lower."""
    h = np.convolve(score_histogram(scored, bins), np.ones(5) / 5, "same")
    peaks = [i for i in range(bins) if h[i] > 0 and h[i] == h[max(0, i - 5):i + 6].max()]
    best = None
    for i, a in enumerate(peaks):
        for b in peaks[i + 1:]:
            if b - a > 10:
                k = a + int(np.argmin(h[a:b + 1]))
                depth = h[k] / min(h[a], h[b])
                if depth < 0.5 and (best is None or depth < best[0]):
                    best = (depth, k)
    return (best[1] + 0.5) / bins if best else None


def threshold_overlap(scored: DataFrame, threshold: float, band: float = 0.02) -> DataFrame:
    """The share of pairs within ``band`` of the threshold; a column ``pairs`` tells how many pairs a row stands for."""
    times = F.col("pairs") if "pairs" in scored.columns else F.lit(1)
    inside = F.sum(F.when(F.col("score").between(threshold - band, threshold + band), times).otherwise(0))
    return scored.agg(F.round(F.coalesce(inside / F.sum(times), F.lit(0.0)), 6).alias("overlap"))


def size_percentiles(sizes: DataFrame, column: str = "size") -> DataFrame:
    return sizes.agg(*(F.percentile_approx(column, p, 100_000).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)), F.max(column).alias("max"))


def cluster_report(membership: DataFrame) -> DataFrame:
    """Records, clusters of two or more, their sizes, and the two rates that go by the name of match rate."""
    s = membership.groupBy(CID).agg(F.count("*").alias("n"))
    multi = F.col("n") > 1
    return s.agg(F.sum("n").alias("total_records"), F.count_if(multi).alias("clusters"), F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("matched_records"), F.max("n").alias("max_size"),
                 F.round(F.coalesce(F.avg(F.when(multi, F.col("n"))), F.lit(0.0)), 6).alias("avg_size")).withColumns({
        "cluster_rate": F.round(F.col("clusters") / F.col("total_records"), 6), "matched_rate": F.round(F.col("matched_records") / F.col("total_records"), 6)})


def match_report(matches: DataFrame, targets: DataFrame, target: str = "target_id") -> DataFrame:
    """Targets, how many have a match, and the range of scores."""
    m = matches.agg(F.countDistinct(target).alias("matched"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max("score"), 6).alias("max_score"))
    return targets.agg(F.count("*").alias("targets")).join(m).withColumn("hit_rate", F.round(F.col("matched") / F.greatest("targets", F.lit(1)), 6))


def learn_threshold(corrections: list[tuple[float, bool, float]]) -> float | None:
    """From (score, approved, trust) of ten or more: between rejects and approvals, or where least trust is on the wrong side."""
    if len(corrections) < 10:
        return None
    yes, no = [s for s, ok, _ in corrections if ok], [s for s, ok, _ in corrections if not ok]
    if not yes or not no:
        return None
    if min(yes) > max(no):
        return (min(yes) + max(no)) / 2
    grid = [i / 100 for i in range(101)]
    return min(grid, key=lambda t: (sum(w for s, ok, w in corrections if (s >= t) != ok), t))
