"""Entry points by name: files or DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.functions.similarity import SCORERS, indel, jaro_winkler
from erspark.operators import evaluate as E
from erspark.operators import explain as X
from erspark.operators import pprl as P
from erspark.operators import scoring as S
from erspark.plans import pipeline
from erspark.plans.config import Config, config_of, load_config
from erspark.sources.files import load_files


def _config(config: Config | str | None, how: dict) -> Config | None:
    if isinstance(config, str):
        return load_config(config)
    return config or (config_of(**how) if how else None)


def dedupe_df(df: DataFrame, config: Config | str | None = None, **how) -> pipeline.DedupeResult:
    """``how``: exact=[columns], fuzzy={column: weight}, blocking=[columns], threshold; without any the plan comes from the data."""
    return pipeline.dedupe(df, _config(config, how))


def dedupe(spark: SparkSession, *paths: str, config: Config | str | None = None, **how) -> pipeline.DedupeResult:
    return dedupe_df(load_files(spark, [(p, p.rsplit("/", 1)[-1]) for p in paths]), config, **how)


def match_df(target: DataFrame, reference: DataFrame, config: Config | str | None = None, mode: str = "best", **how) -> pipeline.MatchResult:
    return pipeline.match(target, reference, _config(config, how), mode)


def match(spark: SparkSession, target: str, reference: str, config: Config | str | None = None, mode: str = "best", **how) -> pipeline.MatchResult:
    t, r = (load_files(spark, [(p, n)]).drop("__source__") for p, n in ((target, "target"), (reference, "reference")))
    return match_df(t, r, config, mode, **how)


def score_strings(a: str | None, b: str | None, scorer: str = "jaro_winkler") -> float:
    """Of two values on the driver; null gives 0."""
    if a is None or b is None:
        return 0.0
    if scorer == "jaro_winkler":
        return jaro_winkler(a, b)
    if scorer == "token_sort":
        return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if scorer not in SCORERS:
        raise ValueError(f"no such scorer: {scorer}")
    spark = SparkSession.getActiveSession()
    return float(spark.range(1).select(SCORERS[scorer](F.lit(a), F.lit(b)).alias("s")).first().s or 0.0)


def score_pair_df(df: DataFrame, id_a: int, id_b: int, fields: list[dict]) -> DataFrame:
    return S.weighted_scores(df.sparkSession.createDataFrame([(id_a, id_b)], "id_a long, id_b long"), df, fields, 0.0)


def explain_pair_df(df: DataFrame, id_a: int, id_b: int, fields: list[dict]) -> DataFrame:
    return X.explain_pairs(df.sparkSession.createDataFrame([(id_a, id_b)], "id_a long, id_b long"), df, fields)


def pprl_link(a: DataFrame, b: DataFrame, columns: list[str], **how) -> DataFrame:
    return P.link(a, b, columns, **how)


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return E.evaluate_pairs(predicted, E.load_truth(truth))


def gate(predicted: DataFrame, truth: DataFrame, min_f1: float | None = None, min_precision: float | None = None, min_recall: float | None = None) -> None:
    """Raises ValueError if a measure falls short."""
    short = E.gates(evaluate(predicted, truth), min_f1, min_precision, min_recall)
    if short:
        raise ValueError("; ".join(short))


class Jobs:
    """Runs by name, whose results are temporary views of the session: ``<name>_golden``, ``_clusters``, ``_membership`` and ``_pairs``,
    or ``_matches`` and ``_unmatched``; SQL reads them by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def dedupe(self, name: str, table: str | DataFrame, config: Config | str | None = None, **how) -> DataFrame:
        r = dedupe_df(self.spark.table(table) if isinstance(table, str) else table, config, **how)
        return self._keep(name, "dedupe", {"golden": r.golden, "clusters": r.clusters, "membership": r.membership, "pairs": r.pairs})["golden"]

    def match(self, name: str, target: str | DataFrame, reference: str | DataFrame, config: Config | str | None = None, mode: str = "best", **how) -> DataFrame:
        t, r = (self.spark.table(d) if isinstance(d, str) else d for d in (target, reference))
        m = match_df(t, r, config, mode, **how)
        return self._keep(name, "match", {"matches": m.matches, "unmatched": m.unmatched})["matches"]

    def _keep(self, name: str, kind: str, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for part, df in parts.items():
            df.createOrReplaceTempView(f"{name}_{part}")
        self.jobs[name] = (kind, parts)
        return parts

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(n, k, sorted(p)) for n, (k, p) in self.jobs.items()], "job string, kind string, parts array<string>")

    def status(self, name: str) -> str:
        return "done" if name in self.jobs else "unknown"

    def get(self, name: str, part: str) -> DataFrame:
        return self.jobs[name][1][part]


def list_scorers() -> list[str]:
    return sorted(SCORERS)
