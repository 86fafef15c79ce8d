"""URL filters: rules by host suffix and path prefix, then logistic regression on hashed character n-grams.

The model is trained from a small labelled table of urls (``urllabels``, fixed and bounded),
with hashed n-grams of host and path kept apart by a prefix. Rules win over the model.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and
gets the model's verdict on nothing but the intercept; repeated rows are judged alike; input
columns named like an output are replaced, and no other column is touched, whatever its name; urls of any length are
judged whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.text import packed, unpacked
from erspark.llm.urllabels import training_table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS, GRAMS = 1 << 16, (3, 4, 5)
#: Strength of the regularisation, the share of urls taken to be unwanted before one is seen (so a url that tells
#: the model nothing is allowed), and the probability from which one is blocked.
REGULARISATION, PRIOR, UNWANTED = 1e-3, 0.1, 0.5


def labelled_urls(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """``(host, path, label)`` of the labelled table, a fixed number of rows."""
    return spark.createDataFrame([(h, p, float(y)) for h, p, y in rows or training_table()], "host string, path string, label double").coalesce(1)


def host_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = lambda g: F.coalesce(F.regexp_extract(url, parts, g), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(of(1), upper, upper.lower()), of(2)


def _grams(host: Column, path: Column) -> Column:
    def of(s: Column, tag: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), s, F.lit("$"))
        many = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.concat(F.lit(tag), F.substring(padded, i, n)))
        return F.when((F.length(padded) >= n) & (s != ""), many).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(s, tag, n) for s, tag in ((host, "h"), (path, "p")) for n in GRAMS))


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="f", binary=True).transform(df.withColumn("grams", _grams(F.col("host"), F.col("path"))))


def train(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None):
    """The model fitted on the labelled table, whose classes weigh as PRIOR says."""
    table = _vectors(labelled_urls(spark, rows))
    n, bad = table.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1.0, PRIOR * n / bad).otherwise((1 - PRIOR) * n / (n - bad))
    return LogisticRegression(featuresCol="f", predictionCol="y", probabilityCol="p", rawPredictionCol="r", weightCol="w", regParam=REGULARISATION, maxIter=60, threshold=UNWANTED).fit(table.withColumn("w", weight))


def score_urls(df: DataFrame, model) -> DataFrame:
    """``df (host, path, ...)`` with ``bad``, whether the model takes the url for unwanted; its other columns go."""
    return model.transform(_vectors(df)).withColumn("bad", F.col("y") == 1.0).drop("grams", "f", "y", "p", "r")


def url_filter(df: DataFrame, url: str = "url", rules: tuple = RULES, model=None) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (of the longest that fits, else null) and ``verdict``."""
    model = model or train(df.sparkSession)
    host, path = host_path(F.col(url))
    rows = packed(df, host=host, path=path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    judged = F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow"))
    return unpacked(score_urls(rows, model), df, host="host", path="path", rule=rule, verdict=judged)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")
