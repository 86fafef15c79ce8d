"""Why pairs match, where golden values come from, what a run changed."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.functions.transforms import apply_transforms
from erspark.operators.scoring import field_score, with_records

ID = "__row_id__"


def explain_pairs(pairs: DataFrame, df: DataFrame, fields: list[dict], id_col: str = ID) -> DataFrame:
    """Pairs with ``fields``: array of raw and transformed values, score, contribution and kind of difference; ``score``, ``strongest``, ``weakest``, ``text``."""
    rows = with_records(pairs.select("id_a", "id_b"), df, [f["field"] for f in fields], id_col)
    rows = rows.withColumns({f"s{i}": field_score(f) for i, f in enumerate(fields)})
    weight = sum((F.when(F.col(f"s{i}").isNotNull(), float(f.get("weight", 1.0))).otherwise(0.0) for i, f in enumerate(fields)), F.lit(0.0))
    parts = []
    for i, f in enumerate(fields):
        a, b, s = F.col(f"a_{f['field']}"), F.col(f"b_{f['field']}"), F.col(f"s{i}")
        t = f.get("transforms", [])
        diff = F.when(s.isNull(), "missing").when(a == b, "identical").when(s >= 1.0, "equal_when_transformed").when(s >= 0.8, "similar").otherwise("different")
        parts.append(F.struct(F.lit(f["field"]).alias("field"), a.cast("string").alias("a"), b.cast("string").alias("b"), apply_transforms(a, t).alias("a_transformed"), apply_transforms(b, t).alias("b_transformed"),
                              F.round(s, 6).alias("score"), F.round(F.when(weight > 0, F.coalesce(s, F.lit(0.0)) * float(f.get("weight", 1.0)) / weight).otherwise(0.0), 6).alias("contribution"), diff.alias("diff")))
    out = rows.select("id_a", "id_b", F.array(*parts).alias("fields"))
    known = F.filter("fields", lambda x: x["score"].isNotNull())
    order = lambda sign: F.array_sort(F.transform(known, lambda x: F.struct((sign * x["score"]).alias("s"), x["field"].alias("f"))))
    text = F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit(": "), F.coalesce(x["a"], F.lit("nothing")), F.lit(" and "), F.coalesce(x["b"], F.lit("nothing")), F.lit(" are "), F.replace(x["diff"], F.lit("_"), F.lit(" ")))), "; ")
    return out.withColumns({"score": F.round(F.aggregate("fields", F.lit(0.0), lambda s, x: s + x["contribution"]), 6), "strongest": F.get(order(-1), F.lit(0))["f"], "weakest": F.get(order(1), F.lit(0))["f"], "text": text})


def explain_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("text", F.concat(F.lit("cluster "), F.col("__cluster_id__"), F.lit(" has "), F.col("size"), F.lit(" records, confidence "), F.round("confidence", 2),
                                                F.when(F.col("bottleneck_pair").isNotNull(), F.concat(F.lit(", weakest link "), F.col("bottleneck_pair.a"), F.lit("-"), F.col("bottleneck_pair.b"))).otherwise("")))


def lineage(pairs: DataFrame, df: DataFrame, membership: DataFrame, fields: list[dict]) -> DataFrame:
    """One row a pair with its cluster and the explanation as JSON; written by ``write_lineage`` as it is made."""
    out = explain_pairs(pairs, df, fields).join(membership.select(F.col(ID).alias("id_a"), "__cluster_id__"), "id_a")
    return out.select("__cluster_id__", "id_a", "id_b", "score", F.to_json("fields").alias("fields"))


def write_lineage(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


class RunLog:
    """Runs as small JSON files beside their outputs; a run is undone by removing what it wrote."""

    def __init__(self, spark: SparkSession, directory: str, keep: int = 50):
        self.spark, self.directory, self.keep = spark, directory.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def add(self, outputs: list[str], **facts) -> str:
        run = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(json.dumps({"run": run, "outputs": outputs, **facts}),)], "value string").coalesce(1).write.text(f"{self.directory}/runs/{run}")
        for old in self.list()[self.keep:]:
            self._remove(f"{self.directory}/runs/{old['run']}")
        return run

    def list(self) -> list[dict]:
        fs, p = self._fs(f"{self.directory}/runs")
        if not fs.exists(p):
            return []
        return sorted((json.loads(r.value) for r in self.spark.read.option("recursiveFileLookup", "true").text(str(p)).collect()), key=lambda r: r["run"], reverse=True)

    def _remove(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.delete(p, True)

    def rollback(self, run: str) -> list[str]:
        found = next((r for r in self.list() if r["run"] == run), None)
        if found is None:
            raise ValueError(f"no such run: {run}")
        gone = [o for o in found["outputs"] if self._remove(o)]
        self._remove(f"{self.directory}/runs/{run}")
        return gone
