"""A queue of pairs for people to decide, as a log of events in a folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.operators.scoring import gate

EVENT = "job string, id_a long, id_b long, score double, text string, status string, decided_by string, reason string, at long"


class ReviewQueue:
    """Pairs by job; the newest event of a pair is its state. Events are only added, so writers never wait for each other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _events(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(self.path)

    def state(self, job: str) -> DataFrame:
        last = Window.partitionBy("id_a", "id_b").orderBy(F.desc("at"), F.desc("status"))
        return self._events().filter(F.col("job") == job).withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")

    def add(self, job: str, scored: DataFrame, merge: float = 0.95, review: float = 0.75, text: str | None = None) -> None:
        """The pairs between the two bounds wait for a decision."""
        pairs = gate(scored, merge, review).filter("decision = 'review'")
        none = F.lit(None).cast("string")
        pairs.select(F.lit(job).alias("job"), "id_a", "id_b", "score", (F.col(text) if text else none).alias("text"), F.lit("pending").alias("status"), none.alias("decided_by"), none.alias("reason"),
                     F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(self.path)

    def pending(self, job: str) -> DataFrame:
        return self.state(job).filter("status = 'pending'")

    def _decide(self, job: str, id_a: int, id_b: int, status: str, by: str, reason: str | None = None) -> None:
        found = self.pending(job).filter((F.col("id_a") == id_a) & (F.col("id_b") == id_b))
        found.withColumns({"status": F.lit(status), "decided_by": F.lit(by), "reason": F.lit(reason).cast("string"), "at": F.lit(time.time_ns())}).coalesce(1).write.mode("append").parquet(self.path)

    def approve(self, job: str, id_a: int, id_b: int, by: str) -> None:
        self._decide(job, id_a, id_b, "approved", by)

    def reject(self, job: str, id_a: int, id_b: int, by: str, reason: str | None = None) -> None:
        self._decide(job, id_a, id_b, "rejected", by, reason)

    def stats(self, job: str) -> dict[str, int]:
        n = {r["status"]: r["count"] for r in self.state(job).groupBy("status").count().collect()}
        return {s: n.get(s, 0) for s in ("pending", "approved", "rejected")}
