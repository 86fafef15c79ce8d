"""Cutting lineage, and joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 256


_here = threading.local()
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary one in local mode, whose driver and
    executors are one process; on a cluster an error, since executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        found = f"file://{tempfile.mkdtemp(prefix='erspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and
    the rows survive the loss of any executor. ``release``, or the end of a ``scratch``, removes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/erspark-{uuid.uuid4().hex}"
    _written[path] = spark
    scopes = getattr(_here, "scopes", [])
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._erspark_path = path
    return out


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote; later reads of ``df`` fail."""
    path = getattr(df, "_erspark_path", None)
    if path:
        _remove(path)


def release_all() -> None:
    """Remove everything that ``materialize`` wrote and nobody released: for the end of a job, when its results are out."""
    for path in [*_written]:
        _remove(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose written tables go at its end, also after an error. The function it gives writes a
    result that outlives the scope and belongs to the one around it, if there is one::

        with scratch() as keep:
            out = keep(steps(df))
    """
    made: list[str] = []
    scopes = _here.__dict__.setdefault("scopes", [])

    def keep(df: DataFrame) -> DataFrame:
        out = df if getattr(df, "_erspark_path", None) in made else materialize(df)
        path = out._erspark_path
        if path in made:
            made.remove(path)
        if len(scopes) > 1:
            scopes[-2].append(path)
        return out

    scopes.append(made)
    try:
        yield keep
    finally:
        scopes.remove(made)
        for path in made:
            _remove(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made of ``stems`` that ``df`` does not have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for s in stems:
        name = f"__{s}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in whatever case."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def hot_keys(counts: DataFrame, key: list[str], total: int, count: str = "n") -> DataFrame:
    """The rows of ``counts`` whose key holds over HOT_SHARE of ``total``: 1 / HOT_SHARE at most."""
    return counts.filter(F.col(count) > F.lit(max(1.0, total * HOT_SHARE)))


def join_split_hot(left: DataFrame, right: DataFrame, key: list[str], counts: DataFrame | None,
                   total: int, how: str = "inner", count: str = "n") -> DataFrame:
    """``left`` joined (inner or left) with ``right`` (at most one row a key) on ``key``.

    Rows of hot keys never meet in one task: they are dealt to as many salts as they exceed HOT_SHARE,
    and the row of ``right`` is there once a salt, which are 2 / HOT_SHARE rows more at most. Only the keys
    of hot rows and their salts, two numbers or so a key, are broadcast; no payload is. ``counts`` has the
    rows of ``left`` by key in column ``count``; None where ``right`` itself holds them. Null keys join nothing.
    """
    of = counts if counts is not None else right
    least = max(1.0, total * HOT_SHARE)
    names = {k: f"__hot_{i}__" for i, k in enumerate(key)}
    hot = hot_keys(of, key, total, count).select(*(F.col(k).alias(n) for k, n in names.items()), F.ceil(F.col(count) / F.lit(least)).cast("int").alias("__salts__"))
    on = [F.col(f"`{k}`") == F.col(n) for k, n in names.items()]
    # equal rows of a hot key share a salt, so they should differ in some column
    own = F.xxhash64(F.lit(17), *(F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("__salt__", F.when(F.col("__salts__") > 1, F.pmod(own, F.col("__salts__"))).otherwise(0).cast("int")).drop(*names.values(), "__salts__")
    spread = right.join(F.broadcast(hot), on, "left").withColumn("__salt__", F.explode(F.sequence(F.lit(0), F.coalesce("__salts__", F.lit(1)) - 1))).drop(*names.values(), "__salts__")
    return salted.join(spread, [*key, "__salt__"], how).drop("__salt__")


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors' Python, once a context, unless they find it by PYTHONPATH
    (or, in local mode, by the working folder) anyhow."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_erspark_shipped", False):
        return
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)} if os.environ.get("PYTHONPATH") else set()
    if str(root) not in known and not (sc.master.startswith("local[") and Path.cwd() == root):
        target = Path(tempfile.mkdtemp(prefix="erspark-")) / "erspark_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "erspark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(target))  # Spark's own file server hands it to executors
    sc._erspark_shipped = True
