"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-duplicates, secrets, packing.

Each stage takes the columns doc_id, text and source, whatever others there are, and all but the last return the
columns that came, untouched but for the text (and n_chars, its length, if there is such a column): what an operator adds
is named apart from them and dropped. Null and empty texts fail the quality rules; a stage given an empty table returns an
empty one; rows that repeat id and text are judged alike, and one of them stays after the near-duplicate stage; texts of any length are
worked through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.linededup import line_dedup
from erspark.llm.neardup import near_duplicates
from erspark.llm.packing import pack_documents
from erspark.llm.quality import quality_rules
from erspark.llm.secrets import redact_secrets
from erspark.llm.text import keep_rows, packed, unpacked
from erspark.plans.runtime import release, scratch


def _with_text(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that ``packed`` wrapped, with the new text and its length."""
    size = {c: F.length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return unpacked(done, docs, text="text", **size)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, those of null or empty texts among them."""
    return unpacked(keep_rows(quality_rules(packed(docs, text="text")), F.col("kept")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document left without a word goes too."""
    done = line_dedup(packed(docs, doc_id="doc_id", text="text"))
    return _with_text(keep_rows(done, (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, that of the smallest id."""
    return near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; no document goes."""
    return _with_text(redact_secrets(packed(docs, doc_id="doc_id", text="text", source="source")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_dedup), ("secret scans", secrets), ("best-fit packing", packing)]
#: SimHash and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again in the shared folder. A stage's own tables go when its result is
    written, and its input goes too; ``release_all`` removes the last ones when the caller has the rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            new = keep(stage(spark, docs, sf_dir))
        release(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
