"""Line dedup: windows of three consecutive lines that occur again anywhere in the corpus.

Lines with a word are numbered within their document, trimmed of white space and hashed in
overlapping windows (128 bits). The first window of each kind, by document id and position,
stays; the lines of every later one are covered, covered positions are merged, and covered
lines go. Any line that goes is still found where its window came first.

Only documents with a covered line need their text beside their covered places, so only they are
shuffled (``maybe_in``); the others pass as they are.

Defined cases: a null text stays null; documents of fewer lines than a window and empty
texts are unchanged; rows that repeat id and text count as one document and get the same
result; among equal ids the order is by a hash of the text; blank lines are kept and don't
break windows; input columns named like an output are replaced, and no other column is touched, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.llm.text import maybe_in, packed, row_key, unpacked
from erspark.plans.runtime import join_split_hot, materialize, release

#: Lines in a window.
WINDOW = 3
#: A line with a word, from its first character other than white space to its last.
LINE = r"[^\x20\x09-\x0D](?:[^\n]*[^\x20\x09-\x0D])?"


def repeated_windows(df: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """``(__k1, __k2, covered)``: of each row with repeated lines, places of windows that came before."""
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    lines = F.transform(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda x: F.struct(F.xxhash64(F.lit(3), x).alias("a"), F.xxhash64(F.lit(5), x).alias("b")))
    d = df.select(F.col(doc_id).alias("id"), k1, k2, lines.alias("l")).filter(F.size("l") >= window)
    at = lambda p, side: F.xxhash64(*(F.get("l", p + k)[side] for k in range(window)))
    places = F.sequence(F.lit(0), F.size("l") - window)
    found = materialize(d.select("id", "__k1", "__k2", F.explode(F.transform(
        places, lambda p: F.struct(p.alias("p"), at(p, "a").alias("h1"), at(p, "b").alias("h2")))).alias("w")).select("id", "__k1", "__k2", "w.*"))
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "__k1", "__k2", "p")).alias("first")).filter("n > 1")
    first = materialize(first)
    total = found.count()
    later = join_split_hot(found, first, ["h1", "h2"], None, total).filter(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("__k1") == F.col("first.__k1")) & (F.col("__k2") == F.col("first.__k2")) & (F.col("p") == F.col("first.p"))))
    out = materialize(later.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("p")).alias("covered")))
    release(found)
    release(first)
    return out


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with ``text`` freed of repeated lines, ``n_lines`` (with a word) and ``n_removed``."""
    covered = repeated_windows(df, doc_id, text, window)
    rows = packed(df, __k1=row_key(F.col(doc_id), F.col(text))[0], __k2=row_key(F.col(doc_id), F.col(text))[1], text=text)
    marked = maybe_in(rows, "__k1", covered, covered.count())
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("bigint")
    same = unpacked(marked.filter(~F.col("maybe")), df, **{text: "text", "n_lines": n_lines, "n_removed": F.lit(0).cast("bigint")})
    changed = marked.filter("maybe").drop("maybe").join(covered.hint("merge"), ["__k1", "__k2"], "left")
    lines = F.split("text", "\n", -1)
    # places among worded lines that go: the union of [p, p + window)
    gone = F.array_distinct(F.flatten(F.transform("covered", lambda p: F.sequence(p, p + window - 1))))
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    changed = changed.withColumn("gone", F.when(F.col("covered").isNotNull(), F.transform(gone, lambda p: F.get(worded, p))))
    done = unpacked(changed, df, **{text: F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept(lines, F.col("gone"))), "n_lines": n_lines,
                                    "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")})
    return same.unionByName(done)


def _kept(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without those at places ``gone``: runs of kept lines between neighbouring cuts."""
    cuts = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.size(lines)))
    runs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1),
                      lambda a, b: F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))))
    return F.array_join(F.flatten(runs), "\n")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed")


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM l),
n AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM t WHERE s <> ''),
w AS (SELECT a.doc_id, a.p, a.s || chr(10) || b.s || chr(10) || c.s AS w FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p = a.p + 1
      JOIN n c ON a.doc_id = c.doc_id AND c.p = a.p + 2),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM r WHERE k > 1),
x AS (SELECT t.doc_id, t.i, t.line, t.s <> '' AS worded, g.p IS NOT NULL AS gone
      FROM t LEFT JOIN n ON t.doc_id = n.doc_id AND t.i = n.i LEFT JOIN g ON n.doc_id = g.doc_id AND n.p = g.p)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE NOT x.gone), '') END AS text,
  CAST(coalesce(sum(CASE WHEN x.worded THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN x.gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id GROUP BY d.doc_id, d.text
"""
