"""Quality rules: a threshold table compiled into one projection of built-in expressions.

A rule is (name, feature, least, most, from_words): a document of at least ``from_words``
words fails it if the feature lies outside [least, most]; None leaves a side open. Features
are expressions over the whole text, so the table costs one scan and no shuffle.

Defined cases: a null or empty text has no words and fails the length rule; ratios over
nothing are 0; input columns named like an output are replaced, and no other column is touched,
whatever its name; texts of any length are worked through whole; an empty table gives an empty one; rows are judged one by one, so repeated rows and ties don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.llm.text import SPACE, packed, unpacked, words

#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it was for on as with by at from this be are or an "
    "le la les de des du et en un une que qui dans par pour est sur "
    "der die das und ist von zu mit den ein eine im dem nicht "
    "el los las del y no se es lo con su"
).split()

RULES = (
    ("words", "n_words", 10, None, 0),
    ("repeated_words", "repeat_ratio", None, 0.2, 0),
    ("word_length", "mean_word_chars", 2.0, 16.0, 0),
    ("symbols", "symbol_ratio", None, 0.1, 0),
    ("exclamations", "exclaim_ratio", None, 0.5, 0),
    ("stop_words", "stop_ratio", 0.03, None, 50),
    ("duplicate_lines", "dup_line_ratio", None, 0.5, 0),
)
#: The two rules whose failure is ``base_failed``.
BASE = ("words", "repeated_words")
#: Counts that ``features`` makes, in order, and the ratios made of them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_exclaim")
RATIOS = ("repeat_ratio", "mean_word_chars", "symbol_ratio", "exclaim_ratio", "stop_ratio", "dup_line_ratio")


def _repeats(grams: Column, n: int) -> Column:
    """Words within windows that ``grams``, a column of their hashes, holds twice or more."""
    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    size = F.size(grams)

    def twice(s: Column) -> Column:
        here = lambda i: F.get(s, i)["h"]
        found = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(
            here(i).eqNullSafe(here(i - 1)) | here(i).eqNullSafe(here(i + 1)), F.get(s, i)["p"]))
        return F.sort_array(F.array_compact(found))

    start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
    # an array of one element lets the sorted array be made once
    covered = F.transform(F.array(ranked), lambda s: F.aggregate(twice(s), start, lambda a, p: F.struct(
        p.alias("last"), (a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum")), lambda a: a["sum"]))
    return F.when(F.size(F.array_distinct(grams)) < size, covered[0]).otherwise(0)


def _features(df: DataFrame, window: int = 5) -> DataFrame:
    """``df``, whose names are the operator's own, with the counts and ratios that rules refer to."""
    t = F.coalesce("text", F.lit(""))
    df = df.withColumn("__w", words(t)).withColumn(
        "__l", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__g", F.when(F.size("__w") >= window, F.transform(
        F.sequence(F.lit(0), F.size("__w") - window),
        lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(window))))).otherwise(F.array().cast("array<bigint>")))
    stop = F.filter("__w", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))
    without = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    counts = {
        "n_words": F.size("__w"), "word_chars": F.length(F.array_join("__w", "")), "n_symbols": without(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")), "n_repeat_words": _repeats(F.col("__g"), window),
        "n_lines": F.size("__l"), "n_stop_words": F.size(stop), "n_exclaim": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
    }
    df = df.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop("__w", "__l", "__h", "__g")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns({
        "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"), "exclaim_ratio": per("n_exclaim", "n_words"),
        "stop_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"),
    })


def _fails(rule: tuple) -> Column:
    _, feature, least, most, from_words = rule
    value, out = F.col(feature), F.lit(False)
    if feature == "repeat_ratio" and most is not None:  # in whole numbers, free of rounding
        out = out | (100 * F.col("n_repeat_words") > F.lit(round(100 * most)) * F.col("n_words"))
    elif most is not None:
        out = out | (value > most)
    if least is not None:
        out = out | (value < least)
    return out & (F.col("n_words") >= from_words) if from_words else out


def quality_rules(df: DataFrame, text: str = "text", rules: tuple = RULES, base: tuple = BASE) -> DataFrame:
    """``df`` with features, ``failed`` (names of failed rules), ``base_failed`` and ``kept``."""
    rows = _features(packed(df, text=text))
    names = F.array_compact(F.array(*(F.when(_fails(r), F.lit(r[0])) for r in rules))) if rules else F.array().cast("array<string>")
    lost = F.lit(False)
    for r in rules:
        if r[0] in base:
            lost = lost | _fails(r)
    rows = rows.withColumns({"failed": names, "base_failed": lost}).withColumn("kept", F.size("failed") == 0)
    return unpacked(rows, df, **{n: n for n in (*COUNTS, *RATIOS, "failed", "base_failed", "kept")})


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *COUNTS, F.array_join("failed", ",").alias("failed"), "base_failed", "kept")


def _sql_rules() -> str:
    out = []
    ratio = {"n_words": "n_words", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)",
             "exclaim_ratio": "n_exclaim / greatest(n_words, 1)", "stop_ratio": "n_stop_words / greatest(n_words, 1)",
             "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    for name, feature, least, most, from_words in RULES:
        if feature == "repeat_ratio":
            test = f"100 * n_repeat_words > {round(100 * most)} * n_words"
        else:
            test = " OR ".join(f"{ratio[feature]} {op} {x}" for op, x in (("<", least), (">", most)) if x is not None)
        out.append(f"CASE WHEN ({test}) AND n_words >= {from_words} THEN '{name}' END")
    return ", ".join(out)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(len(w) - 4)) AS p, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, p + 1, p + 5), ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM h WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
        length(t) - length(replace(t, '!', '')) AS n_exclaim
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, array_to_string(list_filter([{_sql_rules()}], lambda x: x IS NOT NULL), ',') AS failed FROM c)
SELECT doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in COUNTS)}, failed,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed = '' AS kept FROM f
"""
