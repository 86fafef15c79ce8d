"""Auto-fix, validation with quarantine, anomalies and profiles of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.functions.transforms import strip

# fixed values: strings that stand for nothing, and signs of made-up values
NULL_STRINGS = ("", "NULL", "null", "N/A", "NA", "n/a", "None", "none", "-", ".", "nan", "NaN")
FAKE_EMAILS = (r"^test@", r"^noreply@", r"^no-reply@", r"^donotreply@", r"^fake@", r"^example@", r"@example\.com$", r"@test\.com$",
               r"^admin@", r"^info@info\.", r"^asdf", r"^qwerty", r"^a{3,}@", r"^x{3,}@")
FAKE_PHONES = (r"^555-", r"^000-", r"^123-456", r"^111-111", r"^0{5,}", r"^1{5,}", r"^9{5,}")
ODD_ZIPS = ("00000", "99999", "12345", "11111", "00001")
PLACEHOLDERS = ("tbd", "n/a", "na", "none", "null", "unknown", "undefined", "xxx", "yyy", "zzz", "123", "1234", "12345", "123456",
                "test", "testing", "sample", "demo", "fake", "placeholder", "foo", "bar", "baz", "asdf", "qwerty", "aaa", "bbb")
SEVERITY = {"low": 2, "medium": 1, "high": 0}
FORMATS = {"email": r"^[^@]*@[^@]*\.[^@]*$", "phone": r"^(?:[^0-9]*[0-9]){7}", "zip5": r"^(?:[^0-9]*[0-9]){5}"}


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and not c.startswith("__")]


def steps() -> list[tuple[str, object]]:
    """Fixes of one string value, in the order in which they act."""
    return [
        ("bom", lambda c: F.replace(c, F.lit("﻿"), F.lit(""))),
        ("trim", strip),
        ("null_strings", lambda c: F.when(~c.isin(*NULL_STRINGS), c)),
        ("collapse", lambda c: F.regexp_replace(c, r"(?U)\s{2,}", " ")),
        ("control", lambda c: F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")),
    ]


def auto_fix(df: DataFrame, drop_null_columns: bool = True) -> DataFrame:
    """Values fixed, rows without any user value gone, and columns without any value too."""
    done = {}
    for name in string_columns(df):
        c = F.col(name)
        for _, fix in steps():
            c = fix(c)
        done[name] = c
    out = df.withColumns(done) if done else df
    users = user_columns(df)
    if users:
        out = out.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in users]))
    if drop_null_columns and users:
        filled = out.agg(*(F.count(c).alias(c) for c in users)).first()
        out = out.drop(*(c for c in users if filled[c] == 0 and any(filled)))
    return out


#: Optional steps of a run, each a function of a table: none unless one is registered.
HOOKS: dict[str, list] = {"quality": [], "transform": []}


def register_hook(kind: str, step) -> None:
    """``step(df) -> df`` runs as part of ``prepare``: quality ones before the fixes, transform ones after."""
    HOOKS[kind].append(step)


def run_hooks(kind: str, df: DataFrame) -> DataFrame:
    return reduce(lambda d, step: step(d), HOOKS[kind], df)


def fix_log(df: DataFrame) -> DataFrame:
    """``(fix, column, rows_affected)`` of all fixes, counted in one pass."""
    counts = []
    for name in string_columns(df):
        c = F.col(name)
        for step, fix in steps():
            after = fix(c)
            counts.append(F.struct(F.lit(step).alias("fix"), F.lit(name).alias("column"), F.count_if(~c.eqNullSafe(after)).alias("rows_affected")))
            c = after
    return df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


# -- validation


def passes(c: Column, rule: dict) -> Column:
    """Whether a value passes; null fails every rule."""
    kind = rule["rule"]
    s = c.cast("string")
    if kind == "not_null":
        ok = c.isNotNull()
    elif kind == "regex":
        ok = s.rlike(rule["pattern"])
    elif kind == "min_length":
        ok = F.length(s) >= rule["value"]
    elif kind == "max_length":
        ok = F.length(s) <= rule["value"]
    elif kind == "in_set":
        ok = s.isin(*map(str, rule["values"]))
    elif kind == "format":
        ok = s.rlike(FORMATS[rule["format"]])
    else:
        raise ValueError(f"no such rule: {kind}")
    return F.coalesce(ok, F.lit(False))


def validate(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, quarantined with ``__quarantine_reason__``, report).

    A rule has column, rule, its argument and action flag, null or quarantine. Rules act
    one after the other on the working rows, so a value nulled by one is null for the next.
    """
    out, reasons, passed = df, [], []
    for i, r in enumerate(rules):
        name, action = r["column"], r.get("action", "flag")
        ok = f"__ok_{i}"
        out = out.withColumn(ok, passes(F.col(name), r))
        passed.append((ok, r, action))
        if action == "flag":
            out = out.withColumn(f"__vf_{name}_{r['rule']}__", F.col(ok))
        elif action == "null":
            out = out.withColumn(name, F.when(F.col(ok), F.col(name)))
        else:
            reasons.append(F.when(~F.col(ok), F.lit(f"{name}:{r['rule']}")))
    reason = F.array_join(F.array_compact(F.array(*reasons)), "; ") if reasons else F.lit("")
    marked = out.withColumn("__quarantine_reason__", reason)
    hidden = [p[0] for p in passed]
    report = out.agg(F.array(*(F.struct(F.lit(r["column"]).alias("column"), F.lit(r["rule"]).alias("rule"), F.count("*").alias("total"), F.count_if(ok).alias("passed")) for ok, r, _ in passed)).alias("a")).select(
        F.explode("a").alias("a")).select("a.*").withColumns({"failed": F.col("total") - F.col("passed"), "fail_rate": F.round((F.col("total") - F.col("passed")) / F.greatest("total", F.lit(1)), 6)})
    return (marked.filter("__quarantine_reason__ = ''").drop("__quarantine_reason__", *hidden), marked.filter("__quarantine_reason__ <> ''").drop(*hidden), report)


# -- anomalies


def detect_anomalies(df: DataFrame, key: str = "__row_id__", sensitivity: str = "medium") -> DataFrame:
    """``(row_id, column, type, value, severity)``: fake emails and phones, odd zips, placeholders, rows found three times or more."""
    users = [c for c in user_columns(df) if c != key]
    like = lambda c, parts: any(p in c.lower() for p in parts)
    any_of = lambda v, patterns: v.rlike("|".join(patterns))
    found = []

    def add(c: str, kind: str, severity: str, v: Column, when: Column) -> None:
        if {"high": 2, "medium": 1, "low": 0}[severity] >= SEVERITY[sensitivity]:
            found.append(F.when(when, F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), v.alias("value"), F.lit(severity).alias("severity"))))

    for c in users:
        plain = strip(F.col(c).cast("string"))
        low = F.lower(plain)
        if like(c, ("email", "mail")):
            add(c, "fake_email", "high", low, any_of(low, FAKE_EMAILS))
        if like(c, ("phone", "tel", "mobile", "cell")):
            add(c, "fake_phone", "medium", plain, any_of(plain, FAKE_PHONES))
        if like(c, ("zip", "postal", "postcode")):
            add(c, "suspicious_zip", "medium", plain, plain.isin(*ODD_ZIPS))
        add(c, "placeholder", "medium", low, low.isin(*PLACEHOLDERS))
    parts = [df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("a")).select("row_id", "a.*")] if found else []
    if SEVERITY[sensitivity] <= 1:
        h = [F.xxhash64(F.lit(s), *users).alias(n) for s, n in ((3, "h1"), (5, "h2"))]
        same = df.groupBy(*h).agg(F.count("*").alias("n")).filter("n > 2")
        parts.append(df.select(F.col(key).alias("row_id"), *h).join(same, ["h1", "h2"]).select("row_id", F.lit("*").alias("column"), F.lit("identical_row").alias("type"), F.col("n").cast("string").alias("value"), F.lit("medium").alias("severity")))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["row_id", "column", "type"])


# -- profiles

TYPES = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^[\d\s().+-]{7,}$", "zip": r"^\d{5}(-\d{4})?$", "number": r"^-?[\d,]*\.?\d+$", "date": r"^\d{4}-\d{2}-\d{2}"}


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: nulls, distinct values, lengths and a suspected type.

    Exact distinct counts come from values counted first: a row for each column and value is what is shuffled, made
    within each task before, and everything else is a sum over those rows.
    """
    names = user_columns(df)
    if approximate:
        rows = []
        for c in names:
            s, n = F.col(f"`{c}`").cast("string"), F.count(F.col(f"`{c}`"))
            rows.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("total"), (F.count("*") - n).alias("nulls"), F.approx_count_distinct(F.col(f"`{c}`")).alias("n_unique"),
                                 F.min(F.length(s)).alias("min_length"), F.max(F.length(s)).alias("max_length"), F.round(F.avg(F.length(s)), 6).alias("avg_length"),
                                 _suspected(lambda p, s=s: F.count_if(s.rlike(p)), n).alias("suspected_type")))
        return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("s")) for i, c in enumerate(names)))
    values = df.select(F.explode(cells).alias("e")).groupBy("e.i", "e.s").agg(F.count("*").alias("n"))
    filled, size = F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0)), F.length("s")
    per = values.groupBy("i").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("s").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("s").alias("n_unique"), F.min(size).alias("min_length"), F.max(size).alias("max_length"),
        F.round(F.sum(size * F.col("n")) / filled, 6).alias("avg_length"), _suspected(lambda p: F.sum(F.when(F.col("s").rlike(p), F.col("n")).otherwise(0)), filled).alias("suspected_type"))
    return per.select(F.array(*(F.lit(c) for c in names))[F.col("i")].alias("column"), "total", "nulls", "n_unique", "min_length", "max_length", "avg_length", "suspected_type")


def _suspected(hits, filled: Column) -> Column:
    """The first type that over 60 % of the filled values look like."""
    kind = F.lit("text")
    for k in reversed(TYPES):
        kind = F.when(hits(TYPES[k]) / F.greatest(filled, F.lit(1)) > 0.6, k).otherwise(kind)
    return kind


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, rows that repeat others, and rows without a value."""
    users = user_columns(df)
    empty = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in users])
    per = df.groupBy(*(F.xxhash64(F.lit(s), *users).alias(n) for s, n in ((3, "h1"), (5, "h2")))).agg(F.count("*").alias("n"), F.count_if(empty).alias("e"))
    return per.agg(F.sum("n").alias("total_rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"), F.sum("e").alias("empty_rows"))
