"""Planning from data: column kinds, matchkeys, blocking, checks before and after a run, schema matching."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.operators.cleaning import TYPES, user_columns
from erspark.operators.evaluate import size_percentiles, threshold_overlap, valley
from erspark.plans.config import Blocking, BlockKey, Canopy, Config, Matchkey, MatchField
from erspark.plans.runtime import materialize

#: Column kinds by name, the first that fits.
BY_NAME = (
    ("email", r"e.?mail"), ("phone", r"phone|tel|mobile|fax|cell"), ("zip", r"zip|postal|postcode"),
    ("date", r"date|_dt$|registr|created|updated|birth.?d|dob"), ("year", r"(^|_)(year|yr)(_|$)"),
    ("identifier", r"^(id|key|code|sku)$|_(id|key)$|^(uuid|guid)|(uuid|guid)$|_(ref|reg_num|account)$|key$"),
    ("price", r"price|cost|amount|revenue|salary|fee|charge|total|balance|acctbal"), ("address", r"address|street|addr"),
    ("geo", r"(?<![a-z])city|^state$|state.?cd|^country$|province|region|(?<![a-z])county|nation"), ("name", r"name|surname"),
)
#: Scorer, weight and transforms of a kind.
SCORER_OF = {
    "email": ("exact", 1.0, ["lowercase", "strip"]), "phone": ("exact", 0.8, ["digits_only"]), "zip": ("exact", 0.5, ["strip"]), "name": ("ensemble", 1.0, ["lowercase", "strip"]),
    "address": ("token_sort", 0.8, ["lowercase", "strip"]), "identifier": ("exact", 1.0, ["strip"]), "geo": ("exact", 0.3, ["lowercase", "strip"]), "text": ("token_sort", 0.5, ["lowercase", "strip"]),
}
#: Scorers that a domain's columns get in place of those of their kind.
DOMAIN_SCORERS = {
    "product": {"__brand__": ("exact", 0.5, ["lowercase"]), "__model_norm__": ("exact", 1.0, []), "__color__": ("exact", 0.2, []), "__specs__": ("token_sort", 0.3, [])},
    "software": {"__sw_name__": ("token_sort", 1.0, []), "__sw_version__": ("exact", 0.5, []), "__sw_edition__": ("exact", 0.3, []), "__sw_platform__": ("exact", 0.2, [])},
    "biblio": {"__title_key__": ("exact", 0.5, []), "__year__": ("exact", 0.4, []), "__doi__": ("exact", 1.0, ["lowercase"])},
}
#: Columns that one aggregation measures.
TOGETHER = 40
#: Column names that mean the same.
SYNONYMS = ({"first_name", "fname", "given_name", "forename"}, {"last_name", "lname", "surname", "family_name"}, {"email", "email_address", "mail"}, {"phone", "telephone", "phone_number", "mobile"},
            {"zip", "zip_code", "postcode", "postal_code"}, {"address", "street", "street_address", "addr"}, {"dob", "birth_date", "date_of_birth"})


def kind_by_name(column: str) -> str | None:
    return next((k for k, p in BY_NAME if re.search(p, column, re.I)), None)


def profile(df: DataFrame) -> dict[str, dict]:
    """Kind, share of distinct values, of nulls and mean length by column.

    All of it is of the whole table and all columns: aggregations of TOGETHER columns each, with sketches for distinct counts. Kinds
    that names don't tell come from the share of values that look like one.
    """
    columns, out = user_columns(df), {}
    for at in range(0, len(columns), TOGETHER):
        some = columns[at:at + TOGETHER]
        text = lambda c: F.col(f"`{c}`").cast("string")
        open_ = [c for c in some if kind_by_name(c) is None]
        aggs = [x for i, c in enumerate(some) for x in (F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"u{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.avg(F.length(text(c))).alias(f"l{i}"))]
        aggs += [F.count_if(text(c).rlike(p)).alias(f"k{i}_{k}") for i, c in enumerate(some) if c in open_ for k, p in TYPES.items()]
        r = df.agg(F.count("*").alias("rows"), *aggs).first()
        for i, c in enumerate(some):
            kind = kind_by_name(c) or next((k for k in TYPES if r[f"k{i}_{k}"] > 0.6 * r[f"n{i}"]), "text")
            out[c] = {"kind": kind, "rows": r["rows"], "cardinality": min(1.0, r[f"u{i}"] / max(1, r[f"n{i}"])), "nulls": 1 - r[f"n{i}"] / max(1, r["rows"]), "length": r[f"l{i}"] or 0.0}
    return out


def source_overlap(df: DataFrame, column: str, source: str = "__source__") -> DataFrame:
    """One row: sources, values that all of them have, values of any, and the ratio; 1.0 with fewer than two sources or without a value."""
    per = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v"), F.col(source).alias("s")).distinct().groupBy("v").agg(F.count("*").alias("k"))
    all_ = df.select(F.countDistinct(source).alias("sources"))
    both = per.join(all_).groupBy().agg(F.max("sources").alias("m"), F.count_if(F.col("k") == F.col("sources")).alias("shared"), F.count("*").alias("values"))
    return all_.join(both).select("sources", "shared", "values", F.round(F.when((F.col("sources") < 2) | (F.col("values") == 0), 1.0).otherwise(F.col("shared") / F.col("values")), 6).alias("overlap"))


def shared_values(df: DataFrame, column: str, source: str = "__source__") -> DataFrame:
    """The values of a column that every source has."""
    sources = df.select(F.countDistinct(source).alias("n"))
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.countDistinct(source).alias("k")).join(sources).filter("k = n").select("value")


def domain_matchkey(domain: str, threshold: float = 0.8) -> Matchkey:
    """A weighted key over the columns that a domain's features give."""
    return Matchkey(f"{domain}_features", "weighted", [MatchField(c, t, s, w) for c, (s, w, t) in DOMAIN_SCORERS[domain].items()], threshold)


def adaptive_threshold(fields: list[MatchField], nulls: float = 0.0, length: float = 10.0) -> float:
    scorers = {f.scorer for f in fields}
    base = 0.95 if scorers <= {"exact"} else 0.70 if scorers & {"embedding", "record_embedding"} else 0.85 if len(fields) == 1 else 0.80
    return round(base - 0.05 * (nulls > 0.3) + 0.05 * (length < 4), 2)


def plan_matchkeys(found: dict[str, dict]) -> list[Matchkey]:
    """Exact keys of near-unique kinds, and one weighted key of up to five fields."""
    rows = next(iter(found.values()))["rows"] if found else 0
    keys = [Matchkey(f"exact_{c}", "exact", [MatchField(c, SCORER_OF[p["kind"]][2])]) for c, p in found.items()
            if p["kind"] in ("email", "phone", "identifier") and 0.5 <= p["cardinality"] < 0.99 and p["nulls"] < 0.9]
    fuzzy = [(c, p) for c, p in found.items() if p["kind"] in ("name", "address", "text", "email", "phone", "zip", "geo") and p["length"] <= 200 and p["cardinality"] > 0.0]
    fuzzy.sort(key=lambda x: (-SCORER_OF[x[1]["kind"]][1], -x[1]["cardinality"], x[0]))
    fuzzy = [x for x in fuzzy if x[1]["kind"] not in ("geo", "zip") or len(fuzzy) <= 5][:5]
    if fuzzy and any(p["kind"] in ("name", "address", "text") for _, p in fuzzy) and rows:
        fs = [MatchField(c, SCORER_OF[p["kind"]][2], SCORER_OF[p["kind"]][0], min(SCORER_OF[p["kind"]][1], 0.3) if p["nulls"] > 0.5 else SCORER_OF[p["kind"]][1]) for c, p in fuzzy]
        mean = lambda k: sum(p[k] for _, p in fuzzy) / len(fuzzy)
        keys.append(Matchkey("fuzzy", "weighted", fs, adaptive_threshold(fs, mean("nulls"), mean("length"))))
    return keys


def plan_blocking(df: DataFrame, found: dict[str, dict], most: int = 1000) -> Blocking:
    """The finest key whose largest block is small enough; else two together, sounds of names, or canopies."""
    usable = [c for c, p in found.items() if p["nulls"] < 0.5 and p["kind"] in ("zip", "email", "phone", "identifier", "geo", "name", "text") and p["cardinality"] < 0.95]
    if not usable:
        texts = [c for c, p in found.items() if p["kind"] in ("name", "text", "address")] or list(found)
        return Blocking(strategy="multi_pass", passes=[BlockKey([c], ["lowercase", "strip", "substring:0:4"]) for c in texts[:3]])
    # one aggregation: the largest block of each single column
    sizes = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.xxhash64(F.col(c)).alias("h"), F.col(c).isNotNull().alias("ok")) for c in usable))).alias("e")).filter("e.ok").groupBy("e.c", "e.h").count().groupBy("c").agg(F.max("count").alias("m")).collect()
    largest = {r.c: r.m for r in sizes}
    small = sorted((c for c in usable if largest.get(c, most + 1) <= most), key=lambda c: (largest[c], c))
    if small:
        return Blocking(keys=[BlockKey([c], ["lowercase", "strip"]) for c in small[:2]])
    names = [c for c in usable if found[c]["kind"] == "name"]
    others = [c for c in usable if c not in names]
    if names and others:
        return Blocking(keys=[BlockKey([others[0], names[0]], ["lowercase", "strip"])])
    if names:
        return Blocking(strategy="multi_pass", passes=[BlockKey([names[0]], ["soundex"]), BlockKey([names[0]], ["lowercase", "strip", "substring:0:3"])])
    return Blocking(strategy="canopy", canopy=Canopy(usable[:2]))


def auto_configure(df: DataFrame, probabilistic: bool = False) -> Config:
    found = profile(df)
    keys = plan_matchkeys(found)
    if probabilistic:
        keys = [Matchkey(k.name, "probabilistic", k.fields) if k.type == "weighted" else k for k in keys]
    plan = plan_blocking(df, found) if any(k.type != "exact" for k in keys) else None
    if plan and found and next(iter(found.values()))["rows"] >= 50_000 and plan.strategy == "static" and plan.keys:
        plan.strategy = "learned"
    return Config(matchkeys=keys, blocking=plan, planned=True).check()


def preflight(df: DataFrame, config: Config) -> list[dict]:
    """Findings ``{check, severity, subject, message}``: missing columns, keys too unique or too common, large blocks, assets that are not there, weights of doubtful columns."""
    out, found = [], profile(df)
    add = lambda *x: out.append(dict(zip(("check", "severity", "subject", "message"), x)))
    for m in config.matchkeys:
        for f in m.fields:
            if f.field not in df.columns:
                add("columns", "error", f.field, "is not in the table")
                continue
            p = found.get(f.field)
            if p and m.type == "exact" and p["cardinality"] >= 0.99:
                add("cardinality_high", "warning", f.field, "is different in nearly every row")
            if p and m.type == "exact" and p["cardinality"] <= 0.01:
                add("cardinality_low", "warning", f.field, "is the same in most rows")
            if f.scorer in ("embedding", "record_embedding"):
                add("remote_asset", "info", f.field, "needs a vector column")
            if p and m.type == "weighted" and p["nulls"] > 0.5 and (f.weight or 0) > 0.3:
                add("weight_confidence", "warning", f.field, "is mostly empty but weighs over 0.3")
    if config.blocking and config.blocking.keys and not any(x["severity"] == "error" for x in out):
        from erspark.operators.blocking import block_stats, key_relation

        ids = df if "__row_id__" in df.columns else df.withColumn("__row_id__", F.monotonically_increasing_id())
        for r in block_stats(key_relation(ids, [k.as_dict() for k in config.blocking.keys])).collect():
            if r.max_size > config.blocking.max_block_size:
                add("block_size", "warning", str(config.blocking.keys[r["pass"]].fields), f"its largest block has {r.max_size} rows")
    return out


def postflight(scored: DataFrame, sizes: DataFrame, threshold: float, strict: bool = False) -> dict:
    """Signals of a run, and a threshold at the valley of scores if it lies 0.05 off and ``strict`` is not set."""
    low = valley(scored)
    p = size_percentiles(sizes).first().asDict()
    overlap = threshold_overlap(scored, threshold).first().overlap
    moved = low if low is not None and abs(low - threshold) > 0.05 and not strict else None
    return {"valley": low, "overlap": overlap, "sizes": p, "oversized": (p["max"] or 0) > 100, "threshold": moved if moved is not None else threshold, "adjusted": moved is not None}


# -- schema matching


def value_overlap(a: DataFrame, b: DataFrame) -> dict[tuple[str, str], float]:
    """The share of distinct values, in lower case, that each column of ``a`` has in common with each of ``b``: of whole tables, by one join on hashes."""
    def cells(d: DataFrame, name: str) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("c"), F.lower(F.col(f"`{c}`").cast("string")).alias("v")) for c in user_columns(d)]
        return d.select(F.explode(F.array(*parts)).alias("e")).filter("e.v is not null").select(F.col("e.c").alias(name), F.xxhash64("e.v").alias("h")).distinct()

    if not user_columns(a) or not user_columns(b):
        return {}
    x, y = materialize(cells(a, "x")), materialize(cells(b, "y"))
    nx, ny = ({r[0]: r[1] for r in d.groupBy(c).count().collect()} for d, c in ((x, "x"), (y, "y")))  # a row a column
    return {(r.x, r.y): r["count"] / (nx[r.x] + ny[r.y] - r["count"]) for r in x.join(y, "h").groupBy("x", "y").count().collect()}


def map_schemas(a: DataFrame, b: DataFrame, least: float = 0.5) -> list[dict]:
    """One-to-one pairs of columns by equal or synonymous names, name likeness, or values in common."""
    overlap = value_overlap(a, b)
    options = []
    for x in user_columns(a):
        for y in user_columns(b):
            u, v = x.lower(), y.lower()
            if u == v:
                s, how = 1.0, "exact"
            elif any(u in g and v in g for g in SYNONYMS):
                s, how = 0.95, "synonym"
            else:
                s, how = difflib.SequenceMatcher(None, u, v).ratio(), "name"
                if u in v or v in u:
                    s = max(s, 0.9 * min(len(u), len(v)) / max(len(u), len(v)))
                if overlap.get((x, y), 0.0) > s:
                    s, how = overlap[x, y], "values"
                if kind_by_name(x) and kind_by_name(x) == kind_by_name(y):
                    s = min(1.0, s + 0.05)
            options.append((s, x, y, how))
    out, used = [], set()
    for s, x, y, how in sorted(options, key=lambda o: (-o[0], o[1], o[2])):
        if s >= least and ("a", x) not in used and ("b", y) not in used:
            used |= {("a", x), ("b", y)}
            out.append({"source": x, "target": y, "score": round(s, 4), "how": how})
    free_b = {c.lower(): c for c in user_columns(b) if ("b", c) not in used}
    parts = [c for c in user_columns(a) if ("a", c) not in used and c.lower() in SYNONYMS[0] | SYNONYMS[1]]
    whole = next((free_b[n] for n in ("full_name", "name", "fullname") if n in free_b), None)
    if len(parts) == 2 and whole:
        out.append({"source": parts, "target": whole, "score": 0.9, "how": "composite"})
    return out


def apply_mapping(df: DataFrame, mapping: list[dict]) -> DataFrame:
    simple = {m["source"]: m["target"] for m in mapping if isinstance(m["source"], str)}
    out = df.withColumnsRenamed(simple)
    for m in mapping:
        if not isinstance(m["source"], str):
            out = out.withColumn(m["target"], F.concat_ws(" ", *m["source"])).drop(*m["source"])
    return out


def select_strategy(df: DataFrame) -> dict:
    """Which way of matching suits a table, with the reason."""
    found = profile(df)
    kinds = {p["kind"] for p in found.values()}
    exact = [c for c, p in found.items() if p["kind"] in ("email", "phone", "identifier") and 0.5 <= p["cardinality"] < 0.99]
    if any(re.search(r"ssn|hash|encrypted|clk", c, re.I) for c in found):
        return {"strategy": "pprl", "why": "a sensitive or encoded column"}
    if {"name", "text"} & kinds:
        return {"strategy": "exact_fuzzy" if exact else "fuzzy", "why": f"text columns{' and keys ' + ', '.join(exact) if exact else ''}"}
    return {"strategy": "exact" if exact else "domain", "why": "keys only" if exact else "neither keys nor names"}
