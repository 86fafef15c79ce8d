"""Secret scans: spans of known kinds, and long mixed strings judged by corpus-wide ownership.

Base spans come from three patterns. Other candidates (long strings mixing digits with
letters of both cases, or with a known prefix) are hashed, and each hash is counted over
distinct repositories and owners: a value of at most ``max_owners`` owners and ``max_repos``
repositories looks like somebody's own credential and is added as kind ``owned``; one that more
owners have, or that lies about in more repositories (of one owner, or of none that is known), is a widely copied
example. Base values get the same verdict, but their spans stay whichever it is. Only hashes of values are
written to the shared folder, never a value.

Defined cases: a null text is empty; null owners or repositories count as one; rows that
repeat id and text get the same spans; spans are in code points, end exclusive, sorted by start and then kind;
texts of any length and number of matches are worked through whole, in blocks, at a cost in proportion; an empty table
gives an empty one; ``redact_secrets`` touches no column but the text, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.llm.text import maybe_in, packed, row_key, unpacked
from erspark.plans.runtime import join_split_hot, materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group that holds the value, least length of it)
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OWNED = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}"
#: What an owned candidate must hold besides its length.
MIXED = r"^(?:gh[pousr]_|xox[abprs]-|AIza|sk-)|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: A value of more owners, or of more repositories, is an example.
MAX_OWNERS, MAX_REPOS = 2, 16
PLACEHOLDER = "<secret>"
#: Spans gathered, and characters cut, at once.
SOME, BLOCK = 256, 4096
SPAN = "struct<start:int,o:int,kind:string,end:int,h1:bigint,h2:bigint>"


def _gather(items: Column, state: Column, step, kind: str) -> Column:
    """The elements that ``step(state, item)`` = (next state, keep, element) keeps, in order; they are gathered in
    blocks, since an array that grows by one element is copied each time."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("s"), none.alias("some"), F.array().cast(f"array<array<{kind}>>").alias("all"))

    def add(acc: Column, x: Column) -> Column:
        after, keep, element = step(acc["s"], x)
        full = F.size(acc["some"]) >= SOME
        one = F.array(element)
        return F.struct(after.alias("s"), F.when(~keep, acc["some"]).when(full, one).otherwise(F.concat(acc["some"], one)).alias("some"),
                        F.when(keep & full, F.concat(acc["all"], F.array(acc["some"]))).otherwise(acc["all"]).alias("all"))

    return F.aggregate(items, start, add, lambda acc: F.concat(F.flatten(acc["all"]), acc["some"]))


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int, more: str | None = None) -> Column:
    """array<SPAN> of leftmost non-overlapping matches, values as two hashes."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
                        values, lambda x, v: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), v.alias("v")))

    def step(pos: Column, x: Column):
        start = pos + x["g"]
        good = F.length(x["v"]) >= least
        if more:
            good = good & x["v"].rlike(more)
        return start + x["m"], good, F.struct(start.alias("start"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), (start + x["m"]).alias("end"),
                                              F.xxhash64(F.lit(3), x["v"]).alias("h1"), F.xxhash64(F.lit(5), x["v"]).alias("h2"))

    maybe = text.contains("AKIA") if kind == "access" else text.rlike(pattern)
    return F.when(maybe, _gather(zipped, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(base: Column, more: Column) -> Column:
    """Spans of ``more``, which overlap no other of it, that overlap none of ``base``.

    In the order of starts a span of ``base`` that begins within one of ``more`` follows it at once, and one that began
    before reaches into it if the furthest end so far does.
    """
    both = F.array(F.sort_array(F.concat(base, more)))  # an array of one element lets the sorted array be made once
    paired = F.transform(both, lambda b: F.transform(b, lambda x, i: F.struct(x.alias("x"), F.get(b, i + 1).alias("next"))))[0]

    def step(reach: Column, p: Column):
        x, own = p["x"], p["x"]["kind"] == "owned"
        hit = (reach > x["start"]) | (F.coalesce(p["next"]["kind"] != "owned", F.lit(False)) & (p["next"]["start"] < x["end"]))
        return F.when(own, reach).otherwise(F.greatest(reach, x["end"])), own & ~hit, x

    return F.when(F.size(base) == 0, more).otherwise(_gather(paired, F.lit(0), step, SPAN))


def scan(text: Column) -> tuple[Column, Column]:
    """Spans of the known kinds, and candidates; ``_apart`` takes those that overlap none of the former."""
    t = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*(_spans(t, o, *k) for o, k in enumerate(KINDS)))), _spans(t, len(KINDS), "owned", OWNED, 0, 20, MIXED)


def ownership(candidates: DataFrame) -> DataFrame:
    """``(h1, h2, n, n_repos, n_owners)`` of ``(h1, h2, repo, owner)``; each step aggregates before it shuffles."""
    by_repo = candidates.groupBy("h1", "h2", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("h1", "h2", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
    return by_owner.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source",
                 max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row for each row of ``df``: ``(__k1, __k2, doc_id, base, spans, n_live, n_examples)``.

    ``base`` and ``spans`` are array<struct<start, o, kind, end>>; n_live and n_examples count
    candidates, base ones too, by verdict. Without a column ``repo`` equal texts are one repository: copies of a file
    are forks of it.
    """
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    base, more = scan(F.col(text))
    home = F.xxhash64(F.lit(7), text) if repo is None else F.xxhash64(F.lit(7), F.col(repo).cast("string"))
    read = df.select(k1, k2, F.col(doc_id).alias("doc_id"), home.alias("repo"), F.col(owner).cast("string").alias("owner"), base.alias("base"), more.alias("more"))
    found = materialize(read.withColumn("more", _apart(F.col("base"), F.col("more"))))
    tagged = found.select("__k1", "__k2", "repo", "owner", F.explode(F.concat(
        F.transform("base", lambda x: F.struct(F.lit(True).alias("base"), x.alias("s"))),
        F.transform("more", lambda x: F.struct(F.lit(False).alias("base"), x.alias("s"))))).alias("c"))
    each = tagged.select("__k1", "__k2", "repo", "owner", "c.base", "c.s", F.col("c.s.h1").alias("h1"), F.col("c.s.h2").alias("h2"))
    owners = materialize(ownership(each.select("h1", "h2", "repo", "owner")))
    total = owners.agg(F.sum("n")).first()[0] or 0
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = join_split_hot(each, owners, ["h1", "h2"], None, total)
    by_row = judged.groupBy("__k1", "__k2").agg(
        F.collect_set(F.when(live & ~F.col("base"), F.struct("s.start", "s.o", "s.kind", "s.end"))).alias("owned"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_examples"))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["o"].alias("o"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = found.select("__k1", "__k2", "doc_id", bare("base").alias("base"))
    out = rows.join(by_row, ["__k1", "__k2"], "left")
    none = F.array().cast("array<struct<start:int,o:int,kind:string,end:int>>")
    return out.select("__k1", "__k2", "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("owned", none))).alias("spans"),
                      F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_examples", F.lit(0)).cast("bigint").alias("n_examples"))


def redact_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", placeholder: str = PLACEHOLDER, **how) -> DataFrame:
    """``df`` with all spans of ``text`` (overlapping ones merged) replaced."""
    spans = materialize(scan_secrets(df, doc_id, text, **how).filter(F.size("spans") > 0).dropDuplicates(["__k1", "__k2"]).select("__k1", "__k2", "spans"))
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    marked = maybe_in(packed(df, __k1=k1, __k2=k2, text=text), "__k1", spans, spans.count())
    # only texts with a span are shuffled
    rows = marked.filter("maybe").join(spans, ["__k1", "__k2"], "left")
    # what stays between spans; a span that the reach of earlier ones holds leaves nothing behind, not even a placeholder
    piece = "struct<a:int,b:int>"

    def step(pos: Column, s: Column):
        return F.greatest(pos, s["end"]), s["start"] >= pos, F.struct(pos.alias("a"), s["start"].alias("b"))

    gaps = _gather(F.col("spans"), F.lit(0), step, piece)
    last = F.struct(F.array_max(F.transform("spans", lambda s: s["end"])).alias("a"), F.length("text").alias("b"))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))  # a substring is counted from the start of its text

    def cut(bs: Column, g: Column) -> Column:
        first = F.floor(g["a"] / BLOCK).cast("int")
        part = F.slice(bs, first + 1, F.greatest(F.ceil(g["b"] / BLOCK).cast("int") - first, F.lit(0)))
        begin = lambda i: F.greatest(g["a"] - (first + i) * BLOCK, F.lit(0))
        return F.array_join(F.transform(part, lambda b, i: F.substring(b, begin(i) + 1, F.greatest(g["b"] - (first + i) * BLOCK - begin(i), F.lit(0)))), "")

    clean = F.transform(F.array(blocks), lambda bs: F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda g: cut(bs, g)), placeholder))[0]
    return unpacked(marked.filter("not maybe"), df).unionByName(unpacked(rows, df, **{text: F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text"))}))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan_secrets(docs).select("doc_id", *(of(k[0]) for k in KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                                     written(F.col("spans")).alias("spans"), "n_live", "n_examples")
