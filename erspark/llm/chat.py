"""Chat formatting: preference pairs with their longest common turn prefix rendered once.

``format_preferences`` takes chosen and rejected conversations as arrays of turns. Turns that
both begin with make the prompt; what follows is rendered for each side, with the spans, in
code points of the completion, that a loss covers: text and end mark of assistant turns.

Defined cases: null roles and texts are empty, null conversations have no turns; if one
conversation begins with the other, the shorter's completion is empty, and both are if they are equal;
repeated turns are kept, in the order of turn, role and text; input columns named like an output are replaced, and no other
column is touched, whatever its name; turns of any length are rendered whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.llm.text import packed, unpacked
from erspark.plans.runtime import join_split_hot, materialize

TURN = "array<struct<role:string,text:string>>"


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))


def _mask(turns: Column) -> Column:
    """Spans of assistant text and end mark in the rendered turns."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["pos"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + 7
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("pos"), F.when(t["role"] == "assistant", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, add, lambda acc: acc["out"])


def format_preferences(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``df`` with n_prompt_turns, prompt, and text and mask of both completions."""
    none = F.array().cast(TURN)
    clean = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = packed(df, a=clean(chosen), b=clean(rejected))
    n = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    rows = rows.withColumn("n", F.when(first > 0, first - 1).otherwise(n).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(0)))
    rows = rows.withColumns({"p": F.slice("a", 1, F.col("n")), "a": rest("a"), "b": rest("b")})
    text = lambda c: F.array_join(_rendered(F.col(c)), "")
    return unpacked(rows, df, n_prompt_turns="n", prompt=text("p"), chosen_text=text("a"), chosen_mask=_mask(F.col("a")), rejected_text=text("b"), rejected_mask=_mask(F.col("b")))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``(conv_id, chosen_id, kind, chosen, rejected)`` of a table of turns.

    Conversations that open with the same turn compete: the one of most turns (ties: the
    smallest id) is chosen over each other, kind ``shared``. One that is alone, or the chosen itself, is
    chosen over itself with its last assistant text cut to half, kind ``truncated``; without an assistant turn
    it is paired with itself, kind ``none``.
    """
    convs = materialize(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.xxhash64(F.lit(3), F.col("t")[0]["role"], F.col("t")[0]["text"]).alias("f1"), F.xxhash64(F.lit(5), F.col("t")[0]["role"], F.col("t")[0]["text"]).alias("f2")))
    best = convs.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.max_by(F.struct("conv_id", "turns"), F.struct(F.size("turns"), -F.col("conv_id"))).alias("best"))
    best = materialize(best)
    total = best.agg(F.sum("n")).first()[0] or 0
    both = join_split_hot(convs, best, ["f1", "f2"], None, total)
    own = F.col("conv_id").eqNullSafe(F.col("best.conv_id"))
    replies = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))
    last = F.array_max(replies)
    half = F.transform("turns", lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int")).alias("text"))).otherwise(t))
    return both.select("conv_id", F.when(own, F.col("conv_id")).otherwise(F.col("best.conv_id")).alias("chosen_id"),
                       F.when(~own, "shared").when(last.isNotNull(), "truncated").otherwise("none").alias("kind"),
                       F.when(own, F.col("turns")).otherwise(F.col("best.turns")).alias("chosen"),
                       F.when(own & last.isNotNull(), half).otherwise(F.col("turns")).alias("rejected"))


def op7(spark, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return format_preferences(pairs).select("conv_id", "chosen_id", "kind", "n_prompt_turns", "prompt", "chosen_text", spans("chosen_mask"), "rejected_text", spans("rejected_mask"))


OP7_SQL = """
WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
o AS (SELECT *, first_value(conv_id) OVER w AS best, first_value(turns) OVER w AS best_turns FROM c
      WINDOW w AS (PARTITION BY turns[1] ORDER BY len(turns) DESC, conv_id)),
l AS (SELECT *, list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i END)) AS last FROM o),
p AS (SELECT conv_id, best AS chosen_id, CASE WHEN conv_id <> best THEN 'shared' WHEN last IS NOT NULL THEN 'truncated' ELSE 'none' END AS kind,
        best_turns AS a, CASE WHEN conv_id = best AND last IS NOT NULL THEN list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN i = last
          THEN struct_pack(role := turns[i].role, text := left(turns[i].text, length(turns[i].text) // 2)) ELSE turns[i] END) ELSE turns END AS b FROM l),
k AS (SELECT *, coalesce(list_min(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] IS DISTINCT FROM b[i] THEN i END)) - 1, least(len(a), len(b))) AS n FROM p),
s AS (SELECT *, a[n + 1:] AS ra, b[n + 1:] AS rb FROM k),
m AS (SELECT *, list_transform(ra, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ta,
        list_transform(rb, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS tb FROM s),
q AS (SELECT *, list_transform(range(1, len(ra) + 1), lambda i: coalesce(list_sum(list_transform(ta[1:i - 1], lambda x: length(x))), 0) + length(ra[i].role) + 5) AS pa,
        list_transform(range(1, len(rb) + 1), lambda i: coalesce(list_sum(list_transform(tb[1:i - 1], lambda x: length(x))), 0) + length(rb[i].role) + 5) AS pb FROM m)
SELECT conv_id, chosen_id, kind, CAST(n AS INTEGER) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(a[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(ta, ''), '') AS chosen_text,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(ra) + 1), lambda i: CASE WHEN ra[i].role = 'assistant' THEN CAST(pa[i] AS BIGINT) || ':' || CAST(pa[i] + length(ra[i].text) + 7 AS BIGINT) END), lambda x: x IS NOT NULL), ','), '') AS chosen_mask,
  coalesce(array_to_string(tb, ''), '') AS rejected_text,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(rb) + 1), lambda i: CASE WHEN rb[i].role = 'assistant' THEN CAST(pb[i] AS BIGINT) || ':' || CAST(pb[i] + length(rb[i].text) + 7 AS BIGINT) END), lambda x: x IS NOT NULL), ','), '') AS rejected_mask
FROM q
"""
