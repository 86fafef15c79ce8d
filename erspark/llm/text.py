"""Expressions on whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.plans.runtime import fresh

#: White space between words.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs, never null, that name a row by its id and text: equal rows share them."""
    return [F.xxhash64(F.lit(salt), doc_id, text).alias(name) for salt, name in ((11, "__k1"), (13, "__k2"))]


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``df`` for which ``condition`` holds.

    A plain filter would be pushed below the projections that make its columns, with all of
    their expressions copied into it; a generator that makes one row or none stays where it is.
    """
    one = fresh(df, "one")[0]
    return df.withColumn(one, F.explode(F.when(condition, F.array(F.lit(1))))).drop(one)


#: The column that holds a whole row of the input while an operator works.
ROW = "__row"


def packed(df: DataFrame, **columns: str | Column) -> DataFrame:
    """``df`` as one column, ROW, and ``columns`` of it under names of the operator's own: nothing an operator
    adds can meet a column of the input, whatever that is called."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW) if df.columns else F.struct(F.lit(1)).alias(ROW),
                     *((F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def unpacked(done: DataFrame, like: DataFrame, **outputs: str | Column) -> DataFrame:
    """The rows that ``packed`` wrapped, with ``outputs``; a column of ``like`` whose name is that of an output, in
    whatever case, is replaced in its place."""
    by_name = {n.lower(): n for n in outputs}
    at = lambda n: (F.col(outputs[n]) if isinstance(outputs[n], str) else outputs[n]).alias(n)
    out = [at(by_name.pop(c.lower())).alias(c) if c.lower() in by_name else F.col(f"{ROW}.`{c}`").alias(c) for c in like.columns]
    return done.select(*out, *(at(n) for n in by_name.values()))


#: Most bits of a broadcast bitmap (8 MB), in pages of PAGE, and bits that a key is given below that.
BITMAP, PAGE, BITS_A_KEY = 1 << 26, 32768, 32


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` (of ``packed``) with ``maybe``: false only where ``key``, a hash, is not among the ``n`` of ``keys``.

    What few rows need is joined to those few: a bitmap of the keys, of BITMAP bits at most whatever the corpus, is
    broadcast, and rows that it rules out need no shuffle. Rows that it lets through in vain merely take the longer way, so
    results are the same however full it gets.
    """
    bits = min(BITMAP, max(PAGE, 1 << (n * BITS_A_KEY).bit_length()))
    place = F.pmod(key, F.lit(bits))
    pages = keys.select(F.floor(place / PAGE).cast("int").alias("page"), (place % PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(place % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, int(pmod(`{key}`, {bits}L) % 8))")) > 0, F.lit(False))
    return rows.withColumn("page", F.floor(place / PAGE).cast("int")).join(F.broadcast(pages), "page", "left").withColumn("maybe", hit).drop("page", "map")
