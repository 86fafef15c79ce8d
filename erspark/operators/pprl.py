"""Privacy-preserving linkage of two parties by Bloom-filter encodings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.functions.transforms import LEVELS, bloom_filter
from erspark.operators.blocking import classes_of, expand
from erspark.operators.components import connected_components
from erspark.plans.runtime import materialize, ship

ID = "__row_id__"
#: Codes of either side that one task compares at once.
TILE = 2048
# fixed values: how useful a field is for linkage
#: By share of distinct values, from the highest: those above a bound get its score.
DISTINCT = ((0.95, 0.0), (0.8, 0.3), (0.1, 0.8), (0.02, 0.5), (-1.0, 0.1))
#: Weights of that score, of shortness and of being filled, the length that counts as long, and what is taken off.
WEIGHTS, FULL_LENGTH = {"distinct": 0.4, "short": 0.3, "filled": 0.3}, 50
OFF = {"id": 0.5, "mostly empty": 0.3, "long": 0.2}
EMPTY, LONG = 0.5, 15
ID_PARTS = ("_id", "reg_num", "rec_id", "key", "code_id")
PERSON = {"first_name": 0.3, "last_name": 0.3, "given_name": 0.3, "surname": 0.3, "zip": 0.2, "postcode": 0.2, "birth_year": 0.2, "dob": 0.2, "gender": 0.2, "phone": 0.15, "email": 0.15, "ssn": 0.15}


def _text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))


def encode(df: DataFrame, columns: list[str], level: str = "high", key: str | None = None, id_col: str = ID, n: int | None = None, k: int | None = None, bits: int | None = None) -> DataFrame:
    """``(id, clk)``: filled columns joined by a space, encoded once a record; keyed only if a key is given."""
    ln, lk, lbits, _ = LEVELS[level]
    return df.select(F.col(id_col).alias("id"), bloom_filter(_text(columns), n or ln, k or lk, bits or lbits, key, level == "paranoid" and key is not None).alias("clk"))


def link(a: DataFrame, b: DataFrame, columns: list[str], threshold: float = 0.85, level: str = "high", key: str | None = None, metric: str = "dice", protocol: str = "trusted", block: list[str] | None = None, id_col: str = ID) -> DataFrame:
    """``(id_a, id_b, score)`` of pairs at or above the threshold; protocol ``smc`` hides scores behind the threshold.

    Without ``block`` every record of a meets every record of b, which is what the protocol
    asks for; with it only records of equal (agreed, encoded) block keys meet. Records alike in block and fields are encoded
    and compared once; codes meet in tiles, whose shared bits are one product of matrices, and pairs of records are made last.
    """
    ship(a.sparkSession)
    k = F.sha2(F.lower(F.concat_ws("|", *block)), 256) if block else F.lit("")
    sides = [_codes(d, columns, level, key, id_col, k) for d in (a, b)]
    tiles = [c.groupBy("k").agg(F.ceil(F.count("*") / TILE).cast("int").alias(f"n_{s}")) for c, s in zip(sides, "ab")]
    grid = materialize(tiles[0].join(tiles[1], "k"))
    own = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sides[0].join(grid, "k").select("k", "c", "code", own("n_a").alias("i"), every("n_b").alias("j"))
    right = sides[1].join(grid, "k").select("k", "c", "code", own("n_b").alias("j"), every("n_a").alias("i"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            wide = max(map(len, [*x["code"], *y["code"]]))
            bits = lambda s: np.unpackbits(np.frombuffer(b"".join(v.ljust(wide, b"\0") for v in s), np.uint8).reshape(len(s), wide), axis=1).astype(np.float32)
            p, q, ci, cj = bits(x["code"]), bits(y["code"]).T.copy(), x["c"].to_numpy(), y["c"].to_numpy()
            np_, nq = p.sum(axis=1, dtype=np.float64), q.sum(axis=0, dtype=np.float64)
            for at in range(0, len(p), 256):
                both = (p[at:at + 256] @ q).astype(np.float64)  # sums of ones, exact
                all_ = np_[at:at + 256, None] + nq
                top, under = (2.0 * both, all_) if metric == "dice" else (both, all_ - both)
                score = np.divide(top, under, out=np.zeros_like(both), where=under > 0)
                row, col = np.nonzero(score >= threshold)
                out[0].append(np.stack([ci[at + row], cj[col]], axis=1))
                out[1].append(score[row, col])
        both = np.concatenate(out[0])
        return pd.DataFrame({"c_a": both[:, 0], "c_b": both[:, 1], "score": np.concatenate(out[1])})

    near = left.groupBy("k", "i", "j").cogroup(right.groupBy("k", "i", "j")).applyInPandas(meet, "c_a long, c_b long, score double")
    ids = lambda d, s: d.select(F.col("c").alias(f"c_{s}"), F.col("ids").alias(f"ids_{s}"))
    found = near.join(ids(sides[0], "a"), "c_a").join(ids(sides[1], "b"), "c_b").select("ids_a", "ids_b", "score")
    # few rows stand for many pairs, so they are dealt out before those are made
    out = expand(found.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))), True)
    return out.withColumn("score", F.lit(float(threshold))) if protocol == "smc" else out


def _codes(d: DataFrame, columns: list[str], level: str, key: str | None, id_col: str, k: Column) -> DataFrame:
    """``(c, k, code, ids)``: records of one block key and text are one class, which is encoded once."""
    rows = d.select(F.col(id_col).alias("id"), _text(columns).alias("text"), k.alias("k"))
    made = classes_of(rows, [{"fields": ["k"], "transforms": []}], ["text"], "id").select("c", F.col("ks")[0].alias("k"), F.col("r.text").alias("text"), "ids")
    clk = encode(made, ["text"], level, key, "c").withColumnRenamed("id", "c")
    return materialize(made.drop("text").join(clk, "c").select("c", "k", F.unhex("clk").alias("code"), "ids"))


def linked_clusters(pairs: DataFrame) -> DataFrame:
    """``(cluster, party, id)``: components over both parties' records, told apart by the lowest bit of a joint id."""
    joint = pairs.select((F.col("id_a") * 2).alias("id_a"), (F.col("id_b") * 2 + 1).alias("id_b"))
    return connected_components(joint).select(F.col("component").alias("cluster"), F.when(F.col("node") % 2 == 0, "a").otherwise("b").alias("party"), F.floor(F.col("node") / 2).cast("long").alias("id"))


def field_profiles(df: DataFrame) -> DataFrame:
    """``(column, avg_length, cardinality, nulls, usefulness)`` of the string columns that hold anything.

    One aggregation gives a row of measures a column; the table of scores above is applied to them as an expression.
    """
    names = [c for c, t in df.dtypes if t == "string" and not c.startswith("__")]
    measures = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count(F.col(f"`{c}`")).alias("filled"), F.avg(F.length(F.col(f"`{c}`"))).alias("avg_length"),
                         F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias("distinct")) for c in names]
    if not measures:
        return df.sparkSession.createDataFrame([], "column string, avg_length double, cardinality double, nulls double, usefulness double")
    rows = df.agg(F.array(*measures).alias("m")).select(F.explode("m").alias("m")).select("m.*").filter("filled > 0").select(
        "column", "avg_length", (F.col("distinct") / F.col("n")).alias("cardinality"), (1 - F.col("filled") / F.col("n")).alias("nulls"))
    band = F.lit(None).cast("double")
    for bound, points in reversed(DISTINCT):
        band = F.when(F.col("cardinality") > bound, points).otherwise(band)
    low = F.lower("column")
    flag = lambda condition, points: F.when(condition, points).otherwise(0.0)
    off = (flag(low.rlike("|".join(ID_PARTS)), OFF["id"]) + flag(F.col("nulls") > EMPTY, OFF["mostly empty"]) + flag(F.col("avg_length") > LONG, OFF["long"]))
    plain = (WEIGHTS["distinct"] * band + WEIGHTS["short"] * F.greatest(F.lit(0.0), 1 - F.col("avg_length") / FULL_LENGTH) + WEIGHTS["filled"] * (1 - F.col("nulls")))
    known = F.coalesce(F.create_map(*(F.lit(x) for pair in PERSON.items() for x in pair))[low], F.lit(0.0))
    return rows.withColumn("usefulness", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), plain - off) + known), 4))


def profile_fields(df: DataFrame) -> list[dict]:
    """``field_profiles``, the most useful first: a row a column."""
    return [r.asDict() for r in field_profiles(df).orderBy(F.desc("usefulness"), "column").collect()]


def auto_configure(a: DataFrame, b: DataFrame, sample: int = 200) -> dict:
    """The four most useful fields both have, and a threshold above nearly all sampled pairs, from 0.85 to 0.95."""
    both = [p["column"] for p in profile_fields(a) if p["usefulness"] > 0.3 and p["column"] in b.columns][:4]
    ids = lambda d: d if ID in d.columns else d.withColumn(ID, F.monotonically_increasing_id())
    few = [ids(d).orderBy(F.xxhash64(*both)).limit(sample) for d in (a, b)]
    s = link(*few, both, 0.0).agg(F.percentile_approx("score", [0.97, 0.99], 100_000).alias("p")).first().p if both else None
    return {"columns": both, "threshold": min(0.95, max(0.85, sum(s) / 2)) if s else 0.85, "level": "high"}
