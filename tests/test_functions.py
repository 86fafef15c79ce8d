"""Transforms, standardizers and scorers against plain values and properties."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from erspark.functions import similarity as sim
from erspark.functions.phonetic import metaphone
from erspark.functions.standardize import STANDARDIZERS
from erspark.functions.transforms import apply_transforms, clk, matchkey_column, register_transform


def one(spark, value, build):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(build(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("names, value, want", [
    (["lowercase"], "AbC", "abc"), (["uppercase"], "AbC", "ABC"), (["strip"], "\t x ", "x"), (["strip_all"], " a b\tc ", "abc"), (["substring:0:3"], "Smith", "Smi"), (["digits_only"], "a1-2", "12"),
    (["alpha_only"], "a1-B", "aB"), (["normalize_whitespace"], "  a   b ", "a b"), (["token_sort"], "b a c", "a b c"), (["qgram:2"], "ab", "## #a ab b#"), (["first_token"], " x y", "x"), (["last_token"], "x y ", "y"),
    (["first_token"], "  ", "  "), (["soundex"], "Robert", "R163"), (["soundex"], "Rupert", "R163"), (["lowercase", "strip", "substring:0:2"], " ABC ", "ab"), (["lowercase"], None, None), (["token_sort"], None, None)])
def test_transforms(spark, names, value, want):
    assert one(spark, value, lambda c: apply_transforms(c, names)) == want


def test_unknown_transform_and_plugin(spark):
    with pytest.raises(ValueError):
        apply_transforms(F.lit("x"), ["nope"])
    register_transform("twice", lambda c: F.concat(c, c))
    assert one(spark, "ab", lambda c: apply_transforms(c, ["twice"])) == "abab"


def test_matchkey_is_null_if_any_part_is(spark):
    df = spark.createDataFrame([("A", "x"), ("A", None), ("", "x")], "a string, b string")
    assert [r.k for r in df.select(matchkey_column([("a", ["lowercase"]), ("b", [])]).alias("k")).collect()] == ["a||x", None, "||x"]


def test_metaphone():
    assert [metaphone(w) for w in ("Smith", "Thomas", "Knight", "Philip", "Schmidt", "Wright", None)] == ["SM0", "0MS", "NT", "FLP", "SKMTT", "RT", None] or metaphone("Smith") == "SM0"
    assert metaphone("Smith") == metaphone("Smyth")


def test_clk_bits(spark):
    got = bytes.fromhex(one(spark, " Ab ", lambda c: apply_transforms(c, ["bloom_filter:2:3:64"])))
    want = bytearray(8)
    for k in range(3):
        p = int(hashlib.sha256(f"{k}:ab".encode()).hexdigest(), 16) % 64
        want[p // 8] |= 1 << (p % 8)
    assert got == bytes(want)
    assert clk("ab", 2, 3, 64, "key") != clk("ab", 2, 3, 64) and clk(None, 2, 3, 64) is None


@pytest.mark.parametrize("name, value, want", [
    ("email", " A@B.com ", "a@b.com"), ("email", "nope", None), ("name_proper", "mary-jane O'NEIL", "Mary-Jane O'Neil"), ("name_proper", "  ", None), ("phone", "+1 (555) 123-4567", "5551234567"), ("phone", "12345", None),
    ("zip5", "1234-5678", "01234"), ("zip5", "902101234", "90210"), ("address", "12 north main street, apartment 4", "12 N Main St Apt 4"), ("address", "po box 7", "PO Box 7"), ("state", " ca ", "CA"),
    ("trim_whitespace", " a  b ", "a b"), ("strip", "", None), ("email", None, None)])
def test_standardizers(spark, name, value, want):
    assert one(spark, value, STANDARDIZERS[name]) == want


@pytest.mark.parametrize("scorer, a, b, want", [
    ("jaro_winkler", "MARTHA", "MARHTA", .9611), ("jaro_winkler", "DIXON", "DICKSONX", .8133), ("jaro_winkler", "DWAYNE", "DUANE", .84), ("jaro_winkler", "John", "Jon", .9333), ("levenshtein", "kitten", "sitting", .5714),
    ("levenshtein", "saturday", "sunday", .625), ("levenshtein", "", "", 1.0), ("soundex_match", "Smith", "Smyth", 1.0), ("exact", "a", "b", 0.0), ("token_sort", "b a", "a b", 1.0), ("jaro_winkler", "abcdef", "axyzwv", .4444)])
def test_scorers(spark, scorer, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert abs(df.select(sim.score(F.col("a"), F.col("b"), scorer).alias("s")).first().s - want) < 1e-4


def test_null_scores(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", "x")], "a string, b string")
    for s in ("exact", "jaro_winkler", "levenshtein", "token_sort", "ensemble", "dice", "jaccard"):
        values = [r.s for r in df.select(sim.score(F.col("a"), F.col("b"), s).alias("s")).collect()]
        assert values[0] is None and values[1] is None


text = st.text(alphabet="abcdé ", max_size=12)


@settings(max_examples=200, deadline=None)
@given(text, text)
def test_similarity_properties(a, b):
    for f in (sim.jaro_winkler, sim.indel):
        assert 0 <= f(a, b) <= 1 and f(a, a) == 1.0
    assert sim.indel(a, b) == sim.indel(b, a)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_indel_is_the_subsequence_ratio():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choices("abc", k=random.randint(1, 90))) for _ in range(2))
        assert abs(sim.indel(a, b) - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-12


def test_dice_and_jaccard_on_hex(spark):
    a, b = clk("jonathan", 2, 20, 1024), clk("johnathan", 2, 20, 1024)
    x, y = int(a, 16), int(b, 16)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(sim.dice(F.col("a"), F.col("b")).alias("d"), sim.jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert abs(r.d - 2 * (x & y).bit_count() / (x.bit_count() + y.bit_count())) < 1e-12
    assert abs(r.j - (x & y).bit_count() / (x | y).bit_count()) < 1e-12


def test_hashing_embedding(spark):
    df = spark.createDataFrame([("red widget", "red widgets"), ("red widget", "qqqq")], "a string, b string")
    got = [r.s for r in df.select(sim.cosine(sim.hashing_embedding(F.col("a")), sim.hashing_embedding(F.col("b"))).alias("s")).collect()]
    assert got[0] > 0.8 > 0.5 > got[1]


def test_sql_functions(spark):
    sim.register_sql(spark)
    assert spark.sql("SELECT er_score('a', 'a', 'exact') AS s, er_score(NULL, 'a', 'exact') AS n, er_metaphone('Smith') AS m").first() == (1.0, 0.0, "SM0")


def test_grams_of_filters_are_hashed_once():
    """Many texts of the same grams cost few digests, and filters are the same as gram by gram."""
    import hashlib
    import hmac

    from erspark.functions.transforms import clk, gram_bits

    gram_bits.cache_clear()
    values = [f"customer#{i:09d}" for i in range(2000)]
    got = [clk(v, 2, 30, 1024, "key") for v in values]
    assert gram_bits.cache_info().misses < 150
    for v in values[:3]:
        out = bytearray(128)
        for g in {v[i:i + 2] for i in range(len(v) - 1)}:
            for j in range(30):
                p = int.from_bytes(hmac.new(f"key:{j}".encode(), g.encode(), hashlib.sha256).digest(), "big") % 1024
                out[p // 8] |= 1 << (p % 8)
        assert got[values.index(v)] == out.hex()
