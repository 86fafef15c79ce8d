"""Similarity of two string columns, 0 to 1, null if either is null.

Built-in expressions where Spark has them; Jaro-Winkler and the Indel ratio run as Arrow
functions over matrices of letters that score all distinct pairs of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erspark.functions.transforms import soundex, tokens
from erspark.plans.runtime import ship

PLUGINS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(name: str, build: Callable[[Column, Column], Column]) -> None:
    PLUGINS[name] = build


def jaro_winkler(a: str, b: str) -> float:
    """Prefix weight 0.1 over up to 4 characters, where Jaro is above 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    used, mine = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    k = len(mine)
    if not k:
        return 0.0
    theirs = [b[j] for j in range(m) if used[j]]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (k / n + k / m + (k - moved) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def indel(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), the subsequence by bit-parallel rows."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


#: Cells of the matrices that pairs of strings are compared in, at once.
CELLS = 1 << 16


def letters(strings: list[str], width: int) -> np.ndarray:
    """Code points, a row for each string, filled up with zeros."""
    return np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width).copy()


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs: one step over all pairs for each letter of the longest."""
    la, lb = np.array([*map(len, a)]), np.array([*map(len, b)])
    wa, wb = max(1, int(la.max())), max(1, int(lb.max()))
    x, y, rows = letters(a, wa), letters(b, wb), np.arange(len(a))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    far, place, even = int(reach.max()), np.arange(wb), bool((reach == reach[0]).all())
    # past its end a string has a mark that no string has, each side another
    x[np.arange(wa) >= la[:, None]], y[place >= lb[:, None]] = 0xFFFFFFFF, 0xFFFFFFFE
    free, mine = np.ones((len(a), wb), bool), np.zeros((len(a), wa), bool)
    for i in range(wa):
        lo, hi = max(0, i - far), min(wb, i + far + 1)
        if lo >= hi:
            break
        fits = y[:, lo:hi] == x[:, i:i + 1]
        fits &= free[:, lo:hi]
        if not even:
            fits &= np.abs(place[lo:hi] - i) <= reach[:, None]
        at = fits.argmax(axis=1)
        hit = fits[rows, at]
        free[rows, at + lo] &= ~hit
        mine[:, i] = hit
    k = mine.sum(axis=1)
    most = max(1, int(k.max()))
    in_order = lambda m, flags: np.take_along_axis(m, np.argsort(~flags, axis=1, kind="stable")[:, :most], axis=1)
    moved = ((in_order(x, mine) != in_order(y, ~free)) & (np.arange(most) < k[:, None])).sum(axis=1) // 2
    safe = np.maximum(k, 1)
    jaro = np.where(k > 0, (k / np.maximum(la, 1) + k / np.maximum(lb, 1) + (k - moved) / safe) / 3, 0.0)
    n = min(4, wa, wb)
    prefix = np.cumprod(x[:, :n] == y[:, :n], axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return np.where((la == lb) & (la == 0), 1.0, out)


def indel_many(a: list[str], b: list[str]) -> np.ndarray:
    """``indel`` of many pairs whose shorter strings have at most 64 letters, a bit each."""
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    ls, ll = np.array([*map(len, short)]), np.array([*map(len, long)])
    x, y = letters(short, 64), letters(long, max(1, int(ll.max())))
    full = np.where(ls >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(ls, 63).astype(np.uint64)) - np.uint64(1))
    state = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(int(ll.max())):
        here = np.packbits(x == y[:, j:j + 1], axis=1, bitorder="little").view("<u8").ravel() & full
        met = state & here
        state = np.where(j < ll, (state + met) | (state - met), state)
    common = ls - np.bitwise_count(state & full)
    return np.where(ls + ll == 0, 1.0, 2 * common / np.maximum(ls + ll, 1))


def _many(score: Callable[[str, str], float], together: Callable, most: int | None = None) -> Callable[[list, list], np.ndarray]:
    """Scores of lists of pairs, those of like length together; pairs whose shorter string is above ``most`` one by one."""
    def run(a: list[str], b: list[str]) -> np.ndarray:
        size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
        alone = np.array([most is not None and min(len(x), len(y)) > most for x, y in zip(a, b)], bool)
        out = np.zeros(len(a))
        out[alone] = [score(a[i], b[i]) for i in np.flatnonzero(alone)]
        order = np.flatnonzero(~alone)
        order = order[np.argsort(size[order], kind="stable")]
        at = 0
        while at < len(order):
            n = int(max(1, min(len(order) - at, CELLS // max(64, int(size[order[at]]) * 2))))
            while n > 1 and n * int(size[order[at + n - 1]]) > CELLS:
                n //= 2
            some = order[at:at + n]
            out[some] = together([a[i] for i in some], [b[i] for i in some])
            at += n
        return out

    return run


def _arrow(many: Callable[[list, list], np.ndarray]) -> Callable[[Column, Column], Column]:
    def build(a: Column, b: Column) -> Column:
        ship()

        @F.pandas_udf(T.DoubleType())
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            (i, u), (j, v) = pd.factorize(x), pd.factorize(y)
            pair, back = np.unique(i.astype(np.int64) * max(1, len(v)) + j, return_inverse=True)
            if not len(pair):
                return pd.Series([], dtype="float64")
            return pd.Series(many([u[k] for k in pair // len(v)], [v[k] for k in pair % len(v)])[back])

        # the function gets no null, so its own nulls can't turn into NaN
        return F.when(a.isNotNull() & b.isNotNull(), run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))

    return build


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def hex_words(c: Column) -> Column:
    """A hex string as numbers of 60 bits each; made once a record where many pairs are compared."""
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.length(c) - 1) / 15).cast("int"), F.lit(0)))
    return F.transform(places, lambda i: F.coalesce(F.conv(F.substring(c, i * 15 + 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint")))


def set_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))


def shared_bits(a: Column, b: Column) -> Column:
    return set_bits(F.zip_with(a, b, lambda x, y: F.coalesce(x.bitwiseAND(y), F.lit(0).cast("bigint"))))


def dice_of(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(n_a + n_b == 0, 0.0).otherwise(2.0 * both / (n_a + n_b))


def jaccard_of(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(n_a + n_b - both == 0, 0.0).otherwise(both / (n_a + n_b - both))


def _hex(of: Callable) -> Callable[[Column, Column], Column]:
    def build(a: Column, b: Column) -> Column:
        x, y = hex_words(a), hex_words(b)
        return F.when(a.isNotNull() & b.isNotNull(), of(shared_bits(x, y), set_bits(x), set_bits(y)))

    return build


dice, jaccard = _hex(dice_of), _hex(jaccard_of)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def soundex_match(a: Column, b: Column) -> Column:
    return (soundex(a) == soundex(b)).cast("double")


JW_MANY, INDEL_MANY = _many(jaro_winkler, jaro_winkler_many), _many(indel, indel_many, 64)
_JW, _INDEL = _arrow(JW_MANY), _arrow(INDEL_MANY)


def token_sort(a: Column, b: Column) -> Column:
    return _INDEL(_sorted(a), _sorted(b))


def ensemble(a: Column, b: Column) -> Column:
    return F.greatest(_JW(a, b), token_sort(a, b), 0.8 * soundex_match(a, b))


SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "exact": lambda a, b: (a == b).cast("double"),
    "jaro_winkler": _JW,
    "levenshtein": levenshtein,
    "token_sort": token_sort,
    "soundex_match": soundex_match,
    "ensemble": ensemble,
    "dice": dice,
    "jaccard": jaccard,
    "embedding": cosine,
    "record_embedding": cosine,
}
#: Scorers that cost a crossing into Python; others are computed first.
DEAR = ("jaro_winkler", "token_sort", "ensemble")


def score(a: Column, b: Column, scorer: str) -> Column:
    if scorer in PLUGINS:
        return PLUGINS[scorer](a, b)
    if scorer not in SCORERS:
        raise ValueError(f"no such scorer: {scorer}")
    return SCORERS[scorer](a, b)


def record_text(columns: list[str], weights: dict[str, int] | None = None, prefix: str = "") -> Column:
    """``col: value | col: value`` of the columns that are filled; a weight repeats its part."""
    parts = [F.concat(F.lit(f"{c}: "), F.col(prefix + c).cast("string")) for c in columns for _ in range(max(1, round((weights or {}).get(c, 1))))]
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def hashing_embedding(c: Column, dims: int = 64) -> Column:
    """An offline embedding: signed counts of hashed character 3-grams, scaled to length 1."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit("  "))
    hashed = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.xxhash64(F.substring(padded, i, 3)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(
        hashed, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dims)) == d, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(counts), lambda v: F.transform(v, lambda x: F.when(norm(v) > 0, x / norm(v)).otherwise(0.0)))[0]


def model_containment(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def boost_features(columns: list[str], left: str = "a_", right: str = "b_") -> list[Column]:
    """Per column: jaro_winkler, token_sort, levenshtein, exact and the ratio of lengths; 0 for nulls."""
    out = []
    for c in columns:
        a, b = F.col(left + c).cast("string"), F.col(right + c).cast("string")
        longest = F.greatest(F.length(a), F.length(b))
        for name, f in (("jw", score(a, b, "jaro_winkler")), ("ts", score(a, b, "token_sort")), ("lev", score(a, b, "levenshtein")), ("exact", score(a, b, "exact")),
                        ("len", F.when(longest == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longest))):
            out.append(F.coalesce(f, F.lit(0.0)).alias(f"{c}_{name}"))
    return out


def register_sql(spark: SparkSession) -> None:
    """SQL functions ``er_score(a, b, scorer)``, null gives 0, ``er_metaphone(a)``, ``er_score_pair(a, b, fields)`` of two JSON
    records and a JSON object of field: scorer, and ``er_explain(a, b, fields)``, its parts as text."""
    import json

    import erspark.functions.phonetic as phonetic

    ship(spark)

    by_tokens = lambda v: " ".join(sorted(v.split()))
    py = {"exact": lambda a, b: float(a == b), "jaro_winkler": jaro_winkler, "token_sort": lambda a, b: indel(by_tokens(a), by_tokens(b))}

    def parts(a: str | None, b: str | None, fields: str) -> dict[str, float]:
        x, y = json.loads(a or "{}"), json.loads(b or "{}")
        return {f: py[s](str(x[f]), str(y[f])) for f, s in json.loads(fields).items() if x.get(f) is not None and y.get(f) is not None}

    @F.pandas_udf(T.DoubleType())
    def er_score(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else py[z](x, y) for x, y, z in zip(a, b, s)])

    @F.pandas_udf(T.StringType())
    def er_metaphone(a: pd.Series) -> pd.Series:
        return a.map(phonetic.metaphone)

    @F.pandas_udf(T.DoubleType())
    def er_score_pair(a: pd.Series, b: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([sum(p.values()) / len(p) if (p := parts(*r)) else 0.0 for r in zip(a, b, f)])

    @F.pandas_udf(T.StringType())
    def er_explain(a: pd.Series, b: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series(["; ".join(f"{k}: {v:.3f}" for k, v in parts(*r).items()) for r in zip(a, b, f)])

    for name, f in (("er_score", er_score), ("er_metaphone", er_metaphone), ("er_score_pair", er_score_pair), ("er_explain", er_explain)):
        spark.udf.register(name, f)
