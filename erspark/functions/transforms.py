"""Field transforms: chains of named steps compiled into one Column, null in, null out."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erspark.functions.phonetic import metaphone_column
from erspark.plans.runtime import ship

#: Transforms added by ``register_transform``: name -> (Column -> Column).
PLUGINS: dict[str, Callable[[Column], Column]] = {}
#: Security levels of Bloom filters: n-gram size, hash functions, bits, keyed.
LEVELS = {"standard": (2, 20, 512, False), "high": (2, 30, 1024, True), "paranoid": (3, 40, 2048, True)}


def register_transform(name: str, build: Callable[[Column], Column]) -> None:
    PLUGINS[name] = build


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def title_case(c: Column) -> Column:
    """Upper case after anything that is no letter, lower case after a letter."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def soundex(c: Column) -> Column:
    """Codes of values that begin with a letter; others have an empty code."""
    s = strip(c)
    return F.when(c.isNull(), None).when(s.rlike("^[A-Za-z]"), F.soundex(s)).otherwise("")


def qgrams(c: Column, q: int) -> Column:
    padded = F.concat(F.lit("#" * q), c, F.lit("#" * q)) if q != 2 else F.concat(F.lit("##"), c, F.lit("##"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, q))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(grams)), 1, 5), " ")


@lru_cache(1 << 16)
def gram_bits(gram: str, k: int, bits: int, key: str | None = None) -> tuple:
    """The bits of an n-gram, keyed if a key is given; texts share most of their grams, so those met are kept."""
    if key:
        digests = (hmac.digest(f"{key}:{j}".encode(), gram.encode(), "sha256") for j in range(k))
    else:
        digests = (hashlib.sha256(f"{j}:{gram}".encode()).digest() for j in range(k))
    return tuple({int.from_bytes(d, "big") % bits for d in digests})


def clk(value: str | None, n: int, k: int, bits: int, key: str | None = None, pad: bool = False) -> str | None:
    """Bloom filter of the n-grams of a value as hex, bit ``p`` in byte ``p // 8`` from the low end."""
    if value is None:
        return None
    v = value.lower().strip()
    if pad and len(v) < 8:
        v += hashlib.sha256(v.encode()).hexdigest()[:8 - len(v)]
    v = v.ljust(n, "_")
    out = bytearray(bits // 8)
    for gram in {v[i:i + n] for i in range(len(v) - n + 1)}:
        for p in gram_bits(gram, k, bits, key):
            out[p // 8] |= 1 << (p % 8)
    return out.hex()


def bloom_filter(c: Column, n: int = 2, k: int = 20, bits: int = 1024, key: str | None = None, pad: bool = False) -> Column:
    ship()

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        memo: dict = {}
        return s.map(lambda v: memo[v] if v in memo else memo.setdefault(v, clk(v, n, k, bits, key, pad)), na_action="ignore")

    return run(c)


def _bloom(c: Column, args: list[str]) -> Column:
    if args and args[0] in LEVELS:
        n, k, bits, keyed = LEVELS[args[0]]
        key = args[1] if len(args) > 1 else "default" if keyed else None
        return bloom_filter(c, n, k, bits, key, args[0] == "paranoid")
    numbers = [int(x) for x in args[:3]]
    return bloom_filter(c, *numbers, key=args[3] if len(args) > 3 else None)


SIMPLE: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": strip,
    "strip_all": lambda c: F.regexp_replace(c, r"(?U)\s+", ""),
    "soundex": soundex,
    "metaphone": metaphone_column,
    "digits_only": lambda c: F.regexp_replace(c, "[^0-9]", ""),
    "alpha_only": lambda c: F.regexp_replace(c, "[^A-Za-z]", ""),
    "normalize_whitespace": lambda c: strip(F.regexp_replace(c, r"(?U)\s+", " ")),
    "token_sort": lambda c: F.array_join(F.array_sort(tokens(c)), " "),
    "first_token": lambda c: F.coalesce(F.get(tokens(c), F.lit(0)), c),
    "last_token": lambda c: F.coalesce(F.element_at(F.when(F.size(tokens(c)) > 0, tokens(c)), -1), c),
}


def apply_transform(c: Column, name: str) -> Column:
    if name in PLUGINS:
        return PLUGINS[name](c)
    if name in SIMPLE:
        return SIMPLE[name](c)
    head, *args = name.split(":")
    if head == "substring" and len(args) == 2:
        s, e = map(int, args)
        return F.substring(c, s + 1, max(0, e - s))
    if head == "qgram" and len(args) == 1:
        return qgrams(c, int(args[0]))
    if head == "bloom_filter":
        return _bloom(c, args)
    raise ValueError(f"no such transform: {name}")


def apply_transforms(c: Column, names: list[str] | tuple = ()) -> Column:
    """The chain, left to right, on the value as a string."""
    c = c.cast("string")
    for name in names:
        c = apply_transform(c, name)
    return c


def matchkey_column(fields: list[tuple[str, list[str]]]) -> Column:
    """Transformed fields joined by ``||``; null if any is."""
    parts = [apply_transforms(F.col(c), t) for c, t in fields]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("||"), p)
    return out
