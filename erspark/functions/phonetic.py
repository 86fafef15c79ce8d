"""Metaphone codes, which Spark lacks, as an Arrow function over distinct values of a batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erspark.plans.runtime import ship

_VOWELS = "AEIOU"
#: Spellings at the start of a word.
_FIRST = (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W"))


def metaphone(value: str | None) -> str | None:
    """Lawrence Philips' original Metaphone of the letters A to Z of each word."""
    if value is None:
        return None
    return " ".join(filter(None, (_word(re.sub("[^A-Z]", "", w)) for w in value.upper().split())))


def _word(w: str) -> str:
    for a, b in _FIRST:
        if w.startswith(a):
            w = b + w[len(a):]
            break
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, nxt = w[i], at(i + 1)
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and at(i - 1) == "M"):
                out.append("B")
        elif c == "C":
            if nxt and nxt in "EIY":
                if w[i:i + 3] == "CIA":
                    out.append("X")
                elif at(i - 1) != "S":
                    out.append("S")
            elif nxt == "H":
                out.append("K" if at(i - 1) == "S" or (i == 0 and at(i + 2) not in _VOWELS) else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            if nxt == "G" and at(i + 2) and at(i + 2) in "EIY":
                out.append("J")
                i += 2
            else:
                out.append("T")
        elif c == "G":
            if nxt == "H" and (i + 2 < n and at(i + 2) not in _VOWELS or i + 2 >= n):
                if i + 2 >= n and i > 0 and at(i - 1) not in _VOWELS:
                    out.append("K")
            elif nxt == "N" and (i + 2 >= n or w[i + 2:] == "ED"):
                pass
            elif nxt and nxt in "EIY" and at(i - 1) != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if nxt and nxt in _VOWELS and at(i - 1) not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        elif c == "P":
            if nxt == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H":
                out.append("X")
                i += 1
            elif w[i:i + 3] in ("SIO", "SIA"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if w[i:i + 3] in ("TIA", "TIO"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
                i += 1
            elif w[i:i + 3] != "TCH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt and nxt in _VOWELS:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def metaphone_column(c: Column) -> Column:
    ship()

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        codes = {v: metaphone(v) for v in s.dropna().unique()}
        return s.map(codes)

    return run(c)
