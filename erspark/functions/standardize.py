"""Standardizers, one Column expression each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.functions.transforms import strip, title_case, tokens

#: Postal abbreviations.
ADDRESS = {
    "street": "St", "avenue": "Ave", "boulevard": "Blvd", "drive": "Dr", "lane": "Ln", "road": "Rd", "court": "Ct", "place": "Pl",
    "circle": "Cir", "terrace": "Ter", "highway": "Hwy", "parkway": "Pkwy", "expressway": "Expy", "freeway": "Fwy", "trail": "Trl", "way": "Way",
    "north": "N", "south": "S", "east": "E", "west": "W", "northeast": "NE", "northwest": "NW", "southeast": "SE", "southwest": "SW",
    "apartment": "Apt", "suite": "Ste", "building": "Bldg", "floor": "Fl", "room": "Rm", "unit": "Unit", "department": "Dept",
    "post office box": "PO Box", "p.o. box": "PO Box", "po box": "PO Box",
}


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def email(c: Column) -> Column:
    """Lower case, if a dot comes behind the last @."""
    v = F.lower(strip(c))
    return F.when(v.contains("@") & F.substring_index(v, "@", -1).contains("."), v)


def name_proper(c: Column) -> Column:
    return filled(title_case(strip(c)))


def phone(c: Column) -> Column:
    """Digits; a leading 1 of eleven goes; fewer than seven are none."""
    d = F.regexp_replace(c, "[^0-9]", "")
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) >= 7, d)


def zip5(c: Column) -> Column:
    """Digits before a dash or a space, five at most, filled with zeros from the left."""
    d = F.substring(F.regexp_replace(F.substring_index(F.substring_index(c, "-", 1), " ", 1), "[^0-9]", ""), 1, 5)
    return F.when(d != "", F.lpad(d, 5, "0"))


def address(c: Column) -> Column:
    v = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    for phrase in (k for k in ADDRESS if " " in k):
        v = F.regexp_replace(v, r"(?i)(?<![^ ])" + phrase.replace(".", r"\.") + r"(?![^ ,])", ADDRESS[phrase].replace(" ", "\u0001"))
    single = F.create_map(*[F.lit(x) for k, a in ADDRESS.items() if " " not in k for x in (k, a)])
    word = lambda w: F.when(w.contains("\u0001"), F.replace(w, F.lit("\u0001"), F.lit(" "))).otherwise(
        F.coalesce(F.get(F.array(single), F.lit(0))[F.lower(F.rtrim(w, F.lit(".,")))], title_case(w)))
    return filled(F.array_join(F.transform(tokens(v), word), " "))


STANDARDIZERS: dict[str, Callable[[Column], Column]] = {
    "email": email,
    "name_proper": name_proper,
    "name_upper": lambda c: filled(F.upper(strip(c))),
    "name_lower": lambda c: filled(F.lower(strip(c))),
    "phone": phone,
    "zip5": zip5,
    "address": address,
    "state": lambda c: filled(F.upper(strip(c))),
    "strip": lambda c: filled(strip(c)),
    "trim_whitespace": lambda c: filled(strip(F.regexp_replace(c, r"(?U)\s+", " "))),
}


def standardize(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Columns overwritten by their standardizers, in the order given."""
    done = {}
    for column, names in rules.items():
        c = F.col(column).cast("string")
        for name in names:
            if name not in STANDARDIZERS:
                raise ValueError(f"no such standardizer: {name}")
            c = STANDARDIZERS[name](c)
        done[column] = c
    return df.withColumns(done) if done else df
