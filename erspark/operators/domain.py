"""Features of product, software and bibliographic texts, and rulebooks that extract their own."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.functions.transforms import strip
from erspark.plans.runtime import fresh

# fixed values: patterns and words of the features
BRANDS = ("Sony|Samsung|LG|Apple|HP|Dell|Canon|Nikon|Panasonic|Philips|Bose|JBL|Logitech|Microsoft|Intel|AMD|Asus|Acer|Lenovo|"
          "Toshiba|Epson|Brother|Xerox|Bosch|Makita|DeWalt|Nike|Adidas|Puma|Reebok|Under Armour")
MODEL = r"\b([A-Z]{1,5}[-]?\d{2,}[A-Z0-9]*(?:[-/]\w+)?)\b"
SKU = r"\b(\d{6,}|[A-Z]{2,}\d{4,})\b"
COLORS = "black|white|silver|gold|red|blue|green|pink|gray|grey|purple|orange|yellow|brown|navy|titanium|graphite|midnight|space\\s*gray|rose\\s*gold"
SPECS = {
    "megapixels": r"(\d+\.?\d*)\s*(?:mega\s*pixel|mp)\b", "storage_gb": r"(\d+)\s*(?:gb|gigabyte)\b", "storage_tb": r"(\d+\.?\d*)\s*(?:tb|terabyte)\b",
    "screen_inch": r"(\d+\.?\d*)\s*(?:inch|in\.|\")\b", "ram_gb": r"(\d+)\s*gb\s*(?:ram|ddr|memory)\b", "watts": r"(\d+)\s*(?:watt|w)\b", "speed_ghz": r"(\d+\.?\d*)\s*ghz\b",
}
SW_VERSION = r"(?i)\b(?:v\.?\s*)?(\d+(?:\.\d+)+)\b|\b((?:cs|cc)\s*\d+)\b|\b(20[0-2]\d)\b"
SW_EDITION = r"(?i)\b(professional|pro|standard|enterprise|premium|basic|ultimate|home|personal|academic|student|unlimited|plus|lite|express|starter|essentials?)\b"
SW_PLATFORM = r"(?i)\b(windows?|win|mac(?:intosh)?|linux|unix|osx?|ios|android)\b|\b(win(?:/mac|\\mac))\b|\bfor\s+(pc|mac)\b"
SW_PART, SW_UPGRADE = r"\b(\d{5,})\b", r"(?i)\b(upgrade|upg|update)\b"
MODEL_REGIONS, MODEL_COLORS = "(NA|US|EU|UK|CA|AU|JP)$", "(BK|WH|BF|WF|SL|GR|BL|RD|GD|SV)$"
SW_STOP = ("the a an for and or with by from to in of - inc inc. llc corp software edition version ver cd dvd rom cd-rom dvd-rom "
           "jewel case package complete license media").split()
TITLE_STOP = "the a an on in of for and to with".split()
#: Words in column names that speak for a domain.
SIGNALS = {
    "product": ("brand", "model", "sku", "price", "manufacturer", "product", "upc"),
    "software": ("software", "version", "platform", "license", "edition"),
    "biblio": ("title", "author", "venue", "year", "doi", "journal", "abstract"),
    "people": ("first_name", "last_name", "email", "phone", "address", "birth"),
}


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))  # which evaluates the pattern once


def detect_domain(columns: list[str]) -> tuple[str | None, float]:
    joined = " ".join(columns).lower()
    hits = {d: sum(s in joined for s in signals) for d, signals in SIGNALS.items()}
    best = max(hits, key=lambda d: hits[d])
    return (best, hits[best] / sum(hits.values())) if hits[best] else (None, 0.0)


def normalize_model(c: Column) -> Column:
    """Upper case without dashes, slashes and spaces, and without a region suffix; a colour suffix goes if four characters stay."""
    m = F.regexp_replace(F.regexp_replace(F.upper(c), "[-/ ]", ""), MODEL_REGIONS, "")
    bare = F.regexp_replace(m, MODEL_COLORS, "")
    return F.when(F.length(bare) >= 4, bare).otherwise(m)


def evidence(*parts: tuple[Column, float], of: float) -> Column:
    """The confidence of an extraction: the weights of the parts that were found, as a share of what speaks for it, 1.0 at most."""
    return F.least(F.lit(1.0), sum((F.when(found_, F.lit(w)).otherwise(0.0) for found_, w in parts), F.lit(0.0)) / of)


def product_features(df: DataFrame, text: str) -> DataFrame:
    """Brand, model, SKU (looked for only where there is no model), colour, specs and text in brackets."""
    c = F.col(text)
    brand, model, color = found(c, rf"(?i)^({BRANDS})\b"), found(c, MODEL), F.lower(found(c, rf"(?i)\b({COLORS})\b"))
    sku = F.when(model.isNull(), found(c, SKU))
    values = {k: found(c, "(?i)" + p) for k, p in SPECS.items()}
    specs = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in values.items())))
    sure = evidence((brand.isNotNull(), 1.0), (model.isNotNull(), 1.0), (sku.isNotNull(), 0.5), (color.isNotNull(), 0.5), *((v.isNotNull(), 0.5) for v in values.values()), of=4.0)
    return df.withColumns({"__brand__": brand, "__model__": model, "__model_norm__": normalize_model(model), "__sku__": sku, "__color__": color, "__specs__": F.array_join(specs, ";"),
                           "__paren__": found(c, r"\(([^)]+)\)"), "__confidence__": sure})


def software_features(df: DataFrame, text: str) -> DataFrame:
    """Name without noise, version, edition, platform, part number and whether it is an upgrade."""
    c, names = F.col(text), fresh(df, "version", "edition", "platform", "part", "bare")
    version, edition, platform, part, bare = (F.col(n) for n in names)
    plain = F.lower(strip(c))
    for p in (SW_VERSION, SW_EDITION, SW_PLATFORM, SW_PART, SW_UPGRADE, r"\([^)]*\)", r"(?U)[^\w\s]"):
        plain = F.regexp_replace(plain, p, " ")
    # each text is searched once a pattern, and steps are columns, as what a step uses twice would be computed twice within it
    out = df.withColumns({names[0]: F.regexp_extract(c, SW_VERSION, 0), names[1]: F.regexp_extract(c, SW_EDITION, 1), names[2]: F.regexp_extract(c, SW_PLATFORM, 0), names[3]: F.regexp_extract(c, SW_PART, 1), names[4]: plain,
                          "__sw_upgrade__": F.coalesce(c.rlike(SW_UPGRADE), F.lit(False))})
    # of a match, which its pattern matches too, the groups
    any_of = lambda m, p: F.lower(strip(F.coalesce(*(found(m, p, g) for g in (1, 2, 3)))))
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*SW_STOP))
    out = out.withColumns({names[0]: any_of(version, SW_VERSION), names[1]: F.lower(edition), names[2]: any_of(platform, SW_PLATFORM), names[4]: F.array_join(words, " ")})
    out = out.withColumns({"__sw_name__": F.when(bare != "", bare), "__sw_version__": version, "__sw_edition__": F.when(edition == "professional", "pro").when(edition != "", edition),
                           "__sw_platform__": F.when(platform.startswith("win"), "win").otherwise(platform), "__sw_part_num__": F.when(part != "", part)})
    col = lambda n: F.col(f"__sw_{n}__")
    sure = evidence((col("version").isNotNull(), 1.0), (col("edition").isNotNull(), 0.5), (col("platform").isNotNull(), 0.3), (col("part_num").isNotNull(), 0.5), (col("upgrade"), 0.2), (F.length(col("name")) >= 3, 1.0), of=3.0)
    made = [f"__sw_{n}__" for n in ("name", "version", "edition", "platform", "part_num", "upgrade")]
    return out.withColumn("__confidence__", F.round(sure, 6)).select(*(f"`{n}`" for n in df.columns if n.lower() not in (*made, "__confidence__")), *made, "__confidence__")


def title_key(c: Column) -> Column:
    """The first word of three letters or more that is no stop word."""
    return F.get(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP)), F.lit(0))


def biblio_features(df: DataFrame, text: str) -> DataFrame:
    c = F.col(text)
    return df.withColumns({"__title_key__": title_key(c), "__year__": found(c, r"\b((?:19|20)\d{2})\b"), "__doi__": found(c, r"(10\.\d{4,}/\S+)")})


def sub_domain(df: DataFrame, text: str) -> str:
    """Software or product by a vote of all rows."""
    r = df.agg(F.count_if(F.col(text).rlike(SW_EDITION) | F.col(text).rlike(SW_PLATFORM)).alias("s"), F.count_if(F.col(text).rlike(MODEL)).alias("p")).first()
    return "software" if r.s > r.p else "product"


EXTRACT = {"product": product_features, "software": software_features, "biblio": biblio_features}


def low_confidence(df: DataFrame, least: float = 0.3) -> DataFrame:
    return df.filter(F.col("__confidence__") < least)


#: Rulebooks of our own making, in the shape that ``load_rulebook`` reads from YAML.
PACKS = {
    "electronics": {"signals": ["brand", "model", "sku"], "identifiers": {"model": MODEL, "sku": SKU}, "attributes": {"storage": r"(\d+\s*[GT]B)\b", "screen": r"(\d+(?:\.\d+)?)\s*(?:inch|\")"}, "brands": ["Sony", "Samsung", "Apple", "Dell", "Canon"], "stop_words": ["new", "black", "with"]},
    "software": {"signals": ["version", "license"], "identifiers": {"part": r"\b(\d{5,})\b"}, "attributes": {"version": r"\b(\d+(?:\.\d+)+)\b", "edition": SW_EDITION}, "brands": ["Microsoft", "Adobe", "Intuit"], "stop_words": SW_STOP},
    "healthcare": {"signals": ["npi", "provider", "patient"], "identifiers": {"npi": r"\b(\d{10})\b"}, "attributes": {"degree": r"\b(MD|DO|RN|NP|PA|DDS)\b"}, "brands": [], "stop_words": ["dr", "clinic", "center"]},
    "financial": {"signals": ["account", "iban", "ticker"], "identifiers": {"iban": r"\b([A-Z]{2}\d{2}[A-Z0-9]{10,30})\b", "lei": r"\b([A-Z0-9]{18}\d{2})\b"}, "attributes": {"currency": r"\b(USD|EUR|GBP|JPY|CHF)\b"}, "brands": [], "stop_words": ["inc", "ltd", "corp"]},
    "people": {"signals": ["first_name", "last_name"], "identifiers": {"email": r"([\w.+-]+@[\w-]+\.[\w.]+)"}, "attributes": {"zip": r"\b(\d{5})\b"}, "brands": [], "stop_words": ["mr", "mrs", "ms", "dr"]},
    "real_estate": {"signals": ["parcel", "listing"], "identifiers": {"parcel": r"\b(\d{2,3}-\d{2,4}-\d{2,4})\b"}, "attributes": {"beds": r"(?i)(\d+)\s*(?:bed|br)\b", "sqft": r"(?i)([\d,]+)\s*(?:sqft|sq ft)"}, "brands": [], "stop_words": ["for", "sale", "rent"]},
    "retail": {"signals": ["upc", "ean", "price"], "identifiers": {"ean": r"\b(\d{12,13})\b"}, "attributes": {"size": r"(?i)\b(XS|S|M|L|XL|XXL)\b", "pack": r"(?i)(\d+)\s*(?:pack|pk|ct)\b"}, "brands": [], "stop_words": ["new", "sale"]},
}


def load_rulebook(name_or_path: str) -> dict:
    if name_or_path in PACKS:
        return PACKS[name_or_path]
    import yaml

    with open(os.path.expanduser(name_or_path), encoding="utf-8") as f:
        return yaml.safe_load(f)


def save_rulebook(book: dict, path: str) -> None:
    import yaml

    with open(os.path.expanduser(path), "w", encoding="utf-8") as f:
        yaml.safe_dump(book, f, sort_keys=False)


def find_rulebooks(*folders: str) -> dict[str, dict]:
    """Built-in rulebooks and those of YAML files in folders, by name; a file goes before a built-in one."""
    out = dict(PACKS)
    for folder in folders:
        folder = os.path.expanduser(folder)
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
            if name.endswith((".yaml", ".yml")):
                out[name.rsplit(".", 1)[0]] = load_rulebook(os.path.join(folder, name))
    return out


def match_rulebook(columns: list[str], books: dict[str, dict] = PACKS) -> str | None:
    joined = " ".join(columns).lower()
    hits = {n: sum(s in joined for s in b.get("signals", [])) for n, b in books.items()}
    best = max(hits, key=lambda n: hits[n])
    return best if hits[best] else None


def extract_by_rulebook(df: DataFrame, text: str, book: dict) -> DataFrame:
    """``__domain_<name>__`` columns of the identifiers, attributes and brand, and the text without stop words."""
    c = F.col(text)
    out = {f"__domain_{n}__": found(c, p) for group in ("identifiers", "attributes") for n, p in book.get(group, {}).items()}
    if book.get("brands"):
        out["__domain_brand__"] = found(c, r"(?i)\b(" + "|".join(book["brands"]) + r")\b")
    stop = [w.lower() for w in book.get("stop_words", [])]
    words = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: (w != "") & (~w.isin(*stop) if stop else F.lit(True)))
    out["__domain_name__"] = F.array_join(words, " ")
    return df.withColumns(out)
