"""The declarative configuration: what to match on, how to block, score, cluster and merge."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame

from erspark.functions.similarity import PLUGINS as SCORER_PLUGINS
from erspark.functions.similarity import SCORERS
from erspark.functions.standardize import STANDARDIZERS
from erspark.functions.transforms import PLUGINS as TRANSFORM_PLUGINS
from erspark.functions.transforms import SIMPLE

STRATEGIES = ("static", "adaptive", "sorted_neighborhood", "multi_pass", "ann", "canopy", "ann_pairs", "learned")
SURVIVORSHIP = ("most_recent", "source_priority", "most_complete", "majority_vote", "first_non_null")


@dataclass
class MatchField:
    field: str
    transforms: list[str] = field(default_factory=list)
    scorer: str | None = None
    weight: float | None = None
    levels: int = 2
    partial_threshold: float = 0.8

    def as_dict(self) -> dict:
        return {"field": self.field, "transforms": self.transforms, "scorer": self.scorer, "weight": self.weight or 1.0, "levels": self.levels, "partial_threshold": self.partial_threshold}


@dataclass
class Matchkey:
    name: str
    type: str
    fields: list[MatchField]
    threshold: float | None = None
    rerank: bool = False
    rerank_band: float = 0.1
    rerank_model: str = "token_sort"
    em_iterations: int = 20
    convergence_threshold: float = 0.001
    link_threshold: float | None = None

    def check(self) -> None:
        if self.type not in ("exact", "weighted", "probabilistic"):
            raise ValueError(f"matchkey {self.name}: no such type: {self.type}")
        if self.type == "weighted" and (self.threshold is None or any(f.scorer is None or f.weight is None for f in self.fields)):
            raise ValueError(f"matchkey {self.name}: a weighted one needs a threshold, and a scorer and weight for each field")
        if self.type == "probabilistic" and any(f.scorer is None for f in self.fields):
            raise ValueError(f"matchkey {self.name}: a probabilistic one needs a scorer for each field")
        for f in self.fields:
            if f.scorer and f.scorer not in SCORERS and f.scorer not in SCORER_PLUGINS:
                raise ValueError(f"no such scorer: {f.scorer}")
            for t in f.transforms:
                if t not in SIMPLE and t not in TRANSFORM_PLUGINS and t.split(":")[0] not in ("substring", "qgram", "bloom_filter"):
                    raise ValueError(f"no such transform: {t}")


@dataclass
class BlockKey:
    fields: list[str]
    transforms: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"fields": self.fields, "transforms": self.transforms}


@dataclass
class Canopy:
    fields: list[str]
    loose_threshold: float = 0.3
    tight_threshold: float = 0.7
    max_canopy_size: int = 500


@dataclass
class Blocking:
    keys: list[BlockKey] = field(default_factory=list)
    strategy: str = "static"
    max_block_size: int = 5000
    skip_oversized: bool = False
    auto_suggest: bool = False
    auto_select: bool = False
    sub_block_keys: list[BlockKey] = field(default_factory=list)
    window_size: int = 20
    sort_key: list[BlockKey] = field(default_factory=list)
    passes: list[BlockKey] = field(default_factory=list)
    ann_column: str | None = None
    ann_top_k: int = 20
    ann_threshold: float = 0.5
    ann_exact: bool = True
    canopy: Canopy | None = None
    learned_sample: int = 5000
    learned_min_recall: float = 0.95
    learned_min_reduction: float = 0.90
    rules_path: str | None = None
    sub_block_column: str | None = None

    def check(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such blocking strategy: {self.strategy}")
        if self.strategy == "sorted_neighborhood" and not self.sort_key:
            raise ValueError("sorted_neighborhood needs a sort_key")
        if self.strategy in ("ann", "ann_pairs") and not self.ann_column:
            raise ValueError(f"{self.strategy} needs ann_column")
        if self.strategy == "canopy" and not self.canopy:
            raise ValueError("canopy needs its settings")


@dataclass
class GoldenRules:
    default_strategy: str = "most_complete"
    field_rules: dict[str, dict] = field(default_factory=dict)
    max_cluster_size: int = 100
    auto_split: bool = True
    weak_cluster_threshold: float = 0.3

    def check(self) -> None:
        for s in [self.default_strategy, *(r.get("strategy", self.default_strategy) for r in self.field_rules.values())]:
            if s not in SURVIVORSHIP:
                raise ValueError(f"no such survivorship strategy: {s}")


@dataclass
class Config:
    matchkeys: list[Matchkey] = field(default_factory=list)
    blocking: Blocking | None = None
    golden_rules: GoldenRules = field(default_factory=GoldenRules)
    standardization: dict[str, list[str]] = field(default_factory=dict)
    validation: list[dict] = field(default_factory=list)
    auto_fix: bool = True
    across_files_only: bool = False
    domain: str | None = None
    domain_column: str | None = None
    #: Whether the plan was made from data, so that scores may move its threshold after the run, and whether they must not.
    planned: bool = False
    strict: bool = False

    def check(self, df: DataFrame | None = None) -> Config:
        """Raises ValueError for what can't run, before any job starts."""
        for m in self.matchkeys:
            m.check()
        self.golden_rules.check()
        if self.blocking:
            self.blocking.check()
        if any(m.type != "exact" for m in self.matchkeys) and not self.blocking:
            raise ValueError("weighted and probabilistic matchkeys need blocking")
        for names in self.standardization.values():
            for n in names:
                if n not in STANDARDIZERS:
                    raise ValueError(f"no such standardizer: {n}")
        if df is not None:
            used = {f.field for m in self.matchkeys for f in m.fields} | {c for k in ((self.blocking.keys + self.blocking.passes) if self.blocking else []) for c in k.fields} | set(self.standardization)
            missing = sorted(c for c in used if not c.startswith("__") and c not in df.columns)
            if missing:
                raise ValueError(f"missing columns: {', '.join(missing)}")
        return self


_NESTED = {"matchkeys": Matchkey, "blocking": Blocking, "golden_rules": GoldenRules, "keys": BlockKey, "passes": BlockKey, "sub_block_keys": BlockKey, "sort_key": BlockKey, "canopy": Canopy}


def _build(cls, raw: dict):
    known = {f.name for f in fields(cls)}
    unknown = sorted(set(raw) - known)
    if unknown:
        raise ValueError(f"unknown settings of {cls.__name__}: {', '.join(unknown)}")
    out = {}
    for k, v in raw.items():
        kind = MatchField if cls is Matchkey and k == "fields" else _NESTED.get(k)
        if kind and isinstance(v, list):
            v = [x if is_dataclass(x) else _build(kind, x) for x in v]
        elif kind and isinstance(v, dict):
            v = _build(kind, v)
        out[k] = v
    return cls(**out)


def config_from(raw: dict) -> Config:
    """A checked configuration of nested dicts, as YAML gives them; a few short spellings are widened."""
    raw = dict(raw)
    keys = []
    for m in raw.get("matchkeys", []):
        m = dict(m)
        if "comparison" in m:
            m["type"] = m.pop("comparison")
        m["fields"] = [{**{k: v for k, v in f.items() if k != "column"}, "field": f.get("field", f.get("column"))} for f in m.get("fields", [])]
        keys.append(m)
    raw["matchkeys"] = keys
    if isinstance(raw.get("standardization"), dict) and "rules" in raw["standardization"]:
        raw["standardization"] = raw["standardization"]["rules"]
    return _build(Config, raw).check()


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return config_from(yaml.safe_load(f))


def config_of(exact: list[str] = (), fuzzy: dict[str, float] | None = None, blocking: list[str] = (), threshold: float = 0.85) -> Config:
    """From keyword arguments: columns to match exactly, weights of fuzzy ones, columns to block on."""
    keys = [Matchkey(f"exact_{c}", "exact", [MatchField(c, ["lowercase", "strip"])]) for c in exact]
    if fuzzy:
        keys.append(Matchkey("fuzzy", "weighted", [MatchField(c, ["lowercase", "strip"], "jaro_winkler", w) for c, w in fuzzy.items()], threshold))
    plan = None
    if fuzzy:
        plan = Blocking(keys=[BlockKey([c], ["lowercase", "strip"]) for c in blocking], auto_suggest=not blocking)
    return Config(matchkeys=keys, blocking=plan).check()
