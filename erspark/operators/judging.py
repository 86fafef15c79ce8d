"""Second opinions from a model that is asked: budgets, calibrated thresholds, judged clusters, labels, and training texts.

A model is a callable; no provider is built in. What is asked on the driver are samples bounded by a parameter; what is asked for
every pair or row runs in executors, batch by batch.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erspark.functions.similarity import record_text
from erspark.operators.clusters import CID, ID, membership_of, split_oversized
from erspark.operators.scoring import with_records
from erspark.plans.runtime import materialize, ship

log = logging.getLogger(__name__)
Pair = tuple[int, int, float]


@dataclass
class Budget:
    """Caps on calls and cost, a warning on the way, and a dearer model for scores within a band."""

    max_calls: int | None = None
    max_cost: float | None = None
    #: Cost of a thousand tokens, by model: of what is sent, of what comes back.
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    warn_at: float = 0.8
    escalation_model: str | None = None
    escalation_band: tuple[float, float] = (0.80, 0.90)
    calls: int = 0
    cost: float = 0.0
    models: dict[str, int] = field(default_factory=dict)
    warned: bool = False

    def __post_init__(self) -> None:
        self._lock = threading.Lock()

    def price(self, sent: int, got: int, model: str) -> float:
        a, b = self.prices.get(model, (0.0, 0.0))
        return (a * sent + b * got) / 1000

    @property
    def spent(self) -> bool:
        return (self.max_calls is not None and self.calls >= self.max_calls) or (self.max_cost is not None and self.cost >= self.max_cost)

    def allows(self, tokens: int = 0, model: str = "") -> bool:
        return not self.spent and (self.max_cost is None or self.cost + self.price(tokens, 0, model) <= self.max_cost)

    def record(self, sent: int = 0, got: int = 0, model: str = "") -> None:
        with self._lock:
            self.calls += 1
            self.cost += self.price(sent, got, model)
            self.models[model] = self.models.get(model, 0) + 1
            if not self.warned and self.max_cost and self.cost >= self.warn_at * self.max_cost:
                self.warned = True
                log.warning("%.0f %% of the budget is spent", 100 * self.cost / self.max_cost)

    def model_for(self, score: float, default: str) -> str:
        low, high = self.escalation_band
        return self.escalation_model if self.escalation_model and low <= score <= high else default


def separating_threshold(labels: list[tuple[float, bool]]) -> float:
    """Of scores labelled yes or no the cut with fewest on the wrong side: between the two if they are apart; just above or below all if one is missing."""
    scores, yes = np.array([s for s, _ in labels], float), np.array([ok for _, ok in labels], bool)
    if not yes.any():
        return float(scores.max()) + 0.001
    if yes.all():
        return float(scores.min()) - 0.001
    if scores[~yes].max() < scores[yes].min():
        return float(scores[~yes].max() + scores[yes].min()) / 2
    order = np.argsort(scores, kind="stable")
    values, ok = scores[order], yes[order]
    wrong = np.cumsum(ok) + (~ok).sum() - np.cumsum(~ok)  # with the cut behind each place
    places = np.flatnonzero(values[1:] > values[:-1])
    if not len(places):
        return float(values[0])
    at = places[np.argmin(wrong[places])]
    return float(values[at] + values[at + 1]) / 2


def calibrate(scored: DataFrame, ask: Callable[[list[Pair]], list[bool]], low: float = 0.75, high: float = 0.95, sample: int = 100, rounds: int = 5, band: float = 0.03, still: float = 0.01,
              budget: Budget | None = None, seed: int = 42) -> tuple[float, list[tuple[int, int, float, bool]]]:
    """(threshold, labelled pairs): the first round asks for pairs spread over the scores from ``low`` to ``high``, the next ones for pairs
    within ``band`` of the threshold so far; ends when it moves by less than ``still``. ``sample`` pairs a round reach the driver."""
    open_ = materialize(scored.filter((F.col("score") >= low) & (F.col("score") < high)).select("id_a", "id_b", "score"))
    threshold, labelled = (low + high) / 2, []
    chance = F.xxhash64(F.lit(seed), "id_a", "id_b")
    for k in range(rounds):
        if k == 0:
            bins = F.floor((F.col("score") - low) / ((high - low) / 20))
            todo = open_.withColumn("r", F.row_number().over(Window.partitionBy(bins).orderBy(chance, "id_a", "id_b"))).orderBy("r", bins).limit(sample)
        else:
            known = scored.sparkSession.createDataFrame([(a, b) for a, b, _, _ in labelled], "id_a long, id_b long")  # sample * rounds rows at most
            todo = open_.filter(F.abs(F.col("score") - threshold) <= band).join(F.broadcast(known), ["id_a", "id_b"], "left_anti").orderBy(chance, "id_a", "id_b").limit(sample)
        pairs = [(r.id_a, r.id_b, r.score) for r in todo.select("id_a", "id_b", "score").collect()]
        if not pairs or (budget and not budget.allows()):
            break
        labelled += [(*p, bool(ok)) for p, ok in zip(pairs, ask(pairs))]
        if budget:
            budget.record()
        new = separating_threshold([(s, ok) for _, _, s, ok in labelled])
        moved, threshold = abs(new - threshold), new
        if k and moved < still:
            break
    return threshold, labelled


def apply_calibration(scored: DataFrame, threshold: float, labelled: list[tuple[int, int, float, bool]], low: float = 0.75, high: float = 0.95) -> DataFrame:
    """Pairs that were asked for get their answer, others between ``low`` and ``high`` that of the threshold: 1.0 or 0.0; those above are 1.0, those below stay."""
    known = scored.sparkSession.createDataFrame([(a, b, ok) for a, b, _, ok in labelled], "id_a long, id_b long, ok boolean")
    s = F.col("score")
    yes = F.coalesce("ok", s >= threshold)
    return scored.join(F.broadcast(known), ["id_a", "id_b"], "left").select("id_a", "id_b", F.when(s >= high, 1.0).when((s >= low) & yes, 1.0).when(s >= low, 0.0).otherwise(s).alias("score"))


def judge_clusters(scored: DataFrame, df: DataFrame, columns: list[str], cluster: Callable[[list[str]], list[tuple[list[int], float]]], low: float = 0.75, high: float = 0.95, max_size: int = 100) -> DataFrame:
    """Records of borderline pairs judged group by group: ``cluster`` gets the texts of a component (split at its weakest links above
    ``max_size``) and gives groups of places with a confidence. Pairs within one get its confidence, other borderline pairs that were judged 0.0,
    pairs above the band 1.0; those that a split tore apart, and the rest, keep their score."""
    ship(df.sparkSession)
    near = materialize(scored.filter((F.col("score") >= low) & (F.col("score") < high)).select("id_a", "id_b", "score"))
    members = materialize(split_oversized(materialize(membership_of(near)), near, max_size)[0])
    rows = members.join(df.select(F.col(ID), record_text(columns).alias("text")), ID)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ID, ignore_index=True)
        part, sure = np.full(len(group), -1), np.zeros(len(group))
        for k, (places, confidence) in enumerate(cluster(group["text"].fillna("").tolist())):
            part[places], sure[places] = k, confidence
        return pd.DataFrame({"c": group[CID], "node": group[ID], "part": part, "sure": sure})

    judged = materialize(rows.groupBy(CID).applyInPandas(run, "c long, node long, part long, sure double"))
    side = lambda s: judged.select(F.col("node").alias(f"id_{s}"), *(F.col(x).alias(f"{x}_{s}") for x in ("c", "part", "sure")))
    both = near.join(side("a"), "id_a").join(side("b"), "id_b")
    same = (F.col("part_a") == F.col("part_b")) & (F.col("part_a") >= 0)
    asked = both.select("id_a", "id_b", F.when(F.col("c_a") != F.col("c_b"), F.col("score")).when(same, F.col("sure_a")).otherwise(0.0).alias("score"))
    rest = scored.filter((F.col("score") < low) | (F.col("score") >= high)).select("id_a", "id_b", F.when(F.col("score") >= high, 1.0).otherwise(F.col("score")).alias("score"))
    return rest.unionByName(asked)


def label_pairs(pairs: DataFrame, df: DataFrame, columns: list[str], ask: Callable[[str, str], bool], limit: int = 300, retries: int = 2, budget: Budget | None = None) -> list[tuple[int, int, bool]]:
    """Labels of at most ``limit`` pairs, in the order of a hash; a question that fails is asked again, and left out after ``retries``."""
    some = pairs.select("id_a", "id_b").orderBy(F.xxhash64(F.lit(42), "id_a", "id_b"), "id_a", "id_b").limit(limit)
    texts = with_records(some, df, columns).select("id_a", "id_b", record_text(columns, prefix="a_").alias("a"), record_text(columns, prefix="b_").alias("b")).orderBy("id_a", "id_b").collect()
    out = []
    for r in texts:
        if budget and not budget.allows():
            break
        for _ in range(retries + 1):
            try:
                out.append((r.id_a, r.id_b, bool(ask(r.a, r.b))))
                break
            except Exception as e:  # whatever a provider raises
                log.warning("no label for %s, %s: %s", r.id_a, r.id_b, e)
        if budget:
            budget.record()
    return out


def extract_more(df: DataFrame, text: str, extract: Callable[[list[str]], list[dict]], columns: list[str], least: float = 0.3, confidence: str = "__confidence__", batch: int = 20) -> DataFrame:
    """``df`` whose rows of low confidence have the ``columns`` that are empty filled by ``extract``, which gets texts in batches; only those rows leave the plan of built-ins."""
    ship(df.sparkSession)
    low = F.coalesce(F.col(confidence) < least, F.lit(True)) & F.col(text).isNotNull()

    def run(parts):
        for rows in parts:
            found = [x for at in range(0, len(rows), batch) for x in extract(rows[text].iloc[at:at + batch].tolist())]
            for c in columns:
                new = pd.Series([None if x.get(c) is None else str(x[c]) for x in found], index=rows.index, dtype=object)
                rows[c] = rows[c].where(rows[c].notna(), new)
            yield rows

    return df.filter(~low).unionByName(df.filter(low).mapInPandas(run, df.schema))


def suggested_kinds(found: dict[str, dict], suggest: Callable[[dict[str, dict]], dict[str, str]], kinds: tuple) -> dict[str, dict]:
    """A profile whose column kinds a model may change: of columns that there are, to kinds that there are."""
    said = suggest({c: dict(p) for c, p in found.items()})
    return {c: {**p, "kind": said[c] if said.get(c) in kinds else p["kind"]} for c, p in found.items()}


def suggested_blocking(columns: list[str], suggest: Callable[[list[str]], list[list[str]]], most: int = 5) -> list[dict]:
    """Block keys that a model names, those of columns that there are, ``most`` at most."""
    return [{"fields": list(k), "transforms": ["lowercase", "strip"]} for k in suggest(columns) if k and all(c in columns for c in k)][:most]


# -- training texts


def augment(pairs: DataFrame, a: str = "text_a", b: str = "text_b", label: str = "label", times: int = 2, seed: int = 42) -> DataFrame:
    """Labelled pairs of record texts and ``times`` variants of each: one text, by chance, loses a run of one to three words, has a run of two to
    four turned round, or loses a column of ``col: val | col: val``. Chance is a hash, so a run that is repeated gives the same rows."""
    def chance(k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + k), a, b, "variant"), F.lit(1 << 30)) / (1 << 30)

    def change(text: Column) -> Column:
        words = F.array(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        size = lambda w, least, most: F.least(F.floor(chance(1) * (most - least + 1)).cast("int") + least, F.size(w) - 1)
        start = lambda w, n: F.floor(chance(2) * (F.size(w) - n + 1)).cast("int")
        part = lambda w, i, j: F.slice(w, i + 1, F.greatest(j - i, F.lit(0)))
        cut = lambda w: F.concat(part(w, F.lit(0), start(w, size(w, 1, 3))), part(w, start(w, size(w, 1, 3)) + size(w, 1, 3), F.size(w)))
        turn = lambda w: F.concat(part(w, F.lit(0), start(w, size(w, 2, 4))), F.reverse(part(w, start(w, size(w, 2, 4)), start(w, size(w, 2, 4)) + size(w, 2, 4))),
                                  part(w, start(w, size(w, 2, 4)) + size(w, 2, 4), F.size(w)))
        of = lambda f: F.array_join(F.transform(words, lambda w: F.when(F.size(w) > 2, f(w)).otherwise(w))[0], " ")
        columns = F.split(text, r"\s*\|\s*")
        drop = F.when(F.size(columns) > 1, F.array_join(F.filter(columns, lambda c, i: i != F.floor(chance(3) * F.size(columns)).cast("int")), " | ")).otherwise(text)
        return F.when(chance(0) < 0.4, of(cut)).when(chance(0) < 0.7, of(turn)).otherwise(drop)

    every = pairs.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(times))))
    left = (F.col("variant") > 0) & (chance(4) < 0.5)
    right = (F.col("variant") > 0) & ~left
    return every.select(F.when(left, change(F.col(a))).otherwise(F.col(a)).alias(a), F.when(right, change(F.col(b))).otherwise(F.col(b)).alias(b), label, "variant")
