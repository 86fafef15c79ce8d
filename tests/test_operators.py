"""Cleaning, blocking, scoring, clusters, golden records and planning on small tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erspark.functions import similarity as sim
from erspark.operators import blocking as B
from erspark.operators import cleaning as C
from erspark.operators import clusters as K
from erspark.operators import domain as D
from erspark.operators import entity_graph
from erspark.operators import evaluate as E
from erspark.operators import explain as X
from erspark.operators import golden as G
from erspark.operators import judging as J
from erspark.operators import pprl
from erspark.operators import scoring as S
from erspark.operators import vector_index
from erspark.operators.components import connected_components
from erspark.operators.entity_graph import resolve_graph
from erspark.operators.reconcile import add_versions, reconcile
from erspark.operators.review import ReviewQueue
from erspark.operators.vector_index import VectorIndex, near_pairs
from erspark.plans import auto
from erspark.plans import runtime as R
from erspark.plans.config import config_from, config_of
from erspark.sources import files

ID, CID = "__row_id__", "__cluster_id__"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "John", "Smith", "j@x.com", "12345"), (1, "john", "Smyth", "J@X.com ", "12345"), (2, "Jane", "Doe", None, "99999"), (3, "JOHN", "Smith", "other@y.org", "12345"), (4, "Ann", "Lee", "a@z.net", None)]
    return spark.createDataFrame(rows, f"{ID} long, first_name string, last_name string, email string, zip string")


def groups(df, node="node", root="component"):
    return {r[node]: r[root] for r in df.collect()}


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(600, 600)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame([*edges, (None, 3)], "id_a long, id_b long")
    assert groups(connected_components(df)) == {x: root(x) for e in edges for x in e}
    assert connected_components(df.limit(0)).count() == 0


def test_auto_fix(spark):
    df = spark.createDataFrame([("﻿ Jo  e ", "N/A", None), ("", None, None), ("x\x00y", "5", None)], "name string, age string, z string")
    assert [tuple(r) for r in C.auto_fix(df).collect()] == [("Jo e", None), ("xy", "5")]
    log = {(r["fix"], r["column"]): r.rows_affected for r in C.fix_log(df).collect()}
    assert log["bom", "name"] == 1 and log["null_strings", "age"] == 1 and log["control", "name"] == 1


def test_validate(spark):
    df = spark.createDataFrame([("A1",), ("b",), (None,)], "code string")
    ok, bad, report = C.validate(df, [{"column": "code", "rule": "regex", "pattern": r"^[A-Z]\d", "action": "quarantine"}, {"column": "code", "rule": "not_null", "action": "flag"}])
    assert [r.code for r in ok.collect()] == ["A1"] and bad.count() == 2
    assert {r["__quarantine_reason__"] for r in bad.collect()} == {"code:regex"}
    assert {r.rule: (r.passed, r.failed) for r in report.collect()} == {"regex": (1, 2), "not_null": (2, 1)}


def test_anomalies(people):
    df = people.withColumn("email", F.lit("test@foo.com"))
    assert C.detect_anomalies(df, sensitivity="low").select("type").distinct().collect()[0].type == "fake_email"


def test_exact_links_across_sources(spark):
    rows = [(i, "hot", "ABA"[i % 3]) for i in range(6000)] + [(6000, "hot", None), (7000, "x", "A"), (7001, "x", "A"), (7002, "y", "B"), (7003, "y", "C"), (7004, None, "A")]
    df = spark.createDataFrame(rows, f"{ID} long, k string, __source__ string")
    links = B.exact_links(df, "k", cross="__source__")
    assert links.join(df.select(F.col(ID).alias("id_a"), F.col("__source__").alias("a")), "id_a").join(df.select(F.col(ID).alias("id_b"), F.col("__source__").alias("b")), "id_b").filter("a = b").isEmpty()
    got = {r[ID]: r[CID] for r in K.membership_of(links).collect()}
    assert got == {**{i: 0 for i in range(6000)}, 7002: 7002, 7003: 7002}
    assert round(links.agg(F.sum("pairs")).first()[0]) == 4000 * 2000 + 1
    assert B.exact_pairs(df.filter(F.col(ID) < 300), "k", cross="__source__").count() == 200 * 100


def test_hot_joins_and_scopes(spark, tmp_path):
    left = spark.range(20_000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id").unionByName(spark.range(5).select(F.lit(None).cast("long").alias("k"), "id"))
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    for how in ("inner", "left"):
        got = R.join_split_hot(left, right, ["k"], None, 20_005, how)
        assert got.columns == ["k", "id", "n", "s"]
        assert got.count() == (20_000 if how == "inner" else 20_005) and got.select("id", "k").distinct().count() == got.count()
    with R.scratch() as keep:
        gone = R.materialize(spark.range(3))
        kept = keep(gone.filter("id > 0"))
        with R.scratch() as inner:
            up = inner(R.materialize(spark.range(9)))
        assert up.count() == 9
    assert kept.count() == 2
    for d in (gone, up):
        assert not os.path.exists(d._erspark_path.removeprefix("file://"))
    R.release(kept)
    assert not os.path.exists(kept._erspark_path.removeprefix("file://"))
    assert R.fresh(spark.createDataFrame([(1,)], "__A int"), "a") == ["__a_"]

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        R.shared_dir(Far)


def test_exact_groups_of_any_size(spark):
    df = spark.range(5101).select(F.col("id").alias(ID), F.lit("hot").alias("k"), F.when(F.col("id") < 5100, "A").otherwise("B").alias("__source__"))
    pairs = B.exact_pairs(df, "k")
    assert pairs.count() == 5101 * 5100 // 2
    assert S.across_sources(pairs, df).count() == 5100
    links = B.exact_links(df, "k")
    r = K.cluster_stats(K.membership_of(links, df), links).first()
    assert (r["size"], r.confidence, r.cluster_quality, tuple(r.bottleneck_pair)) == (5101, 1.0, "strong", (0, 1))


def test_salted_blocks_make_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "SALT_ROWS", 7)
    df = spark.range(50).select(F.col("id").alias(ID), (F.col("id") % 2).cast("string").alias("k"))
    assert B.static_pairs(df, [{"fields": ["k"]}]).count() == 2 * 300


def test_multi_pass_finds_more(people):
    one = B.static_pairs(people, [{"fields": ["last_name"]}])
    two = B.static_pairs(people, [{"fields": ["last_name"]}, {"fields": ["zip"]}])
    assert one.count() == 1 and two.count() == 3


def test_sorted_neighborhood(people):
    assert B.sorted_neighborhood(people, [("last_name", ["lowercase"])], 2).count() == 4
    assert B.sorted_neighborhood(people, [("last_name", [])], 50).count() == 10


def test_adaptive_without_sub_keys_splits(spark):
    df = spark.range(40).select(F.col("id").alias(ID), F.lit("x").alias("k"), (F.col("id") % 8).cast("string").alias("part"))
    sizes = [r["count"] for r in B.adaptive_keys(df, [{"fields": ["k"]}], [], 10).groupBy("key").count().collect()]
    assert sorted(sizes) == [5] * 8


def test_canopies_cover_all(spark):
    names = ["red widget", "red widgets", "blue gear", "blue gears", "odd one", "red gear"]
    df = spark.createDataFrame(list(enumerate(names)), f"{ID} long, name string")
    got = B.canopies(df, ["name"], 0.3, 0.7).collect()
    assert {r.id for r in got} == set(range(6))
    assert all(r.score >= 0.3 for r in got)


def test_canopies_of_many_copies(spark):
    names = ["red widget", "red widgets", "blue gear", "blue gears"]
    df = spark.createDataFrame([(i, names[i % 4]) for i in range(200)], f"{ID} long, name string")
    some, every = B.canopies(df, ["name"], 0.3, 0.7, 60), B.canopies(df, ["name"], 0.3, 0.7, None)
    first = {}
    for r in sorted(every.collect(), key=lambda r: (r.canopy, -r.score, r.id)):
        first.setdefault(r.canopy, []).append(r)
    assert sorted(some.collect()) == sorted(r for rows in first.values() for r in rows[:60])
    assert "windowspecdefinition(t#" in some._jdf.queryExecution().executedPlan().toString()  # copies go before they meet the canopies


def test_learned_rules(people):
    truth = people.sparkSession.createDataFrame([(0, 3)], "id_a long, id_b long")
    rules = B.learn_rules(people, ["first_name", "last_name"], truth, 0.9, 0.5)
    assert rules[0]["name"].endswith("(last_name)")


def test_rules_measured_by_keys(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, *(rng.choice(["a", "b b", "B", "", None]) for _ in range(3))) for i in range(60)], f"{ID} long, x string, y string, z string")
    truth = [{"fields": ["x"], "transforms": ["lowercase"]}, {"fields": ["y", "z"]}, {"fields": ["z"], "transforms": ["first_token"]}]
    rules = [{"fields": ["x"], "transforms": []}, {"steps": [("y", ["lowercase"]), ("z", [])]}, {"fields": ["z"], "transforms": ["first_token"]}]
    for keys in (truth[:1], truth):
        by_pairs, by_keys = (sorted(B.evaluate_rules(df, rules, t).collect()) for t in (B.static_pairs(df, keys), keys))
        assert by_pairs == by_keys and 0 < by_keys[0].recall


def test_weighted_scores_skip_nulls(people):
    pairs = people.sparkSession.createDataFrame([(0, 1), (0, 2), (2, 4)], "id_a long, id_b long")
    fields = [{"field": "email", "scorer": "exact", "weight": 1.0, "transforms": ["lowercase", "strip"]}, {"field": "zip", "scorer": "exact", "weight": 3.0}, {"field": "last_name", "scorer": "jaro_winkler", "weight": 1.0}]
    got = {(r.id_a, r.id_b): r.score for r in S.weighted_scores(pairs, people, fields, 0.0).collect()}
    assert got[0, 1] > 0.97 and abs(got[2, 4]) < 0.6
    assert set(got) - {p for p in got if got[p] < 0.9} == {(r.id_a, r.id_b) for r in S.weighted_scores(pairs, people, fields, 0.9).collect()}


def test_em_finds_the_matching_pattern(spark):
    rows = [(i, 1, 1) for i in range(60)] + [(i, 0, 0) for i in range(60, 900)] + [(i, 1, 0) for i in range(900, 960)]
    v = spark.createDataFrame(rows, "id_a long, l0 int, l1 int").withColumn("id_b", F.col("id_a") + 1000)
    rand = v.filter("l1 = 0")
    fields = [{"field": "a", "scorer": "exact"}, {"field": "b", "scorer": "exact"}]
    model = S.train_em(v, rand, fields)
    assert model["weights"][1][1] > 3 and model["m"][1][1] > 0.5
    scored = S.probabilistic_scores(v, model, 0.9)
    assert scored.count() == 60
    pinned = S.train_em(v, rand, fields, ("a",))
    assert pinned["weights"][0] == [-3.0, 3.0]
    assert S.train_em(v.limit(3), rand, fields)["moved"] == []


def test_corrections_and_gate(people):
    spark = people.sparkSession
    scored = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.8), (0, 3, 0.99)], "id_a long, id_b long, score double")
    log = spark.createDataFrame([(0, 1, "approve", "", ""), (0, 2, "reject", "stale", "stale")], "id_a long, id_b long, decision string, hash_a string, hash_b string")
    got = {r.id_b: (r.score, r.correction) for r in S.apply_corrections(scored, people, log, ["email"]).collect()}
    assert got == {1: (1.0, "approve"), 2: (0.8, "stale"), 3: (0.99, "none")}
    assert [r.decision for r in S.gate(scored).orderBy("id_b").collect()] == ["review", "review", "merge"]


def test_rerank_and_judge(people):
    spark = people.sparkSession
    scored = spark.createDataFrame([(0, 1, 0.85), (0, 2, 0.2), (0, 3, 0.99)], "id_a long, id_b long, score double")
    assert {r.id_b for r in S.rerank(scored, people, ["last_name"], lambda a, b: F.lit(0.0), 0.8).collect()} == {3}
    got = {r.id_b: r.score for r in S.judge(scored, people, ["last_name"], lambda a, b: F.lit(True)).collect()}
    assert got == {1: 1.0, 2: 0.2, 3: 1.0}


def test_split_of_an_oversized_cluster(spark):
    edges = [(i, i + 1, 0.9 if i != 4 else 0.6) for i in range(9)]
    pairs = spark.createDataFrame(edges, "id_a long, id_b long, score double")
    members, clusters = K.build_clusters(pairs, max_size=5)
    assert {r[ID]: r[CID] for r in members.collect()} == {**{i: 0 for i in range(5)}, **{i: 5 for i in range(5, 10)}}
    assert {r.cluster_quality for r in clusters.collect()} == {"split"}
    _, whole = K.build_clusters(pairs, max_size=5, auto_split=False)
    r = whole.first()
    assert r.oversized and r.bottleneck_pair == (4, 5) and r.cluster_quality == "strong"


def test_cluster_upkeep(spark):
    members = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (5, 5)], f"{CID} long, {ID} long")
    pairs = spark.createDataFrame([(0, 1, .9), (1, 2, .9)], "id_a long, id_b long, score double")
    got = {r[ID]: r[CID] for r in K.unmerge(members, pairs, 1).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 5: 5}
    new = K.add_to_clusters(members, spark.createDataFrame([(9,), (10,)], f"{ID} long"), spark.createDataFrame([(9, 2), (9, 5)], "id_a long, id_b long"))
    assert {r[ID]: r[CID] for r in new.collect()} == {0: 0, 1: 0, 2: 0, 5: 0, 9: 0, 10: 10}
    assert K.shatter(members, 0).select(CID).distinct().count() == 4


def test_golden_strategies(spark):
    rows = [(0, 1, "a", "Bob", "x", "2020-01-01"), (0, 2, "b", "Robert", "y", "2021-01-01"), (0, 3, "b", None, "y", None), (7, 4, "a", None, None, None)]
    df = spark.createDataFrame(rows, f"{CID} long, {ID} long, __source__ string, name string, v string, d string")
    g = {r[CID]: r for r in G.build_golden(df, {"name": {"strategy": "source_priority", "source_priority": ["b", "a"]}, "v": {"strategy": "majority_vote"}, "d": {"strategy": "most_recent", "date_column": "d"}}, provenance=True).collect()}
    assert (g[0].name, g[0].v, g[0].d) == ("Robert", "y", "2021-01-01")
    assert abs(g[0]["__golden_confidence__"] - (1.0 + 2 / 3 + 1.0) / 3) < 1e-6
    assert g[7].name is None and g[7]["__golden_confidence__"] == 0.0
    assert g[0]["__provenance__"]["name"]["source_row_id"] == 2
    one = G.build_golden(df.withColumn("n2", F.lit("same")), columns=["name", "n2"]).filter(f"{CID} = 0").first()
    assert one.name == "Robert" and one.n2 == "same"


def test_evaluation_and_comparison(spark):
    a = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 3), (4, 4)], f"{CID} long, {ID} long")
    b = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (3, 3), (4, 4)], f"{CID} long, {ID} long")
    r = E.compare_clusters(a, b).first()
    assert (r.unchanged, r.partitioned, r.merged, r.overlapping) == (2, 1, 0, 0)
    e = E.evaluate_pairs(E.cluster_pairs(a), E.cluster_pairs(b)).first()
    assert (e.tp, e.fp, e.fn, e.precision, e.recall) == (1, 1, 0, 0.5, 1.0)
    with pytest.raises(ValueError):
        E.load_truth(a)


def test_thresholds_from_histograms(spark):
    two = [(i, i + 1, 0.2 + (i % 10) / 100) for i in range(200)] + [(i, i + 1, 0.85 + (i % 10) / 100) for i in range(200)]
    df = spark.createDataFrame(two, "id_a long, id_b long, score double")
    assert 0.29 <= E.otsu_threshold(df) <= 0.86 and 0.3 <= E.valley(df) <= 0.86
    assert E.otsu_threshold(df.limit(0)) is None
    assert E.learn_threshold([(0.9, True, 1.0)] * 5 + [(0.5, False, 1.0)] * 5) == 0.7


def test_domain_features(spark):
    df = spark.createDataFrame([("Sony Alpha A7R-4 61 MP black camera (body)",), ("Adobe Acrobat Professional 9.4 for Windows upgrade 12345",), (None,)], "t string")
    p = D.product_features(df, "t").collect()
    assert (p[0]["__brand__"], p[0]["__color__"], p[0]["__paren__"]) == ("Sony", "black", "body") and p[2]["__brand__"] is None
    s = D.software_features(df, "t").collect()[1]
    assert (s["__sw_version__"], s["__sw_edition__"], s["__sw_platform__"], s["__sw_part_num__"], s["__sw_upgrade__"]) == ("9.4", "pro", "win", "12345", True)
    assert D.detect_domain(["brand", "model_no", "sku"])[0] == "product" and D.match_rulebook(["upc", "price"]) == "retail"
    assert D.extract_by_rulebook(df, "t", D.load_rulebook("software")).first()["__domain_version__"] is None


def test_planning(people):
    plan = auto.auto_configure(people)
    assert any(m.type == "weighted" for m in plan.matchkeys) and plan.blocking
    assert auto.kind_by_name("email_addr") == "email" and auto.kind_by_name("cust_id") == "identifier"
    found = auto.preflight(people, config_of(exact=["zip", "nope"]))
    assert {f["check"] for f in found} >= {"columns"}
    m = auto.map_schemas(people.withColumnRenamed("last_name", "surname"), people, 0.6)
    assert {"source": "surname", "target": "last_name", "score": 0.95, "how": "synonym"} in m
    assert auto.select_strategy(people)["strategy"] in ("fuzzy", "exact_fuzzy")


def test_config_errors():
    for raw in ({"matchkeys": [{"name": "a", "type": "odd", "fields": []}]}, {"matchkeys": [{"name": "a", "type": "weighted", "fields": [{"field": "x"}]}]}, {"nope": 1},
                {"matchkeys": [{"name": "a", "type": "weighted", "threshold": 0.8, "fields": [{"field": "x", "scorer": "exact", "weight": 1.0}]}]}, {"blocking": {"strategy": "odd"}}):
        with pytest.raises(ValueError):
            config_from(raw)
    c = config_from({"matchkeys": [{"name": "a", "comparison": "exact", "fields": [{"column": "x"}]}], "standardization": {"rules": {"x": ["email"]}}})
    assert c.matchkeys[0].fields[0].field == "x" and c.standardization == {"x": ["email"]}


def test_explanations(people):
    pairs = people.sparkSession.createDataFrame([(0, 3)], "id_a long, id_b long")
    r = X.explain_pairs(pairs, people, [{"field": "first_name", "scorer": "exact", "weight": 1.0, "transforms": ["lowercase"]}, {"field": "email", "scorer": "exact", "weight": 1.0}]).first()
    assert r.score == 0.5 and r.strongest == "first_name" and r.weakest == "email" and r.fields[0]["diff"] == "equal_when_transformed"


def test_run_log(spark, tmp_path):
    log = X.RunLog(spark, f"file://{tmp_path}")
    out = f"file://{tmp_path}/out"
    spark.range(3).write.parquet(out)
    run = log.add([out], rows=3)
    assert [r["run"] for r in log.list()] == [run] and log.rollback(run) == [out] and log.list() == []
    with pytest.raises(ValueError):
        log.rollback("none")


def test_software_patterns_run_once(spark):
    df = spark.createDataFrame([("Adobe CS 5 for Mac upgrade",), ("Office v.12.1 (x) Professional windows 12345",), (None,), ("",)], "t string").withColumn("t", F.concat("t", F.lit("")))
    got = D.software_features(df, "t")
    assert [tuple(r)[1:] for r in got.collect()] == [("adobe", "cs 5", None, "mac", None, True, 0.833333), ("office", "12.1", "pro", "win", "12345", False, 1.0), (None,) * 5 + (False, 0.0), (None,) * 5 + (False, 0.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?:20[0-2]") + plan.count("20[0-2]") <= 7  # on the text itself twice, to find it and to take it out, else on what was found


def test_private_linkage(spark):
    a = spark.createDataFrame([(0, "John Smith"), (1, "Ann Lee")], f"{ID} long, name string")
    b = spark.createDataFrame([(0, "JOHN SMITH"), (1, "Bob Ray")], f"{ID} long, name string")
    got = pprl.link(a, b, ["name"], 0.9).collect()
    assert [(r.id_a, r.id_b, r.score) for r in got] == [(0, 0, 1.0)]
    assert [r.score for r in pprl.link(a, b, ["name"], 0.9, protocol="smc", key="k").collect()] == [0.9]
    assert {(r.party, r.id) for r in pprl.linked_clusters(pprl.link(a, b, ["name"], 0.9)).collect()} == {("a", 0), ("b", 0)}
    assert pprl.auto_configure(a, b)["threshold"] >= 0.85


def test_private_linkage_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(pprl, "TILE", 4)
    names = [f"Person {i % 12:04d}" for i in range(30)] + ["", "\u00e9t\u00e9"]
    df = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], f"{ID} long, name string, part long")
    other = df.select((F.col(ID) + 100).alias(ID), F.regexp_replace("name", "00", "01").alias("name"), "part")
    code = lambda d, s: pprl.encode(d, ["name"], key="k").join(d.select(F.col(ID).alias("id"), "part"), "id").toDF(f"id_{s}", f"c_{s}", f"p_{s}")
    for metric in ("dice", "jaccard"):
        every = code(df, "a").crossJoin(code(other, "b")).select("id_a", "id_b", "p_a", "p_b", sim.score(F.col("c_a"), F.col("c_b"), metric).alias("s")).filter("s >= 0.6").collect()
        for block in (None, ["part"]):
            got = {(r.id_a, r.id_b): r.score for r in pprl.link(df, other, ["name"], 0.6, key="k", metric=metric, block=block).collect()}
            assert got == {(r.id_a, r.id_b): r.s for r in every if not block or r.p_a == r.p_b}


def test_graph_evidence_joins_entities(spark):
    customers = spark.createDataFrame([(0, "c1"), (1, "c2")], f"{ID} long, id string")
    orders = spark.createDataFrame([(0, "c1"), (1, "c2")], f"{ID} long, customer_id string")
    pair = lambda s: spark.createDataFrame([(0, 1, s)], "id_a long, id_b long, score double")
    got = resolve_graph({"orders": orders, "customers": customers}, {"orders": pair(0.9), "customers": pair(0.8)}, [{"from": "orders", "to": "customers", "from_key": "customer_id", "to_key": "id"}])
    assert got["customers"].select(CID).distinct().count() == 1


def test_evidence_of_classes_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(entity_graph, "FEW", 2)
    refs = [(c, k) for k in range(12) for c in ((k % 3,), (k % 3, 3), (0, 1, 2, 3, 4))[min(2, k // 5)]] + [(5, 20), (5, 20), (6, 21)]
    orders = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(refs)], f"{ID} long, {CID} long, k long")
    others = spark.createDataFrame([(100 + k, k) for k in range(22)], f"{ID} long, key long")
    got = [(r.id_a, r.id_b) for r in entity_graph.evidence(orders.select(CID, ID), orders.select(ID, "k"), "k", others, "key").collect()]
    assert len(got) == len(set(got)) and set(got) == {(100 + j, 100 + k) for c, j in refs for d, k in refs if c == d and j < k}


def test_row_ids_are_dense(spark):
    df = spark.range(100).repartition(7).select(F.col("id").alias("k"))
    assert sorted(r[ID] for r in files.add_row_ids(df, offset=5).collect()) == list(range(5, 105))
    assert all(r[ID] == r.k for r in files.add_row_ids(df, order=["k"]).collect())


def test_smart_load(spark, tmp_path):
    def load(name, text):
        p = tmp_path / name
        p.write_text(text)
        return files.smart_load(spark, f"file://{p}")

    d = load("a.txt", "name|age\nann|5\n----\nbob|7\npage 2\n")
    assert d.columns == ["name", "age"] and sorted(r.name for r in d.collect()) == ["ann", "bob"]
    kv = load("b.txt", "name: ann\ncity: rome\n  old town\nname: bob\ncity: oslo\n")
    assert sorted((r.name, r.city) for r in kv.collect()) == [("ann", "rome old town"), ("bob", "oslo")]
    fixed = load("c.txt", "ann   rome \nbobby oslo \ncat   paris\n")
    assert [tuple(r) for r in fixed.collect()][1] == ("bobby", "oslo")
    blocks = load("d.txt", "Ann Lee\nRome\n\nBob Ray\nOslo\n")
    assert sorted(tuple(r) for r in blocks.collect()) == [("Ann Lee", "Rome"), ("Bob Ray", "Oslo")]
    assert files.detect_encoding(b"\xff\xfea") == "utf-16" and files.suggest_column_mapping(["E_MAIL"], ["email", "x"]) == {"E_MAIL": "email"}
    with pytest.raises(ValueError):
        files.load_file(spark, "x.odd")
    with pytest.raises(ValueError):
        files.validate_columns(d, ["nope"])


def test_write_output(spark, tmp_path):
    for fmt in ("parquet", "csv", "json"):
        path = files.write_output(spark.range(3).withColumn("a", F.array("id")), f"file://{tmp_path}", "run", "golden", fmt)
        assert files.load_file(spark, path).count() == 3


def test_canopies_of_frequent_grams_by_brute_force(spark):
    import math
    from collections import Counter

    words = ["red ring", "hot ring", "red rings", "blue stone", "blue stones", "red ring"]
    rows = [(i, words[i % 6]) for i in range(1500)]  # every gram is in hundreds of rows
    df = spark.createDataFrame(rows, f"{ID} long, n string")
    members, vectors = B.tfidf_vectors(df, F.col("n"))
    name = {r.t: words[r.t % 6] for r in members.select("t").distinct().collect()}
    grams = {w: Counter(f" {w} "[i:i + k] for k in (3, 4) for i in range(len(w) + 3 - k)) for w in set(words)}
    df_of = Counter(g for _, w in rows for g in grams[w])
    unit = {}
    for w, c in grams.items():
        v = {g: n * (math.log(1501 / (df_of[g] + 1)) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        unit[w] = {g: x / size for g, x in v.items()}
    cosine = lambda a, b: sum(x * unit[b].get(g, 0) for g, x in unit[a].items())
    for loose in (0.1, 0.3, 0.6):
        got = {(name[r.id_a], name[r.id_b]): r.score for r in B.tfidf_pairs(vectors, loose).collect()}
        want = {(a, b): cosine(a, b) for a in unit for b in unit if a != b and cosine(a, b) >= loose}
        assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}
        assert all(abs(s - cosine(*p)) < 1e-9 for p, s in got.items())
    out = B.canopies(df, ["n"], max_size=None)
    assert out.select("id").distinct().count() == 1500
    centre = {r.canopy for r in out.collect()}
    assert all(cosine(name[a], name[b]) < 0.7 for a in centre for b in centre if a != b)


def test_learned_conjunctions_and_saved_rules(spark, tmp_path):
    rows = [(i, f"c{i % 8}", f"d{i // 8 % 8}") for i in range(128)]
    df = spark.createDataFrame(rows, f"{ID} long, a string, b string")
    truth = B.static_pairs(df, [{"fields": ["a", "b"]}])
    rules = B.learn_rules(df, ["a", "b"], truth, min_recall=0.95, min_reduction=0.95, top=2)
    assert all(" & " in r["name"] for r in rules)
    B.save_rules(rules, f"{tmp_path}/rules.json")
    again = B.load_rules(f"{tmp_path}/rules.json")
    assert B.load_rules(f"{tmp_path}/none.json") is None
    assert rows_of(B.static_pairs(df, again)) == rows_of(B.static_pairs(df, rules))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_judging(people):
    scored = people.sparkSession.createDataFrame([(i, i + 1000, 0.75 + i / 500) for i in range(100)], "id_a long, id_b long, score double")
    assert J.separating_threshold([(0.8, True), (0.7, False)]) == 0.75 and J.separating_threshold([(0.8, True)]) < 0.8 < J.separating_threshold([(0.8, False)])
    labels = [(0.1, False), (0.2, True), (0.3, False), (0.4, True), (0.5, True)]
    cut = J.separating_threshold(labels)
    assert sum((s >= cut) != ok for s, ok in labels) == 1
    budget = J.Budget(max_calls=3, prices={"m": (1.0, 2.0)}, escalation_model="big")
    threshold, labelled = J.calibrate(scored, lambda pairs: [s >= 0.871 for _, _, s in pairs], sample=12, budget=budget)
    assert abs(threshold - 0.87) < 0.011 and budget.calls <= 3 and len(labelled) <= 36
    got = {r.id_a: r.score for r in J.apply_calibration(scored, threshold, labelled).collect()}
    assert got[0] == 0.0 and got[99] == 1.0
    assert budget.model_for(0.85, "small") == "big" and budget.model_for(0.5, "small") == "small" and budget.price(1000, 500, "m") == 2.0
    budget.max_cost = 1.0
    assert not J.Budget(max_calls=0).allows()


def test_judged_clusters_and_labels(spark):
    df = spark.createDataFrame([(i, f"name {i % 2}") for i in range(6)], f"{ID} long, name string")
    scored = spark.createDataFrame([(0, 2, 0.8), (2, 4, 0.8), (0, 1, 0.8), (1, 3, 0.97), (3, 5, 0.2)], "id_a long, id_b long, score double")

    def cluster(texts):
        return [([i for i, t in enumerate(texts) if t == u], 0.9) for u in sorted(set(texts))]

    got = {(r.id_a, r.id_b): r.score for r in J.judge_clusters(scored, df, ["name"], cluster).collect()}
    assert got == {(0, 2): 0.9, (2, 4): 0.9, (0, 1): 0.0, (1, 3): 1.0, (3, 5): 0.2}
    tries = []

    def ask(a, b):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("busy")
        return a == b

    assert dict(((a, b), ok) for a, b, ok in J.label_pairs(scored, df, ["name"], ask)) == {(0, 2): True, (2, 4): True, (0, 1): False, (1, 3): True, (3, 5): True}
    low = spark.createDataFrame([("a b", None, 0.1), ("c d", "kept", 0.1), ("e f", None, 0.9)], "text string, brand string, __confidence__ double")
    more = J.extract_more(low, "text", lambda ts: [{"brand": t.split()[0]} for t in ts], ["brand"])
    assert {r.text: r.brand for r in more.collect()} == {"a b": "a", "c d": "kept", "e f": None}
    assert J.suggested_kinds({"x": {"kind": "text"}}, lambda p: {"x": "name", "y": "zip"}, ("name", "zip"))["x"]["kind"] == "name"
    assert J.suggested_blocking(["a", "b"], lambda c: [["a"], ["z"], ["a", "b"]]) == [{"fields": ["a"], "transforms": ["lowercase", "strip"]}, {"fields": ["a", "b"], "transforms": ["lowercase", "strip"]}]


def test_augmented_pairs(spark):
    pairs = spark.createDataFrame([(f"name: a{i} b c d e | city: x{i}", f"name: a{i} b c d | city: y", i % 2) for i in range(60)], "text_a string, text_b string, label int")
    out = J.augment(pairs, times=3).collect()
    assert len(out) == 240 and rows_of(J.augment(pairs, times=3)) == sorted(tuple(r) for r in out)
    originals = {(r.text_a, r.text_b) for r in out if r.variant == 0}
    assert len(originals) == 60 and sum((r.text_a, r.text_b) not in originals for r in out) > 120
    assert all(r.text_a and r.text_b for r in out)


def test_review_queue(spark, tmp_path):
    q = ReviewQueue(spark, f"file://{tmp_path}/reviews")
    assert q.stats("j") == {"pending": 0, "approved": 0, "rejected": 0}
    q.add("j", spark.createDataFrame([(1, 2, 0.8), (3, 4, 0.9), (5, 6, 0.99), (7, 8, 0.1)], "id_a long, id_b long, score double"))
    q.approve("j", 1, 2, "me")
    q.reject("j", 3, 4, "me", "no")
    q.approve("j", 9, 9, "me")
    assert q.stats("j") == {"pending": 0, "approved": 1, "rejected": 1} and q.pending("k").isEmpty()


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.2 * rng.normal(size=12)]) for i in range(1500)] + [(9000, [0.0] * 12), (9001, None)]
    df = spark.createDataFrame(rows, f"{ID} long, v array<double>")
    x = np.array([v for _, v in rows[:1500]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = VectorIndex(spark, f"file://{tmp_path}/index").load_or_build(df.filter(F.col(ID) < 1000))
    index.load_or_build(df.filter(F.col(ID) < 1500))
    assert index.entries().count() == 1500 and index.coverage(df) > 0.99
    got = {}
    for r in index.search(df.filter(F.col(ID) < 60), k=5).collect():
        got.setdefault(r["query"], set()).add(r.id)
    s = x[:60] @ x.T
    s[np.arange(60), np.arange(60)] = -1
    assert sum(len(got[q] & set(np.argsort(-s[q])[:5].tolist())) for q in range(60)) >= 0.9 * 300
    exact = {(r.id_a, r.id_b) for r in B.top_k_pairs(df.filter(F.col(ID) < 400), "v", 3).collect()}
    near = {(r.id_a, r.id_b) for r in near_pairs(df.filter(F.col(ID) < 400), "v", 3).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_near_pairs_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE", 16)
    monkeypatch.setattr(vector_index, "CELLS", 40)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i % 40]]) for i in range(110)] + [(900, [float("nan")] * 8), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, f"{ID} long, v array<float>")
    got = {(r.id_a, r.id_b): r.score for r in near_pairs(df, "v", 4, probes=1024).collect()}
    x = x.astype(float)
    cos = lambda i, j: np.cumsum(x[i] * x[j])[-1] / (np.sqrt(np.cumsum(x[i] * x[i])[-1]) * np.sqrt(np.cumsum(x[j] * x[j])[-1]))
    want = {}
    for i in range(110):
        for s, j in sorted((-cos(i % 40, j % 40), j) for j in range(110) if j != i)[:4]:
            want[min(i, j), max(i, j)] = -s
    assert got == want


def test_gates(spark):
    t = spark.createDataFrame([(1, 2), (3, 4)], "id_a long, id_b long")
    assert E.gates(E.evaluate_pairs(t, t), 0.9, 0.9, 0.9) == []
    assert len(E.gates(E.evaluate_pairs(t.limit(1), t), 0.9, 0.9, 0.9)) == 2


def test_hooks(people):
    from erspark.plans.config import Config
    from erspark.plans.pipeline import prepare

    C.register_hook("quality", lambda d: d.filter("zip is not null"))
    try:
        assert prepare(people.withColumn("zip", F.lit(None).cast("string")), Config())[0].count() == 0
    finally:
        C.HOOKS["quality"].clear()


def test_reconcile_and_versions(spark):
    members = spark.createDataFrame([(0, 0), (0, 1), (5, 5), (5, 6), (8, 8)], f"{CID} long, {ID} long")
    new = spark.createDataFrame([(10,), (11,), (12,), (13,)], f"{ID} long")
    matches = spark.createDataFrame([(10, 1, 0.9), (10, 5, 0.8), (11, 8, 0.7), (12, 13, 0.9)], "id_a long, id_b long, score double")
    got, actions = reconcile(members, new, matches, 100)
    assert {r[ID]: r.action for r in actions.collect()} == {10: "merged", 11: "merged", 12: "new", 13: "merged"}
    assert {r[ID]: r[CID] for r in got.collect()} == {0: 0, 1: 0, 5: 0, 6: 0, 10: 0, 8: 8, 11: 8, 12: 12, 13: 12}
    got, actions = reconcile(members, new, matches, 3)
    assert {r[ID]: r.action for r in actions.collect()} == {10: "conflict", 11: "merged", 12: "new", 13: "merged"}
    assert {r[ID]: r[CID] for r in got.collect()} == {0: 0, 1: 0, 10: 0, 5: 5, 6: 5, 8: 8, 11: 8, 12: 12, 13: 12}
    gold = spark.createDataFrame([(0, "a"), (5, "b")], f"{CID} long, v string")
    one = add_versions(None, gold, members, 0)
    two = add_versions(one, spark.createDataFrame([(0, "c")], f"{CID} long, v string"), members.filter(f"{CID} = 0"), 1)
    assert sorted((r[CID], r.v, r["__version__"], r["__is_current__"]) for r in two.collect()) == [(0, "a", 1, False), (0, "c", 2, True), (5, "b", 1, False)]


def test_value_overlap_of_whole_tables(spark):
    a = spark.createDataFrame([(str(i),) for i in range(900)], "x string")
    b = spark.createDataFrame([(str(i + 300),) for i in range(900)], "y string")
    assert auto.value_overlap(a, b) == {("x", "y"): 600 / 1200}


def test_header_far_down_and_longer_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Report: things\nGenerated by hand\nname,age\nann,3\nbob,4\n---\nTotal: 2,x\nend of file\n")
    got = files.smart_load(spark, f"file://{tmp_path}/a.txt")
    assert got.columns == ["name", "age"] and rows_of(got) == [("ann", "3"), ("bob", "4")]
    (tmp_path / "b.csv").write_bytes("\ufeffskip me\nid;n\n1;x\nno\n2;y;z\n".encode())
    got = files.load_file(spark, f"file://{tmp_path}/b.csv", delimiter=";", header_row=1, skip_rows=[3])
    assert got.columns == ["id", "n", "extra"] and rows_of(got) == [("1", "x", ""), ("2", "y", "z")]
    raw = spark.createDataFrame([("a\nb",), ("c\nd\ne\nf",)], "value string")
    assert len(files.parse_blocks(raw).columns) == 4


def test_entities_end_where_ascii_words_end(spark):
    """As in the query's SQL: a letter with an accent is no letter of a word there, a vertical tab no space."""
    df = spark.createDataFrame([(1, "at 3280 zuch st\u00e4ng and 5 Oak Street"), (2, "zip 12345\u00e9"), (3, "7 Elm\x0bStreet")], "doc_id long, text string")
    got = {r.doc_id: (r.zip, r.address) for r in files.extract_entities(df, ["doc_id"], kinds=("email", "phone", "zip", "address")).collect()}
    assert got == {1: ("", "3280 zuch st\u00e4ng and 5 Oak Street"[:12]), 2: ("12345", "")}


def test_active_sample_mixes_its_strategies(spark):
    """A pair whose scorers disagree is taken, strata have their share, and no pair is taken twice."""
    rows = [(i, i + 1000, i / 1000, i / 1000, i / 1000) for i in range(1000)] + [(5000 + i, 6000, 0.05, 1.0, 0.0) for i in range(4)]
    scored = spark.createDataFrame(rows, "id_a long, id_b long, score double, x double, y double")
    got = S.active_sample(scored, 20, "combined", 0.5, ["x", "y"]).collect()
    assert len({(r.id_a, r.id_b) for r in got}) == len(got) == 20
    assert {5000, 5001, 5002, 5003} <= {r.id_a for r in got}
    assert {496, 500, 503, 497} <= {r.id_a for r in got}
    assert sum(0.6 <= r.score <= 0.9 for r in got) >= 4
    assert all(any(low <= r.score < high for r in got) for low, high in ((0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.1)))
    assert [r.id_a for r in S.active_sample(scored, 3, "disagreement", features=["x", "y"]).collect()] == [5000, 5001, 5002]
    assert S.active_sample(scored, 2000, "diversity").count() == 1004


def test_classes_of_equal_rows_stand_for_their_pairs(spark, monkeypatch):
    """Pairs, counts, least pairs and links of classes are those of all pairs, by brute force; classes of many rows are several, and no pair meets a shuffle."""
    monkeypatch.setattr(B, "CLASS_ROWS", 4)
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice(["p", "q"])) for i in range(120)]
    df = spark.createDataFrame(rows, f"{ID} long, k string, l string, v string")
    keys, not_ = [{"fields": ["k"]}, {"fields": ["l"]}], [{"fields": ["v"]}]
    share = lambda a, b, c: a[c] is not None and a[c] == b[c]
    every = {(a[0], b[0]): (a, b) for a in rows for b in rows if a[0] < b[0]}
    want = {p for p, (a, b) in every.items() if share(a, b, 1) or share(a, b, 2)}
    assert sorted((r.id_a, r.id_b) for r in B.static_pairs(df, keys).collect()) == sorted(want)
    assert sorted((r.id_a, r.id_b) for r in B.static_pairs(df, keys, unlike=not_).collect()) == sorted(p for p in want if not share(*every[p], 3))
    cls = B.class_rows(df, keys, ["v"])
    assert {(r.id_a, r.id_b): (r.a_v, r.b_v) for r in B.expand(cls).collect()} == {p: (every[p][0][3], every[p][1][3]) for p in want}
    assert cls.select(F.sum(B.pairs_within())).first()[0] == len(want)
    least = B.least_pairs(cls).collect()
    assert sum(r.pairs for r in least) == len(want) and all((r.id_a, r.id_b) in want for r in least if r.pairs)
    ab = cls.filter("a_v = 'p' and b_v = 'q'")
    assert {tuple(r) for r in connected_components(B.star_links(ab)).collect()} == {tuple(r) for r in connected_components(B.expand(ab)).collect()}
    cross = B.cross_rows(df.filter(f"{ID} % 2 = 0"), df.filter(f"{ID} % 2 = 1"), keys, ["v"])
    assert sorted((r.id_a, r.id_b) for r in cross.collect()) == sorted((a, b) for a in range(0, 120, 2) for b in range(1, 120, 2) if (min(a, b), max(a, b)) in want)
    one, two = B.static_pairs(df, keys), B.static_pairs(df, not_)
    assert E.evaluate_keys(df, keys, not_).collect() == E.evaluate_pairs(one, two).collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[id_a" not in plan


def test_blocks_of_vectors_are_rows_not_pairs(spark):
    """The query has a row a vector, and its blocks are those of all pairs."""
    from erspark import catalog

    sf = "/root/testdata/sf0.01"
    groups = {r.id: r.block for r in catalog.QUERIES["ann_block_pairs"](spark, sf).collect()}
    pairs = {(r.id_a, r.id_b) for r in B.ann_blocks(catalog.table(spark, sf, "embeddings", "vec_id"), "embedding", k=3, threshold=0.4).collect()}
    assert pairs == {(a, b) for a in groups for b in groups if a < b and groups[a] == groups[b]}
