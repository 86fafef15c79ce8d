"""Whole runs, streams, and the queries against DuckDB."""

import os
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from erspark import api, catalog
from erspark.operators import blocking as B
from erspark.operators import clusters as K
from erspark.operators import scoring as S
from erspark.operators.clusters import CID, ID
from erspark.operators.components import connected_components
from erspark.plans.config import Blocking, BlockKey, Canopy, Config, GoldenRules, Matchkey, MatchField, config_of
from erspark.plans.pipeline import dedupe, exact_key, score_key
from erspark.sources.connectors import materialize_table
from erspark.streaming.incremental import Resolver, incremental_pairs, match_one, match_one_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    rows = [("John", "Smith", "j@x.com", "12345"), ("john", "Smith", "J@x.com", "12345"), ("Jane", "Doe", "d@y.org", "99999"), ("Jon", "Smith", "other@y.org", "12345"), ("Ann", "Lee", "a@z.net", "11111")]
    return spark.createDataFrame(rows, "first_name string, last_name string, email string, zip string")


def test_dedupe(people):
    r = api.dedupe_df(people, exact=["email"], fuzzy={"first_name": 1.0, "last_name": 1.0}, blocking=["zip"], threshold=0.85)
    assert r.report.first().clusters == 1 and r.report.first().matched_records == 3
    assert r.golden.count() == 1 and r.dupes.count() == 3 and r.unique.count() == 2


def test_dedupe_of_files_across_sources(spark, people, tmp_path):
    for n, d in (("a", people.filter("first_name <> 'john'")), ("b", people.filter("first_name = 'john'"))):
        d.write.parquet(f"{tmp_path}/{n}.parquet")
    config = config_of(exact=["zip"])
    config.across_files_only = True
    r = api.dedupe(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet", config=config)
    assert r.pairs.count() == 2


def test_dedupe_without_a_plan(people):
    assert api.dedupe_df(people).clusters.count() >= 1


def test_probabilistic_dedupe(spark):
    rows = [(f"name{i % 40}", f"city{i % 5}", str(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, city string, code string")
    fields = [MatchField("name", [], "jaro_winkler", levels=3), MatchField("code", [], "exact")]
    r = api.dedupe_df(df, Config([Matchkey("fs", "probabilistic", fields)], Blocking([BlockKey(["city"])])))
    assert r.pairs.count() > 0 and r.pairs.agg(F.max("score")).first()[0] <= 1.0


@pytest.mark.parametrize("strategy", ["multi_pass", "adaptive", "sorted_neighborhood", "learned", "canopy"])
def test_blocking_strategies_run(people, strategy):
    plan = Blocking(keys=[BlockKey(["zip"])], strategy=strategy, passes=[BlockKey(["zip"])], sub_block_keys=[BlockKey(["last_name"])], sort_key=[BlockKey(["last_name"])], canopy=Canopy(["last_name"]))
    r = api.dedupe_df(people, Config([Matchkey("w", "weighted", [MatchField("last_name", [], "levenshtein", 1.0)], 0.9)], plan))
    assert r.report.first().matched_records >= 2


def test_match(people):
    config = config_of(fuzzy={"last_name": 1.0, "first_name": 1.0}, blocking=["zip"], threshold=0.9)
    m = api.match_df(people.filter("first_name in ('john', 'Ann')"), people.filter("first_name in ('John', 'Jon')"), config)
    assert [(r.target_first_name, r.ref_first_name) for r in m.matches.collect()] == [("john", "John")] and m.unmatched.count() == 1


def test_resolver_equals_batch(spark, people, tmp_path):
    df = people.withColumn(ID, F.monotonically_increasing_id())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(people.collect())], f"{ID} long, first_name string, last_name string, email string, zip string")
    config = config_of(exact=["email"], fuzzy={"first_name": 1.0, "last_name": 1.0}, blocking=["zip"], threshold=0.85)
    state = Resolver(spark, f"file://{tmp_path}/state", config)
    for k in range(3):
        state.process(df.filter(F.col(ID) % 3 == k), k)
    state.process(df, 1)  # delivered again
    got = {r[ID]: r[CID] for r in state.membership().collect()}
    want = {r[ID]: r[CID] for r in api.dedupe_df(df, config).membership.collect()}
    assert got == want and state.stats["batches"] == 3 and state.version() == 2


def test_match_one(spark):
    df = spark.createDataFrame([(0, "Smith"), (1, "Smyth"), (2, "Doe")], f"{ID} long, name string")
    got = match_one(df, {"name": "Smith"}, [{"field": "name", "scorer": "jaro_winkler", "weight": 1.0}], 0.8).collect()
    assert [r[ID] for r in got] == [0, 1]


PLANS = {
    "static": Blocking([BlockKey(["zip"])]), "multi_pass": Blocking(strategy="multi_pass", passes=[BlockKey(["zip"]), BlockKey(["last_name"])]),
    "adaptive": Blocking([BlockKey(["zip"])], "adaptive", max_block_size=2, sub_block_keys=[BlockKey(["last_name"])]), "sorted_neighborhood": Blocking(strategy="sorted_neighborhood", sort_key=[BlockKey(["last_name"])]),
    "canopy": Blocking(strategy="canopy", canopy=Canopy(["last_name"])), "learned": Blocking([BlockKey(["zip"])], "learned"), "suggested": Blocking(auto_suggest=True),
    "selected": Blocking([BlockKey(["zip"]), BlockKey(["last_name"])], auto_select=True),
}


@pytest.mark.parametrize("plan, kind", [*((p, "weighted") for p in sorted(PLANS)), ("static", "probabilistic"), ("adaptive", "probabilistic")])
def test_match_by_any_plan(people, plan, kind):
    fields = [MatchField("last_name", ["lowercase"], "jaro_winkler", 1.0)]
    config = Config([Matchkey("email", "exact", [MatchField("email", ["lowercase"])]), Matchkey("k", kind, fields, 0.9 if kind == "weighted" else None)], PLANS[plan])
    m = api.match_df(people.filter("first_name in ('john', 'Ann')"), people.filter("first_name in ('John', 'Jon', 'Jane')"), config, mode="all")
    got = {(r.target_first_name, r.ref_first_name): r["__match_score__"] for r in m.matches.collect()}
    assert got["john", "John"] == 1.0
    if kind == "weighted":
        assert set(got) == {("john", "John"), ("john", "Jon")} and m.unmatched.count() == 1


def test_match_by_sub_blocks_and_rerank(people):
    config = Config([Matchkey("k", "weighted", [MatchField("last_name", [], "levenshtein", 1.0)], 0.9, rerank=True)], Blocking([BlockKey(["zip"])], max_block_size=1, sub_block_column="last_name"))
    assert api.dedupe_df(people, config).report.first().matched_records == 3


def test_resolver_of_probabilistic_keys_and_any_plan(spark, tmp_path):
    rows = [(i, f"name{i % 20}", f"city{i % 4}", str(i % 20)) for i in range(60)]
    df = spark.createDataFrame(rows, f"{ID} long, name string, city string, code string")
    fields = [MatchField("name", [], "jaro_winkler", levels=3), MatchField("code", [], "exact")]
    for k, plan in enumerate((Blocking([BlockKey(["city"])]), Blocking(strategy="sorted_neighborhood", sort_key=[BlockKey(["name"])]))):
        state = Resolver(spark, f"file://{tmp_path}/s{k}", Config([Matchkey("fs", "probabilistic", fields, link_threshold=0.99)], plan))
        for part in range(2):
            state.process(df.filter(F.col(ID) % 2 == part), part)
        members = state.membership().collect()
        assert len(members) == 60 and state.stats["errors"] == 0 and state.stats["rate"] > 0
        assert all(r[ID] % 20 == r[CID] % 20 for r in members)


def test_sync_and_versions(spark, people, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(people.collect())], f"{ID} long, first_name string, last_name string, email string, zip string")
    config = config_of(exact=["email"])
    state = Resolver(spark, f"file://{tmp_path}/state", config, reconciling=True)
    assert state.sync(df.filter(f"{ID} < 1")) == "full" and state.sync(df.filter(f"{ID} < 1")) == "nothing" and state.sync(df) == "new"
    assert state.cluster_of(1) == 0 and state.members_of(0).count() == 2
    gold = {(r[CID], r["__version__"]): r["__is_current__"] for r in state.golden().collect()}
    assert gold[0, 1] is False and gold[0, 2] is True and gold[2, 1] is True
    other = Resolver(spark, f"file://{tmp_path}/state", config_of(exact=["zip"]), reconciling=True)
    assert other.sync(df) == "full" and other.cluster_of(3) == 0


def test_jobs_and_tables(spark, people, tmp_path):
    jobs = api.Jobs(spark)
    people.createOrReplaceTempView("people_in")
    jobs.dedupe("j", "people_in", exact=["email"])
    assert spark.sql("SELECT count(*) FROM j_membership").first()[0] == 5 and jobs.status("j") == "done" and jobs.status("k") == "unknown"
    jobs.match("m", people, people, exact=["email"])
    assert {r.job for r in jobs.list().collect()} == {"j", "m"} and jobs.get("m", "matches").count() == 5
    with pytest.raises(ValueError):
        api.gate(spark.createDataFrame([(1, 2)], "id_a long, id_b long"), spark.createDataFrame([(3, 4)], "id_a long, id_b long"), min_f1=0.5)
    materialize_table(spark, "people_in", "people_golden", exact=["email"])
    assert spark.table("people_golden").count() == 1


def test_near_record(spark):
    df = spark.createDataFrame([(0, "Smith", [1.0, 0.0]), (1, "Smyth", [0.9, 0.1]), (2, "Smith", [0.0, 1.0])], f"{ID} long, name string, v array<double>")
    got = match_one_near(df, {"name": "Smith"}, [1.0, 0.0], "v", [{"field": "name", "scorer": "jaro_winkler", "weight": 1.0}], 0.5, k=2).collect()
    assert [r[ID] for r in got] == [0, 1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql_counterparts(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cursor.fetchall())


def test_matching_by_classes_is_matching_by_rows(spark):
    """Rows alike are compared once for all; matches, best ones and targets without one are those of all pairs, for keys of any plan, and no pair is shuffled."""
    import random

    from erspark.functions.similarity import jaro_winkler
    from erspark.plans.pipeline import match

    rng = random.Random(5)
    rows = [(i, rng.choice(["anna", "annie", "bob", "zed"]), rng.choice("xyz"), rng.choice("pq")) for i in range(160)]
    df = spark.createDataFrame(rows, "__row_id__ long, name string, k string, l string")
    t, r = df.filter("__row_id__ % 4 = 0 and name <> 'zed' or __row_id__ = 3"), df.filter("__row_id__ % 4 <> 0 and __row_id__ <> 3 and name <> 'zed'")
    left, right = ([rows[x["__row_id__"]] for x in d.collect()] for d in (t, r))
    key = Matchkey("n", "weighted", [MatchField("name", [], "jaro_winkler", 1.0)], 0.8)
    for plan, meet in ((Blocking([BlockKey(["k"])]), lambda a, b: a[2] == b[2]), (Blocking(strategy="multi_pass", passes=[BlockKey(["k"]), BlockKey(["l"])]), lambda a, b: a[2] == b[2] or a[3] == b[3]),
                       (Blocking([BlockKey(["k"])], "adaptive", max_block_size=2, sub_block_keys=[BlockKey(["l"])]), lambda a, b: a[2:] == b[2:])):
        want = {(a[0], b[0]): jaro_winkler(a[1], b[1]) for a in left for b in right if meet(a, b) and jaro_winkler(a[1], b[1]) >= 0.8}
        out = match(t, r, Config([key], plan, auto_fix=False), "all")
        assert sorted((x[0], x[1]) for x in out.scored.collect()) == sorted(want) and out.matches.count() == len(want)
        assert "keys=[id_a" not in out.scored._jdf.queryExecution().executedPlan().toString()
        assert {x["__row_id__"] for x in out.unmatched.collect()} == {a[0] for a in left} - {a for a, _ in want}
        best = match(t, r, Config([key], plan, auto_fix=False), "best")
        first = {a: min((-s, j) for (i, j), s in want.items() if i == a)[1] for a, _ in want}
        assert {x[0]: x[1] for x in best.scored.collect()} == first


@pytest.mark.parametrize("kind", ["probabilistic", "weighted"])
def test_increment_by_classes(spark, kind):
    names = ["red bolt", "red bolts", "blue ring", "blue rings", "old nut"]
    df = spark.createDataFrame([(i * 7 % 120, names[i % 5], i % 3, i % 2) for i in range(120)], f"{ID} long, name string, size long, kind long")
    fields = [MatchField("name", [], "jaro_winkler", levels=3), MatchField("size", [], "exact")]
    m = Matchkey("m", kind, fields, 0.9 if kind == "weighted" else None, link_threshold=0.0 if kind == "probabilistic" else None)
    plan = Config([m], Blocking([BlockKey(["kind"])]))
    known, new = df.filter(F.col(ID) % 4 != 0), df.filter(F.col(ID) % 4 == 0)
    cand = B.cross_pairs(new, known, [{"fields": ["kind"]}]).toDF("id_a", "id_b").unionByName(B.static_pairs(new, [{"fields": ["kind"]}]))
    want = {tuple(r) for r in S.best_per_pair(score_key(df, m, cand, plan.blocking)).collect()}
    got = incremental_pairs(known, new, plan)
    links = incremental_pairs(known, new, plan, links=True)
    assert {tuple(r) for r in got.collect()} == want and {tuple(r) for r in links.collect()} <= want and want
    assert sorted(connected_components(got).collect()) == sorted(connected_components(links).collect())


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("most", [4])
def test_dedupe_of_classes(spark, most, exact):
    names = ["red bolt", "red bolts", "red belts", "blue ring", "blue rings", "old nut"]
    df = spark.createDataFrame([(i * 7 % 72, names[i * 13 % 31 % 6], i % 3, i % 2) for i in range(72)], f"{ID} long, name string, size long, kind long")
    keys = [Matchkey("e", "exact", [MatchField("name"), MatchField("size"), MatchField("kind")])] if exact else []
    fuzzy = Matchkey("f", "weighted", [MatchField("name", [], "jaro_winkler", 2.0), MatchField("size", [], "exact", 1.0)], 0.9)
    got = dedupe(df, Config([*keys, fuzzy], Blocking([BlockKey(["kind"])]), GoldenRules("majority_vote", max_cluster_size=most), auto_fix=False))
    scored = S.weighted_scores(B.static_pairs(df, [{"fields": ["kind"]}]), df, [f.as_dict() for f in fuzzy.fields], 0.9)
    if exact:
        scored = scored.join(got.pairs.filter("score < 1"), ["id_a", "id_b"], "left_semi").filter("score < 1")
    links = [B.exact_links(df, exact_key(k)) for k in keys] + [scored.withColumn("pairs", F.lit(1.0))]
    members, clusters = K.build_clusters(reduce(lambda x, y: x.unionByName(y.select(x.columns)), links), df, most)
    assert got.classes is not None and sorted(got.membership.collect()) == sorted(members.collect())
    assert {r[CID]: r for r in got.clusters.collect()} == {r[CID]: r for r in clusters.collect()}
    assert got.pairs.filter("score < 1").count() == scored.filter("score < 1").count() > 0
