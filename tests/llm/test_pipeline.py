"""The pipeline stage by stage on the small table, and the SQL counterparts of its queries."""

import re

import duckdb
import pytest

import corpus_pipeline
from erspark.llm import queries
from erspark.plans.runtime import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        out.append((name, docs))
    return dict(out)


def test_columns_stay(stages):
    columns = stages["documents"].columns
    assert all(d.columns == columns for n, d in stages.items() if n != "best-fit packing")


def test_each_stage_acts(stages):
    n = {k: d.count() for k, d in stages.items()}
    assert n["quality rules"] < n["documents"] and n["simhash near-dedup"] <= n["line dedup"] <= n["quality rules"]
    assert n["secret scans"] == n["simhash near-dedup"]
    assert all(r.n_chars == len(r.text) for r in stages["secret scans"].collect())
    packed = {r.doc_id for r in stages["best-fit packing"].collect()}
    assert packed == {r.doc_id for r in stages["secret scans"].collect()}


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality rules"].collect()}
    long = {r.doc_id for r in stages["documents"].collect() if len(WORD.findall(r.text)) >= 10}
    good = [i for i, q in labels.items() if q == 1 and i in long]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * max(20, len(bad))


def test_near_dedup_is_exact(stages):
    before = {r.doc_id: r.text for r in stages["line dedup"].collect()}
    sets = {}
    for i, t in before.items():
        w = WORD.findall(t.lower())
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    left = set(before)
    parent = {i: i for i in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in stages["simhash near-dedup"].collect()} == {root(i) for i in before}


def test_no_secret_is_left(stages):
    for r in stages["secret scans"].collect():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_counterparts(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(str(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in cursor.fetchall())
