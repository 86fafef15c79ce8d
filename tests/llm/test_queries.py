"""The registered queries against brute force and libraries, and operators on tables of clashing, null, long and repeated values."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from erspark.llm import annsearch, bpe, chat, linededup, neardup, packing, quality, queries, secrets, sharding, simhash, urlfilter, urllabels
from tests.llm.test_llm import brute_fingerprint, brute_nearest, brute_spans, components

SF = "/root/testdata/sf0.001"
CLASHES = ("covered", "spans", "n_words", "N_LINES", "__w", "__l", "__h", "__g", "__gone", "__a", "__b", "__p", "__grams", "__f", "__order", "__task", "__row", "__k1", "__k2", "kept",
           "failed", "maybe", "page", "map", "base", "rule", "gone", "h1", "h2", "node", "root", "n", "text2", "host", "a.b", "grams", "__one", "sequence_id", "offset", "ids", "w", "f", "bad")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages", "embeddings", "conversations")}


def texts_of(tables):
    return {r.doc_id: r.text or "" for r in tables["documents"].collect()}


def test_op3(spark, tables):
    model = urlfilter.train(spark)
    weight, grams_of = model.coefficients.toArray(), []
    from pyspark.ml.feature import HashingTF

    hashing = HashingTF(numFeatures=urlfilter.BUCKETS)

    def plain(url):
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule = verdict = None
        for v, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                rule, verdict = h + p, v
                break
        if verdict is None:
            found = set()
            for s, tag in ((host, "h"), (path, "p")):
                padded = f"^{s}$"
                found |= {hashing.indexOf(tag + padded[i:i + n]) for n in urlfilter.GRAMS for i in range(len(padded) - n + 1) if s}
            grams_of.append(found)
            verdict = "block" if sum(weight[i] for i in found) + model.intercept > 0 else "allow"
        return host, path, rule, verdict

    urls = {r.page_id: r.url for r in tables["pages"].collect()}
    got = queries.QUERIES["op3_url_filters"](spark, SF)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id])
    assert grams_of


def test_op3_model_on_unseen_hosts(spark):
    seen = {h for h, _, _ in urllabels.training_table()}
    rows = urllabels.held_out_table()
    assert not seen & {h for h, _, _ in rows}
    judged = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urlfilter.host_path(F.col("url"))[0].alias("h")).distinct().collect()
    assert not seen & {r.h for r in judged}
    got = urlfilter.score_urls(urlfilter.labelled_urls(spark, rows), urlfilter.train(spark)).select("label", "bad").collect()
    hit = sum(r.bad and r.label == 1.0 for r in got)
    assert hit >= 0.95 * sum(r.bad for r in got) and hit >= 0.6 * sum(r.label for r in got)


def test_op4(spark, tables):
    fps = {i: brute_fingerprint(t) for i, t in texts_of(tables).items()}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{fps[i]:016x}", want[i]) for i in sorted(fps)]


def test_op5(spark, tables):
    want = brute_nearest([(r.vec_id, r.embedding) for r in tables["embeddings"].collect()])
    got, hits = {}, 0
    out = queries.QUERIES["op5_nearest_neighbours"](spark, SF)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == [*range(1, len(want[q]) + 1)]
        exact = dict(want[q])
        hits += sum(v in exact and abs(exact[v] - s) < 1e-9 for _, v, s in found)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_op6(spark, tables):
    texts = texts_of(tables)
    got = queries.QUERIES["op6_secret_scans"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_op8(spark, tables):
    texts = texts_of(tables)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.QUERIES["op8_bpe_round_trip"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, t in texts_of(tables).items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes()))
    got = queries.QUERIES["op9_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 4096
    assert len(sequences) <= 1 + 1.02 * -(-total // 4096)


def test_op10(spark, tables):
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    got = queries.QUERIES["op10_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, slots, shard = np.zeros(8, np.int64), {}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard.setdefault(raw, r.shard) == r.shard
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    largest = max(len(raw) + 1 for raw in shard)
    assert load.max() - load.min() <= max(largest, 0.02 * load.sum() / 8)


def test_sharding_level_by_level(spark):
    rng = np.random.default_rng(12)
    sizes = rng.lognormal(6, 1.2, 900).astype(int)
    groups = spark.createDataFrame([(int(g), int(g), 1, int(s)) for g, s in zip(rng.integers(0, 1 << 60, 900), sizes)], "g1 long, g2 long, n long, bytes long")
    out = sharding.assign_groups(groups, 8, part=20, parts=4).join(groups.select("g1", "bytes"), "g1").groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("c")).collect()
    assert sum(r.c for r in out) == 900 and max(r.b for r in out) - min(r.b for r in out) <= sizes.max()


def test_packing_spreads_equal_keys(spark):
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.lit("x").alias("__order"))
    out = packing.pack(pieces, task=500)
    assert out.columns == ["doc_id", "piece", "length", "__order", "sequence_id", "offset"]
    tasks = {r.sequence_id >> 32: r.c for r in out.groupBy("sequence_id").agg(F.count("*").alias("c")).collect()}
    assert len(tasks) == 8 and out.groupBy("sequence_id", "offset").count().filter("count > 1").isEmpty()


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with null, empty, long and repeated values, and a column for every name that an operator might use."""
    long_text = "\n".join(f"line {i} of a long text, password = hunter{i:06d}x and so on" for i in range(3000))
    texts = [None, "", "one", "a b c d e f g h i j k\nsecond line\nthird line\nend", "a b c d e f g h i j k\nsecond line\nthird line\nother end", long_text, "the same the", "the same the"]
    rows = [(i, t, "src", "en", None if t is None else len(t)) for i, t in enumerate(texts)] + [(6, "the same the", "src", "en", 12), (None, "no id here", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for i, c in enumerate(CLASHES)))


def untouched(out, df, replaced=()):
    kept = [c for c in df.columns if c.lower() not in replaced]
    assert set(kept) <= set(out.columns)
    own = {f"`{c}`": f"{i}:" for i, c in enumerate(CLASHES) if c.lower() not in replaced}
    for r in out.select(*own).collect():
        assert all(v.startswith(start) for v, start in zip(r, own.values()))


def test_no_column_is_touched(spark, odd):
    out = quality.quality_rules(odd)
    untouched(out, odd, {*quality.COUNTS, *quality.RATIOS, "failed", "base_failed", "kept"})
    assert out.count() == odd.count()
    out = linededup.line_dedup(odd)
    untouched(out, odd, {"text", "n_lines", "n_removed"})
    assert {r.doc_id: r.text for r in out.collect()}[4] == "other end"
    out = secrets.redact_secrets(odd)
    untouched(out, odd, {"text"})
    assert "hunter" not in {r.doc_id: r.text for r in out.collect()}[5]
    assert out.count() == odd.count()
    untouched(neardup.near_duplicates(odd), odd)
    turns = odd.select("*", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text"))).alias("chosen"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("text"))).alias("rejected"))
    untouched(chat.format_preferences(turns), odd)
    untouched(urlfilter.url_filter(odd.withColumn("url", F.concat(F.lit("http://a.example.org/"), F.repeat(F.lit("x"), 100_000)))), odd, {"host", "path", "rule", "verdict"})
    untouched(bpe.bpe_encode(odd, public_tokenizers.path("byte_bpe_50k.json")), odd, {"ids"})
    assert sharding.shard_documents(odd).count() == packing.pack_documents(odd).select("doc_id").filter("doc_id is not null").distinct().count() + 2
    assert simhash.simhash_components(odd).count() == odd.count()
    vectors = odd.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.col("doc_id").cast("float"), F.lit(1.0))})
    assert annsearch.nearest(vectors).filter("query_id = 0").count() == 5


def test_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 0.0]), (4, [])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 9)) for r in annsearch.nearest(df).orderBy("rank").collect()] == [(1, 1.0), (3, round(0.5 ** 0.5, 9)), (2, 0.0)]


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, SF)
            if name != "best-fit packing":
                assert out.columns == odd.columns
                assert dict(out.dtypes) == dict(odd.dtypes)
                untouched(out, odd, {"text"})
            if df is not odd:
                assert out.count() == 0
    kept = corpus_pipeline.near_dedup(spark, odd, SF)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [(False, i) for i in (0, 2, 3, 4, 5, 6)]


def test_owned_spans_by_brute_force(spark):
    rng = np.random.default_rng(13)
    values = ["".join(rng.choice([*"abcdefghijkXYZ0123456789"], 24)) + "aA1" for _ in range(40)]
    rows = []
    for i in range(400):
        some = rng.choice(40, 3)
        # the first values have one owner each, the next many repositories of one owner, the rest many owners
        words = [values[v] for v in some if v >= 20 or i % 10 == v % 10 and i < 100]
        rows.append((i, f"text {i} " + " and ".join(words) + " password=" + values[20 + int(some[0]) % 20], f"owner{i % 10}" if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place, owners, repos = {}, {}, {}
    for i, t, o in rows:
        base = [(m.start(), m.end(), m[1]) for m in re.finditer(r"password=([A-Za-z0-9+/_.=-]+)", t)]
        base += [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9a-f]{24,}", t)] + [(m.start(), m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        more = [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}", t)]
        more = [x for x in more if re.search("[0-9]", x[2]) and re.search("[a-z]", x[2]) and re.search("[A-Z]", x[2])]
        more = [x for x in more if not any(b[0] < x[1] and x[0] < b[1] for b in base)]
        place[i] = more
        for _, _, v in base + more:
            owners.setdefault(v, set()).add(o)
            repos.setdefault(v, set()).add(t)
    assert any(len(owners[v]) <= 2 for v in owners) and any(len(owners[v]) > 2 for v in owners)
    for most in (secrets.MAX_REPOS, 3):
        for r in secrets.scan_secrets(df, max_repos=most).collect():
            want = [(a, b) for a, b, v in place[r.doc_id] if len(owners[v]) <= 2 and len(repos[v]) <= most]
            assert [(s.start, s.end) for s in r.spans if s.kind == "owned"] == want


def test_redacting_a_long_text(spark):
    n = 12_000
    parts = [f"é{i} token: secret{i:07d} 🙂 " for i in range(n)]
    df = spark.createDataFrame([(1, "".join(parts), "o")], "doc_id long, text string, source string")
    r = secrets.redact_secrets(df).first()
    assert r.text == "".join(f"é{i} <secret> 🙂 " for i in range(n))


def test_bpe_cuts_texts_without_spaces(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 200)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, ours = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
        texts = ["中文字，分词。测试1中" * 120, "QmFzZTY0IGVuY29kZWQ+/0aB9=" * 80, "abc=\nd'sé́f2g \n\n h 'll" * 90, "x1y2" * 300, "あいう、えお。" * 90]
        assert [x.tolist() for part in ours.encode(texts) for x in part] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert max(len(p) for t in texts for p in ours.parts(t)) < 400
