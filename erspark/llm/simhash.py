"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments of 22, 21 and 21. Of 4 differing bits two
segments hold at most 2 together, whichever way they fall. For each pair of segments both are
decoded in the perfect (23, 12) Golay code, once as they are and once with each single bit
of either turned: fingerprints 2 bits apart have a midpoint one bit from both, so they share a
pair of codewords. Keys are joined by a shuffle; members of a bucket are verified by counting
differing bits, and what leaves a bucket is links that join its members, never all its pairs.
Buckets above LIMIT members are dealt again by the five chunks of which linked
fingerprints share one; what is still larger falls into blocks, of which every two meet in one task. None is cut,
and no task holds more than two blocks of a bucket.

Defined cases: a text without words, null ones too, has fingerprint 0; equal fingerprints are
one node however many rows they have; null ids take no part in the least id, so a component of
null ids alone has a null id; an empty table gives an empty one; repeated rows are linked;
texts of any length are hashed whole; only the columns named are read, so others can't clash.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.operators.components import connected_components
from erspark.plans.runtime import join_split_hot, materialize, ship

#: Words in a shingle, differing bits of a link, and the seed of the hash.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: First bit and length of each segment; most members of a bucket that are compared at once.
SEGMENTS, LIMIT = ((0, 22), (22, 21), (43, 21)), 4096
#: Fixed value: the generator polynomial of the Golay code.
GOLAY = 0xC75
BLOCK = 1 << 16


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 3 bytes of a 23-bit word, and the error pattern of each remainder."""
    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v
    parts = np.array([[rest(b << s & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)], np.int32)
    errors = np.zeros(2048, np.int32)
    for k in (1, 2, 3):
        for bits in combinations(range(23), k):
            e = sum(1 << b for b in bits)
            errors[rest(e)] = e
    return parts, errors


_tables = None


def decode_golay(v: np.ndarray) -> np.ndarray:
    """Index, 0 to 4095, of the codeword nearest to each 23-bit word."""
    global _tables
    if _tables is None:
        _tables = golay_tables()
    parts, errors = _tables
    s = parts[0][v & 255] ^ parts[1][v >> 8 & 255] ^ parts[2][v >> 16]
    return (v ^ errors[s]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of uint64 fingerprints; any two within RADIUS bits share a key."""
    near, own = [], []
    for at, n in SEGMENTS:
        seg = (fp >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1)
        turned = seg[:, None] ^ np.r_[0, 1 << np.arange(n)][None, :]
        near.append(decode_golay(turned.astype(np.int32)).astype(np.int64))
        own.append(near[-1][:, :1])
    rows, keys = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        k = np.concatenate([near[i] << 12 | own[j], own[i] << 12 | near[j]], axis=1) | p << 24
        k.sort(axis=1)
        fresh = np.ones(k.shape, bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(k[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, size: int):
    """Blocks of XXH64 of the word shingles of a text, whole and with repeats."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, stop = np.r_[0, gaps + 1], np.r_[gaps, len(joined)]
    if len(words) > size:
        start, stop = start[:len(words) - size + 1], stop[size - 1:]
    else:
        start, stop = start[:1], stop[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), BLOCK):
        a, b = start[at:at + BLOCK].tolist(), stop[at:at + BLOCK].tolist()
        yield np.fromiter(map(digest, [joined[x:y] for x, y in zip(a, b)], repeat(SEED)), np.uint64, len(a))


_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def simhash(blocks) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    ones, n = np.zeros((8, 8), np.int64), 0
    for h in blocks:
        raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[b] += np.bincount(raw[:, b], minlength=256) @ _BITS
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * ones.ravel() > n).tolist())


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""
    ship(df.sparkSession)
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join members of a bucket as all its links do: each found member is asked for its unmet neighbours once."""
    rest, a, b = fp, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= radius
            if hit.any():
                found = rest[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~hit]
    none = np.zeros(0, fp.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _deal_again(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New keys of the members of an oversized run: fingerprints of at most four differing bits share one of five chunks."""
    chunk = np.array([0, 13, 26, 39, 52], np.uint64)
    value = (fp[:, None] >> chunk[None, :] & np.uint64(0x1FFF)).astype(np.int64)
    new = (value | np.arange(5)[None, :] << 13) ^ (np.int64(key) << 20)
    return new.ravel(), np.repeat(fp, 5)


def _table(kind: int, a: np.ndarray, b: np.ndarray, block: int = 0) -> pa.RecordBatch:
    long = lambda x: pa.array(np.asarray(x).astype(np.int64, copy=False))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), long(a), long(b), pa.array(np.full(len(a), block, np.int64))], ["kind", "a", "b", "block"])


LINKED, LARGE = 0, 1


def _link_runs(batches, radius: int, limit: int, again: bool):
    """From rows (key, fp), sorted: rows (LINKED, a, b, 0), or of runs above ``limit`` rows (LARGE, new key, fp, 0) if they are
    dealt ``again``, else (LARGE, key, fp, block) in blocks of half the limit. At most ``limit`` rows of a run are held."""
    key, held, large, seen = None, [], False, 0

    def part(key: int, fp: np.ndarray):
        nonlocal seen
        if again:
            yield _table(LARGE, *_deal_again(key, fp))
            return
        half = max(1, limit // 2)
        block = (seen + np.arange(len(fp))) // half
        seen += len(fp)
        for k in np.unique(block).tolist():
            some = fp[block == k]
            yield _table(LARGE, np.full(len(some), key), some.view(np.int64), k)

    def finish():
        fp = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if len(fp) and large:
            yield from part(key, fp)
        elif len(fp) > 1:
            a, b = bucket_links(fp, radius)
            if len(a):
                low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
                yield _table(LINKED, low, high)

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        stop = np.r_[head[1:], len(keys)]
        inner = (head > 0) & (stop < len(keys)) & (stop - head <= 6)
        if inner.any():  # the many small runs that lie within a batch, all at once
            few = np.repeat(inner, stop - head)
            a, b = [], []
            for d in range(1, 6):
                i = np.flatnonzero(few[d:] & few[:-d] & (keys[d:] == keys[:-d])) if len(keys) > d else np.zeros(0, np.int64)
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
                a.append(fps[i].view(np.int64))
                b.append(fps[i + d].view(np.int64))
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield _table(LINKED, pair[0], pair[1])
        for h, t in zip(head[~inner].tolist(), stop[~inner].tolist()):
            if key is None or keys[h] != key:
                yield from finish()
                key, held, large, seen = int(keys[h]), [], False, 0
            held.append(fps[h:t])
            if large or sum(map(len, held)) > limit:
                large = True
                yield from part(key, np.concatenate(held))
                held = []
    yield from finish()


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` of distinct fingerprints (column ``fp``): pairs within ``radius`` bits whose components are those of all such pairs."""
    ship(fps.sparkSession)
    if radius > RADIUS:
        raise ValueError(f"the keys find pairs of up to {RADIUS} differing bits")

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                row, key = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], ["key", "fp"])

    out = "kind byte, a long, b long, block long"
    sorted_by = lambda d: d.repartition("key").sortWithinPartitions("key", "fp")
    runs = lambda d, again: materialize(sorted_by(d).mapInArrow(lambda it: _link_runs(it, radius, LIMIT, again), out))
    pairs = lambda d: d.filter(F.col("kind") == LINKED).select("a", "b")
    first = runs(fps.select("fp").mapInArrow(keys, "key long, fp long"), True)
    links, large = pairs(first), first.filter(F.col("kind") == LARGE)
    if not large.isEmpty():
        second = runs(large.select(F.col("a").alias("key"), F.col("b").alias("fp")), False)
        links, large = links.unionByName(pairs(second)), second.filter(F.col("kind") == LARGE)
        if not large.isEmpty():
            blocks = large.groupBy("a").agg(F.max("block").alias("last"))
            both = join_split_hot(large.select("a", "b", "block"), blocks, ["a"], large.groupBy("a").agg(F.count("*").alias("n")), large.count())
            other = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda k: F.xxhash64("a", F.least("block", k), F.greatest("block", k)))
            units = materialize(both.select(F.explode(other).alias("key"), F.col("b").alias("fp")))
            links = links.unionByName(sorted_by(units).mapInArrow(_unit_runs(radius), "a long, b long"))
    return links.distinct()


def _unit_runs(radius: int):
    """Links within each unit, two blocks of a large bucket."""
    def run(batches):
        for kind in _link_runs(batches, radius, 1 << 62, False):
            yield kind.select(["a", "b"])
    return run


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over links of fingerprints."""
    docs = materialize(fingerprints(df, doc_id, text, size))
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(nodes, radius), "a", "b")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    placed = materialize(placed)
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    total = placed.agg(F.sum("n").alias("n"), F.count("*").alias("fps")).first()
    # one component may hold most fingerprints, and one fingerprint most rows
    named = materialize(join_split_hot(placed, least, ["root"], None, total.fps, count="fps").select("fp", "n", "component_id"))
    return join_split_hot(docs, named, ["fp"], None, total.n or 0).select("doc_id", "fp", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
