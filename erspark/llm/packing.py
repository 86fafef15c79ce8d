"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are encoded, ended with an end id, and those longer than a sequence are cut. Pieces
are dealt by hash to tasks of about ``TASK`` pieces. Each task packs online: a piece goes
to the open bin with the least free space that holds it, found in a bitset keyed by free space;
if none does, a bin is opened, and when ``bins`` are open the fullest is closed first.
Pieces arrive in falling length within windows of ``ARRIVE`` of them, so large ones meet small ones early.

Defined cases: a null text is an empty one, a single end id; repeated rows are packed each;
an empty table gives an empty one; texts of any length are encoded whole; other columns of a piece are carried through, and columns
named like an output are replaced. ``pack`` deals equal pieces apart by the place at which they are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.bpe import Vocabulary, encoder
from erspark.plans.runtime import materialize, ship, without

CAPACITY, BINS, TASK, ARRIVE = 4096, 512, 16384, 1024


def encode_pieces(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``; ids are little-endian unsigned 32-bit numbers."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids"]
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        enc = encoder(shared)
        for batch in batches:
            done = 0
            for lists in enc.encode(batch.column(1).to_pylist()):
                row, piece, start, length, ids = [], [], [], [], []
                for i, x in enumerate(lists):
                    raw, n = x.astype("<u4").tobytes() + end, len(x) + 1
                    for k in range(-(-n // capacity)):
                        a, b = k * capacity, min(n, (k + 1) * capacity)
                        row.append(done + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(raw[4 * a:4 * b])
                done += len(lists)
                for at in range(0, len(row), 2048):
                    part = slice(at, at + 2048)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part], pa.int64())), pa.array(piece[part], pa.int32()),
                                                      pa.array(start[part], pa.int64()), pa.array(length[part], pa.int64()), pa.array(ids[part], pa.binary())], names)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int = CAPACITY, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length, in the order given, and the place in it."""
    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, opened, made = 0, 0, 0  # bit f is set if an open bin has f free
    for i, n in enumerate(lengths):
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if opened >= bins and n < capacity:
                least = (bits & -bits).bit_length() - 1
                by_free[least].pop()
                if not by_free[least]:
                    bits ^= 1 << least
                opened -= 1
            free, b = capacity, made
            made += 1
            opened += 1
        of[i], at[i] = b, capacity - free
        free -= n
        if free:
            by_free[free].append(b)
            bits |= 1 << free
        else:
            opened -= 1
    return of, at


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, bins: int = BINS, key: tuple = ("doc_id", "piece"), task: int = TASK) -> DataFrame:
    """``pieces``, a stored table, with ``sequence_id`` and ``offset``; each length is from 1 to ``capacity``."""
    ship(pieces.sparkSession)
    pieces = without(pieces, "sequence_id", "offset")
    tasks = max(1, -(-pieces.count() // task))
    # columns are numbers meanwhile, so whatever they are called none meets another
    names, schema = pieces.columns, pieces.schema
    c = {n: f"c{i}" for i, n in enumerate(names)}
    keys, size = [c[k] for k in key], c[length]
    # keys may repeat, null ones above all: the place of a row where it is read tells equal ones apart. Rows are read from
    # files, so a task that is run again numbers them as before
    dealt = pieces.toDF(*c.values()).withColumn("at", F.monotonically_increasing_id()).withColumns({
        "order": F.xxhash64(*keys, size, "at"), "task": F.pmod(F.xxhash64(F.lit(9), *keys, size, "at"), F.lit(tasks))}).drop("at")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", *keys, size], ignore_index=True)
        pdf = pdf.iloc[np.lexsort((np.arange(len(pdf)), -pdf[size], np.arange(len(pdf)) // ARRIVE))].reset_index(drop=True)
        of, at = best_fit(pdf[size].tolist(), capacity, bins)
        pdf["sequence_id"] = (int(pdf["task"].iloc[0]) << 32) + of if len(pdf) else of
        pdf["offset"] = at
        return pdf[[*c.values(), "sequence_id", "offset"]]

    out = ", ".join(f"{c[f.name]} {f.dataType.simpleString()}" for f in schema.fields)
    return dealt.groupBy("task").applyInPandas(run, f"{out}, sequence_id long, offset long").toDF(*names, "sequence_id", "offset")


def pack_documents(df: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``; ids stay behind, which
    ``encode_pieces`` gives again for sequences that are to be written."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = encode_pieces(df, vocabulary, doc_id, text, capacity)
    narrow = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(narrow, capacity=capacity)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
