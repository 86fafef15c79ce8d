"""BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by whole-array operations on code points, and equal words of a block
are found by a dictionary encoding. Only words that the worker has not met are merged: the
symbols of all of them lie in one flat array, and in each round every word merges its pair of
lowest rank, found by binary search over sorted pair keys. Ids of texts are then gathered.

Two kinds of vocabulary files are read: byte-level BPE whose words tile the text, and BPE with
word ends ("</w>") over lower-cased NFC text without white space.

Defined cases: a null text is an empty one and has no ids; strings of special tokens in a text
become their ids, as in the tokenizers library; texts of any length are worked through in
pieces cut where words never join (before white space, and between letters, digits and punctuation), so a piece is longer than
BLOCK only if a single run without such a place is; input columns named like an output are replaced; an empty table
gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erspark.plans.runtime import ship, without

#: Characters worked on at once, and words that a worker remembers.
BLOCK, REMEMBER = 1 << 20, 500_000
#: Words of more symbols are merged one at a time with a heap.
LONG = 256
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: White space of the pattern language.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added, which Python's own tables lack.
UNICODE_16 = (
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER), (0x10D40, 0x10D49, NUMBER),
    (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER), (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER),
    (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER), (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER),
    (0x116D0, 0x116E3, NUMBER), (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER), (0x1CCF0, 0x1CCF9, NUMBER),
    (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
)
#: Where a text may be cut: no word reaches from a character in white space, nor from one class into another,
#: apart from quotes; combining marks, which may join the letter before them, are not among these characters.
HAN = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
CUT = re.compile(rf"[A-Za-z0-9+/={HAN}](?=[ \n\t\r])|[0-9](?=[A-Za-z{HAN}])|[A-Za-z{HAN}](?=[0-9.,;:!?()\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f])")
_classes = None


def classes() -> np.ndarray:
    """The class of each code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(SPACES)] = SPACE
        for a, b, k in UNICODE_16:
            table[a:b + 1] = k
        _classes = table
    return _classes


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a vocabulary file holds, as arrays; plain data, so it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, letters = j["model"], byte_letters()
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.word_ends = bool(end)
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        new = np.array([ids[a + b] for a, b in pairs], np.int64)
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = {}
        for r, t in enumerate(new):
            made.setdefault(int(t), r)
        rank = np.arange(len(pairs))
        if any(made.get(int(x), -1) > r for side in (left, right) for r, x in enumerate(side)):
            raise ValueError("a merge comes before one that makes its part")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], rank[order], new[order]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        back = {c: b for b, c in enumerate(letters)}
        size = max([*ids.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for t, i in ids.items():
            t = t.removesuffix(end) if end else t
            spelled[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            spelled[i] = t.encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)


def merge(v: Vocabulary, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of ``n`` words: ``sym`` their symbols, ``word`` the word of each, ascending."""
    done_sym, done_word = [], []
    none = len(v.keys)
    while len(sym):
        # a word's last symbol has no pair
        inner = np.empty(len(sym), bool)
        inner[-1] = False
        np.equal(word[1:], word[:-1], out=inner[:-1])
        at = np.flatnonzero(inner)
        key = sym[at] << 32 | sym[at + 1]
        found = np.minimum(np.searchsorted(v.keys, key), none - 1)
        hit = v.keys[found] == key
        at, found = at[hit], found[hit]
        rank = v.rank[found]
        of = word[at]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        live = np.zeros(n, bool)
        live[of] = True
        keep = live[word]
        if not keep.all():
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
        if not len(of):
            break
        least = np.minimum.reduceat(rank, heads)
        best = rank == np.repeat(least, np.diff(np.r_[heads, len(of)]))
        at, found = at[best], found[best]
        # of touching pairs (a symbol beside itself) every second one from the left
        touch = np.r_[False, at[1:] == at[:-1] + 1]
        if touch.any():
            run = np.flatnonzero(~touch)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 1
            at, found = at[~odd], found[~odd]
        sym = sym.copy()
        sym[at] = v.new[found]
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n)


def merge_long(v: Vocabulary, sym: list[int]) -> list[int]:
    """Ids of one long word, by a heap over a linked list."""
    n = len(sym)
    nxt, prev, none = [*range(1, n), -1], [*range(-1, n - 1)], len(v.keys)
    heap = []

    def look(places: list[int]) -> None:
        key = np.array([sym[i] << 32 | sym[nxt[i]] for i in places], np.int64)
        found = np.minimum(np.searchsorted(v.keys, key), none - 1)
        for i, f, k in zip(places, found.tolist(), key.tolist()):
            if v.keys[f] == k:
                heapq.heappush(heap, (int(v.rank[f]), i, k, int(v.new[f])))

    look(list(range(n - 1)))
    while heap:
        _, i, k, new = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] < 0 or j < 0 or sym[i] << 32 | sym[j] != k:
            continue
        sym[i], sym[j] = new, -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        look([p for p in (prev[i], i) if p >= 0 and nxt[p] >= 0])
    return [s for s in sym if s >= 0]


class Encoder:
    """Encodes texts and remembers words, in one worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def starts(self, cp: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in code points ``cp`` of texts that begin at ``text_at``; classes of all."""
        kind = classes()[cp]
        n = len(cp)
        begin = np.zeros(n + 1, bool)
        begin[text_at[text_at < n]] = True
        first = begin[:n].copy()
        solid = kind != SPACE
        before = np.r_[np.uint8(0), kind[:-1]]
        blank = np.r_[False, cp[:-1] == 32] & ~first
        turn = (kind != before) | first
        if self.v.word_ends:
            begin[:n] |= turn | (kind == NUMBER)
            quote = (cp == 39) & turn
        else:
            begin[:n] |= turn & ~(solid & blank)
            final = ~solid & np.r_[solid[1:] & ~first[1:], False] & (before == SPACE) & ~first
            begin[:n] |= final  # the last of several spaces belongs to what follows
            quote = (cp == 39) & turn & ~blank
        ends = np.r_[np.flatnonzero(first)[1:], n]
        for i in np.flatnonzero(quote).tolist():
            stop = int(ends[np.searchsorted(ends, i, "right")])
            tail = "".join(map(chr, cp[i + 1:min(i + 3, stop)].tolist()))
            size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                begin[i + 1:min(i + size, stop)] = False
                if i + size < stop:
                    begin[i + size] = True
        return np.flatnonzero(begin[:n]), kind

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_end = np.cumsum(sizes)
        at, kind = self.starts(cp, np.unique((text_end - sizes)[sizes > 0]))
        width = 1 + (cp >= 0x80).astype(np.int32) + (cp >= 0x800) + (cp >= 0x10000)
        place = np.zeros(len(cp) + 1, np.int32)
        np.cumsum(width, out=place[1:])
        offsets = np.append(place[at], place[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]).dictionary_encode()
        code, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > REMEMBER:
            self.forget()
        if self.v.word_ends:  # white space is a word of no ids
            distinct = ["" if w[0] in BLANK else w for w in distinct]
        known = [*map(self.known.get, distinct)]
        if None in known:
            self.learn(list(dict.fromkeys(w for w, k in zip(distinct, known) if k is None)))
            known = [*map(self.known.get, distinct)]
        index = np.array(known, np.int64)
        number = self.count[index][code]
        begin = self.start[index][code]
        ends = np.cumsum(number)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(begin - (ends - number), number)
        ids = self.flat[take]
        upto = np.r_[0, ends][np.searchsorted(at, np.r_[0, text_end])]
        return ids, np.diff(upto)

    def learn(self, new: list[str]) -> None:
        v = self.v
        raw = [w.encode() for w in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short = [i for i, s in enumerate(size.tolist()) if s <= LONG]
        data = np.frombuffer(b"".join(raw[i] for i in short), np.uint8)
        short_size = size[short]
        sym = v.first[data]
        ends = np.cumsum(short_size)
        some = short_size > 0
        sym[ends[some] - 1] = v.last[data[ends[some] - 1]]
        word = np.repeat(np.arange(len(short)), short_size)
        flat, count = merge(v, sym, word, len(short))
        self.add([new[i] for i in short], flat, count)
        for i, s in enumerate(size.tolist()):
            if s > LONG:
                b = np.frombuffer(raw[i], np.uint8)
                sym = v.first[b]
                sym[-1] = v.last[b[-1]]
                ids = np.array(merge_long(v, sym.tolist()), np.int64)
                self.add([new[i]], ids, np.array([len(ids)]))

    def add(self, words: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        n, have = len(words), len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used:self.used + len(flat)] = flat
        ends = np.cumsum(count)
        self.start[have:have + n] = self.used + ends - count
        self.count[have:have + n] = count
        self.used += len(flat)
        self.known.update(zip(words, range(have, have + n)))

    def normal(self, text: str) -> str:
        if not self.v.word_ends:
            return text
        # white space is dropped anyhow; letter by letter, so no final form of sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str):
        """Parts of a text as (part, id of a special token or -1)."""
        last = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > last:
                yield text[last:m.start()], -1
            yield "", self.v.special[m[0]]
            last = m.end()
        if last < len(text):
            yield text[last:], -1

    def parts(self, text: str):
        """Parts of BLOCK characters or so, cut where words never join."""
        at = 0
        while len(text) - at > BLOCK:
            cut = None
            for cut in CUT.finditer(text, at + BLOCK // 2, at + BLOCK):
                break
            cut = cut or CUT.search(text, at + BLOCK)
            if not cut:
                break
            yield text[at:cut.end()]
            at = cut.end()
        yield text[at:]

    def encode(self, texts: list[str | None]):
        """Yields lists of id arrays, block by block, in the order of ``texts``."""
        part, owner, size = [], [], 0  # of a block: parts, or ids of special tokens, and which text has each
        waiting: list[list[np.ndarray]] = []  # id arrays of texts begun

        def flush():
            plain = [p for p in part if isinstance(p, str)]
            ids, count = self.block(plain)
            chunks = iter(np.split(ids, np.cumsum(count)[:-1]) if plain else ())
            for p, o in zip(part, owner):
                waiting[o].append(next(chunks) if isinstance(p, str) else np.array([p], np.int32))

        for text in texts:
            waiting.append([])
            for piece, token in self.pieces(text or ""):
                if token >= 0:
                    part.append(token)
                    owner.append(len(waiting) - 1)
                    continue
                for p in self.parts(piece):
                    p = self.normal(p)
                    part.append(p)
                    owner.append(len(waiting) - 1)
                    size += len(p)
                    if size > BLOCK:
                        flush()
                        part, owner, size = [], [], 0
            if not part and waiting or len(waiting) >= 4096:
                if part:
                    flush()
                    part, owner, size = [], [], 0
                yield [joined(w) for w in waiting]
                waiting = []
        if waiting:
            if part:
                flush()
            yield [joined(w) for w in waiting]


BLANK = frozenset(map(chr, SPACES))


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays) if arrays else np.zeros(0, np.int32)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text that ids spell; bytes that are no text become U+FFFD."""
    ids = ids.astype(np.int64)
    begin = v.spelled_at[ids]
    number = v.spelled_at[ids + 1] - begin
    ends = np.cumsum(number)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - number), number)
    return v.spelled[take].tobytes().decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's own encoder for a broadcast vocabulary."""
    if shared.value is not _encoders.get(id(shared.value), Encoder.__new__(Encoder)).__dict__.get("v"):
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def id_arrays(lists: list[np.ndarray]) -> pa.Array:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = joined([*lists]) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``out``, the array<int> of ids of ``text`` in the file ``vocabulary``.

    Under the name ``decoded``, if one is given, the same worker spells the ids again, as ``bpe_decode`` does.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    df = without(df, *([n for n in (out, decoded) if n and n != text]))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), True), *([T.StructField(decoded, T.StringType(), True)] if decoded else [])])
    place = df.columns.index(text)

    def run(batches):
        enc = encoder(shared)
        for batch in batches:
            done = 0
            for lists in enc.encode(batch.column(place).to_pylist()):
                part = batch.slice(done, len(lists))
                done += len(lists)
                more = [pa.array([decode_ids(enc.v, x) for x in lists], pa.string())] if decoded else []
                columns = [*part.columns, id_arrays(lists), *more]
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return _by_place(df, run, schema)


def _by_place(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of whatever names, which are numbers meanwhile."""
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, numbered).toDF(*schema.names)


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text that column ``ids`` spells; null ids give an empty text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    df = without(df, out) if out != ids else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), True)])
    place = df.columns.index(ids)

    def run(batches):
        v = shared.value
        for batch in batches:
            column = batch.column(place)
            texts = [decode_ids(v, column[i].values.to_numpy(zero_copy_only=False)) if column[i].is_valid else "" for i in range(len(column))]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return _by_place(df, run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_encode(docs, path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
