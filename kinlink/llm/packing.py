"""Operator 1: best-fit packing of tokenized documents by a grouping genetic algorithm on islands."""

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.seqhash import chunks, keyed, unkeyed
from kinlink.llm.worker import kept, lean
from kinlink.plans.scratch import drop, materialize

#: Letters and then marks: the tokenizer breaks between them, and marks but for the apostrophe stay together.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """Little-endian ids of a blank-free piece of text. The tokenizer breaks at every blank, so a text's ids are those of
    its pieces in turn; letters with closing marks go to the vocabulary's merges directly, all else to the whole
    tokenizer. A full cache becomes the old one, from which words in use come back, and the one that was old goes: memory does not
    follow the vocabulary of the corpus, and common words stay."""

    def __init__(self, path: str, limit: int = 120_000):
        from tokenizers import Tokenizer

        self.tk, self.limit = Tokenizer.from_file(path), limit
        self.old, self.letters, self.old_letters, self.marks = {}, {}, {}, {}
        # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}

    def _whole(self, w: str) -> bytes:
        ids = self.tk.encode(w, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, w: str) -> bytes:
        got = self.letters.get(w)
        if got is None:
            got = self.old_letters.get(w)
            if got is None:
                ids = [t.id for t in self.tk.model.tokenize("".join([self.byte[b] for b in w.encode()]))]
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.letters) >= self.limit:
                self.letters, self.old_letters = {}, self.letters
            self.letters[w] = got
        return got

    def _marks(self, w: str) -> bytes:
        if w not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[w] = self._whole(w)
        return self.marks[w]

    def __missing__(self, w: str) -> bytes:
        got = self.old.get(w)
        if got is None:
            m = _PLAIN.fullmatch(w)
            got = self._letters(m[1].lower()) + (self._marks(m[2]) if m[2] else b"") if m else self._whole(w)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[w] = got
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    """One tokenizer and one cache for all tasks that a worker runs in turn."""
    return kept(("words", path), lambda: WordIds(path))


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final 0, cut into pieces of `size`. Null text: the 0 alone."""

    def run(batches):
        words = word_ids(tokenizer)
        for c in chunks(batches, own=("words", tokenizer)):
            rows = []
            for doc, text in zip(c.ids.tolist(), c.texts, strict=True):
                ids = words.encode(text.decode("utf-8", "replace")) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    rows.append((doc, i, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by what is free in them; the best fit is the lowest set bit at or above a length."""

    def __init__(self, size: int):
        self.size, self.at, self.mask, self.n = size, [[] for _ in range(size + 1)], 0, 0

    def add(self, b: int, free: int) -> None:
        if free:
            self.at[free].append(b)
            self.mask |= 1 << free

    def fit(self, items: list[int], lengths: list[int], assign: list[int]) -> None:
        at, mask, size, n = self.at, self.mask, self.size, self.n
        for i in items:
            need = lengths[i]
            m = mask >> need
            if m:
                free = need + (m & -m).bit_length() - 1
                b = at[free].pop()
                if not at[free]:
                    mask ^= 1 << free
            else:
                b, free = n, size
                n += 1
            assign[i] = b
            if free > need:
                at[free - need].append(b)
                mask |= 1 << (free - need)
        self.mask, self.n = mask, n


def _value(assign: list[int], lengths: np.ndarray, size: int) -> tuple[int, float]:
    load = np.bincount(assign, lengths)
    return -len(load), float(((load / size) ** 2).sum())


def fitted(lengths: list[int], order: list[int], size: int) -> list[int]:
    assign = [0] * len(lengths)
    Bins(size).fit(order, lengths, assign)
    return assign


def crossover(a: list[int], b: list[int], lengths: np.ndarray, size: int, rng: np.random.Generator) -> list[int]:
    """Whole bins of b that are filled best go into a; a's bins that hold any of their documents are opened, and the
    documents displaced thereby are placed by best fit, the longest first."""
    a_, b_ = np.array(a), np.array(b)
    load = np.bincount(b_, lengths)
    good = np.flatnonzero(load >= size - rng.integers(0, 3))
    if not len(good):
        good = np.argsort(-load)[: max(1, len(load) // 4)]
    take = np.zeros(len(load), bool)
    take[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    moved = take[b_]
    broken = np.zeros(int(a_.max()) + 1, bool)
    broken[a_[moved]] = True
    loose = broken[a_] & ~moved
    names, kept = np.unique(a_[~broken[a_]], return_inverse=True)
    out = np.empty(len(a_), np.int64)
    out[~broken[a_]] = kept
    new, injected = np.unique(b_[moved], return_inverse=True)
    out[moved] = injected + len(names)
    bins = Bins(size)
    bins.n = len(names) + len(new)
    stay = ~loose
    for k, free in enumerate((size - np.bincount(out[stay], lengths[stay], bins.n)).astype(int).tolist()):
        bins.add(k, free)
    items = np.flatnonzero(loose)
    items = items[np.argsort(-lengths[items], kind="stable")]
    assign = out.tolist()
    bins.fit(items.tolist(), lengths.tolist(), assign)
    return assign


def evolve(lengths: np.ndarray, start: list[list[int]], size: int, seed: int, population: int = 4, generations: int = 6) -> tuple[list[int], tuple[int, float]]:
    """One island for one epoch; ends at once where the lower bound is reached."""
    rng, flat = np.random.default_rng(seed), lengths.tolist()
    bound = -int(-(-int(lengths.sum()) // size))
    pool = [(_value(g, lengths, size), g) for g in start]
    while len(pool) < population and (not pool or max(v for v, _ in pool)[0] < bound):
        noise = rng.normal(0, 0 if not pool else size / 100, len(flat))
        g = fitted(flat, np.argsort(-(lengths + noise), kind="stable").tolist(), size)
        pool.append((_value(g, lengths, size), g))
    for _ in range(generations):
        pool.sort(key=lambda x: x[0], reverse=True)
        if pool[0][0][0] >= bound:
            break
        i, j = rng.choice(len(pool), 2, replace=False) if len(pool) > 1 else (0, 0)
        g = crossover(pool[i][1], pool[j][1], lengths, size, rng)
        pool = [*pool[: population - 1], (_value(g, lengths, size), g)]
    best = max(pool, key=lambda x: x[0])
    return best[1], best[0]


def pack(parts: DataFrame, size: int = 2048, shard_rows: int = 16_384, islands: int = 3, epochs: int = 2) -> DataFrame:
    """parts(doc_id, piece, start, length, ids_crc32) with sequence_id and offset: gapless sequences of at most `size`.

    Pieces are dealt by a hash of id, content and row into shards of about shard_rows, each a packing problem of its own that wastes
    less than a sequence against the whole. Every shard lives on several islands, rows of a DataFrame; after
    each epoch an island receives the elite of the next one. Only lengths and assignments travel.
    """
    parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-parts.count() // shard_rows))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def shard(key, table):
        lean()
        table = table.select(cols).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        meta = [np.asarray(table.column(c).to_numpy(), np.int64) for c in cols]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.stack(meta).tobytes()]), pa.array([meta[3].astype(np.int32).tobytes()])], names=["shard", "meta", "lengths"])

    dealt = materialize(parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(shards))).groupBy("shard").applyInArrow(shard, "shard long, meta binary, lengths binary"), "shards")

    def epoch(number: int):
        def run(batches):
            lean()
            for b in batches:
                rows = []
                for s, i, lens, own, migrant in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lengths = np.frombuffer(lens, np.int32).astype(np.int64)
                    start = [np.frombuffer(g, np.int32).tolist() for g in (own, migrant) if g is not None]
                    g, (bins, fill) = evolve(lengths, start, size, 1000 * i + number)
                    rows.append((s, i, lens, np.array(g, np.int32).tobytes(), bins, fill))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64()), strict=True)], ["shard", "island", "lengths", "genome", "bins", "fill"])

        return run

    at = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("binary").alias("genome"), F.lit(None).cast("binary").alias("migrant"))
    for k in range(epochs):
        flat = at.repartition(max(2, islands * shards), "shard", "island")
        at = materialize(flat.mapInArrow(epoch(k), "shard long, island int, lengths binary, genome binary, bins long, fill double"), "islands")
        elite = at.select("shard", F.pmod(F.col("island") - 1, F.lit(islands)).alias("island"), F.col("genome").alias("migrant"))
        last, at = at, at.drop("bins", "fill").join(elite, ["shard", "island"]).select("shard", "island", "lengths", "genome", "migrant")
    best = last.groupBy("shard").agg(F.max_by("genome", F.struct("bins", "fill", -F.col("island"))).alias("genome"))

    def lay(batches):
        lean()
        for b in batches:
            for s, meta, genome in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, g = np.frombuffer(meta, np.int64).reshape(5, -1), np.frombuffer(genome, np.int32)
                order = np.argsort(g, kind="stable")
                m, g = m[:, order], g[order].astype(np.int64)
                before = np.cumsum(m[3]) - m[3]
                head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                offset = before - np.repeat(before[head], np.diff(np.append(head, len(g))))
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32() if c == "piece" else pa.int64()) for x, c in zip(m, cols, strict=True)], pa.array(s * 2**32 + g), pa.array(offset)], [*cols, "sequence_id", "offset"])

    out = dealt.select("shard", "meta").join(best, "shard").select("shard", "meta", "genome").mapInArrow(lay, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    drop(parts)
    return out.select(unkeyed(), *out.columns[1:])


def packed(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Rows that share a
    doc_id are packed as documents of their own; an empty table gives an empty result."""
    return pack(pieces(docs, tokenizer, size), size)
