"""Windows of a fixed width that repeat: what the two exact substring operators have in common.

Round 1 names short windows that begin at the places of a difference cover: of two equal long windows, some
pair of such short ones lies at the same shift in both. Documents none of whose names repeats are done.
Round 2 takes the remaining starts only, those from which a repeated name is within reach, and settles
them by the hash of the whole window. Both rounds go through seqhash.shared_keys, so hot windows are
reduced before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.seqhash import Chunk, bucket_count, chunks, difference_cover, folded, unblob, keyed, member, roll, shared_keys, starts
from kinlink.plans.scratch import drop, materialize, release


#: A run of windows has so many on average.
RUN = 128


#: and so many at most, which keeps what one hash covers under 1024 bytes.
LONGEST = 512


class Cover:
    """How a chunk is read: symbols(chunk) gives the prefix hash, and where each document begins and ends in it. whole(prefix hash,
    places) names the long windows, by the hash of all of them if it is not given."""

    def __init__(self, symbols: Callable[[Chunk], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, q: int, seed: int, whole: Callable | None = None):
        self.symbols, self.width, self.seed = symbols, width, seed
        self.v, self.d = difference_cover(q)
        self.short = width - self.v + 1
        self.whole = whole or (lambda prefix, at: roll(seed).window(prefix, at, at + width))

    def names(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Round 1: hash, document number and place of the sampled short windows, of documents that hold a long one."""
        prefix, low, high = self.symbols(chunk)
        room = np.where(high - low >= self.width, high - low - self.short + 1, 0)
        most = int(room.max()) if len(room) else 0
        sample = (np.sort(self.d)[None, :] + self.v * np.arange(most // self.v + 1)[:, None]).ravel()
        count = np.searchsorted(sample, room)
        number = np.repeat(np.arange(len(room)), count)
        at = sample[np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)] + low[number]
        return roll(self.seed).window(prefix, at, at + self.short), number, at

    def segments(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Long windows in runs that end where the content says so, or after LONGEST: even hash and document number of each run, which is
        that of all it covers; then place, document and run of each window."""
        prefix, low, high = self.symbols(chunk)
        place, doc = starts(low, high, self.width)
        r = roll(self.seed)
        if not len(place):
            return np.zeros(0, np.uint64), doc, place, doc, place
        w = min(32, self.width)
        if len(prefix) > len(r.inv):
            r.grow(len(prefix))
        mark = (((prefix[w:] - prefix[:-w]) * r.inv[: len(prefix) - w]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (RUN.bit_length() - 1)) == 0
        head = mark[place]
        head[0] = True
        head[1:] |= doc[1:] != doc[:-1]
        at = np.arange(len(head))
        head |= (at - np.maximum.accumulate(np.where(head, at, 0))) % LONGEST == 0
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(place)) - 1
        return r.window(prefix, place[first], place[last] + self.width) & ~np.uint64(1), doc[first], place, doc, np.cumsum(head) - 1

    def settled(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place and document of each long window; whether its run repeats, and whether a smaller document has that run."""
        key, of, place, doc, run = self.segments(chunk)
        again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
        cut = np.searchsorted(of, np.arange(len(chunk.ids) + 1))
        for i, x in enumerate(chunk.extra):
            if x["runs"]:
                own, found = key[cut[i] : cut[i + 1]], unblob(x["runs"])
                later[cut[i] : cut[i + 1]] = member(own | np.uint64(1), found)
                again[cut[i] : cut[i + 1]] = later[cut[i] : cut[i + 1]] | member(own, found)
        return place, doc, again[run], later[run]

    def reach(self, chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Round 2: hash and document number of the long windows that hold a repeated name (chunk.extra: the blobs of each
        document), but for those in runs that a smaller document sends."""
        key, number, at = self.names(chunk)
        key = folded(key, n)
        hit = np.zeros(len(key), bool)
        cut = np.searchsorted(number, np.arange(len(chunk.ids) + 1))
        for i, x in enumerate(chunk.extra):
            if x["keys"]:
                hit[cut[i] : cut[i + 1]] = member(key[cut[i] : cut[i + 1]], unblob(x["keys"]))
        prefix, low, high = self.symbols(chunk)
        step = np.zeros(len(prefix) + 1, np.int32)
        np.add.at(step, np.maximum(at[hit] - self.v + 1, low[number[hit]]), 1)
        np.add.at(step, at[hit] + 1, -1)
        near = np.cumsum(step) > 0
        if any(x["runs"] for x in chunk.extra):
            place, doc, _, later = self.settled(chunk)
            ok = near[place] & ~later
            place, doc = place[ok], doc[ok]
        else:
            place = np.flatnonzero(near)
            doc = np.searchsorted(low, place, "right") - 1
            ok = place + self.width <= high[doc]
            place, doc = place[ok], doc[ok]
        return self.whole(prefix, place), doc


def repeated_windows(docs: DataFrame, cover: Cover, *, earlier: bool, **settle) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and (doc_id, found): the hashes of each document's windows that repeat (found.keys), and of runs of
    windows that repeat as wholes (found.runs; for any repeat only, not for earlier ones).

    A run that repeats needs no answer for its windows, and only the smallest document that has it sends them, to be met
    by windows of other runs. settle: how shared_keys deals out and compares the long windows.
    """
    docs, n = keyed(docs), bucket_count(docs)
    first = materialize(shared_keys(docs, lambda c: cover.names(c)[:2], earlier=False, buckets=n, narrow=True).select("doc_id", "keys"), "names")
    near = docs.join(first, "doc_id")
    runs = None
    if earlier:
        near = near.withColumn("runs", F.lit(None).cast("binary"))
    else:
        runs = shared_keys(docs, lambda c: cover.segments(c)[:2], earlier=False, buckets=n, ranked=True).select("doc_id", F.col("keys").alias("runs"))
        runs = materialize(runs, "runs")
        near = near.join(runs, "doc_id", "left")
    release(first)
    near = near.select("doc_id", "text", F.struct("keys", "runs").alias("found"))
    windows = materialize(shared_keys(near, lambda c: cover.reach(c, n), earlier=earlier, buckets=n, **settle).select("doc_id", "keys"), "windows")
    del near
    release(windows)
    drop(first)
    windows = windows.withColumn("runs", F.lit(None).cast("binary")) if runs is None else windows.join(runs, "doc_id", "full")
    return docs, windows.select("doc_id", F.struct("keys", "runs").alias("found"))


def cut_out(docs: DataFrame, windows: DataFrame, cover: Cover, finish: Callable[[Chunk, int, np.ndarray], tuple], schema: str) -> DataFrame:
    """One row per document: finish(chunk, number, covered symbols as booleans) gives its columns after doc_id."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]):
        for c in chunks(batches):
            c.extra = [x or {"keys": None, "runs": None} for x in c.extra]
            prefix, low, high = cover.symbols(c)
            if any(x["runs"] for x in c.extra):
                place, number, again, _ = cover.settled(c)
            else:
                place, number = starts(low, high, cover.width) if any(x["keys"] for x in c.extra) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                again = np.zeros(len(place), bool)
            cut = np.searchsorted(number, np.arange(len(c.ids) + 1))
            rows = []
            for i, doc in enumerate(c.ids):
                covered = np.zeros(high[i] - low[i], bool)
                if c.extra[i]["keys"] or c.extra[i]["runs"]:
                    own, known = place[cut[i] : cut[i + 1]], again[cut[i] : cut[i + 1]]
                    rest = own[~known]
                    at = np.concatenate([own[known], rest[member(cover.whole(prefix, rest), unblob(c.extra[i]["keys"]))]]) - low[i]
                    step = np.zeros(len(covered) + 1, np.int32)
                    step[at] += 1
                    step[at + cover.width] -= 1
                    covered = np.cumsum(step)[:-1] > 0
                rows.append((int(doc), *finish(c, i, covered)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return docs.join(windows, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(run, schema)
