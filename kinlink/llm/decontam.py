"""Operator 8: benchmark passages in documents, by CGK random walks, bit-sampling LSH and exact edit distance."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.seqhash import _LOWER, CHUNK, Chunk, chunks, keyed, member, unkeyed
from kinlink.llm.worker import lean

_BREAK = np.ones(256, bool)
_BREAK[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
_BREAK[128:] = False
#: Steps of a walk, and how many of them are sampled. A walk crosses about half as many characters as it has steps.
STEPS, SAMPLES = 32, 16
#: Items of fewer bytes than that are found by pieces, one of which no allowed number of edits can touch.
SHORT = 24


def plain(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, A-Z lowered, joined by blanks: the bytes, the places where words begin, and from where to where each
    document goes."""
    buf = _LOWER[c.buf]
    gap = _BREAK[buf]
    after = np.concatenate([[True], gap[:-1]])
    keep = ~gap | ~after
    out = np.where(gap, np.uint8(32), buf)[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    return out, place[:-1][~gap & after], place[c.start], place[c.start + c.lengths]


class Walk:
    """One CGK embedding and the steps of it that are sampled. At step t a walk shows the byte it stands on, and a random
    bit of (t, byte) says whether it goes on: sequences a few edits apart fall into step again, so their embeddings
    differ in few places."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.go = rng.integers(0, 2, (STEPS, 256)).astype(np.int32)
        self.show = set(rng.choice(STEPS - 1, SAMPLES - 1, replace=False).tolist()) | {STEPS - 1}
        self.half = sorted(self.show)[SAMPLES // 2]

    def run(self, text: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walks from each place of `at` over text, which ends with STEPS zeros: the places, their keys, the keys halfway, and where the walks end.
        known: marks by slot(key halfway) what is looked for; other walks stop there."""
        pos, key, half = at.astype(np.int32), np.zeros(len(at), np.uint64), None
        for t in range(STEPS):
            cur = text[pos]
            if t in self.show:
                key = key * np.uint64(0x100000001B3) + cur
            if t == self.half:
                half = key
                if known is not None:
                    ok = np.flatnonzero(known[slot(key)])
                    at, pos, key, half, cur = at[ok], pos[ok], key[ok], half[ok], cur[ok]
            pos = pos + self.go[t][cur]
        return at, key, half, pos


def slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def agreement(rate: float) -> float:
    """How often the sampled steps of a walk agree if a share of the characters is edited: none it crosses may be."""
    return (1 - rate) ** (1 + STEPS / 2)


def walks_for(recall: float, rate: float, words: int = 30) -> int:
    """How many walks let a passage of so many words speak twice with the wanted probability, if its characters are edited at three
    quarters of the rate that is allowed. Walks from one place share its edits: beyond the first, one counts half."""
    rate *= 0.75
    n = 1
    while math.exp(-(x := agreement(rate) * words * (n + 1) / 2)) * (1 + x) > 1 - recall:
        n += 1
    return n


def edit_distance(pattern: bytes, text: bytes, most: int) -> int:
    """Least edits from the pattern to any substring of text, by bit-parallel columns; most + 1 if there are more."""
    m = len(pattern)
    if pattern in text:
        return 0
    where: dict[int, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for ch in text:
        eq = where[ch] if ch in where else 0
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        right = down | ~(d | up)
        left = up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
            if score < best:
                best = score
        # the first row is free: a match may begin anywhere in the text
        right <<= 1
        up = (left << 1 | ~(x | right)) & full
        down = right & x & full
    return best if best <= most else most + 1


def grams(text: np.ndarray) -> np.ndarray:
    """The three bytes from each place, as one number."""
    x = text.astype(np.int32)
    return x[:-2] << 16 | x[1:-1] << 8 | x[2:]


class Index:
    """The keys of every item from each of its words, for each walk; short items by their pieces."""

    def __init__(self, items: list[tuple[int, str]], walks: int, rate: float):
        self.rate, self.walks = rate, [Walk(800 + i) for i in range(walks)]
        self.items: list[tuple[int, bytes, int]] = []
        self.pieces: dict[bytes, list[tuple[int, int]]] = {}
        keys: list[list] = [[] for _ in self.walks]
        halves: list[list] = [[] for _ in self.walks]
        for item, text in items:
            out, place, low, high = plain(Chunk([0], [(text or "").encode()]))
            own = out[: high[0]].tobytes().rstrip()
            if not own:
                continue
            number = len(self.items)
            spoken = 0
            if len(own) < SHORT:
                parts = int(rate * len(own)) + 1
                for i in range(parts):
                    a, b = len(own) * i // parts, len(own) * (i + 1) // parts
                    self.pieces.setdefault(own[a:b], []).append((number, a))
            else:
                padded = np.concatenate([np.frombuffer(own, np.uint8), np.zeros(STEPS, np.uint8)])
                for w, to, to_half in zip(self.walks, keys, halves, strict=True):
                    at, key, half, end = w.run(padded, place)
                    inside = end <= len(own)
                    if not inside.any():
                        inside[0] = True
                    to += [(x, number, a) for x, a in zip(key[inside].tolist(), at[inside].tolist(), strict=True)]
                    to_half += half[inside].tolist()
                    spoken += int(inside.sum())
            # two walks or places must speak for an item that is long enough for that at the rate, one for others
            self.items.append((item, own, 2 if agreement(rate) * spoken >= 2 else 1))
        self.grams = [grams(np.frombuffer(own, np.uint8)) for _, own, _ in self.items]
        self.known, self.keys, self.found = [], [], []
        for to, to_half in zip(keys, halves, strict=True):
            table = np.zeros(1 << 20, bool)
            table[slot(np.array(to_half, np.uint64))] = True
            found: dict[int, list[tuple[int, int]]] = {}
            for x, number, a in to:
                found.setdefault(x, []).append((number, a))
            self.known.append(table)
            self.keys.append(np.array(sorted(found), np.uint64))
            self.found.append(found)

    def near(self, text: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first start, last start) of the runs of hits that enough places of the item speak for."""
        hits: list[tuple[int, int, int]] = []
        for walk, known, keys, found in zip(self.walks, self.known, self.keys, self.found, strict=True):
            if not len(keys):
                continue
            at, key, _, _ = walk.run(text, place, known)
            ok = member(key, keys)
            for a, x in zip(at[ok].tolist(), key[ok].tolist(), strict=True):
                hits += [(i, a - o, o) for i, o in found[x]]
        hits.sort()
        out, low = [], 0
        for high, (item, start, spot) in enumerate(hits):
            _, own, votes = self.items[item]
            slack = 4 + int(self.rate * len(own))
            while hits[low][0] != item or start - hits[low][1] > slack:
                low += 1
            # places that show the same characters speak once
            if votes == 1 or any(abs(o - spot) >= STEPS // 2 for _, _, o in hits[low:high]):
                if out and out[-1][0] == item and hits[low][1] <= out[-1][2] and start - out[-1][1] <= slack:
                    out[-1] = item, out[-1][1], start
                else:
                    out.append((item, hits[low][1], start))
        return out

    def search(self, c: Chunk) -> list[tuple[int, int, int, int]]:
        """(document number, item number, first word, edits): the best window of each item in each document."""
        text, place, low, high = plain(c)
        if not len(place) or not self.items:
            return []
        whole, code = text.tobytes(), grams(text)
        near = self.near(np.concatenate([text, np.zeros(STEPS, np.uint8)]), place)
        for piece, own in self.pieces.items():
            at = whole.find(piece)
            while at >= 0:
                near += [(i, at - o, at - o) for i, o in own]
                at = whole.find(piece, at + 1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, first, last in near:
            _, own, _ = self.items[item]
            most = int(self.rate * len(own))
            slack = 4 + most
            lo, hi = max(0, first - slack), min(len(text), last + len(own) + slack)
            # the documents that the window touches, each by itself
            d = int(np.searchsorted(low, lo, "right")) - 1
            while d < len(low) and low[d] < hi:
                a, b = max(lo, int(low[d])), min(hi, int(high[d]))
                had = best.get((d, item))
                # an edit touches three grams at most, so the window must have all but 3 * most of the item's
                few = len(own) - 2 - 3 * most
                if b - a >= len(own) - most and not (had and had[0] == 0) and (few <= 0 or np.isin(self.grams[item], code[a : b - 2]).sum() >= few):
                    edits = edit_distance(own, whole[a:b], most)
                    if edits <= most and (not had or edits < had[0]):
                        word = int(np.searchsorted(place, max(a, first))) - int(np.searchsorted(place, low[d]))
                        best[d, item] = edits, max(0, word)
                d += 1
        return [(d, i, a, e) for (d, i), (e, a) in sorted(best.items())]


def _blocks(benchmark: DataFrame, rate: float, recall: float, block_bytes: int):
    """An index for each block of at most about block_bytes of items."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, walks = total // block_bytes + 1, walks_for(recall, rate)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in rows], walks, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.95, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, first_word, edits, item_chars): for each document and each item it holds, the best window.

    Texts are compared as their runs of letters and digits, A-Z lowered, joined by blanks; a window holds an item if
    at most rate * length edits (of UTF-8 bytes) turn the item into a substring of it. Every word of every text begins a
    walk; of equally good windows the first counts. Null and empty texts hold nothing, and items without words match
    nothing. Rows that share a doc_id, or have none, give rows each; columns besides doc_id and text play no part.

    Items reach the tasks in blocks of at most block_bytes, one pass over the documents for each.
    """
    docs, out = keyed(docs), None
    for index in _blocks(benchmark, rate, recall, block_bytes):

        def run(batches, index=index):
            for c in chunks(batches):
                got = [(int(c.ids[d]), index.items[i][0], a, e, len(index.items[i][1])) for d, i, a, e in index.search(c)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["doc_id", "item_id", "first_word", "edits", "item_chars"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, first_word long, edits long, item_chars long")
        out = part if out is None else out.unionByName(part)
    return out.select(unkeyed(), "item_id", "first_word", "edits", "item_chars")


def _clean(index: Index):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        lean()
        texts = [x.encode() for x in text.fillna("")]
        bad, low = np.zeros(len(texts), bool), 0
        # a batch may hold very many bytes: some at a time
        size = np.cumsum([len(x) for x in texts])
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + CHUNK)))
            bad[[low + d for d, *_ in index.search(Chunk(list(range(high - low)), texts[low:high]))]] = True
            low = high
        return pd.Series(~bad)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.95, block_bytes: int = 16 << 20) -> DataFrame:
    """docs, with all their columns, without the rows whose text holds an item. Each row is judged by its own text, whatever its id."""
    for index in _blocks(benchmark, rate, recall, block_bytes):
        docs = docs.where(_clean(index)(docs["text"].cast("string")))
    return docs
