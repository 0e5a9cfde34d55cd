"""Operator 10: words inside a long word window that an earlier document holds, by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinlink.llm.repeats import Cover, cut_out, repeated_windows
from kinlink.llm.seqhash import Chunk, chunks, keyed, mix, roll, starts, unkeyed

#: The three edges of a suffix's path: bits of each, the first on top. Edges end after EDGES words and at the width.
BITS, EDGES = (20, 20, 24), (3, 12)
CELL_BITS, SLICES = 16, 32


def word_cover(width: int = 50) -> Cover:
    q = max(q for q in (2, 3, 5, 7, 11, 13, 17) if q == 2 or q * q + q + 1 <= 0.7 * width)

    def symbols(c: Chunk):
        h, _, _, bounds = c.words(lower=False)
        return roll(31).prefix(h), bounds[:-1], bounds[1:]

    return Cover(symbols, width, q, 31, lambda prefix, at: path(prefix, at, width))


def path(prefix: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A suffix's first `width` words as a path of three edges in one number: numbers sort as the paths of a tree do."""
    r, out, low = roll(31), np.zeros(len(at), np.uint64), 0
    for bits, high in zip(BITS, (*EDGES, width), strict=True):
        out = out << np.uint64(bits) | r.window(prefix, at + low, at + high) >> np.uint64(64 - bits)
        low = high
    return out


def above(paths: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """The prefix of so many edges (1 to 3)."""
    below = np.array([64, 64 - BITS[0], BITS[2], 0], np.uint64)
    return paths >> below[depth]


def subtrees(paths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of a group: leaves sorted by path and document, how many edges each shares with the one before, and from that
    the internal nodes. Of these the deep ones, at the full width, are given: paths and documents of all leaves, where
    each deepest node (or single leaf) begins, and its number of leaves."""
    order = np.lexsort((docs, paths))
    k, d = paths[order], docs[order]
    shared = np.zeros(len(k), np.int64)
    # the tree by levels: leaves under one node of a level share its prefix, so a level is searched within nodes of the one above
    for depth in (1, 2, 3):
        p = above(k, depth)
        shared[1:][(shared[1:] == depth - 1) & (p[1:] == p[:-1])] = depth
    head = np.flatnonzero(shared < 3)
    return k, d, head, np.diff(np.append(head, len(k)))


def prefix_lengths(docs: DataFrame, width: int, group: int = 1 << 19) -> np.ndarray:
    """For the first bits of a path, how many edges make the prefix that its suffixes are dealt out by: the fewest that keep a group at `group`
    suffixes. Counted over all suffixes of all documents, in a table of fixed size."""
    cells = 1 << CELL_BITS

    def count(batches):
        one, two = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for c in chunks(batches):
            h, _, _, bounds = c.words(lower=False)
            at, _ = starts(bounds[:-1], bounds[1:], width)
            r, prefix = roll(31), roll(31).prefix(h)
            first = r.window(prefix, at, at + EDGES[0])
            one += np.bincount((first >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=cells)
            second = r.window(prefix, at + EDGES[0], at + EDGES[1])
            two += np.bincount((mix(first >> np.uint64(44) ^ second << np.uint64(20)) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=cells)
        parts = [x.tobytes() for x in np.split(np.concatenate([one, two]), 2 * SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["part", "counts"])

    def add(key, table):
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()).tobytes()])], names=["part", "counts"])

    tables = docs.mapInArrow(count, "part int, counts binary")
    got = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in tables.groupBy("part").applyInArrow(add, "part int, counts binary").collect()}
    one, two = np.split(np.concatenate([got.get(i, np.zeros(cells // SLICES, np.int64)) for i in range(2 * SLICES)]), 2)
    crowded = bool((two > group).any())
    return np.where(one <= group, 1, 3 if crowded else 2).astype(np.int8)


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document; words are maximal runs of non-blank characters.

    A word goes if a window of `width` (13 at least) words that covers it also starts in a document with a smaller
    doc_id, so the first copy stays whole. Null and blank texts have no words; a null doc_id counts as the
    smallest; rows that share a doc_id do not cut each other. Columns besides doc_id and text play no part.

    Names of sampled windows leave out suffixes that repeat nowhere. The others are dealt out by prefixes of one, two or all three
    edges, as long as memory-sized groups need (prefix_lengths); each group is one suffix tree, whose internal nodes at
    the full width are the repeats, and a node keeps its smallest document. Edges are hashes, 64 bits for a path.
    """
    if width <= EDGES[-1]:
        raise ValueError(f"width must be over {EDGES[-1]}")
    cover = word_cover(width)
    lengths = prefix_lengths(keyed(docs), width)

    def dealt(paths: np.ndarray, n: int) -> np.ndarray:
        depth = lengths[(paths >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64)
        return (mix(above(paths, depth) ^ depth.astype(np.uint64) << np.uint64(62)) % np.uint64(n)).astype(np.int64)

    texts, windows = repeated_windows(docs, cover, earlier=True, bucket_of=dealt, grouped=subtrees)

    def finish(c: Chunk, i: int, covered: np.ndarray):
        words = c.texts[i].split()
        kept = [w for w, x in zip(words, covered.tolist(), strict=True) if not x] if covered.any() else words
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    out = cut_out(texts, windows, cover, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(unkeyed(), "n_words", "n_removed", "kept_sha256")
