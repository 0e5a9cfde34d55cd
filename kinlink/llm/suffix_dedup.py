"""Operator 5: bytes inside a long string that also starts elsewhere, by difference-cover naming of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from kinlink.llm.repeats import Cover, cut_out, repeated_windows
from kinlink.llm.seqhash import Chunk, roll, unkeyed


def byte_cover(width: int = 400) -> Cover:
    """The largest cover that leaves names of half the width; it samples q+1 of q^2+q+1 bytes."""
    q = max(q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if q == 2 or q * q + q + 1 <= 0.5 * width)
    return Cover(lambda c: (roll(21).prefix(c.buf), c.start, c.start + c.lengths), width, q, 21)


def suffix_dedup(docs: DataFrame, width: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is what is left of the UTF-8 text, as binary.

    A byte goes if a string of `width` (8 at least) bytes that covers it also starts at any other place of
    any document. Both places lose it. Null and empty texts give zeros and an empty rest; a null doc_id
    stays null; repeated rows repeat each other's text and are both emptied of it.

    Suffixes that start in the difference cover are named by the hash of their first bytes; names are sorted and compared with
    their neighbours, and only what lies within reach of a repeated name is looked at further, by the hash of the whole width,
    sorted and compared likewise. Names are 64-bit hashes of any width instead of ranks of triples, so there is no
    recursion, and no order of suffixes beyond equality: this departs from the named method (README).
    """
    if width < 8:
        raise ValueError("width must be 8 or more")
    cover = byte_cover(width)
    texts, windows = repeated_windows(docs, cover, earlier=False)

    def finish(c: Chunk, i: int, covered: np.ndarray):
        text = np.frombuffer(c.texts[i], np.uint8)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)) == 1))
        kept = text[~covered].tobytes() if spans else c.texts[i]
        return len(text), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()

    out = cut_out(texts, windows, cover, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(unkeyed(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
