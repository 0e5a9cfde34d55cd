"""The two exact substring operators on made-up tables with repeated rows, missing ids, long and periodic texts, and split prefixes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from kinlink.llm import substring
from kinlink.llm.substring import above, prefix_lengths, subtrees, substring_dedup
from kinlink.llm.suffix_dedup import suffix_dedup


def rows():
    rng = np.random.default_rng(0)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50, n)]
    shared = [word(int(rng.integers(40, 160))) for _ in range(5)]
    out = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 60)))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(5)], word(int(rng.integers(0, 20)))]
        out.append((int(rng.integers(0, 1000)) if i % 9 else None, " ".join(sum(parts, []))))
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + b, b + a
    return [*out, out[3], out[3], (5000, "z " * 900), (5001, "é" * 300 + "x" + "é" * 300), (5002, None), (5003, ""), (5004, a), (5005, b), (5006, "\t \n")]


@pytest.fixture(scope="module")
def table(spark):
    return rows(), spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, found string").repartition(4)


def test_suffixes(table):
    data, docs = table
    texts = [(t or "").encode() for _, t in data]
    count = Counter(b[i : i + 400] for b in texts for i in range(len(b) - 399))
    want = Counter()
    for (k, _), b in zip(data, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[k, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup(docs).collect()) == want


@pytest.mark.parametrize("group", [1 << 19, 20])
def test_words(table, monkeypatch, group):
    data, docs = table
    lengths = prefix_lengths(docs.select("doc_id", "text"), 50, group)
    assert lengths.min() >= 1 and (lengths.max() > 1) == (group == 20)
    monkeypatch.setattr(substring, "prefix_lengths", lambda docs, width: lengths)
    texts = [(i, (t or "").encode().split()) for i, t in data]
    first: dict = {}
    for k, w in texts:
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            first[x] = min(first.get(x, 2**62), -1 if k is None else k)
    want = Counter()
    for k, w in texts:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (-1 if k is None else k):
                gone[i : i + 50] = True
        want[k, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup(docs).collect()) == want


def test_subtrees_are_those_of_the_paths():
    rng = np.random.default_rng(2)
    k = (rng.integers(0, 3, 200).astype(np.uint64) << np.uint64(44)) | (rng.integers(0, 3, 200).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 3, 200).astype(np.uint64)
    d = rng.integers(0, 9, 200)
    paths, docs, head, size = subtrees(k, d)
    assert Counter(zip(paths.tolist(), docs.tolist())) == Counter(zip(k.tolist(), d.tolist()))
    assert dict(zip(paths[head].tolist(), size.tolist())) == Counter(k.tolist())
    assert above(k[:1], 1)[0] == k[0] >> np.uint64(44) and above(k[:1], 3)[0] == k[0]
