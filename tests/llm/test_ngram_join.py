"""The n-gram join against all pairs: repeated and missing ids, hot shingles, long words, large groups, several exchanges."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from kinlink.llm import ngram_join, seqhash
from kinlink.llm.ngram_join import drop_near_copies, ngram_components
from kinlink.llm.seqhash import Chunk, hops, label, shared_keys


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts):
    s = sets_of(texts)
    up = list(range(len(s)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(s)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [len(x) for x in s], [root(i) for i in range(len(s))]


def corpus(seed=0, groups=12, most=12):
    rng = np.random.default_rng(seed)
    hot = " ".join(f"hot{i}" for i in range(30))
    out = []
    for g in range(groups):
        words = [f"g{g}x{rng.integers(500)}" for _ in range(rng.integers(8, 120))]
        for _ in range(rng.integers(1, most)):
            own = list(words)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = f"e{rng.integers(9)}"
            out.append(" ".join(own) + (" " + hot if rng.random() < 0.5 else ""))
    return [*out, None, "", " \t", hot, hot, "a b", "A b", "a" * 5000 + " b c d e", "a" * 4999 + "c b c d e", out[0]]


@pytest.mark.parametrize("cell_bytes", [3000, 4 << 20])
def test_against_all_pairs(spark, cell_bytes):
    texts = corpus()
    rng = np.random.default_rng(1)
    ids = rng.permutation(len(texts)).tolist()
    sizes, up = brute(texts)
    least = {r: min(ids[i] for i in range(len(ids)) if up[i] == r) for r in set(up)}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, cell_bytes=cell_bytes).collect()}
    assert got == {ids[i]: (sizes[i], least[up[i]]) for i in range(len(ids))}


def test_rows_that_share_an_id_are_documents(spark):
    long = " ".join(f"w{i}" for i in range(100))
    short = " ".join(f"v{i}" for i in range(10))
    rows = [(1, long, "x"), (1, short, "x"), (2, short, "x"), (None, long, "x"), (None, "other words stand in here", None), (7, None, None), (7, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect())
    assert got == Counter([(1, 96, 1), (1, 6, 1), (2, 6, 1), (None, 96, 1), (None, 1, None), (7, 0, 7), (7, 96, 1)])
    kept = sorted((str(r.doc_id), r.text or "") for r in drop_near_copies(docs).collect())
    assert kept == sorted([("1", long), ("1", short), ("None", "other words stand in here"), ("7", "")])
    assert drop_near_copies(docs).columns == docs.columns


def test_words_beyond_any_polynomial():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    h = Chunk([1], [f"{a} {b} {a}".encode()]).words(lower=True)[0]
    assert h[0] == h[2] != h[1]


def test_several_exchanges_give_the_same(spark, monkeypatch):
    texts = corpus(3, 6, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    size = lambda c: np.bincount(ngram_join.shingles(c, 5)[1], minlength=len(c.ids))
    run = lambda **k: sorted((r.doc_id, r.n, bytes(r["keys"] or b"")) for r in shared_keys(docs, lambda c: ngram_join.shingles(c, 5), earlier=False, sizes=size, buckets=40, **k).collect())
    direct = run()
    monkeypatch.setattr(seqhash, "RADIX", 4)
    assert hops(40) == [16, 4] and label(np.array([37]), 16, 5)[0] == 37
    assert run() == direct
    monkeypatch.setattr(seqhash, "RADIX", 7)
    assert [x[:2] for x in run(narrow=True)] == [x[:2] for x in direct]
