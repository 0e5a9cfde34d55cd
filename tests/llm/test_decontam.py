"""Decontamination: recall against a scan of every document by exact edit distance, and the cases of its contract."""

import random

import numpy as np
import pytest

from kinlink.llm.decontam import Index, drop_leaks, edit_distance, leaks, plain, walks_for
from kinlink.llm.seqhash import Chunk

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n, words=600):
    return " ".join("".join(LETTERS[(w * 7 + i * i * 3 + w // 26) % 26] for i in range(2 + w % 8)) for w in (rng.integers(0, words, n) ** 2 // words).tolist())


def test_edit_distance_is_exact():
    random.seed(1)
    for _ in range(500):
        p, t = (bytes(random.choice(b"abc") for _ in range(random.randint(a, 12))) for a in (1, 0))
        prev = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            cur = [i + 1]
            for j, b in enumerate(t):
                cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[-1] + 1))
            prev = cur
        assert edit_distance(p, t, 99) == min(prev)


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.2])
def test_recall_against_a_scan(rate):
    rng = np.random.default_rng(int(100 * rate))
    items = [(i, prose(rng, int(rng.integers(15, 60)))) for i in range(80)]
    index = Index(items, walks_for(0.95, 0.2), 0.2)
    texts = []
    for _, x in items:
        y = [str(rng.choice(list(LETTERS))) if rng.random() < rate else c for c in x]
        texts.append(prose(rng, 60) + " " + "".join(y) + " " + prose(rng, 60))
    chunk = Chunk(list(range(len(texts))), [x.encode() for x in texts])
    got = {(d, index.items[i][0]): e for d, i, _, e in index.search(chunk)}
    text, _, low, high = plain(chunk)
    whole = text.tobytes()
    want = {}
    for d in range(len(texts)):
        item, own, _ = index.items[d]
        if (e := edit_distance(own, whole[low[d] : high[d]], int(0.2 * len(own)))) <= int(0.2 * len(own)):
            want[d, item] = e
    assert want and sum(got.get(k, 10**9) <= e for k, e in want.items()) >= 0.9 * len(want)
    assert all(k in want or k[0] != k[1] for k in got)


def test_rows_ids_and_short_items(spark):
    item = "seven words make this one short passage and some more words that follow here"
    rows = [(1, f"x {item.upper()} y", "c"), (1, "clean", "c"), (None, item.replace("short", "shart"), None), (None, "nothing to see", None), (3, None, "c"), (4, "", "c"), (5, "some quick brown cat ran by", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " . "), (4, "quick brown fox")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits, r.first_word) for r in leaks(docs, bench).collect())
    assert got == [("1", 1, 0, 1), ("1", 1, 0, 1), ("5", 4, 3, 1), ("None", 1, 1, 0), ("None", 1, 1, 0)]
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("1", "clean"), ("None", "nothing to see")]
    assert leaks(docs.limit(0), bench).count() == 0 and drop_leaks(docs, bench.limit(0)).count() == 7
