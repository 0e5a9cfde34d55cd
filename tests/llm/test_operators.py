"""Exact operators against brute force on a small table of hard cases; models by what must hold for any data."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinlink.llm import lm, media, packing, pii
from kinlink.llm.decontam import leaks
from kinlink.llm.gbt import Boosted, Isotonic
from kinlink.llm.ngram_join import Trie, links, ngram_components
from kinlink.llm.seqhash import difference_cover
from kinlink.llm.substring import substring_dedup
from kinlink.llm.suffix_dedup import suffix_dedup

WORDS = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
LONG = " ".join(WORDS)
HARD = [
    (1, LONG), (2, LONG), (3, "x " + " ".join(WORDS[40:140]) + " y"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (9, " ".join(WORDS[:396]) + " q"),
    (10, "ab" * 600), (11, "z" * 401), (None, "lonely words stand here today"), (12, " ".join(WORDS[i % 3] for i in range(200))), (50, "+1 (269) 555-3296 a.b@c.example.com 4524132264652876 and 1.2.3.4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, b"") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, keys int, blobs binary".replace("n long", "n string"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_difference_cover():
    for q in (2, 3, 5, 7):
        v, d = difference_cover(q)
        for a, b in itertools.product(range(v), repeat=2):
            assert any((a + s) % v in d and (b + s) % v in d for s in range(v))


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    texts = {i: (t or "").encode() for i, t in HARD}
    count = Counter(b[i : i + 400] for b in texts.values() for i in range(len(b) - 399))
    for k, b in texts.items():
        gone = [False] * len(b)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    first: dict = {}
    for k, t in sorted(HARD, key=lambda x: (x[0] is not None, x[0])):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), k) != k:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup(empty).count() == 0


def shingle_sets():
    out = {}
    for k, t in HARD:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_ngram_components(docs, empty):
    got = {r.doc_id: r for r in ngram_components(docs).collect()}
    sets = shingle_sets()
    up = {k: k for k in sets}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            up[a] = up[b] = min(up[a], up[b])
    for k, s in sets.items():
        assert (got[k].n_shingles, got[k].component_id) == (len(s), up[k])
    assert {got[1].component_id, got[2].component_id, got[9].component_id} == {1}
    assert ngram_components(empty).count() == 0


def test_trie_finds_every_component():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 20))).astype(np.uint64) for _ in range(25)]
        sizes = np.array([len(s) for s in sets])
        tree = Trie(sets, sizes)
        for x in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(x, s)) >= 50 * len(np.union1d(x, s))]
            assert sorted(tree.linked(x, len(x), 50)) == want
        assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b])) for a, b in links(sets, sizes, 50))


def test_pii_base_is_plain_regex():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        s = "".join(rng.choice(list("ab123..@@+- ()é"), rng.integers(0, 50)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
        assert [x for x in pii.base_spans(s) if x[1] == 0] == want


def test_pii_query(docs, empty):
    got = {r.doc_id: r for r in pii.pii(docs).collect()}
    assert (got[50].n_email, got[50].n_ip, got[50].n_card, got[50].n_phone) == (1, 1, 1, 1)
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "a.b@c" not in {r.doc_id: r.text for r in pii.redact(docs).collect()}[50]
    assert pii.pii(empty).count() == 0


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tk = tokenizers.Tokenizer.from_file(path)
    got = packing.packed(docs, path, 128).toPandas()
    want = []
    for k, t in HARD:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k, i // 128, i, len(ids[i : i + 128]), zlib.crc32(ids[i : i + 128].tobytes())) for i in range(0, len(ids), 128)]
    key = lambda r: tuple(-1 if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(map(key, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 128
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) + 1
    assert packing.packed(empty, path).count() == 0


def test_crossover_keeps_every_document():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 300)
    a, b = (packing.fitted(lengths.tolist(), rng.permutation(300).tolist(), 100) for _ in range(2))
    child = packing.crossover(a, b, lengths, 100, rng)
    assert len(child) == 300 and np.bincount(child, lengths).max() <= 100


def test_lm_base_and_normalization(docs):
    got = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    toks = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in HARD}
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k in toks}
    c = Counter(w for k, v in toks.items() if not held[k] for w in v)
    n, v = sum(c.values()), len(c)
    for k, w in toks.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))


@pytest.mark.parametrize("words", [2, 8, 9, 50])
def test_lm_probabilities_of_all_words_sum_to_one(words):
    rng = np.random.default_rng(words)
    model = lm.LogBilinear(words).unigram(rng.integers(0, 9, words)).start()
    model.use((model.p + rng.normal(0, 0.5, model.p.shape)).astype(np.float32))
    h = rng.integers(0, words, (5, 2))
    p = 10 ** model.log10(np.repeat(h, words, 0), np.tile(np.arange(words), 5), block=7)
    assert np.allclose(p.reshape(5, words).sum(1), 1, atol=1e-5)


def test_lm_untrained_is_the_unigram():
    model = lm.LogBilinear(30).unigram(np.arange(30)).start()
    model.p[:, :-1] = 0
    w = np.arange(30)
    assert np.allclose(10 ** model.log10(np.zeros((30, 2), int), w), (w + 0.5) / (w + 0.5).sum(), atol=1e-6)


def test_lm_learns_what_follows(spark):
    """Words in a fixed cycle: the base knows how often each occurs, the model which one comes next, also in held-out documents."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[(i + j) % 40] for j in range(400))) for i in range(400)], "doc_id long, text string").repartition(3)
    got = lm.lm_scores(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_a_training_step_makes_no_matrix_of_parameters_anew():
    import tracemalloc

    rng, model = np.random.default_rng(3), lm.LogBilinear(20_000).unigram(np.arange(20_000)).start()
    state, seen = np.full(model.p.shape, 1e-6, np.float32), np.zeros(len(model.p))
    step = lambda: model.step(rng.integers(0, 20_000, (64, 2)), rng.integers(0, 20_000, 64), state, seen, rng, 0.1)
    step()
    tracemalloc.start()
    try:
        step()
        assert tracemalloc.get_traced_memory()[1] < model.p.nbytes
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("size", [0, 1, 2, 1000])
def test_places_in_the_head(size):
    rng = np.random.default_rng(size)
    # many that begin with the same bits, the least and the largest ones, and others
    known = np.unique(np.concatenate([rng.integers(0, 2**64, size, np.uint64), np.arange(size, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(size, dtype=np.uint64)]))
    asked = np.concatenate([known, known + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)])
    want = {int(k): i for i, k in enumerate(known)}
    assert lm.Head(known).place(asked).tolist() == [want.get(int(h), -1) for h in asked]
    assert lm.Head(known).place(known[:0]).tolist() == []


def test_lm_without_training_documents(spark):
    held = [i for i in range(50) if lm._held(i)]
    got = lm.lm_scores(spark.createDataFrame([(i, "a b") for i in held] + [(held[0], None)], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and np.isfinite(r.score) for r in got)
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_ranks_words_over_all_training_documents(spark):
    held = [i for i in range(50) if lm._held(i)]
    rows = [(i, "only held" if i in held else f"often w{i}") for i in range(50)] + [(None, "null null null")] + [(50 + i, "late") for i in range(100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trained = [t for i, t in rows if i is None or not lm._held(i)]
    want = Counter(w for t in trained for w in t.split())
    hashes = {w: int(lm.Chunk([0], [w.encode()]).words(lower=True)[0][0]) for w in [*want, "only", "held"]}
    for flush in (1, 1 << 20):
        got, counts = (x.tolist() for x in lm.head_words(docs, 100, flush))
        assert dict(zip(got, counts, strict=True)) == {hashes[w]: n for w, n in want.items()} and got[:3] == [hashes[w] for w in ("late", "often", "null")]


def test_leaks(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(WORDS[60:90])), (2, "entirely other words that no document of this table holds at all"), (3, ""), (4, None), (5, "one two")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks(docs, bench).collect()}
    assert {k for k in got if k[1] == 1} == {(1, 1), (2, 1), (3, 1), (9, 1)} and not any(i in (2, 3, 4) for _, i in got)
    assert {(7, 5), (8, 5)} <= set(got) and leaks(empty, bench).count() == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((Boosted().fit(x[:600], y[:600]).decision(x[600:]) > 0) == y[600:]).mean() > 0.85
    p = Isotonic().fit(x[:, 0], (x[:, 0] > 0).astype(float)).predict(np.linspace(-2, 2, 50))
    assert (np.diff(p) >= 0).all() and p[0] < 0.1 and p[-1] > 0.9
    assert Boosted().fit(np.zeros((0, 3)), np.zeros(0)).decision(x[:2]).shape == (2,)


def test_media(spark):
    a = media.tones(list(np.random.default_rng(1).normal(0, 0.2, 64)))
    cut = media.decode(a)[128 * 10 :]
    whole, part = media.fingerprint(media.decode(a)), media.fingerprint(cut)
    assert (whole[10 : 10 + len(part)] == part[: len(whole) - 10]).mean() > 0.8
    assert len(media.fingerprint(media.decode(None))) == 0 and len(media.fingerprint(media.decode(b"junk"))) == 0
    rows = [(0, whole.tobytes()), (1, part.tobytes()), (2, whole.tobytes()), (3, b""), (None, b"")]
    got = {(r.query_id, r.match_id): r for r in media.recordings(spark.createDataFrame(rows, "id long, print binary")).collect()}
    assert got[0, 0].match_copies == 2 and got[0, 1].offset == -10


def test_media_finds_distorted_copies():
    """Copies cut at any sample, with noise: at least 0.9 of what a comparison at every offset finds, and nothing else."""
    rng = np.random.default_rng(9)
    sound = [media.decode(media.tones(list(rng.normal(0, 0.2, 64)))) for _ in range(60)]
    index = media.Asked([media.fingerprint(x) for x in sound])
    found = wanted = 0
    for i, x in enumerate(sound):
        for noise in (0.02, 0.2):
            x = x[int(rng.integers(0, 2000)) :]
            p = media.fingerprint(x + rng.normal(0, noise * x.std(), len(x)))
            want = {q for q, a in enumerate(index.prints) if media.alignments(a, p[None, :], 0.2, 16)}
            got = {q for q, *_ in index.aligned(p, 0.2, 16)}
            assert got <= want and got <= {i}
            found, wanted = found + len(got), wanted + len(want)
    assert wanted >= 100 and found >= 0.9 * wanted
    index.offsets = lambda x: None
    assert {q for q, *_ in index.aligned(p, 0.2, 16)} == want


def test_media_alignment_is_exhaustive(spark):
    rng = np.random.default_rng(5)
    x, y, z, w = (rng.integers(0, 2**32, n, dtype=np.uint32) for n in (30, 20, 25, 40))
    far = w.copy()
    for i in range(len(far)):
        far[i] ^= np.bitwise_or.reduce(np.uint32(1) << rng.choice(32, 4, replace=False).astype(np.uint32))  # no integer stays equal
    rows = [(0, np.concatenate([x, z])), (1, np.concatenate([x, y, x, z])), (50, w), (51, far), (100, np.full(40, 7, np.uint32)), (101, np.concatenate([np.full(30, 9, np.uint32), np.full(40, 7, np.uint32)]))]
    table = spark.createDataFrame([(i, p.tobytes()) for i, p in rows], "id long, print binary")
    want = {}
    for (q, a), (i, b) in itertools.product(rows, rows):
        if q % 50 == 0 and q != i:
            for off in range(-len(a), len(b)):
                lo, hi = max(0, -off), min(len(a), len(b) - off)
                if hi - lo >= 16 and (e := int(np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).sum())) <= 0.35 * 32 * (hi - lo):
                    want.setdefault((q, i), {})[off] = hi - lo, e
    for block in (1, 64 << 10):
        got = {(r.query_id, r.match_id): r for r in media.recordings(table, block=block).collect() if r.query_id != r.match_id}
        assert set(got) == set(want) and all(want[k][r.offset] == (r.overlap, r.errors) for k, r in got.items())
        assert got[0, 1].offset == 50 and got[50, 51].offset == 0 and got[100, 101].offset == 30
