"""Toxicity and quality by held-out accuracy and by the cases of their contracts, base spans by brute force, the corpus queries' SQL, and
the pipeline stage by stage."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kinlink.llm import pii
from kinlink.llm.queries import ORACLE_SQL, QUERIES
from kinlink.llm.quality import quality
from kinlink.llm.toxicity import drop_toxic, features, toxicity

DATA = "/root/testdata/sf0.001"


def corpus(toxic: bool, n=240):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        w = rng.choice(plain, int(rng.integers(20, 60))).tolist()
        if toxic and bad:
            for k in range(0, len(w), 6):
                w[k] = str(rng.choice(["you idiot", "STUPID!", "m0ron", "vexgrub", "shut up"]))
        lines = [" ".join(w[k : k + 8]) + "." for k in range(0, len(w), 8)]
        if not toxic and bad:
            lines = ["### %%% " + "$$ " * int(rng.integers(3, 9)) for _ in lines]
        texts.append("\n".join(lines))
        marks.append(int(bad))
    return texts, marks


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy_and_cases(spark, name):
    texts, marks = corpus(name == "toxic")
    if name == "quality":
        marks = [1 - m for m in marks]
    rows = [(i, t, "x", 3, 1.0) for i, t in enumerate(texts)] + [(None, None, "x", 1, 0.0), (5000, "", None, None, None), (5001, "w " * 50_000, "x", 1, 0.0), (3, texts[3], "x", 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, fold int, score double")
    labels = spark.createDataFrame([(i, m, m) for i, m in enumerate(marks)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    run, parts, part, cut = (toxicity, 4, 2, 0.3) if name == "toxic" else (quality, 3, 1, 0.5)
    got = run(docs, labels).collect()
    assert len(got) == len(rows)
    right = wrong = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part)
        if r.held_out and r.doc_id < len(marks):
            right, wrong = right + (r.predicted == marks[r.doc_id]), wrong + (r.predicted != marks[r.doc_id])
    assert right >= 0.9 * (right + wrong) and right > 40
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - m, 1 - m) if zlib.crc32(str(i).encode()) % parts == part else (i, m, m) for i, m in enumerate(marks)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((str(r.doc_id), r.score) for r in run(docs, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert run(docs.limit(0), labels).count() == 0
    assert len({r.score for r in run(docs, labels.limit(0)).collect()}) == 1
    if name == "toxic":
        kept = drop_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() < len(rows)


def test_toxicity_features_of_long_texts_are_linear():
    x = features("you idiot " * 30_000, {})
    assert len(x) == len(features("", {})) and x[8] == 30_000


def test_base_spans_by_their_definition():
    digits = lambda s: [c for c in s if c.isdigit()]

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    rng = np.random.default_rng(3)
    for _ in range(3000):
        s = "".join(rng.choice(list("0123456789.. -+()a@é"), rng.integers(0, 60)))
        ip = [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m[0].split("."))]
        card = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 14 <= len(digits(m[0])) <= 19 and luhn(m[0]) % 10 == 0]
        phone = [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 10 <= len(digits(m[0])) <= 15]
        got = pii.base_spans(s)
        for kind, want in ((1, ip), (2, card), (3, phone)):
            assert [tuple(x[:3]) for x in got if x[1] == kind] == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(duck.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Clean documents pass, planted ones are caught, whatever their ids; the last stage packs all that is left."""
    pytest.importorskip("public_tokenizers")
    texts, marks = corpus(True, 160)
    near = " ".join(f"c{i}" for i in range(120))
    item = " ".join(f"bench{i}" for i in range(30))
    planted = [(1000, near), (1001, near + " tail"), (1002, near), (None, f"lead {item} rest"), (None, "clean words without any id at all"), (1003, "mail a.b@c.example.com or +1 (269) 555-3296"), (1004, None), (1005, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*enumerate(texts), *planted]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    left = {r.doc_id for r in kept["toxicity"]}
    assert sum(i in left for i, m in enumerate(marks) if not m) >= 0.97 * (len(marks) - sum(marks)) and sum(i in left for i, m in enumerate(marks) if m) <= 0.1 * sum(marks)
    ids = [r.doc_id for r in kept["near_duplicates"]]
    assert 1000 in ids and 1001 not in ids and 1002 not in ids and {1003, 1004, 1005} <= set(ids) and ids.count(None) == 2
    assert [r.text for r in kept["decontamination"] if r.doc_id is None] == ["clean words without any id at all"] and len(kept["decontamination"]) == len(ids) - 1
    assert not any("a.b@c" in (r.text or "") or "555-3296" in (r.text or "") for r in kept["pii"]) and len(kept["pii"]) == len(kept["decontamination"])
    assert sum(r.piece == 0 for r in kept["packing"]) == len(kept["pii"])
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)
