"""Operator 4: toxicity by boosted trees over dense lexical features, with isotonic calibration."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.gbt import Boosted, Isotonic, calibrated
from kinlink.llm.seqhash import NO_ID, chunks, keyed, unkeyed
from kinlink.llm.worker import lean
from kinlink.plans.scratch import materialize

#: A seed list of insults, and second-person forms of four languages.
SEED = frozenset("idiot idiots moron morons stupid dumb trash pathetic disgusting clown clowns loser losers garbage worthless scum hate shut kill ugly fool crap damn hell bastard freak creep dummkopf arschloch scheisse idiota estupido imbecil basura mierda imbecile connard merde ordure salaud".split())
SECOND = frozenset("you your yours you're youre yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tus ti vosotros ustedes".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FOLDS = 5
_EDGE = ".,;:!?\"'()[]{}<>*#|%&-_"
_ODD = re.compile(r"[a-z][0-9@$*!]+[a-z]|(?:\b[a-z][ .\-_*]){3,}", re.I)
_MARKS = re.compile(r"[!?]")
NAMES = ("seed_share", "seed_hits", "learned_sum", "learned_best", "learned_share", "learned_hits", "hidden_hits", "second_share", "near_second", "capitals", "shouted", "marks", "odd_share", "log_words")


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def features(text: str, weight: dict[str, float]) -> list[float]:
    """Densities and rates per word; weight: log odds of the learned lexicon. An empty text gives zeros."""
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = Counter(words)
    seed = sum(c for w, c in count.items() if w in SEED)
    odds = [(weight[w], c) for w, c in count.items() if w in weight]
    hidden = sum(c for w, c in count.items() if not w.isalpha() and ((plain := w.translate(LEET)) != w) and (plain in SEED or weight.get(plain, 0) > 1))
    second = [i for i, w in enumerate(words) if w in SECOND]
    bad = [i for i, w in enumerate(words) if w in SEED or weight.get(w, 0) > 1] if seed or odds else []
    near = int((np.searchsorted(second, np.array(bad) + 5, "right") > np.searchsorted(second, np.array(bad) - 5)).sum()) if second and bad else 0
    letters = max(1, len(text))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if capitals > 2 else 0
    return [
        seed / n, seed, sum(v * c for v, c in odds), max((v for v, _ in odds), default=0.0), sum(c for v, c in odds if v > 1) / n, sum(c for v, c in odds if v > 1), hidden,
        len(second) / n, near, capitals / letters, shouted / n, len(_MARKS.findall(text)) / n, len(_ODD.findall(text)) / n, float(np.log1p(n)),
    ]


def log_odds(toxic: np.ndarray, seen: np.ndarray, toxic_docs: float, docs: float) -> np.ndarray:
    """Smoothed log odds of a word between toxic and other documents."""
    return np.log((toxic + 0.3) / (toxic_docs + 0.6)) - np.log((seen - toxic + 0.3) / (docs - toxic_docs + 0.6))


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, scale: Isotonic):
        self.lexicon, self.trees, self.scale = lexicon, trees, scale

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(NAMES))
        return self.scale.predict(self.trees.decision(x))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held: F.Column, rows: int) -> DataFrame:
    """Up to `rows` training documents (doc_id, text, y), the first by a hash of the id: a documented bound on what trains a classifier. Of rows
    that share a doc_id the one with the least text trains."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids go to all tasks; texts are picked where they are read, and only these are written
    found = keyed(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return materialize(found, "labelled")


def held_out(doc_id, parts: int, part: int) -> F.Column:
    """crc32 of the id as text, modulo parts, is part; a null id is not."""
    return F.coalesce((F.col(doc_id) != NO_ID) & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part), F.lit(False))


def train(docs: DataFrame, labels: DataFrame, held: F.Column, rows: int = 20_000, words: int = 5_000) -> ToxicityModel:
    """rows: at most so many labelled documents train it; words: the largest learned lexicon. Words are counted on
    executors and by fold, so that a document's features come from a lexicon that has not seen its label."""
    sample = labelled(docs, labels, "toxic", held, rows)

    def count(batches):
        lean()
        for b in batches:
            total: dict[tuple[str, int], list[int]] = {}
            for doc, text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in set(tokens(text or "")):
                    x = total.setdefault((w, doc % FOLDS), [0, 0])
                    x[0] += y
                    x[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["word", "fold", "toxic", "seen"])

    counts = sample.mapInArrow(count, "word string, fold int, toxic long, seen long").groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))
    per_word = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("seen").alias("s"), *[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("toxic", "seen")])
    best = per_word.where("t >= 2").orderBy(F.desc(F.col("t") / (F.col("s") - F.col("t") + 3)), "word").limit(words).toPandas()
    folds = sample.groupBy((F.pmod("doc_id", F.lit(FOLDS))).alias("fold")).agg(F.sum("y").alias("t"), F.count("*").alias("s")).toPandas().set_index("fold").reindex(range(FOLDS)).fillna(0)
    t_all, s_all = float(folds.t.sum()), float(folds.s.sum())

    def lexicon(skip: int | None) -> dict[str, float]:
        t, s = best.t.to_numpy(float), best.s.to_numpy(float)
        td, sd = t_all, s_all
        if skip is not None:
            t, s = t - best[f"toxic{skip}"].to_numpy(float), s - best[f"seen{skip}"].to_numpy(float)
            td, sd = td - float(folds.t[skip]), sd - float(folds.s[skip])
        odds = log_odds(t, s, td, sd)
        return {w: float(o) for w, o, k in zip(best.word, odds, t, strict=True) if o > 0.5 and k >= 1}

    by_fold = [lexicon(k) for k in range(FOLDS)]

    def measure(batches):
        lean()
        for b in batches:
            docs_, texts, ys = (c.to_pylist() for c in b.columns)
            x = [features(t or "", by_fold[d % FOLDS]) for d, t in zip(docs_, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ys, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got.x.tolist(), float).reshape(-1, len(NAMES))
    trees, scale = calibrated(x, got.y.to_numpy(float), got.doc_id.to_numpy() % FOLDS)
    return ToxicityModel(lexicon(None), trees, scale)


def score_texts(docs: DataFrame, model, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) for docs(doc_id, text); the model goes to the tasks with the function."""

    def run(batches):
        for c in chunks(batches):
            s = model.score([t.decode("utf-8", "replace") for t in c.texts])
            yield pa.RecordBatch.from_arrays([pa.array(c.ids), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Labels of documents with crc32(doc_id) mod 4 = 2 are not used. Null and empty texts are scored by the calibrated
    value of all-zero features; null labels and ids train nothing; without labels every score is the prior.
    """
    model = train(docs, labels, held_out("doc_id", 4, 2), rows)
    return score_texts(keyed(docs), model, threshold).select(unkeyed(), held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs, with all their columns, without those the model rejects."""
    model = train(docs, labels, held_out("doc_id", 4, 2))

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        lean()
        return pd.Series(model.score(text.fillna("").tolist()) >= threshold)

    return docs.where(~rejected(docs["text"].cast("string")))
