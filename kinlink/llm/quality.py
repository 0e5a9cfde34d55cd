"""Operator 6: document quality from a linear-chain conditional random field over lines."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinlink.llm.gbt import Isotonic
from kinlink.llm.seqhash import keyed, unkeyed
from kinlink.llm.toxicity import held_out, labelled, score_texts

_TAIL = re.compile(r"[#$%&*^~=+<>|]{1,}(?=\s|$)")
_URL = re.compile(r"https?://|www\.|\.(?:com|net|org)\b|click|subscribe", re.I)
_DIGIT = re.compile(r"[0-9]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
WIDTH = 15


def line_features(line: str) -> list[float]:
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * WIDTH
    chars = len(line)
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lengths = sum(map(len, words)) / n
    return [
        1.0, min(1.0, np.log1p(n) / 6), distinct / n, same / n, min(3.0, lengths / 8), len(_TAIL.findall(line)) / n, words.count("|") / n,
        len(_DIGIT.findall(line)) / chars, len(_ODD.findall(line)) / chars, min(1.0, 4 * len(_URL.findall(line)) / n), float(line.rstrip()[-1] in ".!?\"'"), float(line.lstrip()[0].isupper()),
        float(n < 4), max(0.0, 1 - distinct / n) ** 2, sum(map(line.count, ".,;")) / n,
    ]


def document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line and of its neighbours, and the lines' lengths. Blank lines are left out; a text without others is one empty line."""
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    f = np.array([line_features(x) for x in lines])
    edge = np.zeros((1, WIDTH))
    return np.hstack([f, np.vstack([edge, f[:-1]]), np.vstack([f[1:], edge])]), np.array([max(1, len(x)) for x in lines], float)


class LineCRF:
    """States bad (0) and good (1). emit: weights of the good state; move: log potentials from state to state."""

    def __init__(self):
        self.emit, self.move = np.zeros(3 * WIDTH), np.zeros((2, 2))

    def chain(self, e: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward over padded chains: P(good) of each line, expected moves, log partition."""
        n, t_max = e.shape
        t = self.move
        a, b = np.zeros((t_max, n, 2)), np.zeros((t_max, n, 2))
        a[0, :, 1] = e[:, 0]
        for i in range(1, t_max):
            on = size > i
            a[i, :, 0] = np.where(on, np.logaddexp(a[i - 1, :, 0] + t[0, 0], a[i - 1, :, 1] + t[1, 0]), a[i - 1, :, 0])
            a[i, :, 1] = np.where(on, np.logaddexp(a[i - 1, :, 0] + t[0, 1], a[i - 1, :, 1] + t[1, 1]) + e[:, i], a[i - 1, :, 1])
        z = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
        moves = np.zeros((2, 2))
        for i in range(t_max - 1, 0, -1):
            on = size > i
            up = b[i, :, 1] + e[:, i]
            for s in (0, 1):
                b[i - 1, :, s] = np.where(on, np.logaddexp(t[s, 0] + b[i, :, 0], t[s, 1] + up), b[i, :, s])
                for r, w in ((0, b[i, :, 0]), (1, up)):
                    moves[s, r] += np.exp(a[i - 1, on, s] + t[s, r] + w[on] - z[on]).sum()
        p = np.exp(np.minimum(0, a[:, :, 1] + b[:, :, 1] - z)).T
        return p, moves, z

    @staticmethod
    def pad(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in parts])
        out = np.zeros((len(parts), size.max(), *parts[0].shape[1:]))
        for i, x in enumerate(parts):
            out[i, : len(x)] = x
        return out, size

    def fit(self, docs: list[np.ndarray], labels: list[np.ndarray], epochs: int = 25, rate: float = 0.05, l2: float = 1e-4, batch: int = 256) -> "LineCRF":
        """Adam on the conditional log-likelihood, by batches of chains of like length."""
        order = np.argsort([len(x) for x in docs], kind="stable")
        groups = []
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x, size = self.pad([docs[i] for i in own])
            groups.append((x, size, self.pad([labels[i].astype(float) for i in own])[0]))
        rng, theta = np.random.default_rng(6), np.concatenate([self.emit, self.move.ravel()])
        m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, size, y = groups[g]
                self.emit, self.move = theta[:-4], theta[-4:].reshape(2, 2)
                p, moves, _ = self.chain(x @ self.emit, size)
                on = np.arange(x.shape[1]) < size[:, None]
                seen = np.zeros((2, 2))
                prev, nxt, ok = y[:, :-1].astype(int), y[:, 1:].astype(int), on[:, 1:]
                np.add.at(seen, (prev[ok], nxt[ok]), 1)
                total = max(1, on.sum())
                grad = np.concatenate([np.einsum("nt,ntf->f", (y - p) * on, x), (seen - moves).ravel()]) / total - l2 * theta
                step += 1
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
                theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def good(self, docs: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """P(good) of every line of every document."""
        out: list = [None] * len(docs)
        order = np.argsort([len(x) for x in docs], kind="stable")
        at = 0
        while at < len(order):
            # long chains run in smaller batches: the padded block stays bounded
            own = order[at : at + max(1, min(batch, 200_000 // max(1, len(docs[order[min(at + batch, len(order)) - 1]]))))]
            x, size = self.pad([docs[i] @ self.emit for i in own])
            p, _, _ = self.chain(x, size)
            for row, i in enumerate(own):
                out[i] = p[row, : size[row]]
            at += len(own)
        return out


class QualityModel:
    def __init__(self, crf: LineCRF, scale: Isotonic):
        self.crf, self.scale = crf, scale

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the lines' log odds, as a probability: a long junk line weighs as its characters do."""
        p = self.crf.good([f for f, _ in docs])
        return np.array([float(w @ np.clip(x, 1e-6, 1 - 1e-6) / w.sum()) for x, (_, w) in zip(p, docs, strict=True)])

    def score(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(texts), 512):
            out.append(self.scale.predict(self.raw([document(t) for t in texts[at : at + 512]])))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, held, rows: int = 8_000) -> QualityModel:
    """rows: at most so many labelled documents. Lines begin with the label of their document; after a first fit,
    lines of bad documents that look good are relabelled, except the worst of each, and the field is fitted again."""
    sample = labelled(docs, labels, "quality", held, rows)

    def measure(batches):
        for b in batches:
            ids, texts, ys = (c.to_pylist() for c in b.columns)
            got = [document(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ys, pa.int32()), pa.array([f[:, :WIDTH].astype(np.float32).tobytes() for f, _ in got]), pa.array([w.astype(np.float32).tobytes() for _, w in got])], ["doc_id", "y", "f", "w"])

    got = sample.select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, y int, f binary, w binary").toPandas().sort_values("doc_id")
    edge, parts = np.zeros((1, WIDTH)), []
    for f, w in zip(got.f, got.w, strict=True):
        x = np.frombuffer(f, np.float32).reshape(-1, WIDTH).astype(float)
        parts.append((np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge])]), np.frombuffer(w, np.float32).astype(float)))
    y, chains = got.y.to_numpy(), [f for f, _ in parts]
    crf = LineCRF()
    if len(chains):
        crf.fit(chains, [np.full(len(f), t) for f, t in zip(chains, y, strict=True)], epochs=12)
        lines = []
        for p, t in zip(crf.good(chains), y, strict=True):
            own = np.ones(len(p), int) if t else (p > 0.5).astype(int)
            if not t:
                own[np.argmin(p)] = 0
            lines.append(own)
        crf = LineCRF().fit(chains, lines)
    model = QualityModel(crf, Isotonic())
    model.scale.fit(model.raw(parts) if parts else np.zeros(0), y.astype(float))
    return model


def quality(docs: DataFrame, labels: DataFrame, rows: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; labels with crc32(doc_id) mod 3 = 1 are not used.

    Null, empty and blank texts are scored as one empty line; null labels and ids train nothing; without
    labels every score is one half.
    """
    model = train(docs, labels, held_out("doc_id", 3, 1), rows)
    return score_texts(keyed(docs), model, threshold).select(unkeyed(), held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
