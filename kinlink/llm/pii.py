"""Operator 3: personal data by candidate spans, boosted trees and calibrated thresholds."""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.gbt import Boosted, Isotonic, calibrated
from kinlink.llm.seqhash import NO_ID, keyed, unkeyed
from kinlink.llm.worker import lean

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match takes whole digit runs, so it can begin at the first digit of a run only: the look-behind keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# generators of further candidates: high recall, overlapping
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:00 ?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-][0-9]{4}){3}(?![0-9])")
#: Words before a span that speak for a kind, and words that speak against all.
CUES = {
    "email": frozenset("mail email e-mail contact write schreib correo courriel".split()),
    "ip": frozenset("ip host server address adresse address: login".split()),
    "card": frozenset("card visa mastercard amex credit karte tarjeta carte payment".split()),
    "phone": frozenset("phone tel tel. call fax mobile cell telefon telefono telephone whatsapp sms ring dial".split()),
}
AGAINST = frozenset("version isbn issn order invoice page pages section chapter date on from year build release ref no nr id article figure table".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within a kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append((m.start(), 0, m.end()))
            done = m.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))
    if _ANY_DIGIT.search(text):
        if text.count(".") > 2:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "dot" in text or "(at)" in text or "[at]" in text or "{at}" in text:
        out += [(m.start(), 0, m.end()) for m in _LOOSE_MAIL.finditer(text)]
    if _ANY_DIGIT.search(text):
        out += [(m.start(), 2, m.end()) for m in _LOOSE_CARD.finditer(text)]
        out += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text) if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def span_features(text: str, start: int, kind: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = _NOT_DIGIT.sub("", span)
    groups = re.findall("[0-9]+", span)
    words = [w.strip(":,;()").lower() for w in before.split()][-4:]
    return [
        *[float(kind == k) for k in range(4)], len(digits), end - start, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(bool(digits) and luhn(digits)),
        float(span.startswith("00")), span.count("("), span.count("."), span.count("-"), span.count(" "), span.count("/"), len(set(digits)),
        *[float(any(w in CUES[k] for w in words)) for k in KINDS], float(any(w in AGAINST for w in words)), float("[" in span or "(at" in span or "{" in span), float("dot" in span),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#"), float(bool(re.match(r"(?:19|20)[0-9]{2}\b", span))), sum(c.isalpha() for c in span),
    ]


def examples(n: int = 6_000, seed: int = 3) -> tuple[list[tuple[str, int, int, int]], np.ndarray]:
    """Made-up spans in made-up contexts: formats of personal data, and of dates, versions, prices and numbers that are none."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    rows, y = [], []
    while len(rows) < n:
        good, kind = bool(rng.random() < 0.5), int(rng.choice([0, 2, 3, 3]))
        cue = str(rng.choice(sorted(CUES[KINDS[kind]]))) if rng.random() < (0.8 if good else 0.05) else str(rng.choice(sorted(AGAINST))) if not good and rng.random() < 0.6 else word()
        if kind == 0 and good:
            at, dot = [("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] ")][rng.integers(5)]
            span = f"{word()}{'.' + num(2) if rng.random() < 0.5 else ''}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        elif kind == 0:
            span = f"{word()} at {word()}{rng.choice([' dot ', '.', '. '])}{word()}"
        elif kind == 2:
            d = num(15)
            d = d + next(c for c in "0123456789" if luhn(d + c) == good)
            span = rng.choice([".", "/", "_", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))
        elif good:
            span = [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"][rng.integers(6)]
        else:
            span = [f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}.{num(2)}.19{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"[:17], f"{num(2)} {num(3)} {num(3)}", f"{num(4)} {num(4)}", f"{num(5)}-{num(4)}", f"19{num(2)}-20{num(2)}"][rng.integers(8)]
        text = f"{word()} {word()} {cue}{': ' if rng.random() < 0.3 else ' '}"
        rows.append((f"{text}{span} {word()}", len(text), kind, len(text) + len(span)))
        y.append(float(good))
    return rows, np.array(y)


class SpanModel:
    """trees and calibration; floor: the least calibrated probability at which a span of each kind is taken."""

    def __init__(self, trees: Boosted, scale: Isotonic, floor: list[float]):
        self.trees, self.scale, self.floor = trees, scale, floor

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = candidates(text)
        if base:
            # the base spans stay; what touches one is none of ours
            low, high = np.array([s for s, _, _ in base]), np.maximum.accumulate(np.array([e for _, _, e in base]))
            found = [c for c in found if (k := int(np.searchsorted(low, c[2])) - 1) < 0 or high[k] <= c[0]]
        if not found:
            return []
        p = self.scale.predict(self.trees.decision(np.array([span_features(text, *c) for c in found], float)))
        out: list[tuple[int, int, int]] = []
        taken = np.zeros(len(text) + 1, bool)
        for i in np.argsort(-p, kind="stable"):
            s, k, e = found[i]
            if p[i] >= self.floor[k] and not taken[s:e].any():
                taken[s:e] = True
                out.append(found[i])
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


@lru_cache(maxsize=4)
def trained(n: int = 6_000, seed: int = 3, precision: float = 0.98) -> SpanModel:
    """No table labels spans, so the trees learn from made-up examples; thresholds are the least that reach the precision on rows left out."""
    rows, y = examples(n, seed)
    x = np.array([span_features(*r) for r in rows], float)
    folds = np.arange(n) % 5
    trees, scale = calibrated(x, y, folds, rounds=40)
    held = folds == 0
    p = scale.predict(Boosted(rounds=40).fit(x[~held], y[~held]).decision(x[held]))
    kind, floor = np.array([r[2] for r in rows])[held], []
    for k in range(4):
        own, truth = p[kind == k], y[held][kind == k]
        able = [t for t in np.unique(own) if truth[own >= t].mean() >= precision]
        floor.append(max(0.9, float(min(able))) if able else 2.0)
    return SpanModel(trees, scale, floor)


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; counts are those of the base spans.

    Null and empty texts have no spans: zeros, the hash of the empty string, and an empty list. Offsets are code points.
    """
    model = trained()

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base, every = model.spans(text or "")
                n = np.bincount([k for _, k, _ in base], minlength=4).tolist()
                rows.append((NO_ID if doc is None else doc, *n, hashlib.sha256(_text(base).encode()).hexdigest(), _text(every)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    out = keyed(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.select(unkeyed(), *out.columns[1:])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    model = trained()

    def clean(text: str) -> str:
        out, at = [], 0
        merged: list[list[int]] = []
        for s, k, e in model.spans(text)[1]:
            if merged and s < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([s, k, e])
        for s, k, e in merged:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(text: pd.Series) -> pd.Series:
        lean()
        return text.map(lambda t: None if t is None else clean(t))

    return docs.withColumn("text", cleaned(docs["text"].cast("string")))
