"""Operator 9: chroma fingerprints of audio columns, and the search that aligns recordings."""

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.plans.scratch import materialize, partitions_for

RATE, FRAME, HOP = 4000, 512, 128
#: Frames that a filter spans at most; so many frames give one integer less than frames - WIDEST + 1.
WIDEST = 8


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, classes, frames) of 16 filters, by rule: four shapes at four places and widths."""
    return [(shape, 3 * k, 2 + (k + shape) % 3 * 2, (2, 4, 6, 8)[(k + shape) % 4]) for k in range(4) for shape in range(4)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of the 12 pitch classes in every frame, each frame scaled to unit length; silence gives zeros."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, 12))
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (f > 60) & (f < 1900)
    classes = np.eye(12)[np.round(12 * np.log2(f[use] / 440)).astype(int) % 12]
    views, window = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP], np.hanning(FRAME)
    # some thousand frames at once: memory does not follow the length of a recording
    out = np.concatenate([(np.abs(np.fft.rfft(views[i : i + 4096] * window, axis=1)) ** 2)[:, use] @ classes for i in range(0, n, 4096)])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-12), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer per place: 16 filters over the integral image of the chroma, two Gray-coded bits each."""
    c = chroma(samples)
    n = len(c) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wrapped = np.hstack([c, c])  # pitch classes are a circle
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = wrapped.cumsum(0).cumsum(1)
    at, out = np.arange(n), np.zeros(n, np.uint32)

    def area(t0, t1, p0, p1):
        return image[t1, p1] - image[t0, p1] - image[t1, p0] + image[t0, p0]

    for shape, p, height, width in filters():
        t0, t1, p1 = at, at + width, p + height
        if shape == 0:
            a, b = area(t0, t1, p, p1), area(t0, t1, p1, p1 + height)
        elif shape == 1:
            a, b = area(t0, t0 + width // 2, p, p1), area(t0 + width // 2, t1, p, p1)
        elif shape == 2:
            mid = p + height // 2
            a = area(t0, t0 + width // 2, p, mid) + area(t0 + width // 2, t1, mid, p1)
            b = area(t0, t0 + width // 2, mid, p1) + area(t0 + width // 2, t1, p, mid)
        else:
            third = max(1, height // 2)
            a, b = area(t0, t1, p, p + third) + area(t0, t1, p + 2 * third, p + 3 * third), 2 * area(t0, t1, p + third, p + 2 * third)
        v = np.log((1 + a) / (1 + b))
        level = np.digitize(v, (-0.25, 0.0, 0.25))
        out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def decode(media: bytes | None) -> np.ndarray:
    """Mono samples at RATE of a PCM WAV (8 or 16 bits, any channels, any rate); anything else gives no samples."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2):
        return np.zeros(0)
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x) if rate != RATE and len(x) else x


def tones(values: list[float | None] | None) -> bytes:
    """A WAV that plays one tone for each number: the synthetic tables hold no audio, so the query renders vectors."""
    v = np.nan_to_num(np.array([x if x is not None else 0.0 for x in values or []], float), posinf=0.0, neginf=0.0)
    note = 220 * 2 ** (np.clip(np.round(12 * np.tanh(v * 4)), -11, 12) / 12 + 1)
    phase = 2 * np.pi * np.cumsum(np.repeat(note, HOP)) / RATE
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.sin(phase) * 16000).astype("<i2").tobytes())
    return out.getvalue()


def fingerprints(media: DataFrame, key: str = "id", column: str = "media") -> DataFrame:
    """(id, print): the packed fingerprint of each row's media; null and undecodable media give an empty one."""

    def run(batches):
        for b in batches:
            got = [fingerprint(decode(x)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["id", "print"])

    return media.select(media[key].cast("long").alias("id"), media[column].cast("binary").alias("media")).mapInArrow(run, "id long, print binary")


def alignments(x: np.ndarray, ys: np.ndarray, most_errors: float, least_overlap: int) -> list[tuple[int, int, int, int]]:
    """(row of ys, offset, overlap, errors) for each row that aligns with x. All offsets are verified; of those that pass, the one
    with most equal integers counts, then the one with the smallest share of errors, then the least."""
    m, n = len(x), ys.shape[1]
    need, best = min(least_overlap, m, n), {}
    for off in range(need - m, n - need + 1):
        lo, hi = max(0, -off), min(m, n - off)
        own, cut = x[lo:hi], ys[:, lo + off : hi + off]
        errors = np.bitwise_count(own ^ cut).sum(1, dtype=np.int64)
        for j in np.flatnonzero(errors <= most_errors * 32 * (hi - lo)).tolist():
            e = int(errors[j])
            rank = (int((own == cut[j]).sum()), -e / (hi - lo), -abs(off), -off)
            if j not in best or rank > best[j][0]:
                best[j] = rank, off, hi - lo, e
    return [(j, *x[1:]) for j, x in best.items()]


#: Each key is half of an integer's bits; four halves, each by a rule.
MASKS = np.array([0x0000FFFF, 0xFFFF0000, 0x55555555, 0xAAAAAAAA], np.uint32)


class Asked:
    """A block of queries, by the halves of their integers."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        flat = np.concatenate(prints)
        of = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        at = np.concatenate([np.arange(len(p)) for p in prints])
        self.tables = []
        for m in MASKS:
            order = np.argsort(flat & m, kind="stable")
            self.tables.append(((flat & m)[order], of[order], at[order]))

    def offsets(self, x: np.ndarray, limit: int = 1 << 21) -> np.ndarray | None:
        """Rows (query, offset) that at least two halves speak for: the histogram of offsets of all places with equal halves. None if there
        are more than limit such places."""
        spans = [(np.searchsorted(keys, x & m), np.searchsorted(keys, x & m, "right")) for m, (keys, _, _) in zip(MASKS, self.tables, strict=True)]
        if sum(int((hi - lo).sum()) for lo, hi in spans) > limit:
            return None
        found = []
        for (lo, hi), (_, of, at) in zip(spans, self.tables, strict=True):
            count = hi - lo
            i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            found.append(of[i] << 32 | np.repeat(np.arange(len(x)), count) - at[i] + (1 << 31))
        code, votes = np.unique(np.concatenate(found), return_counts=True)
        code = code[votes > 1]
        return np.stack([code >> 32, (code & 0xFFFFFFFF) - (1 << 31)], 1)

    def aligned(self, x: np.ndarray, most_errors: float, least_overlap: int) -> list[tuple[int, int, int, int]]:
        """(query, offset, overlap, errors) of the queries that align with x; of several offsets as in alignments()."""
        near = self.offsets(x)
        if near is None:  # integers that very many places share, such as silence: every offset is verified
            return [(q, *r[1:]) for q, p in enumerate(self.prints) for r in alignments(p, x[None, :], most_errors, least_overlap)]
        best = {}
        for q, off in near.tolist():
            p = self.prints[q]
            lo, hi = max(0, -off), min(len(p), len(x) - off)
            if hi - lo < min(least_overlap, len(p), len(x)):
                continue
            own, cut = p[lo:hi], x[lo + off : hi + off]
            e = int(np.bitwise_count(own ^ cut).sum())
            if e <= most_errors * 32 * (hi - lo):
                rank = (int((own == cut).sum()), -e / (hi - lo), -abs(off), -off)
                if q not in best or rank > best[q][0]:
                    best[q] = rank, off, hi - lo, e
        return [(q, *r[1:]) for q, r in best.items()]


def recordings(prints: DataFrame, every: int = 50, most_errors: float = 0.2, least_overlap: int = 16, block: int = 256 << 10) -> DataFrame:
    """(query_id, match_id, offset, overlap, errors, bit_error_rate, match_copies), for each query and each recording that aligns with it.

    Queries are the rows whose id is divisible by `every`. Equal prints are one recording, named by its smallest id;
    match_copies counts its rows. Every query meets every recording, in blocks of about `block` bytes: places whose
    integers have an equal half vote for an offset, offsets with two votes are verified by bit errors. Copies with noise and
    cut at any sample have up to 0.16 bit errors here, unrelated recordings 0.25 and more, hence most_errors.
    Of several offsets the one with most equal integers counts, then the fewest errors, then the least offset. Rows without id or
    with empty prints match nothing; rows that share an id are rows of their own. Columns besides id and print play no part.
    """
    prints = materialize(prints.select("id", "print").where("id is not null and length(print) > 0"), "prints")
    classes = prints.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.col("id") % every == 0, F.col("id"))).alias("query"))
    classes = materialize(classes, "recordings")

    def pack(batches):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([[r[k] for r in held]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["ids", "copies", "prints"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                size += len(r[2])
                if size >= block:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    blocks = "ids array<bigint>, copies array<bigint>, prints array<binary>"
    asked = classes.where("query is not null").coalesce(max(1, partitions_for(classes, 64 << 20) // 50)).select("rep", "copies", "print").mapInArrow(pack, blocks).select(F.col("ids").alias("q"), F.col("prints").alias("qp"))
    held = classes.select("rep", "copies", "print").mapInArrow(pack, blocks).repartition(partitions_for(classes, 1 << 20))

    def compare(batches):
        name, index = None, None
        for b in batches:
            for qs, qps, ids, copies, ps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != qs:
                    name, index = qs, Asked([np.frombuffer(x, np.uint32) for x in qps])
                rows = []
                for i, n, p in zip(ids, copies, ps, strict=True):
                    for q, off, overlap, errors in index.aligned(np.frombuffer(p, np.uint32), most_errors, least_overlap):
                        if i != qs[q]:
                            rows.append((qs[q], i, off, overlap, errors, errors / (32 * overlap), n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["q", "match_id", "offset", "overlap", "errors", "bit_error_rate", "match_copies"])

    pairs = held.crossJoin(materialize(asked, "asked")).select("q", "qp", "ids", "copies", "prints")
    found = pairs.mapInArrow(compare, "q long, match_id long, offset int, overlap int, errors int, bit_error_rate double, match_copies long")
    # a query's own recording is its first match
    own = classes.where("query is not null").select(F.col("rep").alias("q"), F.col("rep").alias("match_id"), F.lit(0).alias("offset"), (F.length("print") / 4).cast("int").alias("overlap"), F.lit(0).alias("errors"), F.lit(0.0).alias("bit_error_rate"), F.col("copies").alias("match_copies"))
    members = prints.where(F.col("id") % every == 0).join(classes.select("print", F.col("rep").alias("q")), "print").select("q", F.col("id").alias("query_id"))
    return found.unionByName(own).join(members, "q").select("query_id", "match_id", "offset", "overlap", "errors", "bit_error_rate", "match_copies")


def rendered(vectors: DataFrame) -> DataFrame:
    """(id, media) of the embeddings table: each vector as a melody."""

    @F.udf("binary", useArrow=True)
    def wav(v):
        return tones(v)

    return vectors.select(vectors["vec_id"].cast("long").alias("id"), wav(vectors["embedding"]).alias("media"))
