"""Operator 7: a log-bilinear language model trained by noise-contrastive estimation, beside an add-one unigram base."""

import math
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.seqhash import BLOB, NO_ID, Chunk, bucket_count, chunks, keyed, mix, unkeyed
from kinlink.llm.toxicity import held_out
from kinlink.plans.scratch import drop, input_bytes, materialize

UNKNOWN, END = 0, 1


def _held(doc: int) -> bool:
    return doc != NO_ID and zlib.crc32(str(doc).encode()) % 7 == 2


class LogBilinear:
    """P(w | h) = P(class of w | h) P(w | its class, h), both log-bilinear in z = sum_i C_i r_{h_i}; word w has class isqrt(w), so class k
    holds the 2k + 1 words from k^2 on and a probability takes about three square roots of the vocabulary of dot products.

    All parameters are rows of one matrix, so that training can run on many parts of the corpus and average by row: context vectors r,
    word vectors q and class vectors with their bias last, and the matrices C_i by rows."""

    def __init__(self, words: int, dim: int = 16, context: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.n, self.dim, self.context = words, dim, context
        self.klass = np.array([math.isqrt(w) for w in range(words)], np.int64)
        self.classes = int(self.klass[-1]) + 1
        self.first = np.arange(self.classes + 1) ** 2
        self.first[-1] = words
        p = np.zeros((2 * words + self.classes + context * dim, dim + 1), np.float32)
        p[: -context * dim, :dim] = rng.normal(0, 0.1, (len(p) - context * dim, dim))
        for i in range(context):
            p[len(p) - (context - i) * dim :][:dim, :dim] = np.eye(dim)
        self.use(p)

    def use(self, p: np.ndarray) -> "LogBilinear":
        n, d = self.n, self.dim
        self.p = p
        self.room = None
        self.r, self.q, self.b = p[:n, :d], p[n : 2 * n, :d], p[n : 2 * n, d]
        self.qc, self.bc = p[2 * n : 2 * n + self.classes, :d], p[2 * n : 2 * n + self.classes, d]
        self.c = [p[2 * n + self.classes + i * d :][:d, :d] for i in range(self.context)]
        return self

    def unigram(self, counts: np.ndarray) -> "LogBilinear":
        """The corpus counts of the words: noise classes follow them, and biases start there, so an untrained model is the unigram."""
        u = counts + 0.5
        u /= u.sum()
        self.uc = np.bincount(self.klass, u)
        self.log_u, self.log_uc = np.log(u / self.uc[self.klass]).astype(np.float32), np.log(self.uc).astype(np.float32)
        return self

    def start(self) -> "LogBilinear":
        self.b[:], self.bc[:] = self.log_u, self.log_uc
        return self

    def hidden(self, h: np.ndarray) -> np.ndarray:
        # whole rows are taken, with the bias that contexts have no use for: rows of a narrower view are copied number by number
        return sum(self.p.take(h[:, i], 0)[:, : self.dim] @ self.c[i] for i in range(self.context))

    def step(self, h: np.ndarray, w: np.ndarray, state: np.ndarray, seen: np.ndarray, rng: np.random.Generator, rate: float, noise: int = 3, class_noise: int = 32) -> None:
        """One Adagrad step on contexts h and words w. The true class is told from classes of the unigram, which the batch shares, the true
        word from any words of its class, which are about as frequent. seen counts the rows that contexts and true words use."""
        n, d, m = self.n, self.dim, len(w)
        k, z = self.klass[w], self.hidden(h)
        other = np.minimum(np.searchsorted(np.cumsum(self.uc), rng.random(class_noise)), self.classes - 1)

        def told(s, log_noise):
            np.subtract(log_noise, s, out=s)
            np.clip(s, -30, 30, out=s)
            np.exp(s, out=s)
            s += 1
            return np.divide(1, s, out=s)

        own = (1 - told(np.einsum("bd,bd->b", z, self.qc[k]) + self.bc[k], self.log_uc[k] + np.float32(np.log(class_noise)))) / m
        rest = -told(z @ self.qc[other].T + self.bc[other], self.log_uc[other] + np.float32(np.log(class_noise))) / m
        dz = own[:, None] * self.qc[k] + rest @ self.qc[other]
        size = self.first[k + 1] - self.first[k]
        words = np.concatenate([w[:, None], self.first[k, None] + (rng.random((m, noise)) * size[:, None]).astype(np.int64)], 1)
        q = self.p[n : 2 * n].take(words, 0)
        dw = told(np.einsum("bd,bkd->bk", z, q[:, :, :d]) + q[:, :, d], np.log(noise / size).astype(np.float32)[:, None])
        dw /= -m
        dw[:, 0] += 1 / m
        dz += np.einsum("bk,bkd->bd", dw, q[:, :, :d])
        flat, at = words.ravel(), 2 * n + self.classes
        back, context = np.concatenate([c @ dz.T for c in self.c], 1), h.T.ravel()
        # the gradient and the roots of its sums of squares; made anew at each step, their pages would be too
        self.room = self.room or (np.empty_like(self.p), np.empty_like(self.p))
        # the bias is a weight whose input is 1
        one, (grad, root) = np.concatenate([z, np.ones((m, 1), np.float32)], 1), self.room
        for j, x in enumerate(np.ascontiguousarray(one.T)):
            grad[n : 2 * n, j] = np.bincount(flat, (dw * x[:, None]).ravel(), n)
            grad[2 * n : at, j] = np.bincount(k, own * x, self.classes)
            grad[:n, j] = np.bincount(context, back[j], n) if j < d else 0
        np.add.at(grad[2 * n : at], other, rest.T @ one)
        grad[at:, d] = 0
        for i in range(self.context):
            grad[at + i * d :][:d, :d] = self.p.take(h[:, i], 0)[:, :d].T @ dz
        np.multiply(grad, grad, out=root)
        state += root
        np.sqrt(state, out=root)
        grad *= np.float32(rate)
        grad /= root
        self.p += grad
        seen[:n] += np.bincount(h.ravel(), minlength=n)
        seen[n : 2 * n] += np.bincount(w, minlength=n)
        seen[2 * n : at] += np.bincount(k, minlength=self.classes)
        seen[at:] += m

    def log10(self, h: np.ndarray, w: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """log10 P(w | h), normalised: a matrix product over the classes, and one for the words of each class that occurs. Products have
        about `block` entries, so that they stay near the processor."""
        out = np.zeros(len(w))

        def normal(z, q, b, at):
            got = []
            for i in range(0, len(z), max(1, block // len(q))):
                s = z[i : i + max(1, block // len(q))] @ q.T + b
                s -= s.max(1)[:, None]
                top = s[np.arange(len(s)), at[i : i + len(s)]]
                np.exp(s, out=s)
                got.append(top - np.log(s.sum(1)))
            return np.concatenate(got)

        order = np.argsort(self.klass[w].astype(np.min_scalar_type(self.classes)), kind="stable")
        for i in range(0, len(w), 1 << 18):
            o = order[i : i + (1 << 18)]
            z, k = self.hidden(h[o]), self.klass[w[o]]
            got = normal(z, self.qc, self.bc, k).astype(float)
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(k)], strict=True):
                x = slice(self.first[k[a]], self.first[k[a] + 1])
                if x.stop - x.start > 1:
                    got[a:b] += normal(z[a:b], self.q[x], self.b[x], w[o[a:b]] - x.start)
            out[o] = got
        return out / np.log(10)


class Head:
    """Where hashes lie among sorted, different ones. Those that begin with the same bits are few, so that a table by these bits leaves few
    steps, where a binary search reads from all over the list."""

    def __init__(self, head: np.ndarray):
        self.head, self.bits = head, min(20, max(1, len(head)).bit_length() + 2)
        self.begin = np.searchsorted(head >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.begin).max()) if len(head) else 0

    def place(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not there."""
        out = np.full(len(h), -1)
        if not len(self.head):
            return out
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[top].astype(np.int64), self.begin[top + 1]
        on = np.arange(len(h))
        for _ in range(self.steps):
            here = at < end
            on, at, end = on[here], at[here], end[here]
            hit = self.head[at] == h[on]
            out[on[hit]] = at[hit]
            on, at, end = on[~hit], at[~hit] + 1, end[~hit]
        return out


def _stream(c: Chunk, head: Head, number_of: np.ndarray):
    """Word hashes, document of each word, place in head (-1: none), the words' numbers in the model with two ends before and one after
    each text, and where in these the tokens are."""
    h, _, _, bounds = c.words(lower=True)
    place = head.place(h)
    docs = len(c.ids)
    number = np.repeat(np.arange(docs), np.diff(bounds))
    stream = np.full(len(h) + 3 * docs, END)
    spot = np.arange(len(h)) + 3 * number + 2
    stream[spot] = np.where(place >= 0, number_of[place], UNKNOWN) if len(number_of) else UNKNOWN
    begin = bounds[:-1] + 3 * np.arange(docs)
    is_token = np.ones(len(stream), bool)
    is_token[begin] = is_token[begin + 1] = False
    token = np.flatnonzero(is_token)
    return h, number, place, stream, token


def _training(c: Chunk) -> Chunk | None:
    keep = [i for i, d in enumerate(c.ids.tolist()) if not _held(d)]
    return Chunk([int(c.ids[i]) for i in keep], [c.texts[i] for i in keep]) if keep else None


def head_words(docs: DataFrame, size: int, flush: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words of all training documents, most frequent first, and their counts. A task sends a word once for
    every flush distinct words it meets."""

    def count(batches):
        held, new = [], 0

        def merged():
            k, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate([n for _, n in held]), len(k)).astype(np.int64)

        def out(k, n):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "c"])

        for c in filter(None, map(_training, chunks(batches))):
            held.append(np.unique(c.words(lower=True)[0], return_counts=True))
            new += len(held[-1][0])
            # merged when the new ones are as many as the first, merged entry
            if new >= min(flush, max(1 << 18, len(held[0][0]))):
                held, new = [merged()], 0
                if len(held[0][0]) >= flush:
                    yield out(*held.pop())
        if held:
            yield out(*merged())

    # written first: collected at once, each task would send its own most frequent ones to the driver
    top = materialize(docs.mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "k").limit(size), "head")
    got = top.toPandas().sort_values(["c", "k"], ascending=[False, True])
    drop(top)
    return got.k.to_numpy(np.int64).view(np.uint64), got.c.to_numpy(np.int64)


def trained(docs: DataFrame, head: np.ndarray, number_of: np.ndarray, counts: np.ndarray, rounds: tuple = ((8, 0.2), (1, 0.1)), batch: int = 4096, bytes_each: int = 16 << 20) -> LogBilinear:
    """The model after one pass over all training documents for each of `rounds` (every how many-th chunk, rate): tasks train copies on
    their own part, and rows of the parameters are averaged, weighted by how often a part used them. Training thus follows the corpus,
    and the driver sees the averages alone. A first round over every eighth chunk brings the copies of the second near each other. A
    part has bytes_each of the input at least, as each sends a row for every word it holds."""
    model, head = LogBilinear(len(counts)).unigram(counts).start(), Head(head)
    size, columns = input_bytes(docs), [f"x{j}" for j in range(model.dim + 1)]
    if size < 1 << 60:
        docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // bytes_each + 1))
    for every, rate in rounds:
        begin = model.p

        def run(batches, every=every, rate=rate, begin=begin):
            own = LogBilinear(len(counts)).unigram(counts).use(begin.copy())
            state, seen, rng = np.full(own.p.shape, 1e-6, np.float32), np.zeros(len(own.p)), np.random.default_rng(7)
            for c in filter(None, map(_training, islice(chunks(batches), 0, None, every))):
                *_, s, t = _stream(c, head, number_of)
                t = rng.permutation(t)
                for i in range(0, len(t), batch):
                    x = t[i : i + batch]
                    own.step(np.stack([s[x - 2], s[x - 1]], 1), s[x], state, seen, rng, rate)
            on = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(seen[on]), *(pa.array(own.p[on, j] * seen[on]) for j in range(own.dim + 1))], ["k", "weight", *columns])

        parts = docs.mapInArrow(run, "k long, weight double, " + ", ".join(f"{c} double" for c in columns))
        mean = parts.groupBy("k").agg(*(((F.sum(c)) / F.sum("weight")).alias(c) for c in columns)).toPandas()
        p = begin.copy()
        p[mean.k.to_numpy(np.int64)] = mean[columns].to_numpy(np.float32)
        model.use(p)
    return model


def lm_scores(docs: DataFrame, vocabulary: int = 9216, head_size: int = 50_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document; scores are log10 probabilities.

    Tokens are A-Z-lowered words and one end per text, also of null, empty and blank texts. Documents with
    crc32(doc_id) mod 7 = 2 are scored only; a null doc_id trains. Rows that share a doc_id are scored as one document.

    The model has `vocabulary` entries: the most frequent words, the end, and any other word, whose spelling then comes from
    add-one counts among those. Counts of the head (head_size words, a fixed bound) reach every task; other words meet
    their counts in an exchange by hash, which sends back sums per document.
    """
    docs = keyed(docs)
    n_b = bucket_count(docs)
    ranked, ranked_counts = head_words(docs, head_size)
    ends = docs.where((F.col("doc_id") == NO_ID) | ~held_out("doc_id", 7, 2)).count()
    order = np.argsort(ranked)
    own = min(len(ranked), vocabulary - 2)
    head, number_of = ranked[order], np.where(order < own, order + 2, UNKNOWN)
    counts = np.append(ranked_counts[order], ends)
    model = trained(docs, head, number_of, np.concatenate([[ranked_counts[own:].sum()], [ends], ranked_counts[:own]]))
    log_count, modelled, head = np.log10(counts + 1.0), number_of != UNKNOWN, Head(head)

    def send(batches):
        for c in chunks(batches, 2 << 20):
            h, number, place, s, t = _stream(c, head, number_of)
            docs_n = len(c.ids)
            lbl = model.log10(np.stack([s[t - 2], s[t - 1]], 1), s[t])
            # a document's tokens are its words and then its end
            of = np.repeat(np.arange(docs_n), np.bincount(number, minlength=docs_n) + 1)
            known, spelled = place >= 0, (place >= 0) & ~modelled[np.maximum(place, 0)] if len(modelled) else np.zeros(len(h), bool)
            lc = log_count[np.maximum(place, 0)] * known
            total = lambda w, at=number: np.bincount(at, w, docs_n)  # noqa: E731,B023
            end_known = float(counts[-1] > 0)
            fixed = np.stack([np.bincount(number, minlength=docs_n) + 1.0, total((known & (counts[np.maximum(place, 0)] > 0)).astype(float)) + end_known, total((s[np.arange(len(h)) + 3 * number + 2] == UNKNOWN).astype(float)), total(lc) + log_count[-1], total(lc * spelled), np.bincount(of, lbl, docs_n)], 1)
            rows = [(-1 - int(c.ids[0] % n_b), c.ids.tobytes(), b"", fixed.tobytes())]
            k, d = h[~known], number[~known]
            o = np.lexsort((k, d))
            k, d = k[o], d[o]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, int)
            tf = np.diff(np.append(first, len(k)))
            k, d = k[first], d[first]
            sign = np.array([-1 if _held(x) else 1 for x in c.ids.tolist()])
            to = (k % np.uint64(n_b)).astype(np.int64)
            o = np.argsort(to, kind="stable")
            k, d, tf, to = k[o], d[o], (tf * sign[d])[o], to[o]
            at = np.searchsorted(to, np.arange(n_b + 1))
            for b in np.unique(to):
                x = slice(at[b], at[b + 1])
                cut = np.flatnonzero(np.concatenate([[True], d[x][1:] != d[x][:-1]]))
                rows.append((int(b), c.ids[d[x][cut]].tobytes(), np.diff(np.append(cut, len(d[x]))).astype(np.uint32).tobytes(), k[x].tobytes() + tf[x].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ty) for i, ty in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "docs", "counts", "keys"])

    def blobs(rows):
        return pa.table([pa.array([r[i] for r in rows], ty) for i, ty in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "docs", "counts", "keys"])

    def deal(d: np.ndarray, x: np.ndarray) -> list:
        to = (mix(d.view(np.uint64)) % np.uint64(n_b)).astype(np.int64)
        o = np.argsort(to, kind="stable")
        d, x, to = d[o], x[o], to[o]
        at = np.searchsorted(to, np.arange(n_b + 1))
        return [(int(b), d[at[b] : at[b + 1]].tobytes(), b"", np.ascontiguousarray(x[at[b] : at[b + 1]]).tobytes()) for b in np.unique(to)]

    def settle(key, table):
        parts = table.select(["docs", "counts", "keys"]).to_pylist()
        d = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in parts])
        if key[0].as_py() < 0:
            return blobs(deal(d, np.concatenate([np.frombuffer(r["keys"], float).reshape(-1, 6) for r in parts])))
        sizes = [np.frombuffer(r["counts"], np.uint32) for r in parts]
        k = np.concatenate([np.frombuffer(r["keys"], np.uint64, int(s.sum())) for r, s in zip(parts, sizes, strict=True)])
        tf = np.concatenate([np.frombuffer(r["keys"], np.int32, int(s.sum()), 8 * int(s.sum())) for r, s in zip(parts, sizes, strict=True)])
        d = np.repeat(d, np.concatenate(sizes))
        _, inverse = np.unique(k, return_inverse=True)
        c = np.bincount(inverse, np.maximum(tf, 0)).astype(np.int64)
        ids, number = np.unique(d, return_inverse=True)
        got, tf = c[inverse], np.abs(tf)
        x = np.zeros((len(ids), 6))
        x[:, 1] = np.bincount(number, tf * (got > 0))
        x[:, 3] = x[:, 4] = np.bincount(number, tf * np.log10(got + 1.0))
        # the bucket's own numbers: tokens and distinct words in training
        return blobs([*deal(ids, x), (-1, b"", b"", np.array([c.sum(), np.count_nonzero(c)], np.int64).tobytes())])

    def gather(key, table):
        parts = table.select(["docs", "keys"]).to_pylist()
        if key[0].as_py() < 0:
            x = sum(np.frombuffer(r["keys"], np.int64) for r in parts)
            return pa.table([pa.array([0], pa.int64()), pa.array([True]), pa.array([[float(v) for v in x]], pa.list_(pa.float64()))], names=["doc_id", "whole", "x"])
        ids, number = np.unique(np.concatenate([np.frombuffer(r["docs"], np.int64) for r in parts]), return_inverse=True)
        x = np.concatenate([np.frombuffer(r["keys"], float).reshape(-1, 6) for r in parts])
        out = np.stack([np.bincount(number, x[:, j]) for j in range(6)], 1)
        return pa.table([pa.array(ids), pa.array([False] * len(ids)), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["doc_id", "whole", "x"])

    settled = docs.mapInArrow(send, BLOB).groupBy("bucket").applyInArrow(settle, BLOB).groupBy("bucket").applyInArrow(gather, "doc_id long, whole boolean, x array<double>")
    sums = materialize(settled, "lm")
    tail = sums.where("whole").agg(F.sum(F.col("x")[0]), F.sum(F.col("x")[1])).first()
    n = int(counts.sum()) + int(tail[0] or 0)
    v = int(np.count_nonzero(counts)) + int(tail[1] or 0)
    named = np.append(modelled, True)
    n_u, v_u = n - int(counts[named].sum()), v - int(np.count_nonzero(counts[named]))
    x = F.col("x")
    return sums.where("not whole").select(
        unkeyed(),
        F.when(F.col("doc_id") != NO_ID, held_out("doc_id", 7, 2)).otherwise(False).alias("held_out"),
        x[0].cast("long").alias("n_tokens"),
        x[1].cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (x[3] - x[0] * float(np.log10(n + v + 1))).alias("base_score"),
        (x[5] + x[4] - x[2] * float(np.log10(n_u + v_u + 1))).alias("score"),
    )
