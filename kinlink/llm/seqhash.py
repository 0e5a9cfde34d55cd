"""Vectorised hashing of byte and word sequences, and the exchange that finds which hashes repeat.

Texts are handled as UTF-8 bytes in chunks of a few MB; a prefix hash over the chunk gives the hash of any
window in constant time, so no Python loop runs per byte or per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.worker import lean
from kinlink.plans.scratch import input_bytes

#: Stands for a null id; it sorts before every other id.
NO_ID = -(2**63)
CHUNK = 1 << 20
BLOB = "bucket long, docs binary, counts binary, keys binary"
#: A group sends to so many others at most; more buckets than that are reached over several exchanges.
RADIX = 1024
#: Words of more bytes are hashed by blake2b: polynomials modulo 2^64 are equal for some pairs of very long words.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roll:
    """Polynomial prefix hashes modulo 2^64 with a random value per symbol."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        # with the last eight bits all different, texts of under 1024 bytes have no equal hashes by structure (Thue-Morse words have, if longer)
        self.table = rng.integers(0, 2**56, 256, dtype=np.uint64) << np.uint64(8) | rng.permutation(256).astype(np.uint64)
        self.base = int(rng.integers(2**60, 2**61)) * 8 + 5
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        pw = np.full(n, self.base % 2**64, np.uint64)
        inv = np.full(n, pow(self.base, -1, 2**64), np.uint64)
        pw[0] = inv[0] = 1
        self.pw, self.inv = np.multiply.accumulate(pw), np.multiply.accumulate(inv)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: uint8 (mapped by the table) or uint64 (taken as they are)."""
        n = len(symbols)
        if n + 1 > len(self.pw):
            self.grow(n + 2 + (n >> 3))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((self.table[symbols] if symbols.dtype == np.uint8 else symbols) * self.pw[:n], out=out[1:])
        return out

    def window(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rolls: dict[int, Roll] = {}


def roll(seed: int) -> Roll:
    if seed not in _rolls:
        _rolls[seed] = Roll(seed)
    return _rolls[seed]


class Chunk:
    """Some whole documents: ids, one buffer with a line feed after each text, and where each text begins."""

    def __init__(self, ids: list[int], texts: list[bytes], extra: list | None = None):
        self.ids, self.extra = np.array(ids, np.int64), extra
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.texts = texts

    def words(self, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, first byte, end byte, and where each document's words begin (one more entry at the end)."""
        buf = _LOWER[self.buf] if lower else self.buf
        edge = np.diff(np.concatenate([[False], ~_SPACE[buf], [False]]).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        r = roll(11)
        h = r.window(r.prefix(buf), first, end)
        for i in np.flatnonzero(end - first > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(buf[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h, first, end, np.append(np.searchsorted(first, self.start), len(first))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, own: tuple | None = None) -> Iterator[Chunk]:
    """Columns doc_id, text and perhaps one more. Null text counts as empty, a null id as NO_ID. own: what the task
    keeps in its worker."""
    lean(own)
    ids, texts, extra, size = [], [], [], 0
    for batch in batches:
        more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), more, strict=True):
            t = t or b""
            ids.append(NO_ID if i is None else i)
            texts.append(t)
            extra.append(x)
            size += len(t)
            if size >= limit:
                yield Chunk(ids, texts, extra)
                ids, texts, extra, size = [], [], [], 0
    if ids:
        yield Chunk(ids, texts, extra)


def bucket_count(docs: DataFrame) -> int:
    """Buckets follow the bytes of the input alone, not its partitions, and have no upper limit. Where the optimizer knows no size, the
    texts are measured."""
    size = input_bytes(docs)
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 16 + 2 * (size // (8 << 20))


def hops(n: int) -> list[int]:
    """How many buckets stand together at each exchange but the last, from the coarsest on: none for up to RADIX buckets."""
    sizes = [RADIX]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * RADIX)
    return sizes[-2::-1]


def label(to: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Where entries for the buckets `to` wait: with others of their `size` buckets, spread by the salt. A group of an exchange
    sends RADIX blobs at most, so rows follow the buckets and not their square."""
    return to // size * size + salt % size


def folded(keys: np.ndarray, n: int) -> np.ndarray:
    return keys % np.uint64(n << 32)


def starts(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the width begin that lie in one document: place in the chunk, document number."""
    counts = np.maximum(0, high - low - width + 1)
    number = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[number], number


def _pack(bucket: int, docs: np.ndarray, keys: np.ndarray) -> tuple:
    """Entries that stand together by document."""
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    counts = np.diff(np.append(cut, len(docs)))
    return bucket, docs[cut].tobytes(), counts.astype(np.uint32).tobytes(), keys.tobytes()


def _runs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key then document: keys, documents, where each key begins, and its number of entries."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k, d, head, np.diff(np.append(head, len(k)))


def _repeated(k, d, head, size, earlier: bool) -> np.ndarray:
    """earlier: entries whose key also has a smaller document; else: entries whose key has another entry."""
    return d > np.repeat(d[head], size) if earlier else np.repeat(size > 1, size)


def _ranked(k, d, head, size) -> np.ndarray:
    return k | (d > np.repeat(d[head], size)).astype(np.uint64)


COLUMNS = ["bucket", "docs", "counts", "keys"]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=COLUMNS)


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of blobs."""
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    d = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    return k, np.repeat(d, c)


def _dealt(to: np.ndarray, k: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
    """One blob for each bucket, its entries by document, then key."""
    order = np.lexsort((k, d, to))
    k, d, to = k[order], d[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(to)][: len(cut)], strict=True):
        yield _pack(int(to[i]), d[i:j], k[i:j])


def home(d: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document's answers."""
    return (mix(d.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def shared_keys(docs: DataFrame, extract: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], *, earlier: bool, sizes: Callable | None = None, buckets: int | None = None, narrow: bool = False, ranked: bool = False, counted: bool = False, bucket_of: Callable | None = None, grouped: Callable = _runs, flush: int = 1 << 20) -> DataFrame:
    """(doc_id, n, keys): for each document, the sorted hashes of its own that occur elsewhere too, as one blob.

    extract gives (hash, document number in the chunk). earlier: only hashes that a document with a
    smaller id has; else: hashes with two entries anywhere. Documents without any are left out, unless
    sizes(chunk) is given: then each document has a row, and n is its size, summed over the rows of an id.

    What repeats within a chunk is settled there, and one entry per hash leaves it: a hash that a third
    of all documents share sends as many entries as there are chunks, so no bucket grows with a hot
    key. Buckets follow the input's size; each is sorted in memory on its own. More than RADIX buckets are reached over
    several exchanges, each of which sends on RADIX blobs from a group, so rows never grow with the square of the buckets.
    narrow: hashes are folded() to 32 bits within their bucket, for filters, where a few false repeats do no harm. ranked:
    keys are even, and come back odd where a smaller document has them. counted: the last five bits of keys are zero, and come back as
    the bits of the number of documents that have the key; extract gives a document's distinct keys, and nothing is settled before.
    bucket_of(keys, n): the buckets of keys, the key modulo n otherwise. grouped(keys, documents): how a bucket finds equal keys.
    """
    n = buckets or bucket_count(docs)
    coarse = hops(n)
    thin = narrow and not coarse
    bucket_of = bucket_of or (lambda k, n: (k % np.uint64(n)).astype(np.int64))

    def route(keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        k, d, head, size = _runs(folded(keys, n) if narrow else keys, ids)
        again = _repeated(k, d, head, size, earlier)
        if again.any():
            own, of = (_ranked(k, d, head, size) if ranked else k)[again], d[again]
            order = np.lexsort((own, of))
            yield _pack(-1 - int(own[0] % np.uint64(n)), of[order], own[order])
        k, d = k[head], d[head]
        to = bucket_of(k, n)
        for b, own, c, blob in _dealt(label(to, coarse[0], int(k[0] >> np.uint64(1))) if coarse else to, k, d):
            yield b, own, c, (np.frombuffer(blob, np.uint64) // np.uint64(n)).astype(np.uint32).tobytes() if thin else blob

    def send(batches):
        held, count = [], 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], COLUMNS)

        for c in chunks(batches, 0 if counted else CHUNK):
            keys, number = extract(c)
            if sizes is not None and len(c.ids):
                yield out([(-1 - n - int(c.ids[0] % n), c.ids.tobytes(), sizes(c).astype(np.uint32).tobytes(), b"")])
            held.append((keys, c.ids[number]))
            count += len(keys)
            if count >= (1 if counted else flush):
                yield out(list(route(*map(np.concatenate, zip(*held, strict=True)))))
                held, count = [], 0
        if count:
            yield out(list(route(*map(np.concatenate, zip(*held, strict=True)))))

    def nearer(size: int, bucket: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """An exchange on the way: entries go on to the labels of the next size, or to their buckets."""

        def run(key, table):
            lean()
            at = key[0].as_py()
            if at < 0:
                return table.select(COLUMNS)
            sized = np.array([x is None for x in table.column("keys").to_pylist()], bool)
            k, d = _read(table.filter(pa.array(~sized))) if not sized.all() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            to = bucket(k, d)
            rows = list(_dealt(label(to, size, at) if size > 1 else to, k, d))
            for x in table.filter(pa.array(sized)).to_pylist():
                d, c = np.frombuffer(x["docs"], np.int64), np.frombuffer(x["counts"], np.uint32)
                to = home(d, n)
                to = label(to, size, at) if size > 1 else to
                rows += [(int(b), d[to == b].tobytes(), c[to == b].tobytes(), None) for b in np.unique(to)]
            return _table(rows)

        return run

    def by_document(k, d, at):
        """Blobs again, dealt out by document."""
        to = home(d, n)
        return list(_dealt(label(to, coarse[0], at) if coarse else to, k, d))

    def settle(key, table):
        lean()
        bucket = key[0].as_py()
        if bucket < -n:
            d = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
            c = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
            to = home(d, n)
            to = label(to, coarse[0], -bucket) if coarse else to
            order = np.argsort(to, kind="stable")
            d, c, to = d[order], c[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            return _table([(int(to[i]), d[i:j].tobytes(), c[i:j].tobytes(), None) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(to)][: len(cut)], strict=True)])
        if bucket >= 0 and thin:
            wide = [(np.frombuffer(x, np.uint32).astype(np.uint64) * np.uint64(n) + np.uint64(bucket)).tobytes() for x in table.column("keys").to_pylist()]
            table = table.set_column(table.column_names.index("keys"), "keys", pa.array(wide, pa.binary()))
        k, d = _read(table)
        if bucket >= 0:
            k, d, head, size = grouped(k, d)
            again = _repeated(k, d, head, size, earlier)
            if counted:
                k = k | np.repeat(np.minimum(31, np.floor(np.log2(size)) if len(size) else size).astype(np.uint64), size)
            k, d = (_ranked(k, d, head, size) if ranked else k)[again], d[again]
        return _table(by_document(k, d, abs(bucket)))

    def unpack(key, table):
        lean()
        parts = [(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32), r["keys"]) for r in table.select(COLUMNS[1:]).to_pylist()]
        total: dict[int, int] = {}
        for d, c, k in parts:
            if k is None:
                for i, x in zip(d.tolist(), c.tolist(), strict=True):
                    total[i] = total.get(i, 0) + x
        found: dict[int, bytes] = {}
        if any(k is not None for _, _, k in parts):
            d = np.concatenate([np.repeat(d, c) for d, c, k in parts if k is not None])
            k = np.concatenate([np.frombuffer(k, np.uint64) for _, _, k in parts if k is not None])
            order = np.lexsort((k, d))
            k, d = k[order], d[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            k, d = k[new], d[new]
            cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            found = {int(i): x.tobytes() for i, x in zip(d[cut], np.split(k, cut[1:]), strict=True)}
        ids = sorted(total.keys() | found.keys())
        return pa.table([pa.array(ids, pa.int64()), pa.array([total.get(i) for i in ids], pa.int64()), pa.array([found.get(i) for i in ids], pa.binary())], names=["doc_id", "n", "keys"])

    at = docs.mapInArrow(send, BLOB)
    for size in [*coarse[1:], 1][: len(coarse)]:
        at = at.groupBy("bucket").applyInArrow(nearer(size, lambda k, d: bucket_of(k, n)), BLOB)
    at = at.groupBy("bucket").applyInArrow(settle, BLOB)
    for size in [*coarse[1:], 1][: len(coarse)]:
        at = at.groupBy("bucket").applyInArrow(nearer(size, lambda k, d: home(d, n)), BLOB)
    return at.groupBy("bucket").applyInArrow(unpack, "doc_id long, n long, keys binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, with NO_ID for a null id: other columns may have any names."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), docs["text"].cast("string").alias("text"))


def unkeyed() -> F.Column:
    return F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")


def unblob(keys: bytes | None) -> np.ndarray:
    return np.frombuffer(keys or b"", np.uint64)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D): Singer's perfect difference set for a prime q. Of any two residues modulo v = q^2+q+1, some one
    shift below v brings both into D, which has q+1 members: the powers of a generator of GF(q^3) that lie in a plane."""
    v = q * q + q + 1
    for code in range(1, q**3):
        c0, c1, c2 = code % q, code // q % q, code // q // q
        x, seen, plane = (1, 0, 0), set(), []
        for i in range(v):
            if x[2] == 0:
                plane.append(i)
            lead = next(t for t in reversed(x) if t)
            point = tuple(t * pow(lead, -1, q) % q for t in x)
            if point in seen:
                break
            seen.add(point)
            x = (-c0 * x[2] % q, (x[0] - c1 * x[2]) % q, (x[1] - c2 * x[2]) % q)
            if not any(x):
                break
        if len(seen) == v and len(plane) == q + 1:
            d = np.array(plane)
            if len(np.unique((d[:, None] - d[None, :]) % v)) == v:
                return v, d
    raise ValueError(q)
