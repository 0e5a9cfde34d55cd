"""Operator 2: exact n-gram Jaccard join with prefix trees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.seqhash import Chunk, bucket_count, mix, roll, shared_keys, unblob
from kinlink.llm.worker import lean
from kinlink.operators.graph import connected_components
from kinlink.plans.scratch import drop, materialize, release


def shingles(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and document numbers; fewer words than a shingle make one shingle of them all."""
    h, _, _, bounds = c.words(lower=True)
    m = np.diff(bounds)
    counts = np.where(m == 0, 0, np.maximum(1, m - words + 1))
    number = np.repeat(np.arange(len(m)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][number]
    width = np.minimum(words, m)[number]
    r = roll(41)
    keys = mix(r.window(r.prefix(h), at, at + width) + width.astype(np.uint64))
    order = np.lexsort((keys, number))
    keys, number = keys[order], number[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])]) if len(keys) else np.zeros(0, bool)
    return keys[new], number[new]


class Trie:
    """A radix tree over sorted hash sequences. An edge holds the hashes up to the next branch, so sets that
    begin alike share them; a search walks it once for all of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes, m = sets, sizes, len(sets)
        order = sorted(range(m), key=lambda i: sets[i].astype(">u8").tobytes())
        self.edge: list[tuple[int, int, int]] = [(0, 0, 0)]  # set, from, to
        self.up, self.kids, self.ends = [-1], [[]], [[]]
        path = [0]
        for j, i in enumerate(order):
            common = 0
            if j:
                a, b = sets[order[j - 1]], sets[i]
                k = min(len(a), len(b))
                differ = np.flatnonzero(a[:k] != b[:k])
                common = int(differ[0]) if len(differ) else k
            last = -1
            while self.edge[path[-1]][1] >= common and path[-1] != 0:
                last = path.pop()
            top = path[-1]
            if self.edge[top][2] > common:  # the edge to top is split
                s, lo, hi = self.edge[top]
                node = self._new(s, lo, common, self.up[top])
                self.kids[self.up[top]].remove(top)
                self.edge[top], self.up[top] = (s, common, hi), node
                self.kids[node].append(top)
                path[-1] = top = node
            del last
            if len(sets[i]) > self.edge[top][2]:
                top = self._new(i, self.edge[top][2], len(sets[i]), top)
                path.append(top)
            self.ends[top].append(i)
        self.short, self.long, self.rest = [np.zeros(len(self.edge), np.int64) for _ in range(3)]
        self.short[:] = np.iinfo(np.int64).max
        self.home = np.zeros(m, np.int64)
        for v, own in enumerate(self.ends):
            for i in own:
                self.home[i] = v
                n, u = int(sizes[i]), v
                while u >= 0:
                    self.short[u], self.long[u] = min(self.short[u], n), max(self.long[u], n)
                    self.rest[u] = max(self.rest[u], len(sets[i]) - self.edge[u][2])
                    u = self.up[u]

    def _new(self, s: int, lo: int, hi: int, up: int) -> int:
        self.edge.append((s, lo, hi))
        self.up.append(up)
        self.kids.append([])
        self.ends.append([])
        self.kids[up].append(len(self.edge) - 1)
        return len(self.edge) - 1

    def linked(self, x: np.ndarray, n: int, percent: int, near: np.ndarray | None = None) -> list[int]:
        """Sets of the tree with 100 * intersection >= percent * union with x; n is the size of x. near: only these are asked for, so
        only the nodes above them are visited."""
        wanted, marked = None, None
        if near is not None:
            wanted, marked = set(near.tolist()), set()
            for v in np.unique(self.home[near]).tolist():
                while v >= 0 and v not in marked:
                    marked.add(v)
                    v = self.up[v]
        found, stack = [], [(0, 0)]
        while stack:
            v, had = stack.pop()
            s, lo, hi = self.edge[v]
            left = len(x)
            if hi > lo:
                own = self.sets[s][lo:hi]
                at = np.searchsorted(x, own)
                had += int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == own))
                left = len(x) - int(np.searchsorted(x, own[-1], "right"))
            # the smallest partner asks for the least overlap; no more than what is left on either side can come
            if (100 + percent) * (had + min(left, int(self.rest[v]))) < percent * (n + int(self.short[v])) or 100 * n < percent * int(self.short[v]) or 100 * int(self.long[v]) < percent * n:
                continue
            found += [i for i in self.ends[v] if (wanted is None or i in wanted) and (100 + percent) * had >= percent * (n + int(self.sizes[i]))]
            stack += [(k, had) for k in self.kids[v] if marked is None or k in marked]
        return found


def prefix_length(n: int, held: int, percent: int) -> int:
    """How many of a set's `held` repeated hashes, taken in the global order behind its n - held unshared ones, a partner must meet one of."""
    return max(0, n + (-percent * n // 100) + 1 - (n - held))


def links(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span each component of the similarity graph of these sets; what is reached is asked for no more.

    Within the cell hashes are ordered again, the rarest first. Sets that share a prefix hash with x are its candidates, and the
    tree, which all sets of the cell share, is walked above them.
    """
    flat = np.concatenate(sets)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.uint32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
    sets = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(x) for x in sets])[:-1])]
    del flat, inverse, count, rank
    heads = [x[: prefix_length(int(n), len(x), percent)] for x, n in zip(sets, sizes, strict=True)]
    token, owner = np.concatenate(heads), np.repeat(np.arange(len(sets), dtype=np.int32), [len(h) for h in heads])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    alive, left, listed = np.ones(len(sets), bool), len(sets), len(sets)
    tree, out = Trie(sets, sizes), []

    def partners(x: int) -> list[int]:
        nonlocal token, owner, listed
        if 2 * left < listed:  # the lists forget what has been reached
            stay = alive[owner]
            token, owner, listed = token[stay], owner[stay], left
        low, high = np.searchsorted(token, heads[x]), np.searchsorted(token, heads[x], "right")
        near = [owner[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True) if j > i]
        if not near:
            return []
        near = np.unique(np.concatenate(near))
        n = int(sizes[x])
        near = near[alive[near] & (100 * sizes[near] >= percent * n) & (100 * n >= percent * sizes[near])]
        return tree.linked(sets[x], n, percent, near) if len(near) else []

    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            x = queue.pop()
            for y in partners(x):
                out.append((x, y))
                alive[y] = False
                left -= 1
                queue.append(y)
    return out


def _search(percent: int) -> Callable:
    """Spanning links of one cell: of each group in it (column cc) by itself. A set may come twice."""

    def run(table):
        lean()
        src, dst = [], []
        order = np.argsort(table.column("cc").to_numpy(), kind="stable")
        cc, ids = table.column("cc").to_numpy()[order], table.column("doc_id").to_numpy()[order]
        n, keys = table.column("n").to_numpy()[order], table.column("keys").take(pa.array(order))
        cut = np.flatnonzero(np.concatenate([[True], cc[1:] != cc[:-1]]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(cc)][: len(cut)], strict=True):
            own = i + np.unique(ids[i:j], return_index=True)[1]
            if len(own) > 1:
                found = links([np.frombuffer(keys[k].as_buffer(), np.uint64) for k in own.tolist()], n[own], percent)
                src += [ids[own[a]] for a, _ in found]
                dst += [ids[own[b]] for _, b in found]
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def spanning_links(sets: DataFrame, percent: int, cell_bytes: int = 4 << 20, pivots: int = 64) -> DataFrame:
    """(src, dst): links that span the components within each group cc of sets(cc, doc_id, n, keys), written.

    Cells hold about cell_bytes of keys. Small groups share cells. A larger group is cut into blocks, and some `pivots` of its
    sets join every block; links found there tie most of a group of near copies together. What is not in the group's
    largest component then, is compared with every block, in blocks of its own: all pairs that could still add a
    link meet, and the work is in proportion to the group unless it falls apart into many components.
    """
    size = F.length("keys") + 64
    groups = sets.groupBy("cc").agg(F.count("*").alias("members"), F.sum(size).alias("bytes"))
    groups = materialize(groups.where("members > 1").withColumn("blocks", F.ceil(F.col("bytes") / cell_bytes).cast("long")), "groups")
    small = int(groups.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0) // cell_bytes + 16
    put = ["cell", "part", "rest", "cc", "doc_id", "n", "keys"]
    known = sets.join(groups, "cc")
    easy = known.where("blocks = 1").withColumn("cell", F.pmod(F.xxhash64("cc"), F.lit(small))).withColumn("part", F.lit(-1)).withColumn("rest", F.lit(-1))
    found = materialize(easy.select(put).groupBy("cell", "part", "rest").applyInArrow(_search(percent), "src long, dst long"), "links")
    if groups.where("blocks > 1").limit(1).count() == 0:
        return found
    large = materialize(known.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))), "large")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pivot = large.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("members") / pivots)) == 0)
    cells = large.withColumn("part", F.col("block")).unionByName(pivot.withColumn("part", every)).withColumn("cell", F.col("cc")).withColumn("rest", F.lit(-1))
    first = materialize(cells.select(put).groupBy("cell", "part", "rest").applyInArrow(_search(percent), "src long, dst long"), "links")
    tied = connected_components(first).select(F.col("node").alias("doc_id"), F.col("component").alias("tie"))
    tied = materialize(large.select("cc", "doc_id", "blocks", size.alias("bytes")).join(tied, "doc_id", "left").withColumn("tie", F.coalesce("tie", "doc_id")), "tied")
    ties = tied.groupBy("cc", "tie").agg(F.sum("bytes").alias("bytes"))
    main = ties.groupBy("cc").agg(F.max_by("tie", F.struct("bytes", "tie")).alias("tie"))
    loose = tied.join(main, ["cc", "tie"], "left_anti")
    shares = loose.groupBy("cc").agg(F.ceil(F.sum("bytes") / cell_bytes).cast("long").alias("shares"))
    loose = materialize(large.join(loose.select("doc_id"), "doc_id", "left_semi").join(shares, "cc").withColumn("rest", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("shares"))), "loose")
    meet = large.join(shares, "cc").withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).withColumn("part", F.col("block"))
    cells = meet.select("cc", "part", "rest", "doc_id", "n", "keys").unionByName(loose.withColumn("part", every).select("cc", "part", "rest", "doc_id", "n", "keys")).withColumn("cell", F.col("cc"))
    last = materialize(cells.select(put).groupBy("cell", "part", "rest").applyInArrow(_search(percent), "src long, dst long"), "links")
    out = materialize(found.unionByName(first).unionByName(last), "links")
    drop(found, first, last, large, tied, loose)
    return out


def ordered(sets: DataFrame, percent: int, pack_bytes: int = 1 << 20, spread: int = 64) -> DataFrame:
    """(doc_id, n, keys): sets(doc_id, n, keys) without the hashes that no other set here has, and the rest in the global order as numbers
    that ascend: by the bits of the count of sets that have the hash, then by the hash. Sets of which less than percent is left are done.
    Sets are dealt into packs; an exchange counts the packs that have a hash, and hashes of one pack alone are counted there.
    """
    total = sets.agg(F.sum(F.length("keys"))).first()[0] or 0
    packs = spread + total // pack_bytes

    def pack(key, table):
        lean()
        keys = [x.as_buffer().to_pybytes() for x in table.column("keys")]
        ids, n = table.column("doc_id").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.stack([ids, n, [len(x) // 8 for x in keys]]).astype(np.int64).tobytes()]), pa.array([b"".join(keys)])], names=["doc_id", "meta", "text"])

    packed = materialize(sets.withColumn("pack", F.pmod(F.xxhash64("doc_id"), F.lit(packs))).groupBy("pack").applyInArrow(pack, "doc_id long, meta binary, text binary"), "packs")

    def extract(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        k = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in c.texts]) & ~np.uint64(31))
        return k, np.zeros(len(k), np.int64)

    counted = shared_keys(packed.select("doc_id", "text"), extract, earlier=False, buckets=16 + total // (8 << 20), counted=True).select("doc_id", "keys")

    def unpack(batches):
        lean()
        for b in batches:
            ids, sizes, out = [], [], []
            for meta, text, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc, n, m = np.frombuffer(meta, np.int64).reshape(3, -1)
                k = np.frombuffer(text, np.uint64) & ~np.uint64(31)
                u, inverse, own = np.unique(k, return_inverse=True, return_counts=True)
                bits = np.floor(np.log2(own)).astype(np.uint64)
                known = unblob(known)
                at = np.searchsorted(u, known & ~np.uint64(31))
                bits[at] = known & np.uint64(31)
                shared = own > 1
                shared[at] = True
                code = (bits << np.uint64(59) | u >> np.uint64(5))[inverse]
                for i, (x, keep) in enumerate(zip(np.split(code, np.cumsum(m)[:-1]), np.split(shared[inverse], np.cumsum(m)[:-1]), strict=True)):
                    x = np.unique(x[keep])
                    if 100 * len(x) >= percent * n[i]:
                        ids.append(doc[i])
                        sizes.append(n[i])
                        out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "keys"])

    return packed.join(counted.withColumnRenamed("keys", "known"), "doc_id", "left").select("meta", "text", "known").mapInArrow(unpack, "doc_id long, n long, keys binary")


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a key of their own for all rows. Where ids are missing or repeated, rows are numbered in a written table,
    and the second frame has (doc_id, id) of each row."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    if not plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return plain, None
    plain = materialize(plain.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("doc_id")), "rows")
    return plain.select("doc_id", "text"), plain.select("doc_id", "id")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, shingle: Callable = shingles, cell_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text).

    Words are lower-cased (A-Z) runs of non-blank characters; documents link when 100 * intersection >=
    percent * union of their shingle sets. Null, empty and blank texts have no shingles and link with nothing.
    component_id is the smallest doc_id that links reach; rows that share a doc_id, or have none, are documents of their own,
    and a null doc_id is the smallest only among nulls. Shingles are told apart by 64-bit hashes.

    1. Which shingles occur in one document only is settled by an exchange of hashes; a set with too many of them is done.
    2. Equal sets fold into one, and the global order is made: shingles that no other set has first, then the rarest (ordered).
    3. Sets that share a shingle of both prefixes fall into one group; each group's sets meet in prefix trees
       (spanning_links), in cells of bounded bytes.
    """
    docs, names = _rows(docs)

    def size(c: Chunk) -> np.ndarray:
        return np.bincount(shingle(c, words)[1], minlength=len(c.ids))

    exchanged = shared_keys(docs, lambda c: shingle(c, words), earlier=False, sizes=size, buckets=bucket_count(docs))
    # a set whose repeated shingles are too few for any partner keeps no more than its size
    able = F.col("keys").isNotNull() & (100 * F.length("keys") / 8 >= percent * F.col("n"))
    whole = materialize(exchanged.select("doc_id", "n", F.when(able, F.col("keys")).alias("keys")), "sets")
    del exchanged
    release(whole)
    # a set that holds unshared shingles is equal to no other
    own = F.when(F.length("keys") < 8 * F.col("n"), F.col("doc_id"))
    sets = whole.where("keys is not null").withColumn("print", F.struct("n", F.md5("keys"), own))
    same = sets.groupBy("print").agg(F.min("doc_id").alias("rep"))
    member = materialize(sets.select("doc_id", "print").join(same, "print").select("doc_id", "rep"), "same")
    reps = whole.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "keys")
    reps = materialize(ordered(materialize(reps, "reps"), percent), "ordered")
    release(reps)

    def prefixes(batches):
        lean()
        for b in batches:
            ids, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, n, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = unblob(keys)
                k = k[: max(0, prefix_length(n, len(k), percent))]
                ids.append(np.full(len(k), doc, np.int64))
                heads.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, heads)], ["doc_id", "token"])

    heads = reps.mapInArrow(prefixes, "doc_id long, token long")
    least = heads.groupBy("token").agg(F.min("doc_id").alias("low"), F.count("*").alias("m")).where("m > 1").drop("m")
    near = materialize(heads.join(least, "token").where("doc_id <> low").select(F.col("doc_id").alias("src"), F.col("low").alias("dst")).distinct(), "near")
    del heads, least
    groups = connected_components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("cc"))
    edges = spanning_links(reps.join(groups, "doc_id"), percent, cell_bytes)
    drop(near, reps)
    joined = connected_components(edges).select(F.col("node").alias("rep"), F.col("component"))
    classes = materialize(member.join(joined, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")), "classes")
    drop(edges, member)
    out = whole.select("doc_id", "n").join(classes, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if names is None:
        return out
    out = out.join(names, "doc_id")
    least = out.groupBy("component_id").agg(F.min("id").alias("low"))
    return out.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("low").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, with one row of each group that links tie together: that with the smallest doc_id, and of several such
    rows one of them. Rows without shingles all stay; rows may have any ids, and columns may have any names."""
    key = next(c for c in (f"_row{i}" for i in range(10**6)) if c not in docs.columns)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    tied = ngram_components(rows.select(F.col(key).alias("doc_id"), rows["text"]))
    tied = tied.where("n_shingles > 0").join(rows.select(F.col(key).alias("doc_id"), rows["doc_id"].alias("id")), "doc_id")
    first = tied.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first"))
    gone = tied.join(first, "component_id").where("doc_id <> first.doc_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)
