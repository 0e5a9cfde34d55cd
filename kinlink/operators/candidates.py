"""Candidate lists: merging of sources, enrichment, recall, uniqueness and rival joins, LSH blocking. Every join carries its keys and no
group is collected: windows and sums run per reference or target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(sources: dict[str, DataFrame], keys: tuple[str, ...] = ("ref", "tgt")) -> DataFrame:
    """Full outer merge of candidate sources (keys, score): one column for each source, 0 where it lacks the pair, and how many have it."""
    named = [f.select(*keys, F.col("score").alias(n)) for n, f in sources.items()]
    out = reduce(lambda a, b: a.join(b, list(keys), "full"), named)
    hits = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in sources])
    return out.withColumn("hits", hits).fillna(0, subset=list(sources))


def with_found(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """gold(ref, tgt) with found: whether the pair is a candidate. Repeated candidates count once."""
    return gold.join(candidates.select("ref", "tgt").distinct().withColumn("found", F.lit(1)), ["ref", "tgt"], "left").fillna(0, subset=["found"])


def cut_sweep(ranked: DataFrame, cuts: list[int]) -> DataFrame:
    """ranked(ref, k, y) to recall, mean and largest list, and references left without a link, for each cut."""
    kept = lambda c, w: F.sum(F.when(F.col("k") <= c, w).otherwise(0))
    per_ref = ranked.groupBy("ref").agg(F.sum("y").alias("gold"), F.array(*[F.struct(F.lit(c).alias("cut"), kept(c, 1).alias("n"), kept(c, F.col("y")).alias("hit")) for c in cuts]).alias("cuts"))
    x = per_ref.select("ref", "gold", F.inline("cuts"))
    lost = F.sum(((F.col("gold") > 0) & (F.col("hit") == 0)).cast("long"))
    return x.groupBy("cut").agg(F.round(F.sum("hit") / F.sum("gold"), 6).alias("recall"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").cast("long").alias("max_n"), lost.alias("refs_lost"))


def others_best(group: str, score: str) -> Column:
    """The best score among a group's other rows, from the column _top that holds its best; null if there are none."""
    w = Window.partitionBy(group)
    ties = F.sum(F.lit(1)).over(Window.partitionBy(group, score))
    second = F.max(F.when(F.col(score) < F.col("_top"), F.col(score))).over(w)
    return F.when(F.col(score) < F.col("_top"), F.col("_top")).when(ties > 1, F.col("_top")).otherwise(second)


def rivals(claims: DataFrame) -> DataFrame:
    """claims(ref, tgt, score) with the best score of the target's other references and the margin over it."""
    x = claims.join(claims.groupBy("tgt").agg(F.max("score").alias("_top")), "tgt")
    return x.withColumn("rival", others_best("tgt", "score")).withColumn("margin", F.col("score") - F.coalesce("rival", F.lit(0.0))).drop("_top")


def minhash(grams: DataFrame, hashes: int = 24) -> DataFrame:
    """grams(id, gram) to (id, sig): for each of the seeds the least hash of a record's grams, combined before the shuffle."""
    sig = [F.min(F.md5(F.concat(F.lit(f"{s}:"), "gram"))).alias(f"h{s}") for s in range(hashes)]
    return grams.groupBy("id").agg(*sig).select("id", F.array(*[F.col(f"h{s}") for s in range(hashes)]).alias("sig"))


def bands(signatures: DataFrame, rows: int = 3, hashes: int = 24) -> DataFrame:
    """(id, band, bucket): the signature cut into bands of `rows`."""
    cut = [F.struct(F.lit(b).alias("band"), F.md5(F.array_join(F.slice("sig", b * rows + 1, rows), ",")).alias("bucket")) for b in range(hashes // rows)]
    return signatures.select("id", F.inline(F.array(*cut)))


def banded_pairs(left: DataFrame, right: DataFrame, pairs: int = 500_000) -> DataFrame:
    """Pairs that share a bucket, of the bands whose products stay within `pairs` in sum: the gate is the operator's meaning, and
    it is settled before anything is joined."""
    a, b = left.groupBy("band", "bucket").agg(F.count("*").alias("n")), right.groupBy("band", "bucket").agg(F.count("*").alias("m"))
    ok = a.join(b, ["band", "bucket"]).groupBy("band").agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).where(F.col("pairs") <= pairs).select("band")
    return left.withColumnRenamed("id", "ref").join(ok, "band", "left_semi").join(right.withColumnRenamed("id", "tgt"), ["band", "bucket"]).select("ref", "tgt").distinct()


def simhash(weights: DataFrame, tables: int = 6, bits: int = 16) -> DataFrame:
    """weights(id, term, weight) to (id, band, bucket): signs of random projections whose +1 and -1 come from a hash of table and term."""

    def bit(t: int, b: int) -> Column:
        side = F.conv(F.substring(F.md5(F.concat(F.lit(f"{t}:{b}:"), "term")), 1, 1), 16, 10).cast("int") % 2 * 2 - 1
        return F.when(F.sum(F.col("weight") * side) > 0, "1").otherwise("0")

    x = weights.groupBy("id").agg(*[F.concat(*[bit(t, b) for b in range(bits)]).alias(f"t{t}") for t in range(tables)])
    return x.select("id", F.inline(F.array(*[F.struct(F.lit(t).alias("band"), F.col(f"t{t}").alias("bucket")) for t in range(tables)])))


def poisson_binomial_f05(p: Column, picked: Column, most: int = 64) -> Column:
    """Expected F0.5 of a list's first `picked` items, from independent probabilities p (an array): the distribution of true ones among
    the picked and among the others is built item by item. Lists over `most` items raise."""

    def dist(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            stay = F.transform(F.concat(acc, F.array(F.lit(0.0))), lambda v: v * (1 - x))
            return F.zip_with(stay, F.concat(F.array(F.lit(0.0)), acc), lambda a, b: a + b * x)

        return F.aggregate(xs, F.array(F.lit(1.0)), step)

    checked = F.when(F.size(p) <= most, p).otherwise(F.raise_error(F.lit(f"a list has over {most} items")).cast("array<double>"))
    inside, outside = dist(F.slice(checked, F.lit(1), picked)), dist(F.slice(checked, picked + 1, F.greatest(F.size(p) - picked, F.lit(0))))

    def value(tp: Column, fn: Column) -> Column:
        none = (picked == 0) & (fn == 0)
        return F.when(none, 1.0).when(tp + fn == 0, 0.0).otherwise(5.0 * tp / (5.0 * tp + 4.0 * (picked - tp) + fn))

    rows = F.transform(inside, lambda a, i: F.aggregate(F.transform(outside, lambda b, j: a * b * value(i.cast("double"), j.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v)
