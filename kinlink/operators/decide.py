"""Scored candidate lists: windows, exclusivity, decisions and the F0.5 metric. Lists have columns ref, tgt, p and perhaps y."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_ref():
    return Window.partitionBy("ref")


def ranked():
    return by_ref().orderBy(F.desc("p"), "tgt")


def prefix():
    return ranked().rowsBetween(Window.unboundedPreceding, 0)


def by_tgt():
    return Window.partitionBy("tgt")


def exclusive(df: DataFrame) -> DataFrame:
    """Every target keeps its best reference (ties: the smaller one); elsewhere its probability is 0."""
    best = F.row_number().over(by_tgt().orderBy(F.desc("p"), "ref")) == 1
    return df.withColumn("p", F.when(best, F.col("p")).otherwise(F.lit(0.0)))


def threshold(df: DataFrame, t: float) -> DataFrame:
    return df.withColumn("sel", F.col("p") >= t)


def expected(df: DataFrame, floor: float) -> DataFrame:
    """The prefix with the best ratio of expectations, if it beats the empty answer and its top reaches the floor."""
    k = F.row_number().over(ranked())
    v = 1.25 * F.sum("p").over(prefix()) / (0.25 * F.sum("p").over(by_ref()) + k)
    x = df.withColumn("k", k).withColumn("v", v)
    x = x.withColumn("top", F.max("p").over(by_ref())).withColumn("none", F.exp(F.sum(F.log(1 - F.least("p", F.lit(1 - 1e-9)))).over(by_ref())))
    x = x.withColumn("best", F.max("v").over(by_ref())).withColumn("cut", F.min(F.when(F.col("v") == F.col("best"), F.col("k"))).over(by_ref()))
    return x.withColumn("sel", (F.col("best") > F.col("none")) & (F.col("top") >= floor) & (F.col("k") <= F.col("cut"))).drop("k", "v", "top", "none", "best", "cut")


def f05(df: DataFrame, cost: float = 1.0) -> DataFrame:
    """(ref, gold, links, tp, f05): an empty answer to an empty gold list is right. cost: weight of a false link."""
    g = df.groupBy("ref").agg(F.sum("y").cast("long").alias("gold"), F.sum(F.col("sel").cast("int")).cast("long").alias("links"), F.sum((F.col("sel") & (F.col("y") == 1)).cast("int")).cast("long").alias("tp"))
    wrong = F.lit(cost) * (F.col("links") - F.col("tp"))
    score = 5.0 * F.col("tp") / (5.0 * F.col("tp") + 4.0 * wrong + (F.col("gold") - F.col("tp")))
    return g.withColumn("f05", F.when(F.col("gold") == 0, F.when(F.col("links") == 0, 1.0).otherwise(0.0)).otherwise(score))


def macro_f05(df: DataFrame, cost: float = 1.0) -> DataFrame:
    return f05(df, cost).agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.sum("links").alias("links"), F.count("*").alias("refs"))


def overcommitted(df: DataFrame) -> DataFrame:
    return df.withColumn("claimed", F.sum("p").over(by_tgt()))


def normalized(df: DataFrame) -> DataFrame:
    """Probabilities of a target's references are scaled down to a sum of 1 where they exceed it. Decimals are summed, as a sum of doubles
    depends on the order of rows and then so does what lies on a threshold."""
    return df.withColumn("p", F.col("p") / F.greatest(F.lit(1.0), F.sum(F.col("p").cast("decimal(28,18)")).over(by_tgt()).cast("double")))


def prune_overcommitted(df: DataFrame, most: float = 1.2, share: float = 0.77) -> DataFrame:
    """Of selected links, those to over-claimed targets with a small share go, but a reference keeps its best link."""
    x = overcommitted(df).withColumn("best", F.row_number().over(ranked()) == 1)
    return x.where(F.col("best") | ~((F.col("claimed") > most) & (F.col("p") / F.col("claimed") < share))).drop("best")


def grid(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Macro F0.5 of each threshold rule, from one groupBy with sums for each rule."""
    hit = lambda t, w: F.sum(F.when(F.col("p") >= t, w).otherwise(0))
    sums = [F.struct(F.lit(t).alias("t"), hit(t, 1).alias("links"), hit(t, F.col("y")).alias("tp")) for t in thresholds]
    g = df.groupBy("ref").agg(F.sum("y").alias("gold"), F.array(*sums).alias("rules")).select("gold", F.inline("rules"))
    score = F.when(F.col("gold") == 0, F.when(F.col("links") == 0, 1.0).otherwise(0.0)).otherwise(5.0 * F.col("tp") / (5.0 * F.col("tp") + 4.0 * (F.col("links") - F.col("tp")) + F.col("gold") - F.col("tp")))
    return g.groupBy("t").agg(F.round(F.avg(score), 6).alias("macro_f05"))


def ceiling(df: DataFrame) -> DataFrame:
    """The best F0.5 any prefix of each list could reach."""
    k, tp = F.row_number().over(ranked()), F.sum("y").over(prefix())
    x = df.withColumn("f", 5.0 * tp / (5.0 * tp + 4.0 * (k - tp) + F.sum("y").over(by_ref()) - tp))
    return x.groupBy("ref").agg(F.when(F.sum("y") == 0, 1.0).otherwise(F.max("f")).alias("best")).agg(F.round(F.avg("best"), 6).alias("ceiling"), F.count("*").alias("refs"))


def split_bucket(key: F.Column, salt: str = "") -> F.Column:
    """Bucket 0..99 from the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256), 1, 8), 16, 10).cast("long") % 100


def rrf(routes: dict[str, DataFrame], constant: int = 60, keep: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of routes (ref, tgt, score); each route's score and rank stay, 0 where it has no candidate."""
    ranked = [df.select("ref", "tgt", F.lit(name).alias("route"), F.col("score"), F.row_number().over(by_ref().orderBy(F.desc("score"), "tgt")).alias("rank")) for name, df in routes.items()]
    union = reduce(DataFrame.unionByName, ranked)
    cols = [F.coalesce(F.max(F.when(F.col("route") == r, F.col(c))), F.lit(z)).alias(f"{c}_{r}") for r in routes for c, z in (("score", 0.0), ("rank", 0))]
    fused = union.groupBy("ref", "tgt").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), F.count("*").cast("int").alias("route_hits"), *cols)
    return fused.withColumn("fused_rank", F.row_number().over(by_ref().orderBy(F.desc(F.round("rrf", 12)), "tgt"))).where(F.col("fused_rank") <= keep)


def guarded_add(links: DataFrame, new: DataFrame) -> DataFrame:
    """Adds links whose target no one holds and only one reference claims."""
    one = new.groupBy("tgt").agg(F.countDistinct("ref").alias("claims"), F.min("ref").alias("ref")).where("claims = 1").select("ref", "tgt")
    return links.select("ref", "tgt").unionByName(one.join(links.select("tgt").distinct(), "tgt", "left_anti").select("ref", "tgt"))
