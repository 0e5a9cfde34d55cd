"""Guarded blocking joins and inverted-index similarity joins, everything within a country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precheck(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right, pairs) of the keys that both sides have."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, keys).withColumn("pairs", F.col("n_left") * F.col("n_right"))


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = 200, pairs: int = 40_000) -> DataFrame:
    """Inner join on keys frequent at most `most` times on a side and with at most `pairs` products: the cap is the operator's meaning.
    Rows with a null or empty key join nothing."""
    for k in keys:
        left, right = [x.where((F.col(k).cast("string") != "") & F.col(k).isNotNull()) for x in (left, right)]
    ok = precheck(left, right, keys).where((F.col("n_left") <= most) & (F.col("n_right") <= most) & (F.col("pairs") <= pairs)).select(*keys)
    return left.join(ok, keys, "left_semi").join(right, keys).distinct()


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], ref: str = "ref") -> DataFrame:
    """right with the one ref of left that has the same key; keys that two rows of left have join nothing, and neither do null ones."""
    own = left.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(ref).alias(ref)).where("_n = 1").drop("_n")
    return own.join(right, keys)


def class_pairs(left: DataFrame, right: DataFrame, keys: list[str], n: int, most: int = 64, ways: int = 16) -> DataFrame:
    """left(keys, id, x) and right(keys, id, y): (keys, x, refs, y, tgts) of the classes of equal x and equal y under one key, whose ids stand
    for all their pairs. A class of more than `most` ids comes in blocks of about as
    many, as what two blocks expand to is held in memory, and the blocks of a key go to `ways` tasks."""

    def blocks(side, value, ids):
        parts = side.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_v")).agg(F.ceil(F.count("*") / most).alias("_parts"))
        x = side.join(parts, [*(F.col(k) == F.col(f"_{k}") for k in keys), F.col(value).eqNullSafe(F.col("_v"))])
        return x.groupBy(*keys, value, F.pmod(F.xxhash64("id"), "_parts").alias("_part")).agg(F.collect_list("id").alias(ids))

    a = blocks(left, "x", "refs").withColumn("_way", F.pmod(F.xxhash64("x", "_part"), F.lit(ways)))
    b = blocks(right, "y", "tgts").withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)).cast("array<bigint>")))
    by = [*keys, "_way"]
    return a.repartition(n, *by).join(b.repartition(n, *by), by).select(*keys, "x", "refs", "y", "tgts")


def term_weights(terms: DataFrame, docs: DataFrame, min_max_df: int = 1000, share: float = 0.005, copies: str | None = None) -> DataFrame:
    """terms(country, id, term, tf) to (country, id, term, df, idf, keep, weight): smoothed idf, L2 norm over all terms, then the
    cap. Document frequencies come back by a join on the term, so a frequent term is summed before it is shuffled. If id stands for a
    class of equal documents, the column copies has their number."""
    n = docs.groupBy("country").agg(F.count("*").alias("n"))
    df = terms.groupBy("country", "term").agg((F.sum(copies) if copies else F.count("*")).alias("df"))
    stats = df.join(n, "country").withColumn("idf", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).withColumn("keep", F.col("df") <= F.greatest(F.lit(min_max_df), F.floor(F.col("n") * share)))
    raw = terms.join(stats.select("country", "term", "df", "idf", "keep"), ["country", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("country", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["country", "id"]).withColumn("weight", F.col("w") / F.col("norm")).drop("w", "norm")


def top_terms(weights: DataFrame, k: int = 64) -> DataFrame:
    w = Window.partitionBy("country", "id").orderBy(F.desc(F.round("weight", 12)), "term")
    return weights.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= k)


def profiles(docs: DataFrame, text: str, terms) -> tuple[DataFrame, DataFrame]:
    """docs(country, id, text): members (country, cls, id), documents without a text left out, and the terms (country, cls, term, tf,
    copies) of each class of documents with equal texts. terms makes an array of terms of a text; rows of one id are one document."""
    x = docs.groupBy("country", "id").agg(F.array_sort(F.collect_list(text)).alias("texts")).where(F.size("texts") > 0)
    x = x.withColumn("cls", F.to_json("texts"))
    one = x.groupBy("country", "cls").agg(F.first("texts").alias("texts"), F.count("*").alias("copies"))
    t = one.select("country", "cls", "copies", F.explode("texts").alias("_text")).select("country", "cls", "copies", F.explode(terms(F.col("_text"))).alias("term"))
    return x.select("country", "cls", "id"), t.groupBy("country", "cls", "copies", "term").agg(F.count("*").alias("tf"))


def topk_join(queries: DataFrame, index: DataFrame, asking: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """queries and index: (country, cls, term, weight) of classes of equal documents; asking and asked: their members (country, cls, id).
    (country, ref, tgt, score, rank) of the k best by the sum of products. Documents of a class score alike, so classes meet once, and of
    the k best each comes from the k first members of its class."""
    q = queries.select("country", F.col("cls").alias("q"), "term", F.col("weight").alias("wq"))
    t = index.select("country", "cls", "term", F.col("weight").alias("wt"))
    s = q.join(t, ["country", "term"]).groupBy("country", "q", "cls").agg(F.sum(F.col("wq") * F.col("wt")).alias("score"))
    w = Window.partitionBy("country", "cls").orderBy("id")
    first = asked.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("country", "cls", F.col("id").alias("tgt"))
    w = Window.partitionBy("country", "q").orderBy(F.desc(F.round("score", 9)), "tgt")
    best = s.join(first, ["country", "cls"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("cls")
    # both sides are dealt out: members compress so well that they would be broadcast, and the few tasks of best would make all rows
    return asking.select("country", F.col("cls").alias("q"), F.col("id").alias("ref")).join(best.hint("shuffle_hash"), ["country", "q"]).select("country", "ref", "tgt", "score", "rank")


def bm25_weights(terms: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, copies: str | None = None) -> DataFrame:
    """Index-side BM25 weights, so that a query is a plain sum. k1 and b are this library's choice; copies as in term_weights."""
    n = docs.groupBy("country").agg(F.count("*").alias("n"))
    each = F.col(copies) if copies else F.lit(1)
    length = terms.groupBy("country", "id").agg(F.sum("tf").alias("len"), F.max(each).alias("_each"))
    mean = length.groupBy("country").agg((F.sum(F.col("len") * F.col("_each")) / F.sum("_each")).alias("avg_len"))
    df = terms.groupBy("country", "term").agg(F.sum(each).alias("df"))
    x = terms.join(df, ["country", "term"]).join(length.drop("_each"), ["country", "id"]).join(n, "country").join(mean, "country")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.withColumn("weight", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))))
