"""Distribution reports that scale: values are grouped before anything is ordered globally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _running(g: DataFrame, value: str, cols: list[str]) -> DataFrame:
    """Running totals of the counts in value order, exclusive of the row itself, without sending all rows to one task:
    values are range-partitioned, partitions are summed, and only the partition totals meet."""
    g = g.repartitionByRange(value).withColumn("part", F.spark_partition_id()).persist()
    inner = Window.partitionBy("part").orderBy(value)
    totals = g.groupBy("part").agg(*[F.sum(c).alias(f"{c}_t") for c in cols])
    before = totals.select("part", *[F.coalesce(F.sum(f"{c}_t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_b") for c in cols])
    x = g.join(before, "part")
    return x.select(value, *cols, *[(F.sum(c).over(inner) - F.col(c) + F.col(f"{c}_b")).alias(f"{c}_before") for c in cols])


def _counts(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("v")).agg(F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area with half credit for ties."""
    x = _running(_counts(df, score, label), "v", ["n1", "n0"])
    return x.agg(F.round(F.sum(F.col("n1") * (F.col("n0_before") + F.col("n0") / 2.0)) / (F.sum("n1") * F.sum("n0")), 6).alias("auc"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Largest distance of the two distribution functions."""
    c = _counts(df, score, label)
    x = _running(c, "v", ["n1", "n0"])
    total = c.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return x.crossJoin(F.broadcast(total)).agg(F.round(F.max(F.abs((F.col("n1_before") + F.col("n1")) / F.col("t1") - (F.col("n0_before") + F.col("n0")) / F.col("t0"))), 6).alias("ks"))
