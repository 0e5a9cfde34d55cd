"""Tab-separated sources and sinks: strict scans, gold files, id lists, result files with manifests. All paths go through Spark, so they
may lie in any store; checks are plans that run where the data is."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("entity_id", "business_name", "business_address", "country")


def _plain(reader):
    """Nothing is quoted or escaped in these files, and an empty field is an empty text."""
    return reader.option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "\u0000").option("encoding", "UTF-8")


def read_lines(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW) -> DataFrame:
    """A TSV with a header, gzipped or not, every field as text. A mark at the beginning of the file is no part of the header."""
    return _plain(spark.read).option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path).fillna("")


def read_strict(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW) -> DataFrame:
    """As read_lines, but a header that differs, and rows with missing or additional fields, raise when the frame is read."""
    rows = spark.read.option("encoding", "UTF-8").text(path).withColumn("_fields", F.split(F.regexp_replace("value", "^﻿", ""), "\t", -1))
    header = F.array(*map(F.lit, columns))
    wrong = rows.where((F.col("_fields") != header) & (F.size("_fields") != len(columns))).limit(1)
    first = spark.read.text(path).limit(1).select(F.split(F.regexp_replace("value", "^﻿", ""), "\t", -1).alias("h")).collect()
    if first and tuple(first[0].h) != tuple(columns):
        raise ValueError(f"{path}: the header is {first[0].h}")
    bad = wrong.collect()
    if bad:
        raise ValueError(f"{path}: {len(bad[0]._fields)} fields in {bad[0].value!r}")
    return rows.where(F.col("_fields") != header).select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def write_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("emptyValue", "").option("nullValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def only(df: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows whose key is wanted, and the columns asked for."""
    return df.join(ids.select(key).distinct(), key, "left_semi").select(*columns)


def gold_pairs(gold: DataFrame, ref: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(ref, tgt) of a gold file with comma lists; references with an empty list have no row."""
    return gold.select(F.col(ref).alias("ref"), F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias("tgt")).withColumn("tgt", F.trim("tgt")).where("tgt <> ''").distinct()


def gold_sets(gold: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, tgts) for each of refs(ref), empty arrays included. A reference that the gold file lacks raises."""
    names = gold.select(F.col("source1_entity_id").alias("ref")).distinct()
    if refs.join(names, "ref", "left_anti").limit(1).count():
        raise ValueError("the gold file lacks a reference")
    sets = gold_pairs(gold).groupBy("ref").agg(F.array_sort(F.collect_set("tgt")).alias("tgts"))
    return refs.join(sets, "ref", "left").select("ref", F.coalesce("tgts", F.array().cast("array<string>")).alias("tgts"))


def owners(gold: DataFrame) -> DataFrame:
    """(tgt, owner): the reference that each target belongs to."""
    return gold_pairs(gold).groupBy("tgt").agg(F.min("ref").alias("owner"))


def expanded(rows: DataFrame, ref: str, ids: str, shards: int = 1, shard: int = 0) -> DataFrame:
    """(ref, pos, tgt): lists row by row in their order, of one shard of the references."""
    own = rows.where(F.pmod(F.xxhash64(ref), F.lit(shards)) == shard)
    return own.select(F.col(ref).alias("ref"), F.posexplode(F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "")).alias("pos", "tgt"))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n by key: the same rows at every run."""
    return df.orderBy(key).limit(n)


def result_rows(refs: DataFrame, links: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): a row for each reference with its sorted, distinct targets, or with an empty list."""
    lists = links.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set(F.col("tgt").cast("string"))), ",").alias("m"))
    return refs.join(lists, "ref", "left").select(F.col("ref").cast("string").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))


def fingerprint(df: DataFrame, *columns: str) -> str:
    """The same for equal sets of rows in any order: count and sum of 64-bit hashes."""
    x = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{x.n}:{x.s or 0}"


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_with_manifest(df: DataFrame, path: str, signature: dict) -> bool:
    """Parquet, and a manifest that is written last. Nothing is done (False) if a manifest with the same signature is there already."""
    spark = df.sparkSession
    p, fs = _store(spark, f"{path}/_manifest")
    if fs.exists(p):
        kept = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
        if kept["input"] == signature:
            return False
    df.write.mode("overwrite").parquet(f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    note = {"input": signature, "rows": back.count(), "fingerprint": fingerprint(back, *back.columns)}
    spark.createDataFrame([(json.dumps(note, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return True


def write_shards(df: DataFrame, path: str, by: str) -> list[str]:
    """One folder for each value of `by` that is not there yet; gives the values written. A folder counts only when Spark has committed it."""
    spark, done = df.sparkSession, []
    for (value,) in df.select(F.col(by).cast("string")).distinct().orderBy(by).collect():
        p, fs = _store(spark, f"{path}/{by}={value}/_SUCCESS")
        if not fs.exists(p):
            df.where(F.col(by).cast("string") == value).drop(by).write.mode("overwrite").parquet(f"{path}/{by}={value}")
            done.append(value)
    return done


def listed_features(listed: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features of the listed pairs, in whatever order the list has them; pairs without any have found = false and NaN."""
    x = listed.join(features.dropDuplicates(keys).withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return x.select(*listed.columns, *[F.when(F.col("found"), F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in features.columns if c not in keys], "found")
