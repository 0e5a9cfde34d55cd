"""The corpus pipeline: each stage reads what the one before it kept, written as Parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.decontam import drop_leaks
from kinlink.llm.ngram_join import drop_near_copies
from kinlink.llm.packing import packed
from kinlink.llm.pii import redact
from kinlink.llm.queries import tokenizer_path
from kinlink.llm.toxicity import drop_toxic
from kinlink.plans.scratch import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model rejects go; null and empty texts are scored like any other, and repeated rows alike."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id; rows without words all stay, whatever their ids."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; every row is judged by its own text."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; no row goes, and n_chars follows the text (null for a null text)."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every text; a null or empty text is one piece with the closing id alone."""
    return packed(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Tokenizers and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
