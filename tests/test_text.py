import pytest
from pyspark.sql import functions as F

from kinlink.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first().r


def test_normalize_golden(spark):
    assert one(spark, "  CAFÉ & Co. １２ ", lambda c: T.normalize(c)) == "café and co 12"
    assert one(spark, "CAFÉ", lambda c: T.normalize(c, True)) == "cafe"
    assert one(spark, "शर्मा", lambda c: T.normalize(c, True)) == "शर्मा"
    assert one(spark, None, lambda c: T.normalize(c)) is None


def test_keys(spark):
    assert one(spark, "c the b c", T.name_key) == "b c"
    assert one(spark, "acme zenith holdings ltd x", lambda c: F.array_join(T.core_tokens(c), " ")) == "acme zenith"
    assert one(spark, "ab", lambda c: T.grams(c, 3, 3)) == [" ab", "ab "]
    assert one(spark, "a", lambda c: T.grams(c, 5, 5)) == [" a "]


def test_similarities():
    assert T.indel_ratio("abcd", "abxd") == pytest.approx(0.75)
    assert T.token_set_ratio("a b", "b a c") == 1.0
    assert T.partial_ratio("abc", "xxabcxx") == 1.0
