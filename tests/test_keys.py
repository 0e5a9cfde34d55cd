"""Keys of names and addresses at their edges."""

import pytest
from pyspark.sql import functions as F

from kinlink.functions import keys as K


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("text,keys", [("630 45th terrace kansas city mo", ["45|terrace", "630|terrace"]), ("12 34", []), ("", []), ("rue 0014 de", ["14|rue"]), (None, None)])
def test_anchors(spark, text, keys):
    assert one(spark, K.anchors, text) == keys


@pytest.mark.parametrize("a,b", [("classic finance", "klasik fainens"), ("lakshmi", "laxmi"), ("sree ltd", "sri")])
def test_sounds_meet(spark, a, b):
    assert one(spark, K.sounds, a) == one(spark, K.sounds, b)


def test_postal_by_country(spark):
    assert one(spark, K.postal_codes, "12 Road 110001", "India") == ["110001"]
    assert one(spark, K.postal_codes, "12 Road 110001", "US") == []
    assert one(spark, K.postal_codes, "b 61602-0001 a 11111", " us ") == ["11111", "61602-0001"]
    assert one(spark, K.postal_codes, "75001", "Japan") == []


def test_forms_units_aliases(spark):
    assert one(spark, K.legal_forms, "Martin S.A.R.L. (SAS)") == ["sarl", "sas"]
    assert one(spark, K.unit_of, "12 main st suite 4b") == "4b"
    assert one(spark, K.alias_parts, "acme dba zenith dba x") == ["acme", "zenith dba x"]
    assert one(spark, K.address_key, "no number here") == "here number"
    assert one(spark, K.folder_of, "!!")[:2] == "x_"


def test_number_prefix(spark):
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    for a, b, want in (("12", "123", 1.0), ("12", "13", 0.0), ("", "1", -1.0)):
        assert one(spark, lambda x, y: K.number_prefix(split(x), split(y)), a, b) == want
