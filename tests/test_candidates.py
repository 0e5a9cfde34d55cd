"""Operators that SQL does not check: exact expectations against all outcomes, strict scans, empty and null keys."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from kinlink.functions import text as T
from kinlink.operators.blocking import bounded_join, unique_join
from kinlink.operators.candidates import poisson_binomial_f05
from kinlink.sources import tsv


def all_outcomes(p, m):
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(p)):
        weight = math.prod(x if t else 1 - x for x, t in zip(p, y))
        tp, gold = sum(y[:m]), sum(y)
        total += weight * ((1.0 if m == 0 else 0.0) if gold == 0 else 5 * tp / (5 * tp + 4 * (m - tp) + gold - tp))
    return total


def test_expected_f05_is_exact(spark):
    rows = [([0.9, 0.5, 0.2], 2), ([0.3], 0), ([0.3], 1), ([1.0, 0.0], 1), ([], 0), ([0.7, 0.7, 0.1, 0.05], 3)]
    df = spark.createDataFrame(rows, "p array<double>, m int")
    got = [r.v for r in df.select(poisson_binomial_f05(F.col("p"), F.col("m")).alias("v")).collect()]
    assert got == pytest.approx([all_outcomes(p, m) for p, m in rows])
    with pytest.raises(Exception, match="over 2 items"):
        df.select(poisson_binomial_f05(F.col("p"), F.col("m"), most=2).alias("v")).collect()


def test_strict_scan(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_bytes("﻿entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t\"Ab\t\tUS\n".encode())
    assert [tuple(r) for r in tsv.read_strict(spark, str(good)).collect()] == [("1", '"Ab', "", "US")]
    for name, text in (("short", "entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tx\tUS\n"), ("header", "id\tname\n1\tx\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            tsv.read_strict(spark, str(tmp_path / name))


def test_gold_must_name_every_reference(spark):
    gold = spark.createDataFrame([("1", "b, a,b"), ("2", ""), ("3", None)], "source1_entity_id string, matched_entity_ids string")
    refs = spark.createDataFrame([("1",), ("2",), ("3",)], "ref string")
    assert {r.ref: r.tgts for r in tsv.gold_sets(gold, refs).collect()} == {"1": ["a", "b"], "2": [], "3": []}
    with pytest.raises(ValueError):
        tsv.gold_sets(gold, spark.createDataFrame([("9",)], "ref string"))


def test_empty_and_null_keys_join_nothing(spark):
    a = spark.createDataFrame([("US", "", 1), ("US", None, 2), ("US", "k", 3), ("US", "k", 4), ("US", "u", 5)], "country string, k string, ref long")
    b = spark.createDataFrame([("US", "", 7), ("US", None, 8), ("US", "k", 9), ("US", "u", 10)], "country string, k string, tgt long")
    assert sorted((r.ref, r.tgt) for r in bounded_join(a, b, ["country", "k"]).collect()) == [(3, 9), (4, 9), (5, 10)]
    assert [(r.ref, r.tgt) for r in unique_join(a.where("k <> ''"), b, ["country", "k"]).collect()] == [(5, 10)]


def test_shift_and_jaro_winkler(spark):
    rows = [("12", "12", "same"), ("12", "123", "digit_drop"), ("12", "33", "up_21"), ("12", "34", "far"), ("33", "12", "down_small")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", T.number_shift(F.col("a"), F.col("b"))).collect())
    assert T._jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and T._jaro_winkler("", "a") == 0 and T._jaro_winkler("", "") == 1
