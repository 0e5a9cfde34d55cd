"""Queries over part against their SQL, on a table of odd rows and on one with more copies than any cap."""

import os
import threading

import duckdb
import pytest

from kinlink.plans import registry

COLUMNS = "p_partkey::bigint p_partkey, p_name, p_brand, p_type, p_size::int p_size, (p_partkey * 0.1)::double p_retailprice"
#: 1,101 records of one country and first word: every gram is more frequent than the cap of 1,000.
MANY = "select i p_partkey, case i % 5 when 0 then 'steel bolt' when 1 then 'steel nut' else 'steel bolt m' || i % 9 end p_name, 'Brand#' || i % 25 p_brand, 'A' p_type, i % 50 p_size from range(1101) r(i)"
#: Empty, one-word and repeated words, legal words, no size, repeated ids, numbers with several digits and with leading zeros.
ODD = "select i p_partkey, (['', 'bolt', 'bolt bolt', 'bolt ltd', 'bolt & nut', 'bolt nut ltd', 'Bolt  NUT', 'bolt x.com', 'ltd', 'ltd and', 'ring old', null])[i % 12 + 1] p_name, (['Brand#7', 'Brand#07', 'Brand', 'Brand#71 4', 'x'])[i % 5 + 1] p_brand, (['A', 'B1', ''])[i // 3 % 3 + 1] p_type, case when i % 4 = 0 then null else i % 37 end p_size from (select unnest(range(240)) i union all select unnest([3, 4, 5, 12, 13, 14])) r"


@pytest.fixture(scope="module", params=[ODD, MANY], ids=["odd", "many"])
def tables(request, tmp_path_factory):
    d, c = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    c.sql(f"copy (select {COLUMNS} from ({request.param})) to '{os.path.join(d, 'part.parquet')}' (format parquet)")
    c.sql(f"create view part as select * from '{d}/part.parquet'")
    return c, d


def rows(data):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in data)


NAMES = "ix06_top_terms jn09_tfidf_topn jn10_bm25_topk jn13_reverse an47_number_difference rl13_swap_classes an46_token_lift sm12_name_relation sm06_jaccard sm08_number_prefix sm13_shift sm17_miss_reason sm07_num_jaccard sm05_jaro_winkler sm09_exact sm10_len_ratio jn31_conjunctive".split()


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, tables, name):
    c, d = tables
    df = registry.queries()[name](spark, d)
    cols = sorted(df.columns)
    got, want = rows(df.select(cols).collect()), rows(c.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall())
    assert len(got) == len(want) and got == want


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """60,000 records with eight names: 400 million pairs."""
    d = str(tmp_path_factory.mktemp("large"))
    names = "select i p_partkey, 'bolt ' || (['a1', 'b2', 'c3', 'd4', 'e5', 'f6', 'g7', 'h8'])[(hash(i) % 8 + 1)::int] p_name, 'Brand#' || i % 25 p_brand, 'A' p_type, i % 50 p_size from range(60000) r(i)"
    duckdb.connect().sql(f"copy (select {COLUMNS} from ({names})) to '{os.path.join(d, 'part.parquet')}' (format parquet)")
    return d


@pytest.mark.parametrize("name,n", [("jn10_bm25_topk", 100_000), ("an46_token_lift", 8), ("sm01_ratio", 64), ("sm02_token_sort", 64), ("sm03_token_set", 64), ("sm04_partial", 64)])
def test_large_classes(spark, large, name, n):
    """What does not return its pairs must not make them; one that does is stopped."""
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        assert registry.queries()[name](spark, large).count() == n
    finally:
        timer.cancel()


@pytest.mark.parametrize("name", ["sm01_ratio", "sm02_token_sort", "sm03_token_set", "sm04_partial", "an46_token_lift"])
def test_names_are_cleaned_after_they_are_counted(spark, large, name):
    """No record's name is cleaned by itself: above each scan records are summed first."""
    plan = registry.queries()[name](spark, large)._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("Relation ")[:-1]:
        assert "regexp_replace" in part and "regexp_replace" not in part[part.rindex("Aggregate") :].partition("\n")[2]


def test_members_meet_the_best_by_a_dealt_join(spark, large):
    """Members are not broadcast to the few tasks that hold the best of each class."""
    plan = registry.queries()["jn10_bm25_topk"](spark, large)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in next(x for x in plan.splitlines() if "Join" in x)
