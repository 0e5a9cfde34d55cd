"""How often a query reads and cleans its table: at a million records that is most of its time."""

import os

import duckdb
import pytest

from kinlink.plans import registry


@pytest.fixture(scope="module")
def part(tmp_path_factory):
    """Records of different names."""
    d = str(tmp_path_factory.mktemp("scans"))
    made = "select i p_partkey, md5(i::varchar) || ' bolt' p_name, 'Brand#' || i % 25 p_brand, 'A' p_type, (i % 50)::int p_size, (i * 0.1)::double p_retailprice from range(60000) r(i)"
    duckdb.connect().sql(f"copy ({made}) to '{os.path.join(d, 'part.parquet')}' (format parquet, row_group_size 100000)")
    return d


def test_one_pass_for_each_side(spark, part):
    plan = registry.queries()["rl13_swap_classes"](spark, part)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert plan.length() == 2
