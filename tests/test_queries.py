"""Registered queries beside their SQL on the smallest tables. The whole catalog is run by
``python tests/oracle.py <dir> [names]``; here a cross-section keeps the suite short."""

import os

import pytest

from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
NAMES = (
    "split_by_header_pattern", "mask_codons", "majority_consensus", "informative_to_private_ratio", "entropy_summary",
    "pairwise_hamming", "distance_histogram", "poisson_lambda", "distance_sd_ustat", "remove_hypermutated",
    "nearest_founder_scores", "results_summary", "auc", "lopo_linear_predictions", "overlay_updates",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    problem, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None


def test_result_does_not_depend_on_partitioning(spark):
    import __spark_entry__ as entry

    query = entry.queries()["distance_sd_ustat"]
    few = sorted(map(tuple, query(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(tuple, query(spark, SF).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
