"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {
        "chunk_recursive",
        "html_blocks",
        "block_chunks",
        "index_default",
        "pq_search",
        "ivf_probe",
    }


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert compare(duck, oracle_sql()[name], frame) == ""
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 40
